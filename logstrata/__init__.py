"""logstrata: a Spark-native engine for analysing operating-system log archives."""

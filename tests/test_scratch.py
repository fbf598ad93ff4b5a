import os
from types import SimpleNamespace

import pytest

from logstrata import scratch


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: folder or other), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_shared_folder_is_that_of_the_session_or_a_local_one():
    assert scratch.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    own = scratch.shared_dir(session("local[3]"))
    assert os.path.isdir(own) and scratch.shared_dir(session("local[3]")) == own
    os.rmdir(own)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(session("spark://host:7077"))


def test_tables_are_written_and_dropped(spark):
    before = spark.conf.get(scratch._CLEANUP)
    a, b = scratch.written(spark.range(5), "a"), scratch.written(spark.range(70).groupBy("id").count(), "b")
    assert a.count() == 5 and b.count() == 70 and os.path.isdir(a._table_path) and spark.conf.get(scratch._CLEANUP) == before
    scratch.drop(a)
    assert not os.path.exists(a._table_path) and b.count() == 70
    scratch.drop_all(spark)
    assert not os.path.exists(b._table_path)


def test_a_table_is_its_data_files_alone_and_damage_is_told(spark):
    """Each further file on a local file system is a child of the JVM, or more, that shares its memory."""
    table = scratch.written(spark.range(50_000).selectExpr("id", "sha2(string(id), 256) AS text").repartition(3), "alone")
    names = os.listdir(table._table_path)
    assert len(names) == 3 and all(n.startswith("part-") for n in names)
    assert table.distinct().count() == 50_000
    file = f"{table._table_path}/{names[0]}"
    with open(file, "r+b") as f:
        f.seek(os.path.getsize(file) // 2)
        byte = f.read(1)[0]
        f.seek(-1, os.SEEK_CUR)
        f.write(bytes([byte ^ 1]))
    with pytest.raises(Exception, match="(?i)crc checksum|corrupt"):
        table.selectExpr("sum(hash(id, text))").collect()
    scratch.drop(table)

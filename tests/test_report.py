from logstrata.kb import KnowledgeBase, Match, Signature
from logstrata.operators import report


def test_text():
    assert report.grid([("a", 1), ("bb", 1200)], ("k", "n")) == "k       n\n--  -----\na       1\nbb  1,200"
    assert report.grid([], ("k",)) == "k\n-" and report.bar(0.5, 4) == "██░░" and report.duration(93_784) == "1 d 2 h" and report.duration(0) == "0 s"
    text = report.comparison({"matched": 3, "missing": 1}, [("pid", 3, 3, 100.0)], [("p", 1)])
    assert "75.00 %" in text and "100.00" in text
    text, ok = report.files([("a", "identical"), ("b", "append"), ("c", "only_b")])
    assert ok and "only_b" in text and not report.files([("a", "diverged")])[1]
    s = Signature("sig-77", "acts", "d", Match(format_str="x", process="p"), tags=("t", "u"), extract_fields=(("lab", "x"),), source_file="f.yaml")
    kb = KnowledgeBase("1", (s,), {"label": ""})
    assert "sig-77" in report.signatures(kb, tag="t") and "sig-77" not in report.signatures(kb, process="q") and '"id": "sig-77"' in report.signatures(kb, as_json=True)
    assert "did you mean 'label'" in report.kb_stats(kb) or "not in the vocabulary" in report.kb_stats(kb)
    assert 'id: "sig-77"' in report.signature(s)

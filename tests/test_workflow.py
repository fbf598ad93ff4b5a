import pytest
from test_sources import archive  # noqa: F401

from logstrata import api
from logstrata.kb import KnowledgeBase, Match, Signature
from logstrata.operators.diff import Counts
from logstrata.sources import package


def test_package_round_trip(archive, tmp_path):  # noqa: F811
    made = package.pack(str(archive), str(tmp_path / "p.zip"), {"device": "x"})
    assert package.is_package(str(tmp_path / "p.zip")) and not package.is_package(str(archive)) and package.sidecar(str(tmp_path / "p.zip")) == {"device": "x"}
    root = package.unpack(str(tmp_path / "p.zip"), str(tmp_path / "out"))
    assert package.pack(root, str(tmp_path / "q.zip")) == made and b"EndTimeRef" in package.info_plist(root)


def test_case_from_archive_to_comparison(spark, archive, tmp_path):  # noqa: F811
    (archive / "shutdown.log").write_text("After 2.0s, these clients are still here:\n\tremaining client pid: 9 (/x)\nSIGTERM: [1774602168]\n")
    made = api.run_extract(spark, str(archive), str(tmp_path / "case"))
    case = api.open_or_extract(spark, str(archive), str(tmp_path / "case"))
    assert made.rows == 22 and case.meta()["changed_files"] == 0 and case.table("shutdown_events").count() == 1 and case.table("_parsed") is None
    assert all(c.passed for c in api.verify_case(case, str(archive))) and api.verify_case(case)[-1].passed is None
    kb = KnowledgeBase("1", (Signature("hello", "greets", "d", Match(format_str="hello %s %d", message_regex="world"), extract_fields=(("who", r"hello (\w+)"),)),))
    assert api.annotate_case(case, kb) == 2 and case.logs().labels() == ["who"] and case.logs().count(api.LogFilters(signature="hello")) == 2
    assert case.meta()["phase"] == "hash again" and case.meta()["damaged_files"] == 0 and case.table("kb_signatures").first()["match"] == '{"format_str": "hello %s %d", "message_regex": "world"}'
    scanned = [r.id for r in case.logs().query(api.LogFilters(message_match="WORLD hello-world")).collect()]
    case.index_messages()
    assert case.logs().indexed and scanned == [r.id for r in case.logs().query(api.LogFilters(message_match="WORLD hello-world")).collect()] and len(scanned) == 2
    other = api.open_or_extract(spark, str(archive), str(tmp_path / "base"))
    assert api.run_identify(other, case).counts() == Counts(0, 0, 0, 0)
    assert api.clear_annotations(case) == 2 and api.annotate_case(case, kb) == 2
    ref = spark.createDataFrame([('{"eventType":"logEvent","bootUUID":"%032X","machTimestamp":1010,"threadID":-9223372036854775803,"eventMessage":"hello world 3"}' % 0xB007,), ('{"eventType":"logEvent","machTimestamp":1}',)], "value string")
    with pytest.warns(UserWarning):
        ok, outer = api.validate(ref, case)
    assert not ok and outer.filter("verdict = 'matched'").count() == 1
    with pytest.raises(FileExistsError):
        api.run_extract(spark, str(archive), str(tmp_path / "case"))


def test_acquisitions_rejects_and_seal(spark, archive, tmp_path):  # noqa: F811
    import hashlib
    import shutil

    other = tmp_path / "b.logarchive"
    shutil.copytree(archive, other)
    (other / "Persist/0000000000000001.tracev3").write_bytes((archive / "Persist/0000000000000001.tracev3").read_bytes() + b"more")
    (other / "Special/0000000000000002.tracev3").unlink()
    ok, found = api.validate_acquisition(spark, str(archive), str(other))
    kinds = {r.rel_path.split("/")[0]: r.verdict for r in found.collect() if "._" not in r.rel_path}
    assert ok and kinds["Persist"] == "append" and kinds["Special"] == "only_a" and kinds["timesync"] == "identical"
    (other / "Persist/0000000000000001.tracev3").write_bytes(b"rewritten")
    assert not api.validate_acquisition(spark, str(archive), str(other))[0]
    case = api.CaseStore.create(spark, str(tmp_path / "case"))
    rows = spark.createDataFrame([(1, 5, "m"), (None, 6, "m"), (3, 7, None)], "id long, timestamp_unix_ns long, message string")
    assert case.write_valid("logs", rows) == 2 and case.table("logs").count() == 1 and case.table("logs_rejects").count() == 2
    (tmp_path / "run.log").write_text("done")
    assert case.seal(str(tmp_path / "run.log")) == hashlib.sha256(b"done").hexdigest() == case.meta()["log_file_sha256"] and case.meta()["status"] == "running"

import random

import pytest
from pyspark.sql import functions as F

from logstrata.kb import KnowledgeBase, KnowledgeBaseError, Match, Signature, build_signature, lint_labels, load_kb, render_signature
from logstrata.operators import annotate, clock, compare, diff, export, ordering, summary
from logstrata.operators.filters import LogFilters, apply_filters, warn_unknown
from logstrata.operators.query import LogStore
from logstrata.store import CaseStore, IncompleteCaseError

B = 1_705_320_001_000_000_000
NS = 10**9


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, B, 1000, 42, 101, "Default", "Log", "Hello world", "syslogd", "com.apple.system", "syslog", "Hello %@"), (2, B + NS, 2000, 55, 102, "Error", "Log", "Location updated", "locationd", "com.apple.locationd", "loc", None),
        (3, B + 2 * NS, 3000, 42, 103, "Info", "Log", "Hello again", "syslogd", "com.apple.system", "syslog", "Hello %@"), (4, B + 3 * NS, 4000, 42, 104, "Default", "Log", "progress 100%_x done", "syslogd", "com.apple.system", "syslog", None),
    ]
    return spark.createDataFrame(rows, "id long, timestamp_unix_ns long, timestamp_mach long, pid int, tid long, log_level string, event_type string, message string, process string, subsystem string, category string, message_format_string string")


@pytest.fixture(scope="module")
def noted(spark):
    return (
        spark.createDataFrame([(1, "loc.update", "Location was updated", "high", ["location", "privacy"])], "kb_id long, signature_id string, action string, confidence string, tags array<string>"),
        spark.createDataFrame([(2, 1)], "log_id long, kb_id long"),
        spark.createDataFrame([(2, 1, "lat", "48.8"), (2, 1, "lon", "2.3"), (2, 1, "lat", "48.8")], "log_id long, kb_id long, label string, value string"),
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(small, noted):
    for want, criteria in [
        ([1, 3], {"message_prefix": "hello"}), ([], {"message_prefix": "%"}), ([4], {"message_contains": "%"}), ([4], {"message_contains": "100%_X"}), ([1], {"message_match": "hello world"}), ([], {"message_match": "hello OR world"}),
        ([1, 2, 3, 4], {"message_match": "%%% ..."}), ([2], {"time_from": "2024-01-15T12:00:02Z", "time_to": "2024-01-15T12:00:03Z"}), ([1, 3], {"format_str": "Hello %@"}), ([1, 3, 4], {"subsystem": "com.apple.system"}),
        ([2, 3], {"level": ["Error", "Info"]}), ([2], {"like": "%UPDATED"}), ([], {"process": "nobody"}), ([1, 2, 3, 4], {}), ([4], {"last": "1s"}),
    ]:
        assert ids(apply_filters(small, LogFilters(**criteria), now_ns=B + 4 * NS)) == want, criteria
    for want, criteria in [([2], {"signature": "loc.update"}), ([2], {"action": "WAS"}), ([2], {"tag": ["privacy"]}), ([], {"tag": "privacy", "signature": "other"}), ([2], {"annotated_only": True})]:
        assert ids(apply_filters(small, LogFilters(**criteria), *noted[:2])) == want
    with pytest.raises(ValueError):
        apply_filters(small, LogFilters(tag="x"))
    with pytest.raises(ValueError):
        apply_filters(small, LogFilters(last="soon"))
    with pytest.warns(UserWarning):
        assert warn_unknown(small, LogFilters(process=["syslogd", "ghost"])) == ["process: ghost"]


def test_unresolved_rows_in_time_filters(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, 9)], "id long, timestamp_unix_ns long")
    assert ids(apply_filters(df, LogFilters(time_to=9))) == [2] and ids(apply_filters(df, LogFilters(time_from=5))) == [2, 3] and ids(apply_filters(df, LogFilters())) == [1, 2, 3]


def test_folding_and_diacritics(spark):
    df = spark.createDataFrame([(1, "Café foo_bar", 1), (2, "É helloworld", 1)], "id long, message string, timestamp_unix_ns long")
    assert ids(apply_filters(df, LogFilters(message_match="cafe"))) == [1] and ids(apply_filters(df, LogFilters(message_match="FOO"))) == [1]
    assert ids(apply_filters(df, LogFilters(message_match="hello"))) == [] and ids(apply_filters(df, LogFilters(message_contains="é h"))) == []


def test_pages_context_and_rollup(small, noted):
    store = LogStore(small.withColumn("event_order", F.col("id") * 10), *noted)
    assert [r.id for r in store.fetch(1, 2).collect()] == [2, 3] and [r.id for r in store.context(3, 10, 10).collect()] == [2, 3, 4]
    r = store.query(LogFilters(annotated_only=True)).first()
    assert r.signature_ids == ["loc.update"] and r.values_by_label == {"lat": "48.8", "lon": "2.3"}
    assert store.query(limit=0).count() == 0 and store.count() == 4 and store.labels() == ["lat", "lon"] and store.annotations_for(2).count() == 1 and len(list(store.rows(limit=3))) == 3


def test_orderings(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice([None, *range(5)]), rng.randint(0, 3), rng.randint(0, 3), rng.choice(["a", "b", None, "zz"]), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tracev3_file_id long, tracev3_chunkset_file_offset long, tracev3_firehose_inner_offset long, tracev3_entry_inner_offset long, boot_uuid string, timestamp_mach long")
    boots = spark.createDataFrame([("a", 1), ("b", 0)], "boot_uuid string, rank long")
    low = lambda v: (v is not None, v)
    want = sorted(rows, key=lambda r: ({"a": 1, "b": 0}.get(r[5], 1 << 30), low(r[6]), *map(low, r[1:5]), r[0]))
    for scalable in (True, False):
        got = {r.id: r.event_order for r in ordering.event_order(df, boots, scalable=scalable).collect()}
        assert got == {r[0]: i for i, r in enumerate(want, 1)}
    got = {r.id: r.source_order for r in ordering.source_order(df).collect()}
    for f in (None, 1, 2):
        of = sorted((r for r in rows if r[1] == f), key=lambda r: (*map(low, r[2:5]), r[0]))
        assert [got[r[0]] for r in of] == list(range(1, len(of) + 1))


def test_anchor_choice_is_that_of_a_walk(spark):
    """Against a walk that stops at the first record after the target."""
    rng = random.Random(3)
    anchors, logs, want, n = [], [], {}, 0
    for boot in range(40):
        kernel = [rng.randint(0, 12) * 500 for _ in range(rng.randint(0, 6))]
        name, num = f"B{boot}", rng.choice([(1, 1), (125, 3)])
        has_boot = rng.random() < 0.8
        if has_boot:
            n += 1
            anchors.append((n, name, 0, 0, 0, 10**12, n, *num, 0, True))
        recs = []
        for k in kernel:
            n += 1
            recs.append((n, k, 10**12 + k * 7))
            anchors.append((n, name, 0, n, k, recs[-1][2], n, *num, 0, False))
        for t in (0, 499, 500, 1000, 2750, 9999):
            for base in (0, 1):
                at = None
                for r in recs:
                    if r[1] > t:
                        break
                    at = r
                if at is None and base == 0 and has_boot:
                    at = (next(a[0] for a in anchors if a[1] == name and a[-1]), 0, 10**12)
                if at is None and recs:
                    at = recs[0]
                i = len(logs)
                logs.append((i, name, t, base))
                want[i] = (at[2] + (t - at[1]) * num[0] // num[1], at[0]) if at else (0, None)
    a = spark.createDataFrame(anchors, "anchor_id long, boot_uuid string, file_id long, file_offset long, kernel_time long, wall_ns long, record long, numerator long, denominator long, boot_rank long, is_boot boolean")
    x = spark.createDataFrame(logs, "id long, boot_uuid string, timestamp_mach long, preamble_base long")
    assert {r.id: (r.timestamp_unix_ns, r.timesync_anchor_id) for r in clock.resolve_times(x, a).collect()} == want


def test_diff_and_results(spark, noted):
    kind = "id long, timestamp_unix_ns long, message string, process string"
    base = spark.createDataFrame([(1, 100, "boot", "p1")], kind)
    act = spark.createDataFrame([(1, 300, "boot", "p1"), (2, 300, "user tapped Camera", "p2"), (3, 400, "background chatter", "p2"), (4, 50, "old", "p"), (5, 0, "boot", "p1"), (6, 500, None, "p1")], kind)
    out = diff.compare_to_baseline(act, base)
    assert {r.id: (r.excluded, r.note) for r in out.collect()} == {1: (1, None), 2: (0, None), 3: (0, None), 5: (0, diff.UNRESOLVED), 6: (0, None)}
    res = diff.IdentifyResults(diff.with_signatures(out, *noted[:2]))
    assert res.counts() == diff.Counts(3, 1, 1, 0)
    res.hide("background chatter", "p2")
    assert res.counts() == diff.Counts(2, 1, 1, 1) and ids(res.rows()) == [5, 6] and ids(res.rows(known=True, hidden=True, noise=True, search="CAMERA")) == [2]
    res.unhide("background chatter", "p2")
    assert res.hidden_keys().count() == 0
    with pytest.raises(ValueError):
        diff.baseline_cutoff(base.withColumn("timestamp_unix_ns", F.lit(0)))


def test_summary(spark, small, noted, tmp_path):
    s = summary.summarise(small, *noted[:2])
    assert s.total == 4 and s.top["process"] == [("syslogd", 3), ("locationd", 1)] and sum(t for _, t, _ in s.histogram) == 4 and sum(a for *_, a in s.histogram) == 1 and s.annotated == 1
    summary.store(s, str(tmp_path / "s.json"))
    assert summary.load(str(tmp_path / "s.json")) == s and summary.load(str(tmp_path / "none")) is None and "syslogd" in summary.text(s)
    none = summary.summarise(small.withColumn("timestamp_unix_ns", F.lit(0)))
    assert none.unresolved == 4 and none.histogram == [] and none.top == {}
    assert summary.bucket_ns(40 * 86400 * NS) == 86400 * NS and summary.bucket_ns(10**20) == 604800 * NS


SIG = {"id": "wifi", "action": "a", "description": "d", "match": {"format_str": "Associated to %@ with bssid %@"}, "extract-regex": r"to (?P<ssid>\S+) with bssid (?P<bssid>[0-9a-f:]{17})", "tags": ["net"]}


def test_knowledge_base(tmp_path):
    yaml = pytest.importorskip("yaml")
    s = build_signature(SIG, "f.yaml")
    assert build_signature(yaml.safe_load(render_signature(s))[0], "f.yaml") == s
    for wrong in ({"odd": 1}, {"match": {}}, {"match": {"format_str": "x", "dynamic": True}}, {"confidence": "sure"}, {"extract-regex": "("}, {"tags": "x"}, {"id": ""}):
        with pytest.raises(KnowledgeBaseError):
            build_signature(SIG | wrong, "f.yaml")
    (tmp_path / "signatures").mkdir()
    (tmp_path / "VERSION").write_text("1.2\n")
    (tmp_path / "labels.yaml").write_text("labels: {ssid: name, bssids: mac}\n")
    (tmp_path / "signatures/x.yaml").write_text("signatures:\n" + render_signature(s))
    kb = load_kb(str(tmp_path))
    assert kb.version == "1.2" and lint_labels(kb) == [("wifi", "bssid", "bssids")] and len(kb.digest) == 64


def test_annotation(spark):
    logs = spark.createDataFrame([(1, "Associated to HomeNet with bssid aa:bb:cc:dd:ee:ff", "wifid", "Associated to %@ with bssid %@"), (2, "x", "wifid", "Associated to %@ with bssid %@"), (3, None, "p", "f"), (4, "n 42", "p", "f")], "id long, message string, process string, message_format_string string")
    number = Signature("n", "n", "n", Match(format_str_any=("f", "g"), process="p", message_regex=r"\d+"), extract_fields=(("num", r"n (\d+)"), ("all", r"n")), ios_min="15.0")
    kb = KnowledgeBase("1", (build_signature(SIG, "f"), number))
    signatures, annotations, values = annotate.annotate(logs, kb)
    assert sorted(map(tuple, annotations.collect())) == [(1, 1), (2, 1), (4, 2)]
    assert sorted((r.log_id, r.label, r.value) for r in values.collect()) == [(1, "bssid", "aa:bb:cc:dd:ee:ff"), (1, "ssid", "HomeNet"), (4, "all", "n"), (4, "num", "42")]
    assert {r.signature_id: r.match_count for r in signatures.collect()} == {"wifi": 2, "n": 1}
    assert [s.id for s in annotate.select_signatures(kb, only_tags=["net"])] == ["wifi"] and [s.id for s in annotate.select_signatures(kb, version="14.9")] == ["wifi"]
    with pytest.raises(ValueError):
        annotate.candidate(Match(dynamic=True))


def test_reference_compare(spark):
    line = '{{"eventType":"logEvent","bootUUID":"AB-CD","machTimestamp":{},"threadID":1,"eventMessage":"{}","messageType":"Default","timestamp":"2024-01-15 12:00:01.000001+0000"}}'
    lines = [line.format(m, t) for m, t in ((100, "a"), (200, "B  b"), (300, "c"), (400, "d"), (250, "r"), (600, "r"), (100, "again"))] + ['{"eventType":"timesyncEvent"}', "junk", "{broken"]
    ref = compare.read_reference(spark.createDataFrame([(x,) for x in lines], "value string"))
    own = spark.createDataFrame([("ABCD", m, 1, t, 1_705_320_001_000_001_999, i) for i, (m, t) in enumerate(((100, "a"), (200, "b B"), (300, "c"), (400, "d"), (700, "x")))], "boot_uuid string, timestamp_mach long, tid long, message string, timestamp_unix_ns long, id long")
    own = own.withColumns({c: F.lit(None).cast("string") for c in ("message_format_string", "process", "process_uuid")})
    outer = compare.full_outer(compare.match_key(ref).withColumn("id", F.lit(0)), compare.match_key(own), compare.KEY, ["message"])
    assert {r.verdict: r.n for r in outer.groupBy("verdict").agg(F.count("*").alias("n")).collect()} == {"matched": 4, "missing": 2, "extra": 1}
    s = compare.message_stats(outer.filter("verdict = 'matched'")).first()
    assert (s.message_exact, s.message_normalised, s.times_compared, s.times_equal, s.largest_delta_us) == (3, 4, 4, 4, 0)
    assert compare.most_missing(outer).first().process == "(unknown)" and [r.mach for r in compare.samples(outer, "missing").collect()] == [250, 600]


def test_files_and_custody(spark, tmp_path):
    for side, files in (("a", {"x.txt": b"1", "Persist/1.tracev3": b"ab", "s": b"abc", "d": b"q", "e e+é": b"p"}), ("b", {"x.txt": b"1", "Persist/1.tracev3": b"abc", "s": b"ab", "d": b"r", "n": b""})):
        for k, v in files.items():
            p = tmp_path / side / k
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(v)
    a, b = (compare.file_table(spark, str(tmp_path / s)) for s in "ab")
    got = {r.rel_path: r.verdict for r in compare.compare_files(a, b).collect()}
    assert got == {"x.txt": "identical", "Persist/1.tracev3": "append", "s": "shrunk", "d": "diverged", "e e+é": "only_a", "n": "only_b"}
    stored = a.select("rel_path", F.when(F.col("rel_path") != "d", F.col("sha256")).alias("sha256"))
    assert {r.rel_path: r.status for r in compare.custody(stored, b).collect()} == {"x.txt": "matched", "Persist/1.tracev3": "mismatch", "s": "mismatch", "d": "missing_hash", "e e+é": "missing_file"}
    assert compare.tree_digest(a) != compare.tree_digest(b) and compare.tree_digest(a) == compare.tree_digest(a.repartition(3))


def test_exports(small, noted, tmp_path):
    import json

    rows = LogStore(small, *noted).query()
    out = export.run_export(export.export_rows(rows, labels=["lon", "lat"]), str(tmp_path / "x.csv"))
    raw = (tmp_path / "x.csv").read_bytes()
    assert out.rows == 4 and raw.startswith(b"\xef\xbb\xbfid,") and raw.count(b"\r\n") == 5 and b"2024-01-15T12:00:02.000000000Z,48.8,2.3" in raw
    export.run_export(rows, str(tmp_path / "x.JSONL"))
    lines = [json.loads(x) for x in (tmp_path / "x.JSONL").read_text().splitlines()]
    assert [x["id"] for x in lines] == [1, 2, 3, 4] and lines[1]["extracted_values"] == {"lat": "48.8", "lon": "2.3"}
    export.run_export(rows, str(tmp_path / "x.json"), fields=False)
    assert "extracted_values" not in json.loads((tmp_path / "x.json").read_text())[0]
    with pytest.raises(ValueError):
        export.run_export(rows, str(tmp_path / "x.xml"))


def test_case_store(spark, small, tmp_path):
    case = CaseStore.create(spark, str(tmp_path / "case"), source="s")
    case.write("logs", small)
    with pytest.raises(IncompleteCaseError):
        CaseStore.open(spark, str(tmp_path / "case"))
    case.set_status("complete")
    case = CaseStore.open(spark, str(tmp_path / "case"))
    assert case.meta()["source"] == "s" and case.logs().count() == 4 and case.view().count() == 4 and spark.table("v_logs").count() == 4
    case.append("annotations", spark.createDataFrame([(1, 1)], "log_id long, kb_id long"))
    assert case.clear("annotations", "extracted_values") == 1 and case.table("annotations").count() == 0
    with pytest.raises(FileExistsError):
        CaseStore.create(spark, str(tmp_path / "case"))
    with pytest.raises(FileNotFoundError):
        CaseStore.open(spark, str(tmp_path / "none"))


def test_tokens_of_all_documents(spark, tmp_path):
    import unicodedata

    from logstrata.plans import queries

    texts = ["Plain text, twice: text", None, "", "!!", "Déjà vu à Âge Noël", "Déjà vu", "Straße über Größe", "el niño comió piñas", "日本語 テキスト", "x_y-z 3.14 ²", "á̂b", " x"]
    rows = [(i, t, [None, "en", "fr", "de", "es"][i % 5]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")

    def brute(text):
        plain = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if unicodedata.category(c) != "Mn")
        return len("".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in plain).split())

    got = {r.doc_id: r.n for r in queries.QUERIES["set_tokens"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t, _ in rows} and got[1] == 0 and got[5] == 2


def test_hidden_side_grows_with_the_table(spark, tmp_path):
    from datetime import datetime, timedelta

    from logstrata.plans import queries

    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i % 11, ["view", "error", "click"][i % 3], f"p{i}", float(i)) for i in range(1, 3001)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id for r in queries.QUERIES["jn04_hidden_anti_growing"](spark, str(tmp_path)).collect()}
    cut = max(i for i in range(1, 1500) if i % 2 == 0 and i % 50)
    shown = [i for i in range(1, 3001) if i > cut or i % 50 == 0]
    # every message is its own row's, so the baseline excludes no later row, and the hidden keys hide just the errors
    noise = [i for i in shown if i % 50 and i < 1500 and i % 2 == 0]
    assert not noise and got == {i for i in shown if i % 3 != 1}
    counts = queries.QUERIES["ag13_identify_counts_growing"](spark, str(tmp_path)).first()
    assert (counts.retained, counts.hidden) == (len(got), len(shown) - len(got)) and max(i for i in shown if i % 3 == 1) > 500


def test_search_of_a_comparison_is_literal_and_in_messages_only(spark, tmp_path):
    rows = [(1, 1, "progress 100%_x", "p", 0, None, None), (2, 2, "progress 100 xx", "100%_x", 0, None, None), (3, 3, "100%_X too", None, 1, "", ""), (4, 4, None, "p", 0, None, None)]
    found = diff.IdentifyResults(spark.createDataFrame(rows, "id long, timestamp_unix_ns long, message string, process string, excluded int, note string, signatures string"))
    assert ids(found.rows(search="100%_x")) == [1] and ids(found.rows(search="100%_x", noise=True)) == [1, 3] and ids(found.rows(search="_")) == [1]
    found.hide("progress 100 xx", "100%_x")
    assert found.export_csv(str(tmp_path / "out.csv"), noise=True) == 3
    lines = (tmp_path / "out.csv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0] == "timestamp,timestamp_unix_ns,process,message,matched_signatures,note" and len(lines) == 4


def test_default_widths():
    assert [summary.bucket_ns(s * NS, 40) // NS for s in (1, 41, 560_000, 10**9)] == [1, 2, 21_600, 604_800]


def test_registered_names_reach_the_executors(spark):
    from logstrata.functions.printf import message, register_names

    register_names("my:Kind", {"7": "seven"})
    df = spark.createDataFrame([("%{my:kind}d", ["7"]), ("%{my:kind}d", ["8"])], "t string, i array<string>").repartition(2)
    assert {r[0] for r in df.select(message(F.col("t"), F.col("i"))).collect()} == {"seven", "<decoded:my:kind:8>"}


def test_ranges_in_cells_are_those_of_a_loop(spark):
    rng = random.Random(8)
    ranges = [(k, rng.choice("ab"), lo := rng.randint(-50, 400), None if k % 17 == 0 else lo + rng.choice([0, 1, 2, 3, 7, 64, 300])) for k in range(80)]
    points = [(k, rng.choice("abc"), rng.randint(-60, 700)) for k in range(300)]
    left, right = spark.createDataFrame(points, "i long, g string, x long"), spark.createDataFrame(ranges, "r long, g string, lo long, hi long")
    for equal, closed in (([], False), ([], True), (["g"], False)):
        for how in ("left", "inner"):
            want = set()
            for i, g, x in points:
                met = {(i, r) for r, h, lo, hi in ranges if lo <= x and (hi is None or x < hi + closed) and (not equal or g == h)}
                want |= met or ({(i, None)} if how == "left" else set())
            for few in (0, 1000):
                out = clock.range_join(left, right, equal, F.col("x"), F.col("lo"), F.col("hi"), closed, how, few)
                got = [(r[0], r[3]) for r in out.collect()]
                assert len(got) == len(set(got)) and set(got) == want, (equal, closed, how, few)


def test_many_ranges_are_never_broadcast(spark):
    left, right = spark.range(2000).select("id", F.lit("g").alias("g"), (F.col("id") * 5).alias("x")), spark.range(900).select(F.lit("g").alias("g"), (F.col("id") * 9).alias("lo"), (F.col("id") * 9 + F.col("id") % 60).alias("hi"))
    for equal in ([], ["g"]):
        for how, rows in (("left", {(k, None) for k in range(2000)}), ("inner", set())):
            out = clock.range_join(left, right, equal, F.col("x"), F.col("lo"), F.col("hi"), how=how, few=0)
            met = {(k, r * 9) for k in range(2000) for r in range(max(0, k * 5 // 9 - 7), min(900, k * 5 // 9 + 1)) if r * 9 <= k * 5 < r * 9 + r % 60}
            assert {(r[0], r[4]) for r in out.collect()} == met | {x for x in rows if x[0] not in {k for k, _ in met}}
            plan = out._jdf.queryExecution().executedPlan().toString()  # the final one, after its run
            assert "Broadcast" not in plan and "SortMergeJoin" in plan, (equal, how)


def test_digests_do_not_hang_on_how_rows_are_dealt(spark):
    rows = [(k, f"v{k % 7}") for k in range(500)]
    one, two = spark.createDataFrame(rows, "k long, v string").coalesce(1), spark.createDataFrame(rows[::-1], "k long, v string").repartition(7)
    assert compare.ordered_digest(one, ["k"], 64) == compare.ordered_digest(two, ["k"], 64) != compare.ordered_digest(two.filter("k > 0"), ["k"], 64)


def test_numbers_and_running_totals(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows[::-1] + [(None, 5)], "k long, w long").repartition(5)
    got = sorted(((r.k is not None, r.k or 0), r.n, r.t) for r in ordering.running_total(ordering.numbered(df, ["k"], "n", first=1), ["k"], {"w": "t"}).collect())
    assert [n for _, n, _ in got] == list(range(1, 302)) and [t for *_, t in got] == [0] + [5 + sum(w for _, w in rows[:k]) for k in range(300)]


def test_signature_files_may_use_either_spelling():
    raw = {"id": "x", "action": "a", "description": "d", "match": {"format_str": "f"}}
    s = build_signature(raw | {"status": "draft", "extract_regex": "(?P<a>x)", "extract_fields": {"b": "y"}}, "f")
    assert (s.status, s.extract_regex, s.extract_fields, s.labels) == ("draft", "(?P<a>x)", (("b", "y"),), ["a", "b"]) and build_signature(raw, "f").status == "validated"
    assert build_signature(raw | {"extract-regex": "(?P<a>x)", "extract_regex": "(?P<z>x)"}, "f").labels == ["a"]
    with pytest.raises(KnowledgeBaseError):
        build_signature(raw | {"status": "new"}, "f")


def test_keyword_index_and_scan_agree(spark, tmp_path):
    from logstrata.operators.filters import matches_keywords
    from logstrata.operators.keywords import candidates, indexed_match, keyword_index

    texts = ["Plain LICENSE text", "lícense of a plain-text file", "license", "text plain", None, "", "Kelvin \u212aey", "key plain_text", "plain  Text!", "unlicensed plaintext", "Straße text"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, message string")
    keyword_index(df).write.partitionBy("bucket").parquet(f"{tmp_path}/k")
    index = spark.read.parquet(f"{tmp_path}/k")
    for query, want in (("license", [0, 1, 2]), ("plain-text", [1, 7, 8]), ("TEXT plain", [0, 1, 3, 7, 8]), ("key", [6, 7]), ("straße", [10]), ("nothing here", []), ("!!", list(range(11)))):
        assert ids(indexed_match(df, index, query)) == want, query
        scan = matches_keywords(F.col("message"), query)
        assert ids(df if scan is None else df.filter(scan)) == want, query
    plan = candidates(index, "license")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]

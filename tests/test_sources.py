import base64
import io
import plistlib
import struct
import tarfile
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logstrata.sources import binary, clockfiles, containers, shutdown, stringfiles, tracev3
from logstrata.sources.datasource import register
from logstrata.sources.ingest import read_archive

MAIN, DSC, LIB, BOOT = ("%032X" % n for n in (0xA1, 0xD5, 0x77, 0xB007))


def chunk(tag, body, sub=0):
    raw = struct.pack("<IIQ", tag, sub, len(body)) + body
    return raw + bytes(-len(raw) % 8)


def header():
    part = struct.pack("<II", 0x6102, 24) + bytes.fromhex(BOOT) + struct.pack("<II", 1, 0)
    return chunk(0x1000, bytes(40) + part)


def catalog_chunk(first=7, second=9):
    uuids = bytes.fromhex(MAIN) + bytes.fromhex(DSC) + bytes.fromhex(LIB)
    pool = b"com.sub\0cat\0"
    pool += bytes(-len(pool) % 8)
    process = struct.pack("<HHHHQIIIIII", 0, 0, 0, 1, first, second, 42, 501, 0, 1, 0) + struct.pack("<IIH", 0x100, 0, 2) + (0x5000).to_bytes(6, "little")
    process += struct.pack("<II", 1, 0) + struct.pack("<HHH", 3, 0, 8)
    process += bytes(-len(process) % 8)
    fixed = struct.pack("<HHHHH6sQ", len(uuids), len(uuids) + len(pool), 1, 0, 0, bytes(6), 0)
    return chunk(0x600B, fixed + uuids + pool + process)


def entry(kind, flags, location, body, log_type=0, tid=5, delta=10):
    raw = struct.pack("<BBHIQIHH", kind, log_type, flags, location, tid, delta, 0, len(body)) + body
    return raw + bytes(-len(raw) % 8)


def packed_items(*values):
    head, pool = b"", b""
    for v in values:
        if isinstance(v, int):
            head += struct.pack("<BBi", 0, 4, v)
        else:
            s = v.encode() + b"\0"
            head += struct.pack("<BBHH", 0x22, 4, len(pool), len(s))
            pool += s
    return struct.pack("<BB", 0, len(values)) + head + pool


def firehose_chunk(*entries, base=1000, first=7, second=9, private_at=0x1000, private=b""):
    public = b"".join(entries)
    return chunk(0x6001, struct.pack("<QIBBHHHHHQ", first, second, 0, 0, 0, len(public) + 16, private_at, 0, 0, base) + public + private)


def chunkset(content, packed=True):
    if packed:
        block = pa.compress(content, codec="lz4_raw", asbytes=True)
        return chunk(0x600D, b"bv41" + struct.pack("<II", len(content), len(block)) + block + b"bv4$")
    return chunk(0x600D, b"bv4-" + struct.pack("<I", len(content)) + content + b"bv4$")


def oversize_chunk(ref, *values, first=7, second=9):
    data = packed_items(*values)
    return chunk(0x6002, struct.pack("<QI4sQIHH", first, second, bytes(4), 0, ref, len(data), 0) + data)


def log_file(words=("big", "one"), base=1000):
    subsystem = struct.pack("<H", 3)
    content = firehose_chunk(
        entry(4, 0x2 | 0x200, 0x10, struct.pack("<I", 1) + subsystem + packed_items("world", 3), log_type=0x10, tid=2**63 + 5),
        entry(4, 0x4, 0x105, struct.pack("<I", 1) + packed_items("s"), delta=20),
        entry(4, 0xA, 0x1, struct.pack("<I", 1) + bytes.fromhex(LIB) + packed_items()),
        entry(4, 0x8, 0x1, struct.pack("<I", 0x5050) + struct.pack("<H", 0) + packed_items()),
        entry(4, 0x2, 0x80000000, struct.pack("<I", 1) + packed_items("dynamic %s")),
        entry(4, 0x2 | 0x800, 0x10, struct.pack("<I", 1) + struct.pack("<I", 77) + packed_items()),
        entry(7, 0, 0, struct.pack("<QQQ", 1, 2, 3)),
        entry(2, 0x2 | 0x1, 0x10, struct.pack("<II", 11, 0) + struct.pack("<II", 22, 0) + struct.pack("<I", 1) + packed_items("act", 1)),
        entry(3, 0, 0, struct.pack("<I", 1) + b"\x07\x00" + bytes([2]) + bytes([1])),
        base=base,
    )
    dump = struct.pack("<QIIQQ16sII", 7, 9, 0, base + 5, 4, bytes.fromhex(LIB), 1, 0)
    plist = plistlib.dumps({"k": 1, "b": b"x"}, fmt=plistlib.FMT_BINARY)
    dump = struct.pack("<QIIQQ16sII", 7, 9, 0, base + 5, 4, bytes.fromhex(LIB), 1, len(plist)) + b"t".ljust(64, b"\0") + b"u".ljust(64, b"\0") + b"title".ljust(64, b"\0") + plist
    simple = struct.pack("<QIIQQQIHH16s16sIII", 7, 9, 0, base + 6, 8, 0, 0, 0, 0, bytes.fromhex(LIB), bytes(16), 0, 4, 3)[:-4]
    simple = struct.pack("<QIIQQQIHH16s16sII", 7, 9, 0, base + 6, 8, 0, 0, 0, 0, bytes.fromhex(LIB), bytes(16), 4, 3) + b"sub\0" + b"hi\0"
    more = oversize_chunk(77, "old", "er") + oversize_chunk(77, *words) + chunk(0x6003, dump) + chunk(0x6004, simple)
    return header() + catalog_chunk() + chunkset(content) + chunkset(more, packed=False)


def uuidtext_file(first, strings, path):
    pool = b"".join(s.encode() + b"\0" for s in strings)
    return struct.pack("<IIII", 0x66778899, 2, 1, 1) + struct.pack("<II", first, len(pool)) + pool + path.encode() + b"\0"


def shared_file():
    head, strings, path = 16 + 24 + 32, b"xxxxxshared %s\0", b"/lib/shared.dylib\0"
    return b"hcsd" + struct.pack("<HHII", 2, 0, 1, 1) + struct.pack("<QIIQ", 0x100, head, len(strings), 0) + struct.pack("<QI16sI", 0, 0, bytes.fromhex(LIB), head + len(strings)) + strings + path


def timesync_file():
    boot = struct.pack("<HHI16sIIqII", 0xBBB0, 48, 0, bytes.fromhex(BOOT), 125, 3, 10**18, 0, 0)
    return boot + struct.pack("<IIQqII", 0x207354, 0, 900, 10**18 + 5000, 0, 0) + struct.pack("<IIQqII", 0x207354, 0, 5000, 10**18 + 900_000, 0, 0)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("x") / "a.logarchive"
    files = {
        "Persist/0000000000000001.tracev3": log_file(), "Special/0000000000000002.tracev3": log_file(("last", "wins"), base=6000), "Persist/._0000000000000001.tracev3": b"junk", "timesync/00.timesync": timesync_file(),
        f"{MAIN[:2]}/{MAIN[2:]}": uuidtext_file(0x10, ["hello %s %d"], "/usr/bin/tool"), f"{LIB[:2]}/{LIB[2:]}": uuidtext_file(0, ["", "from lib"], "/lib/own.dylib"), f"dsc/{DSC}": shared_file(),
    }
    for k, v in files.items():
        (root / k).parent.mkdir(parents=True, exist_ok=True)
        (root / k).write_bytes(v)
    return root


def test_archive_end_to_end(spark, archive):
    out = read_archive(spark, str(archive))
    rows = [r.asDict() for r in out["logs"].orderBy("id").collect()]
    assert len(rows) == 22 and [r["id"] for r in rows] == sorted(r["id"] for r in rows)
    one = rows[:9] + [r for r in rows[9:11]]
    assert [r["message"] for r in one] == ["hello world 3", "shared s", "from lib", "from lib", "dynamic dynamic %s", "hello last wins", "<loss: 3 messages dropped [1–2]>", "hello act 1", "7", 'title: {"b": "eA==", "k": 1}', "hi"]
    first = one[0]
    assert (first["process"], first["pid"], first["euid"], first["log_level"], first["subsystem"], first["category"], first["boot_uuid"]) == ("tool", 42, 501, "Error", "com.sub", "cat", BOOT)
    assert first["tid"] == 5 - 2**63 and first["timestamp_mach"] == 1010 and first["timestamp_unix_ns"] == 10**18 + 5000 + (1010 - 900) * 125 // 3
    assert (one[1]["library"], one[1]["library_uuid"], one[1]["process"]) == ("/lib/shared.dylib", DSC, "tool")
    assert (one[2]["library"], one[2]["process"], one[2]["process_uuid"]) == ("/lib/own.dylib", "own.dylib", None) and (one[3]["library_uuid"], one[3]["process"]) == (LIB, "tool")
    assert (one[4]["process"], one[4]["library"], one[4]["library_uuid"], one[4]["process_uuid"]) == (None,) * 4
    assert (one[7]["activity_id"], one[7]["parent_activity_id"], one[7]["event_type"]) == (11, 22, "Activity") and one[0]["activity_id"] == 0
    assert [r["event_type"] for r in one[-2:]] == ["Statedump", "Simpledump"] and one[-1]["subsystem"] == "sub"
    assert sorted(r["event_order"] for r in rows) == list(range(1, 23)) and sorted(r["source_order"] for r in rows[:11]) == list(range(1, 12))
    by_time = sorted(rows, key=lambda r: r["event_order"])
    assert [r["timestamp_mach"] for r in by_time] == sorted(r["timestamp_mach"] for r in rows)
    assert out["source_files"].count() == 6 and out["boots"].collect()[0].rank == 0
    files = {r.file_id: r for r in out["source_files"].collect()}
    named = lambda k: files[k].rel_path.rsplit("/", 1)[-1] if k else None
    assert [named(r["format_src_file_id"]) for r in one] == [MAIN[2:], DSC, LIB[2:], LIB[2:], None, MAIN[2:], None, MAIN[2:], None, None, None]
    assert {named(r["timesync_file_id"]) for r in rows} == {"00.timesync"} and first["raw_data"] is None
    assert [files[k].entries for k in sorted(files) if files[k].kind == "log"] == [11, 11] and [r["id"] for r in rows] == list(range(1, 23))


def test_raw_items_and_damage(spark, archive, tmp_path):
    import json

    root = tmp_path / "b.logarchive"
    (root / "Persist").mkdir(parents=True)
    (root / "timesync").mkdir()
    (root / "timesync/00.timesync").write_bytes(timesync_file())
    (root / "Persist/1.tracev3").write_bytes(log_file()[:-40])
    (root / "Persist/2.tracev3").write_bytes(header() + catalog_chunk() + chunk(0x600D, b"nope" + bytes(8)))
    out = read_archive(spark, str(root), keep_raw=True)
    first = out["logs"].orderBy("id").first()
    assert [x["value"] for x in json.loads(first.raw_data)] == ["world", "3"]
    assert {r.rel_path[-9:]: (r.entries, r.damage) for r in out["source_files"].filter("kind = 'log'").collect()}["2.tracev3"] == (0, ["1 chunksets"])


def test_data_source(spark, archive):
    register(spark)
    df = spark.read.format("logstrata").load(str(archive))
    assert df.count() == 22 and df.filter(F.col("kind") == 7).count() == 2


def test_damage_is_counted_and_skipped():
    good, stats = log_file(), Counter()
    bad = header() + catalog_chunk() + chunk(0x600D, b"nope" + bytes(8)) + chunk(0x600D, b"bv41" + struct.pack("<II", 10**6, 4) + bytes(4)) + chunkset(chunk(0x6001, b"\1")) + good[len(header()) :]
    rows = list(tracev3.records(bad, stats))
    assert len([r for r in rows if r[0] == "entry"]) == 11 and stats == Counter({"chunksets": 2, "parts": 1})
    assert len(list(tracev3.records(good[:-40]))) < len(list(tracev3.records(good))) and list(tracev3.records(b"")) == [] and list(tracev3.records(bytes(100))) == []


def test_private_items():
    body = struct.pack("<HH", 0x2000, 9) + struct.pack("<I", 1) + struct.pack("<BB", 0, 2) + struct.pack("<BBHH", 0x21, 4, 0, 7) + struct.pack("<BBHH", 0x1, 4, 0, 2)
    raw = firehose_chunk(entry(4, 0x2 | 0x100, 0x10, body), private_at=0x2000, private=b"secret\0" + struct.pack("<h", -5))
    ((_, e),) = list(tracev3.firehose(next(tracev3.chunks(raw))[2]))
    assert [i.value for i in e["items"]] == ["secret", "-5"]
    raw = firehose_chunk(entry(4, 0x2, 0x10, struct.pack("<I", 1) + struct.pack("<BB", 0, 3) + struct.pack("<BBHH", 0x21, 4, 0, 7) + struct.pack("<BBHH", 0x42, 4, 0, 0) + struct.pack("<BBHH", 0x32, 4, 0, 2) + b"\xff\x00"))
    ((_, e),) = list(tracev3.firehose(next(tracev3.chunks(raw))[2]))
    assert [i.value for i in e["items"]] == ["<private>", "(null)", base64.b64encode(b"\xff\x00").decode()]


def test_small_readers():
    assert [a[2:4] for a in clockfiles.anchors(timesync_file())] == [(0, 10**18), (900, 10**18 + 5000), (5000, 10**18 + 900_000)]
    assert list(clockfiles.anchors(timesync_file()[:50])) == list(clockfiles.anchors(timesync_file()))[:1] and list(clockfiles.anchors(b"xx" * 40)) == []
    assert [r[1:3] for r in stringfiles.uuidtext("U", uuidtext_file(5, ["ab", "c"], "/p"))] == [(-1, -1), (5, 8), (8, 10)] and list(stringfiles.uuidtext("U", b"short")) == []
    c = binary.Cursor(b"\x01\x00\x02")
    assert c.take("H") == 1 and c.maybe("I") == 0 and len(c) == 1
    with pytest.raises(binary.Truncated):
        c.raw(2)


def test_shutdown_log(spark):
    lines = ["After 1.31s, these clients are still here:", "\t\tremaining client pid: 1 (/sbin/locationd)", "\t\tremaining client pid: 2 (/b)", "After 2.62s, these clients are still here:", "\t\tremaining client pid: 1 (/sbin/locationd)", "\t\tremaining client pid: 3 (/c)", "SIGTERM: [1774602168] done",
             "After 1.0s, these clients are still here:", "\t\tremaining client pid: 99 (/d)", "SIGTERM: [1779303547]", "\t\tremaining client pid: 5 (/open)"]
    events, clients = shutdown.parse_shutdown_log(spark.createDataFrame(list(enumerate(lines)), "n long, value string"))
    assert [(r.unix_s, r.delay_seconds, r.client_count) for r in events.orderBy("event").collect()] == [(1774602168, 2.62, 3), (1779303547, 1.0, 1)]
    assert {(r.pid, r.lingered_seconds) for r in clients.collect()} == {(1, 2.62), (2, 1.31), (3, 2.62), (99, 1.0)}


def test_containers(archive, tmp_path):
    assert containers.detect(str(archive)) == "logarchive" and containers.prepare(str(archive), str(tmp_path / "w0")).root == str(archive)
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as t:
        t.add(archive, "sys/system_logs.logarchive")
        info = tarfile.TarInfo("sys/other.txt")
        t.addfile(info, io.BytesIO(b""))
        version = plistlib.dumps({"ProductVersion": "17.5.1"})
        info = tarfile.TarInfo("sys/logs/SystemVersion/SystemVersion.plist")
        info.size = len(version)
        t.addfile(info, io.BytesIO(version))
    got = containers.prepare(str(tmp_path / "s.tar.gz"), str(tmp_path / "w1"))
    assert got.product_version == "17.5.1" and containers.product_version(b"x") is None and containers.archive_facts(got.root) == {}
    assert got.kind == "sysdiagnose" and (tmp_path / "w1/Persist/0000000000000001.tracev3").is_file() and not (tmp_path / "w1/other.txt").exists()
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.write(archive / "Persist/0000000000000001.tracev3", "private/var/db/diagnostics/Persist/1.tracev3")
        z.writestr("private/var/db/uuidtext/00/AA", b"x")
        z.writestr("elsewhere/diagnostics/Persist/2.tracev3", b"x")
    containers.prepare(str(tmp_path / "f.zip"), str(tmp_path / "w2"))
    assert (tmp_path / "w2/Persist/1.tracev3").is_file() and (tmp_path / "w2/00/AA").is_file() and not (tmp_path / "w2/Persist/2.tracev3").exists()
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("diagnostics/../../evil.tracev3", b"x")
    with pytest.raises(containers.SourceError):
        containers.prepare(str(tmp_path / "bad.zip"), str(tmp_path / "w3"))
    assert not (tmp_path / "w3").exists()
    with pytest.raises(containers.SourceError):
        containers.prepare(str(tmp_path / "f.zip"), str(tmp_path / "w2"))
    with pytest.raises(containers.SourceError):
        containers.detect(str(tmp_path / "w2/00/AA"))


def test_live_folder(spark, tmp_path):
    from logstrata.streaming import live

    (tmp_path / "in").mkdir()
    line = '{"eventType":"logEvent","bootUUID":"B","machTimestamp":%d,"threadID":1,"eventMessage":"m","messageType":"%s","timestamp":"2024-01-15 12:00:%02d+0000"}\n'
    (tmp_path / "in/a.ndjson").write_text(line % (1, "Error", 1) + line % (1, "Error", 1) + line % (2, "Info", 30) + "junk\n")
    logs = live.read_stream(spark, str(tmp_path / "in"))
    for df, name, mode in ((live.without_repeats(logs), "one", "append"), (live.rolling_histogram(logs), "two", "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("one").count() == 2 and {(r.log_level, r.n) for r in spark.table("two").collect()} == {("Error", 2), ("Info", 1)}

"""String tables: what offsets in log entries mean."""

from __future__ import annotations

from collections.abc import Iterator

from .binary import Cursor, Truncated, text, uuid

# Signatures of the two kinds of string file.
UUIDTEXT, SHARED = 0x66778899, b"hcsd"


def _strings(pool: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, bytes with the NUL) of the NUL-terminated strings in a pool."""
    at = 0
    while at < len(pool):
        end = pool.find(b"\0", at)
        end = len(pool) if end < 0 else end + 1
        yield at, pool[at:end]
        at = end


def uuidtext(name_uuid: str, data: bytes) -> Iterator[tuple]:
    """(uuid, low, high, ordinal, string, path): half-open ranges of offsets, one for each string, in declared order."""
    try:
        c = Cursor(data)
        signature, _, _, n = c.take("IIII")
        if signature != UUIDTEXT:
            return
        ranges = [c.take("II") for _ in range(n)]
        start = c.at
        path = text(data[start + sum(size for _, size in ranges) :])
        yield name_uuid, -1, -1, -1, b"", path
        for ordinal, (first, size) in enumerate(ranges):
            for at, s in _strings(data[start : start + size]):
                yield name_uuid, first + at, first + at + len(s), ordinal, s, path
            start += size
    except Truncated:
        return


def shared_cache(name_uuid: str, data: bytes) -> Iterator[tuple]:
    """As ``uuidtext`` for a shared string file, each range with the library that it belongs to: adds library uuid and path."""
    try:
        c = Cursor(data)
        magic, major, _, n_ranges, n_uuids = c.take("4sHHII")
        if magic != SHARED:
            return
        ranges = [c.take("QIIQ") if major >= 2 else (lambda r: (r[1], r[2], r[3], r[0]))(c.take("IIII")) for _ in range(n_ranges)]
        images = [c.take("QI16sI" if major >= 2 else "II16sI") for _ in range(n_uuids)]
        for ordinal, (offset, place, size, image) in enumerate(ranges):
            library, path = ("", "")
            if image < len(images):
                _, _, raw, at = images[image]
                library, path = uuid(raw), text(data[at:])
            for k, s in _strings(data[place : place + size]):
                yield name_uuid, offset + k, offset + k + len(s), ordinal, s, path, library
    except Truncated:
        return

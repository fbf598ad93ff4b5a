"""Clock files: a boot record, then records that tie ticks to wall-clock time."""

from __future__ import annotations

from collections.abc import Iterator

from .binary import Cursor, Truncated, uuid

# Signatures of a boot and of a record.
BOOT, RECORD = 0xBBB0, 0x207354


def anchors(data: bytes) -> Iterator[tuple]:
    """(boot_uuid, file_offset, kernel_time, wall_ns, numerator, denominator, is_boot) in file order. Stops at what it can't read."""
    c, boot = Cursor(data), None
    try:
        while len(c) >= 32:
            at = c.at
            if Cursor(data, at).take("H") == BOOT:
                _, size, _, raw, num, den, wall, _, _ = c.take("HHI16sIIqII")
                c.at = at + max(size, 48)
                boot = (uuid(raw), num, den)
                yield boot[0], at, 0, wall, num, den, True
            elif Cursor(data, at).take("I") == RECORD and boot:
                _, _, kernel, wall, _, _ = c.take("IIQqII")
                yield boot[0], at, kernel, wall, boot[1], boot[2], False
            else:
                return
    except Truncated:
        return

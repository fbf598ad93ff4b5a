"""Reading little-endian records."""

from __future__ import annotations

import struct
from functools import lru_cache


@lru_cache(maxsize=512)
def _struct(layout: str) -> struct.Struct:
    return struct.Struct("<" + layout)


class Truncated(ValueError):
    pass


class Cursor:
    """A place in bytes that moves on with each read."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else min(end, len(data))

    def __len__(self) -> int:
        return max(0, self.end - self.at)

    def take(self, layout: str):
        """The fields of a struct layout: a tuple, or the one value."""
        s = _struct(layout)
        if len(self) < s.size:
            raise Truncated(f"{s.size} bytes wanted at {self.at}, {len(self)} left")
        out = s.unpack_from(self.data, self.at)
        self.at += s.size
        return out[0] if len(out) == 1 else out

    def maybe(self, layout: str, wanted: bool = True, default=0):
        """As ``take`` if wanted and there; else the default, and nothing moves."""
        return self.take(layout) if wanted and len(self) >= _struct(layout).size else default

    def raw(self, n: int) -> bytes:
        if n < 0 or len(self) < n:
            raise Truncated(f"{n} bytes wanted at {self.at}, {len(self)} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        self.at = min(self.end, self.at + n)

    def align(self, n: int, base: int = 0) -> None:
        self.skip(-(self.at - base) % n)

    def rest(self) -> bytes:
        return self.data[self.at : self.end]


def uuid(raw: bytes) -> str:
    return raw.hex().upper()


def text(raw: bytes) -> str:
    """Up to the first NUL, as UTF-8."""
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")

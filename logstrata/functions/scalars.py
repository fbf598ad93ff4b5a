"""Scalar functions as column expressions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(s: Column) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(s, _UPPER, _LOWER)


def floor_div(x: Column, d: int) -> Column:
    """Integer division that rounds down, also below zero."""
    return ((x - F.pmod(x, F.lit(d))) / F.lit(d)).cast("long") if d == 1 else F.call_function("div", x - F.pmod(x, F.lit(d)), F.lit(d))


def iso_ns(ns: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.nnnnnnnnnZ`` of nanoseconds since the epoch, exact in all nine digits."""
    seconds = F.timestamp_seconds(F.floor(floor_div(ns, NS)))
    return F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(NS)).cast("string"), 9, "0"), F.lit("Z"))


def iso_or_empty(ns: Column) -> Column:
    """As ``iso_ns``; the sentinel 0 (no wall-clock time is known) and null give an empty string."""
    return F.when((ns == 0) | ns.isNull(), F.lit("")).otherwise(iso_ns(ns))


def format_timestamp(ns: Column, mode: str = "utc") -> Column:
    """``raw`` nanoseconds, ``local`` time of the session's zone, or UTC for any other mode."""
    if mode == "raw":
        return ns.cast("string")
    if mode == "local":
        seconds = F.timestamp_seconds(floor_div(ns, NS))
        return F.concat(F.date_format(seconds, "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(NS)).cast("string"), 9, "0"))
    return iso_or_empty(ns)


def ticks_to_ns(ticks: Column, numerator: Column, denominator: Column) -> Column:
    """floor(ticks * numerator / denominator) without overflow; only a 125/3 time base counts, any other is 1/1."""
    arm = (numerator == 125) & (denominator == 3)
    wide = ticks.cast("decimal(20,0)") * F.lit(125).cast("decimal(3,0)")
    return F.when(arm, F.floor(wide / F.lit(3).cast("decimal(1,0)")).cast("long")).otherwise(ticks)


def apple_timestamp_us(s: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without fraction and offset; null where it is none."""
    forms = ("yyyy-MM-dd HH:mm:ss.SSSSSSZ", "yyyy-MM-dd HH:mm:ssZ", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss")
    text = F.regexp_replace(F.trim(s), "T", " ")
    return F.unix_micros(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]))


def int_or_zero(s: Column) -> Column:
    return F.coalesce(F.trim(s.cast("string")).try_cast("bigint"), F.lit(0).cast("long"))


def plain_uuid(s: Column) -> Column:
    return F.upper(F.replace(s, F.lit("-"), F.lit("")))


def dashed_uuid(s: Column) -> Column:
    """8-4-4-4-12 of 32 hexadecimal digits; anything else stays as it is."""
    u = plain_uuid(s)
    return F.when(F.length(u) == 32, F.regexp_replace(u, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(s)


def plain_message(s: Column) -> Column:
    """Lower case, white space of any kind as single spaces, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"(?U)\s+", " "))


def process_label(path: Column, uuid: Column) -> Column:
    return F.coalesce(F.nullif(path, F.lit("")), F.concat(F.lit("uuid:"), F.nullif(uuid, F.lit(""))), F.lit("(unknown)"))


def truncated(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def process_name(image: Column, library: Column, uuid: Column) -> Column:
    """The image's file name, else the library's, else the uuid, else empty."""
    none = F.lit("")
    return F.coalesce(F.nullif(basename(image), none), F.nullif(basename(library), none), F.nullif(uuid, none), none)


def loss_message(count: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("<loss: "), count.cast("string"), F.lit(" messages dropped ["), start.cast("string"), F.lit("–"), end.cast("string"), F.lit("]>"))


def signed64(hexadecimal: Column) -> Column:
    """Two's complement of an unsigned 64-bit value in hexadecimal."""
    return F.conv(hexadecimal, 16, -10).cast("long")


def content_digest(content: Column) -> Column:
    """SHA-256 of a file's content (or a text's UTF-8 bytes), lower-case hexadecimal; of none, that of nothing."""
    return F.sha2(F.coalesce(content.cast("binary"), F.lit("").cast("binary")), 256)


def filename_token(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_-]", "_")


def version_in_range(version: Column, least: str | None, most: str | None) -> Column:
    """Whether a dotted version lies between the bounds, compared number by number. A version or bound that is none constrains nothing."""

    def numbers(v: Column) -> Column:
        return F.transform(F.split(v, r"\."), lambda x: x.cast("int"))

    known = version.rlike(r"^[0-9]+(\.[0-9]+)*$")
    ok = F.lit(True)
    for bound, above in ((least, True), (most, False)):
        if bound and all(p.isdigit() for p in bound.split(".")):
            b = F.array(*[F.lit(int(p)) for p in bound.split(".")])
            ok = ok & (numbers(version) >= b if above else numbers(version) <= b)
    return F.when(known, ok).otherwise(F.lit(True))


def level_name(code: Column) -> Column:
    from ..schemas import LEVEL_OF_TYPE

    table = F.create_map(*[F.lit(x) for kv in LEVEL_OF_TYPE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("Default"))


def event_name(code: Column) -> Column:
    from ..schemas import EVENT_OF_ACTIVITY

    table = F.create_map(*[F.lit(x) for kv in EVENT_OF_ACTIVITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("Log"))


#: Build numbers of public releases.
IOS_BUILDS = {
    "21A329": "17.0", "21A340": "17.0.1", "21A351": "17.0.2", "21A360": "17.0.3", "21B74": "17.1", "21B91": "17.1.1", "21B101": "17.1.2", "21C62": "17.2", "21C66": "17.2.1", "21D50": "17.3", "21D61": "17.3.1", "21E219": "17.4", "21E236": "17.4.1",
    "21F79": "17.5", "21F90": "17.5.1",
}


def ios_version(build: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in IOS_BUILDS.items() for x in kv]), F.upper(F.trim(build)))


def redact(s: Column, literals: list[str]) -> Column:
    """Known identifiers become a short digest, where they stand between non-identifier characters; home folders lose their user."""
    import hashlib
    import re

    out = F.regexp_replace(s, r"(/(?:Users|home)/)[^/\s]+", "$1<user>")
    out = F.regexp_replace(out, r"([A-Za-z]:\\Users\\)[^\\\s]+", "$1<user>")
    for literal in sorted({x for x in literals if x}, key=len, reverse=True):
        mark = "<redacted:" + hashlib.sha256(literal.encode()).hexdigest()[:8] + ">"
        out = F.regexp_replace(out, r"(?<![A-Za-z0-9_])" + re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", literal) + r"(?![A-Za-z0-9_])", mark)
    return out

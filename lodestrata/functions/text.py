"""Scalar functions on strings, sizes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tenths(n: Column, limit: int) -> Column:
    """n / limit to one decimal, half up, in whole numbers."""
    t = F.floor((n.cast("long") * 10 + limit // 2) / limit)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"))


def format_bytes(n: Column) -> Column:
    """1536 -> 1.5 KB."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for limit, unit in ((1 << 10, "KB"), (1 << 20, "MB"), (1 << 30, "GB")):
        out = F.when(n >= limit, F.concat(_tenths(n, limit), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_number(n: Column) -> Column:
    """12345 -> 12.3K."""
    out = n.cast("string")
    for limit, unit in ((1_000, "K"), (1_000_000, "M")):
        out = F.when(n >= limit, F.concat(_tenths(n, limit), F.lit(unit))).otherwise(out)
    return out


def format_age(seconds: Column) -> Column:
    """Seconds as s, m, h or d, rounded down."""
    out = F.concat(seconds.cast("long").cast("string"), F.lit("s"))
    for limit, unit in ((60, "m"), (3600, "h"), (86400, "d")):
        out = F.when(seconds >= limit, F.concat(F.floor(seconds / limit).cast("string"), F.lit(unit))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """0.0005 -> 500μs, 0.0123 -> 12.3ms, 2.5 -> 2.50s."""
    ms = seconds * 1000
    return F.when(ms < 1, F.format_string("%.0fμs", seconds * 1e6)).when(ms < 1000, F.format_string("%.1fms", ms)).otherwise(F.format_string("%.2fs", seconds.cast("double")))


def truncate_bytes(s: Column, most: int) -> Column:
    """At most so many bytes of UTF-8: a longer string is cut at a character and ends with three dots."""
    raw, end = s.cast("binary"), max(0, most - 3)
    # a byte of 80 to BF goes on with the character before it
    goes_on = lambda i: F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("int").between(128, 191)
    cut = F.lit(end)
    for back in (3, 2, 1, 0):
        if end - back >= 0:
            cut = F.when(~goes_on(end - back), F.lit(end - back)).otherwise(cut)
    return F.when(F.octet_length(s) > most, F.concat(F.substring(raw, F.lit(1), cut).cast("string"), F.lit("..."))).otherwise(s)


def parse_size(s: Column) -> Column:
    """`5GB`, `10 MB`, `1k` or a plain number to bytes; null for anything else."""
    num = F.regexp_extract(s, r"^\s*([0-9]+)\s*([KMGkmg]?)[Bb]?\s*$", 1)
    unit = F.upper(F.regexp_extract(s, r"^\s*([0-9]+)\s*([KMGkmg]?)[Bb]?\s*$", 2))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1)
    return F.when(num != "", num.cast("long") * factor)


def elide_path(p: Column) -> Column:
    """More than three segments: the first, `...`, and the last two; for paths over 60 bytes."""
    long = (F.octet_length(p) > 60) & (F.size(F.split(p, "/")) > 3)
    return F.when(long, F.concat(F.substring_index(p, "/", 1), F.lit("/.../"), F.substring_index(p, "/", -2))).otherwise(p)


def truncate_middle(line: Column, n: int) -> Column:
    """A line without its indent, at most n characters: two thirds of its head, an ellipsis, one third of its tail."""
    s = F.regexp_replace(line, r"^\s+", "")
    head = (n - 1) * 2 // 3
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(head)), F.lit("…"), F.right(s, F.lit(n - 1 - head)))).otherwise(s)


def slug(s: Column, most: int = 40) -> Column:
    x = F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(x, "^-+|-+$", ""), F.lit(most)), "-+$", "")


SENSITIVE = r"(?i)(KEY|SECRET|TOKEN|PASS|CREDENTIAL|AUTH)"


def mask_sensitive(name: Column, value: Column) -> Column:
    """Values under telling names keep their first four characters."""
    return F.when(F.rlike(name, F.lit(SENSITIVE)), F.concat(F.left(value, F.lit(4)), F.lit("****"))).otherwise(value)


def root_hash(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(16))


def iso_week(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))

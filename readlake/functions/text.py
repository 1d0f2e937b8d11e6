"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from readlake.functions.reads import col


def comma_count(n) -> Column:
    """A count with commas; numbers with a fraction have two digits of it."""
    v = col(n).cast("double")
    return F.when(v.isNull(), "n/a").when(v != F.floor(v), F.format_number(v, 2)).otherwise(F.format_number(v, 0))


def compact_count(n) -> Column:
    v = col(n).cast("double")
    whole = F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", v))
    return F.when(F.abs(v) >= 1e6, F.format_string("%.2fM", v / 1e6)).when(F.abs(v) >= 1e3, F.format_string("%.1fk", v / 1e3)).otherwise(whole)


def size_text(n) -> Column:
    """Bytes in steps of 1024, up to TB."""
    v, out = col(n).cast("double"), F.lit(None)
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        own = F.format_string("%.1f" + unit, v / 1024.0**i)
        out = own if i == 4 else F.when(v < 1024.0 ** (i + 1), own).otherwise(out)
    return F.coalesce(out, F.lit("n/a"))


def duration_text(seconds) -> Column:
    s = F.greatest(F.bround(col(seconds)).cast("bigint"), F.lit(0))
    d, h, m, x = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(col(seconds).isNull(), "n/a").when(d > 0, F.format_string("%dd %02dh", d, h)).when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, x)).otherwise(F.format_string("%ds", x))


def rate_text(rate) -> Column:
    r = col(rate).cast("double")
    return F.when(r < 0, None).when(r >= 1e6, F.format_string("%.1fM/s", r / 1e6)).when(r >= 1e3, F.format_string("%.1fk/s", r / 1e3)).otherwise(F.format_string("%.1f/s", r))

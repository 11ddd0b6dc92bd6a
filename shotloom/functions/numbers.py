"""Numeric and timecode column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_at(c: Column, digits: int) -> Column:
    """Half-up rounding by plain floating arithmetic (same result in any engine)."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length of two intervals, 0 when they only touch."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def srt_time_ms(ms: Column) -> Column:
    """HH:MM:SS,mmm from milliseconds; negative counts as 0, hours are not capped."""
    m = F.greatest(F.lit(0).cast("bigint"), ms.cast("bigint"))
    sec = F.floor(m / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60, m % 1000)


def srt_time(sec: Column) -> Column:
    return srt_time_ms(F.floor(sec * 1000.0 + 0.5))


def parse_srt_time(c: Column) -> Column:
    """Seconds of an SRT time code; null when malformed."""
    pat = r"^\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*$"
    g = [F.regexp_extract(c, pat, i) for i in range(1, 5)]
    return F.when(
        c.rlike(pat),
        F.expr("0.0D")
        + g[0].try_cast("int") * 3600
        + g[1].try_cast("int") * 60
        + g[2].try_cast("int")
        + F.rpad(g[3], 3, "0").try_cast("int") / 1000.0,
    )


def mmss(sec: Column) -> Column:
    """MM:SS from a text or number of seconds; '' when it is not a number."""
    v = sec.try_cast("double")
    total = F.greatest(F.lit(0).cast("bigint"), v.cast("bigint"))
    return F.when(v.isNull() | F.isnan(v), "").otherwise(F.format_string("%02d:%02d", F.floor(total / 60), total % 60))


def time_range_text(start: Column, end: Column) -> Column:
    a = F.format_string("%.2fs", start)
    b = F.format_string("%.2fs", end)
    return (
        F.when(start.isNull() & end.isNull(), "")
        .when(start.isNull(), F.concat(F.lit("until "), b))
        .when(end.isNull(), F.concat(F.lit("from "), a))
        .otherwise(F.concat(a, F.lit("-"), b))
    )


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def score_from_text(c: Column, default: float) -> Column:
    """First number in a text, clamped to 0..1."""
    n = F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(n.isNull(), F.lit(default)).otherwise(clamp01(n))


def text_importance(text: Column) -> Column:
    """Importance of a unit with text only."""
    base = F.lit(0.25) + F.least(F.length(text), F.lit(180)) / 260.0
    return F.least(F.lit(0.9), F.greatest(F.lit(0.15), base))


def ocr_importance(text: Column, n_ocr: Column) -> Column:
    """Importance of a unit that also carries recognised on-screen text."""
    conf = ocr_confidence(text, n_ocr)
    base = F.lit(0.25) + n_ocr * 0.08 + F.least(F.length(text), F.lit(160)) / 320.0
    return F.least(F.lit(0.95), F.greatest(conf, base))


def ocr_confidence(text: Column, n_ocr: Column) -> Column:
    return F.when(n_ocr > 0, 0.85).when(F.length(text) > 0, 0.45).otherwise(0.0)


def to_bool(c: Column, default: bool) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return (
        F.when(low.isin("1", "true", "yes", "on"), F.lit(True))
        .when(low.isin("0", "false", "no", "off"), F.lit(False))
        .otherwise(F.lit(default))
    )


def to_double(c: Column, default: float) -> Column:
    """Number of a text; unparsable or non-finite becomes the default."""
    v = c.try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, v).otherwise(F.lit(default))


def to_int(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))

"""Extraction of tagged text (``<name attr="x">body</name>``) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BULLET_PREFIX, NULL_WORDS, NULL_WORDS_CJK, WS, let, strip


def _pair(tag: str) -> str:
    return rf"(?is)<\s*{tag}(?:\s+[^>]*)?\s*>(.*?)<\s*/\s*{tag}\s*>"


def extract_tag(c: Column, tag: str) -> Column:
    """Trimmed body of the first ``tag``; null when absent."""
    pat = _pair(tag)
    return F.when(c.rlike(pat), strip(F.regexp_extract(c, pat, 1)))


def has_flag_tag(c: Column, tag: str) -> Column:
    """A self-closed ``<tag/>`` is present."""
    return c.rlike(rf"(?i)<\s*{tag}\s*/\s*>")


def tag_blocks(c: Column, tag: str) -> Column:
    """All blocks of ``tag`` as ``array<struct<attrs:string, body:string>>``."""
    pat = F.lit(rf"(?is)<\s*{tag}([^>]*)>(.*?)<\s*/\s*{tag}\s*>")
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(c, pat, F.lit(1)).alias("attrs"),
            F.regexp_extract_all(c, pat, F.lit(2)).alias("body"),
        ),
        lambda b: F.struct(b["attrs"].alias("attrs"), strip(b["body"]).alias("body")),
    )


def attr(attrs: Column, *names: str) -> Column:
    """Value of the first non-empty of the named attributes; null when none is set."""
    found = []
    for name in names:
        pat = rf"(?is)(?:^|[^\w:-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
        value = F.concat(F.regexp_extract(attrs, pat, 1), F.regexp_extract(attrs, pat, 2))
        found.append(F.nullif(strip(value), F.lit("")))
    return F.coalesce(*found)


def attr_map(attrs: Column) -> Column:
    """Attributes as a map: lower-case keys, the last value of a repeated key wins."""
    pat = F.lit(r"(?s)([A-Za-z_][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
    pairs = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(attrs, pat, F.lit(1)).alias("k"),
            F.regexp_extract_all(attrs, pat, F.lit(2)).alias("a"),
            F.regexp_extract_all(attrs, pat, F.lit(3)).alias("b"),
        ),
        lambda p: F.struct(F.lower(p["k"]).alias("k"), strip(F.concat(p["a"], p["b"])).alias("v")),
    )
    last = let(
        pairs,
        lambda ps: F.filter(
            ps,
            lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]),
        ),
    )
    return F.map_from_entries(last)


def explode_tags(df: DataFrame, c: str, tag: str) -> DataFrame:
    """One row per block: ``tag_ord`` (1-based), ``attrs`` map and ``body``."""
    return df.select(
        *[x for x in df.columns if x != c], F.posexplode(tag_blocks(F.col(c), tag)).alias("_p", "_b")
    ).select(
        *[x for x in df.columns if x != c],
        (F.col("_p") + 1).alias("tag_ord"),
        attr_map(F.col("_b.attrs")).alias("attrs"),
        F.col("_b.body").alias("body"),
    )


def list_items(body: Column) -> Column:
    """Items of a tag body: bullet lines, or one line split on separators; ordered distinct."""
    text = strip(body)
    lines = F.filter(
        F.transform(
            F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"),
            lambda ln: strip(F.regexp_replace(strip(ln), BULLET_PREFIX, "")),
        ),
        lambda x: x != "",
    )
    parts = F.filter(F.transform(F.split(text, r"[,、，;；|]"), strip), lambda x: x != "")
    chosen = F.when(F.size(lines) <= 1, parts).otherwise(lines)
    items = F.array_distinct(
        F.filter(F.transform(chosen, lambda x: F.btrim(x, F.lit("`"))), lambda x: x != "")
    )
    empty = text.isNull() | F.lower(text).isin(NULL_WORDS) | text.isin(NULL_WORDS_CJK)
    return F.when(empty, F.array().cast("array<string>")).otherwise(items)


def tag_list(c: Column, tag: str) -> Column:
    return list_items(extract_tag(c, tag))


def resolve_choice(value: Column, candidates: Column) -> Column:
    """Struct ``(chosen, fell_back)``: exact match, else suffix match, else the first candidate."""
    v = F.btrim(strip(value), F.lit("\"'`"))
    first = F.get(candidates, F.lit(0))
    none = v.isNull() | F.lower(v).isin([w for w in NULL_WORDS if w != "[]"]) | v.isin(NULL_WORDS_CJK)
    suffix = F.get(F.filter(candidates, lambda f: f.endswith(v)), F.lit(0))
    chosen = F.when(none, first).when(F.array_contains(candidates, v), v).otherwise(F.coalesce(suffix, first))
    fell = ~none & suffix.isNull()
    return F.struct(chosen.alias("chosen"), F.coalesce(fell, F.lit(False)).alias("fell_back"))


__all__ = [
    "attr", "attr_map", "explode_tags", "extract_tag", "has_flag_tag", "list_items",
    "resolve_choice", "tag_blocks", "tag_list", "WS",
]

"""Text column expressions (JVM built-ins, but for `keywords`)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from heapq import nsmallest

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide the results and are shared with the oracles.
# Unicode white space, spelled out so that Java and RE2 agree on it.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(i) for i in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)
WORD_PATTERN = r"[\x{4e00}-\x{9fff}]{2,}|[A-Za-z][A-Za-z0-9_-]+"
TITLE_WORD_PATTERN = r"[\x{4e00}-\x{9fff}]{2,}|[a-z][a-z0-9_-]+"
STOP_WORDS = [
    "the", "this", "that", "shot", "segment", "sampled", "keyframe", "keyframes",
    "seconds", "across", "has", "with", "video", "visual",
]
PLACEHOLDER_TOPICS = ["visual", "Visual timeline", "内容提取", "知识点整理", "重点回顾", "总结", "内容概览"]
GENERIC_TITLES = PLACEHOLDER_TOPICS + ["Part", "Overview", "Summary", "章节", "小节"]
TITLE_PREFIX = (
    r"^(?:[-*+]|\p{Nd}+[.)、:]|第 *\p{Nd}+ *(?:部分|章|节)[：:、]?|[一二三四五六七八九十]+[、.：:]) *"
)
BULLET_PREFIX = r"^(?:[-*+]|\p{Nd}+[.)]|[一二三四五六七八九十]+[、.])"
NULL_WORDS = ["", "null", "none", "n/a", "[]"]
NULL_WORDS_CJK = ["无", "无。", "没有"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def clean_text(c: Column) -> Column:
    """Collapse white space, trim, null becomes ''."""
    blank = F.translate(F.coalesce(c, F.lit("")), WS_CHARS, " " * len(WS_CHARS))
    return F.trim(F.regexp_replace(blank, "  +", " "))


def compact_text(c: Column, limit: int) -> Column:
    """Collapsed text; longer than ``limit``: first limit-1 characters, right-trimmed, plus '...'."""
    t = clean_text(c)
    return F.when(F.length(t) <= limit, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("..."))
    )


def compact_start(c: Column, limit: int) -> Column:
    """`compact_text` of a long text: only its start is collapsed where that already holds more than ``limit`` characters."""

    def cut(start: Column) -> Column:
        t = clean_text(start)
        return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("...")))

    return F.coalesce(cut(F.substring(c, 1, 8 * limit)), compact_text(c, limit))


def clean_title(c: Column) -> Column:
    """Drop a bullet, ordinal or chapter prefix, then back-ticks, '#', '*', '-' and spaces at the edges."""
    return F.btrim(F.trim(F.regexp_replace(clean_text(c), TITLE_PREFIX, "")), F.lit("`#*- "))


def words(c: Column) -> Column:
    """Keyword tokens of a text with the stop words removed."""
    found = F.regexp_extract_all(c, F.lit(WORD_PATTERN), F.lit(0))
    return F.filter(found, lambda w: ~F.lower(w).isin(STOP_WORDS))


def ranked_keywords(tokens: Column, limit: int | None = None) -> Column:
    """Distinct tokens as ``array<struct<neg_count,len,token>>``, most frequent first.

    Runs inside the row: sort, find the end of each run of equal tokens, read the
    counts off the run ends. No shuffle, and O(n log n) for a long text.
    """

    def rank(s: Column) -> Column:
        n = F.size(s)
        last = F.filter(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == n - 1) | (F.get(s, i) != F.get(s, i + 1)),
        )
        return let(
            last,
            lambda e: F.sort_array(
                F.transform(
                    e,
                    lambda end, j: F.struct(
                        (F.coalesce(F.get(e, F.when(j > 0, j - 1)), F.lit(-1)) - end).alias("neg_count"),
                        F.length(F.get(s, end)).alias("len"),
                        F.get(s, end).alias("token"),
                    ),
                )
            ),
        )

    ranked = let(F.sort_array(tokens), rank)
    return ranked if limit is None else F.slice(ranked, 1, limit)


def keywords(c: Column, limit: int) -> Column:
    """Top keywords of a text: count down, length up, token up. Counted in Arrow batches, which costs a tenth of `ranked_keywords`."""
    pattern, stop = re.sub(r"\\x\{(\w+)\}", r"\\u\1", WORD_PATTERN), frozenset(STOP_WORDS)

    def top(text):
        if not isinstance(text, str):
            return []
        counted = [(-n, len(w), w) for w, n in Counter(re.findall(pattern, text)).items() if w.lower() not in stop]
        return [w for _, _, w in nsmallest(limit, counted)]

    return F.pandas_udf(lambda texts: texts.map(top), "array<string>")(c)


def title_tokens(c: Column) -> Column:
    """Lower-case words, CJK runs and CJK bigrams of a title, as a set."""
    low = F.lower(clean_text(c))
    han = F.array_join(F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]"), F.lit(0)), "")
    pairs = let(
        han,
        lambda h: F.when(
            F.length(h) > 1,
            F.transform(F.sequence(F.lit(1), F.length(h) - 1), lambda i: F.substring(h, i, F.lit(2))),
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.array_union(F.regexp_extract_all(low, F.lit(TITLE_WORD_PATTERN), F.lit(0)), pairs)


def is_generic_title(c: Column) -> Column:
    t = clean_text(c)
    low = F.lower(t)
    return (
        (t == "")
        | low.isin([g.lower() for g in GENERIC_TITLES])
        | low.startswith("part ")
        | low.startswith("section ")
    )


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two sets; two empty sets are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    )


def slug(c: Column) -> Column:
    """File-name form of a label; empty becomes 'video'."""
    s = F.btrim(F.regexp_replace(strip(c), r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("video"))


def split_refs(c: Column) -> Column:
    """Split a reference list on commas, semicolons and white space; strip quotes."""
    parts = F.split(c, f"(?:[,，、;；]|{WS})+")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit("\"'`"))), lambda p: p != "")


def ordered_distinct(items: Column) -> Column:
    """Cleaned items, empties dropped, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(items, clean_text), lambda x: x != ""))


def drop_placeholders(items: Column) -> Column:
    return F.filter(items, lambda t: (t != "") & ~t.isin(PLACEHOLDER_TOPICS))


def strip_repeated_heading(body: Column, title: Column) -> Column:
    """Drop a first body line that only repeats the title, and the blank lines around it."""
    b = strip(body)
    first = strip(F.regexp_extract(b, r"^([^\r\n]*)", 1))
    bare = strip(F.regexp_replace(first, r"^#{1,6}", ""))
    return F.when(bare == title, strip(F.regexp_replace(b, r"^[^\r\n]*", ""))).otherwise(b)


def error_category(c: Column) -> Column:
    """First matching category of an error text; null for no error."""
    low = F.lower(c)

    def has(*parts: str) -> Column:
        cond = low.contains(parts[0])
        for p in parts[1:]:
            cond = cond | low.contains(p)
        return cond

    return (
        F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
        .when(has("timeout", "timed out"), "timeout")
        .when(has("http"), "http")
        .when(has("urlopen", "connection", "network"), "network")
        .when(has("json", "parse", "tag"), "parse_or_contract")
        .when(has("missing", "required"), "contract")
        .when(has("empty"), "empty_output")
        .otherwise("unknown")
    )


def inline_plain(c: Column) -> Column:
    """Inline markdown reduced to its text: code, link, bold and italic marks removed.

    Code spans are set aside first, so their content is never read as marks.
    """
    code = r"`([^`\n]+)`"
    slot = "\ue000"
    t = F.regexp_replace(c, code, slot)
    t = F.regexp_replace(t, r"\[([^\]\n]+)\]\((https?://[^\s)]+)\)", "$1")
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "$1")
    t = F.regexp_replace(t, r"__(.+?)__", "$1")
    t = F.regexp_replace(t, r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1")
    t = F.regexp_replace(t, r"(?<!_)_([^_\n]+)_(?!_)", "$1")
    spans = F.regexp_extract_all(c, F.lit(code), F.lit(1))
    both = F.zip_with(F.split(t, slot), spans, lambda p, k: F.concat(F.coalesce(p, F.lit("")), F.coalesce(k, F.lit(""))))
    return F.array_join(both, "")


def plain_items(items: Column, item_limit: int = 80, max_items: int = 8) -> Column:
    """Non-empty items, each cut to ``item_limit``, at most ``max_items``."""
    cut = F.filter(F.transform(items, lambda x: compact_text(x, item_limit)), lambda x: x != "")
    return F.slice(cut, 1, max_items)


def plain_join(items: Column, empty: str = "none", item_limit: int = 80, max_items: int = 8) -> Column:
    got = F.array_join(plain_items(items, item_limit, max_items), ", ")
    return F.when(F.coalesce(got, F.lit("")) == "", empty).otherwise(got)


def relativize(path: Column, root: Column) -> Column:
    """Path below ``root`` without the root; others unchanged."""
    head = F.concat(root, F.lit("/"))
    return F.when(path == root, F.lit(".")).when(
        path.startswith(head), F.substring(path, F.length(head) + 1, F.length(path))
    ).otherwise(path)


def resolve(path: Column, root: Column) -> Column:
    """Absolute path kept, relative path joined to ``root``, empty becomes null."""
    return F.when(path.isNull() | (path == ""), F.lit(None).cast("string")).when(
        path.startswith("/"), path
    ).otherwise(F.concat(root, F.lit("/"), path))

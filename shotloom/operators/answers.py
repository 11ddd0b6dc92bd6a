"""Whole planning answers as one row each: blocks with their references and summaries, settled together, and the warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as tg
from ..functions import text as tx
from ..functions.text import let

#: Limits of the reference's answers, as defaults: sections of an outline, chapters of a plan, subsections of a chapter.
MAX_SECTIONS, MAX_CHAPTERS, MAX_SUBSECTIONS = 6, 8, 5
# Fixed value.
DEFAULT_STYLE = "structured_report"
_MARK = "\x01"


def _strings() -> Column:
    return F.array().cast("array<string>")


def answer_blocks(c: Column, tag: str, names: Sequence[str] = (), title_limit: int | None = None) -> Column:
    """array<struct(title, refs, summary)> in order. The summary is the first SUMMARY after a block and before the next opening."""
    pattern = rf"(?is)(<\s*{tag}[^>]*>.*?<\s*/\s*{tag}\s*>)"
    marked = F.split(F.regexp_replace(c, pattern, "$1" + _MARK), _MARK)
    after = F.transform(F.slice(marked, F.lit(2), F.size(marked)), lambda p: F.regexp_replace(p, rf"(?is)<\s*{tag}(?:\s+[^>]*)?>.*$", ""))

    def one(b: Column) -> Column:
        title = tx.clean_title(b["b"]["body"])
        return F.struct(
            (tx.compact_text(title, title_limit) if title_limit else title).alias("title"),
            (F.coalesce(tg.attr(b["b"]["attrs"], *names), F.lit("")) if names else F.lit("")).alias("refs"),
            F.coalesce(tg.extract_tag(b["a"], "SUMMARY"), F.lit("")).alias("summary"),
        )

    return F.transform(F.arrays_zip(tg.tag_blocks(c, tag).alias("b"), after.alias("a")), one)


def _expanded(refs: Column, valid: Column) -> Column:
    """struct(ids, invalid) of a reference list: single ids, and ranges in either direction over the order of `valid`."""

    def token(t: Column) -> Column:
        a = F.array_position(valid, tx.strip(F.substring_index(t, "-", 1)))
        z = F.array_position(valid, tx.strip(F.regexp_extract(t, r"(?s)^[^-]*-(.*)$", 1)))
        known = F.array_contains(valid, t)
        ranged = ~known & t.contains("-") & (a > 0) & (z > 0)
        ids = F.when(known, F.array(t)).when(ranged, F.slice(valid, F.least(a, z).cast("int"), (F.abs(a - z) + 1).cast("int"))).otherwise(_strings())
        return F.struct(ids.alias("ids"), F.when(known | ranged, _strings()).otherwise(F.array(t)).alias("bad"))

    return let(
        F.transform(tx.split_refs(refs), token),
        lambda ts: F.struct(F.array_distinct(F.flatten(F.transform(ts, lambda t: t["ids"]))).alias("ids"), F.flatten(F.transform(ts, lambda t: t["bad"])).alias("invalid")),
    )


def _settled(blocks: Column, limit: int) -> Column:
    """Blocks with a title, each with `state` kept, duplicate, empty or beyond.

    The first block of a title that has ids is the one kept; later ones are duplicates. Blocks after the `limit`-th kept
    one are beyond and play no part.
    """

    def states(bs: Column) -> Column:
        usable = F.transform(bs, lambda b: F.when(F.size(b["ids"]) > 0, b["title"]))
        return F.transform(
            bs,
            lambda b, i: let(
                F.array_position(usable, b["title"]),
                lambda at: F.struct(
                    b["title"].alias("title"), b["ids"].alias("ids"), b["invalid"].alias("invalid"), b["summary"].alias("summary"), i.alias("i"),
                    F.when((at > 0) & (at < i + 1), "duplicate").when(F.size(b["ids"]) == 0, "empty").otherwise("kept").alias("state"),
                ),
            ),
        )

    def cut(bs: Column) -> Column:
        kept = F.filter(bs, lambda b: b["state"] == "kept")
        last = F.coalesce(F.get(F.transform(kept, lambda b: b["i"]), F.lit(limit - 1)), F.size(bs))
        return let(last, lambda n: F.filter(bs, lambda b: b["i"] <= n))

    return let(let(F.filter(blocks, lambda b: b["title"] != ""), states), cut)


def _warned(bs: Column, removed: dict[str, str], invalid: str) -> Column:
    """Warnings of removed blocks in order, then of unknown references; a duplicate's references are not looked at."""
    codes = F.transform(bs, lambda b: F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in removed.items() for x in kv]), b["state"]), b["title"]))
    unknown = F.array_distinct(F.flatten(F.transform(F.filter(bs, lambda b: b["state"] != "duplicate"), lambda b: b["invalid"])))
    note = F.when(F.size(unknown) > 0, F.array(F.concat(F.lit(invalid), F.array_join(unknown, ",")))).otherwise(_strings())
    return F.concat(F.filter(codes, lambda x: x.isNotNull()), note)


def _kept(bs: Column) -> Column:
    return F.filter(bs, lambda b: b["state"] == "kept")


def parse_outline_answers(df: DataFrame, response: str, valid: str, limit: int = MAX_SECTIONS) -> DataFrame:
    """Outline answers: status, theme, style, sections array<struct(title, source_chunks)> and warnings, one row per answer.

    ``valid`` holds the chunk ids of the prompt. Unknown chunks are removed, the first section of a title is kept, and
    sections past ``limit`` are cut, each with a warning. Without a theme or a section the status is ``failed``.
    """
    c = F.coalesce(F.col(response), F.lit(""))

    def one(b: Column) -> Column:
        refs = tx.split_refs(b["refs"])
        return F.struct(
            b["title"].alias("title"), F.array_distinct(F.filter(refs, lambda r: F.array_contains(valid, r))).alias("ids"),
            F.filter(refs, lambda r: ~F.array_contains(valid, r)).alias("invalid"),
        )

    titled = F.filter(F.transform(answer_blocks(c, "SECTION", ("chunks", "source_chunks"), None), one), lambda b: b["title"] != "")
    d = df.withColumn("_b", titled).withColumn("_t", F.transform("_b", lambda b: b["title"]))
    first = F.filter("_b", lambda b, i: F.array_position("_t", b["title"]) == i + 1)
    again = F.filter("_b", lambda b, i: F.array_position("_t", b["title"]) < i + 1)
    d = d.withColumn("_first", first).withColumn("_again", again)
    unknown = F.array_distinct(F.flatten(F.transform("_first", lambda b: b["invalid"])))
    n = F.size("_first")
    notes = F.concat(
        F.transform("_again", lambda b: F.concat(F.lit("duplicate_section_removed:"), b["title"])),
        F.when(F.size(unknown) > 0, F.array(F.concat(F.lit("invalid_section_chunks_removed:"), F.array_join(unknown, ",")))).otherwise(_strings()),
        F.when(n > limit, F.array(F.concat(F.lit("too_many_sections_truncated:"), n.cast("string")))).otherwise(_strings()),
    )
    theme = tx.clean_title(F.coalesce(tg.extract_tag(c, "THEME"), F.lit("")))
    return d.select(
        *[x for x in df.columns if x not in (response, valid)], F.when((theme == "") | (n == 0), "failed").otherwise("ok").alias("status"), theme.alias("theme"),
        F.coalesce(F.nullif(tg.extract_tag(c, "STYLE"), F.lit("")), F.lit(DEFAULT_STYLE)).alias("style"),
        F.slice(F.transform("_first", lambda b: F.struct(b["title"].alias("title"), b["ids"].alias("source_chunks"))), 1, limit).alias("sections"), notes.alias("warnings"),
    )


def _with_ids(blocks: Column, valid: str) -> Column:
    def one(b: Column) -> Column:
        return let(_expanded(b["refs"], F.col(valid)), lambda e: F.struct(b["title"].alias("title"), e["ids"].alias("ids"), e["invalid"].alias("invalid"), b["summary"].alias("summary")))

    return F.transform(blocks, one)


def _overflow(total: Column, kept: Column, limit: int, code: str) -> Column:
    return F.when((kept >= limit) & (total > limit), F.array(F.concat(F.lit(code), total.cast("string")))).otherwise(_strings())


def parse_planner_answers(df: DataFrame, response: str, valid: str, limit: int = MAX_CHAPTERS) -> DataFrame:
    """Planner answers: status, title, description, chapters array<struct(title, summary, shot_ids)> and warnings.

    ``valid`` holds the shot ids in order; ranges are expanded over it. A chapter's summary is the one that follows it,
    else its title. Chapters of a seen title, chapters without shots and chapters past ``limit`` go, each with a warning.
    """
    c = F.coalesce(F.col(response), F.lit(""))
    d = df.withColumn("_b", _settled(_with_ids(answer_blocks(c, "CHAPTER", ("shots", "shot_ids"), 28), valid), limit))
    kept = _kept(F.col("_b"))
    chapters = F.transform(
        kept,
        lambda b: F.struct(b["title"].alias("title"), F.coalesce(F.nullif(tx.compact_text(b["summary"], 80), F.lit("")), b["title"]).alias("summary"), b["ids"].alias("shot_ids")),
    )
    removed = {"duplicate": "duplicate_outline_chapter_removed:", "empty": "empty_outline_chapter_removed:"}
    notes = F.concat(_warned(F.col("_b"), removed, "invalid_outline_shots_removed:"), _overflow(F.size(tg.tag_blocks(c, "CHAPTER")), F.size(kept), limit, "too_many_outline_chapters_truncated:"))
    return d.select(
        *[x for x in df.columns if x not in (response, valid)], F.when(F.size(kept) == 0, "failed").otherwise("ok").alias("status"),
        tx.compact_text(tx.clean_title(F.coalesce(tg.extract_tag(c, "TITLE"), F.lit(""))), 32).alias("title"),
        tx.compact_text(F.coalesce(tg.extract_tag(c, "DESCRIPTION"), F.lit("")), 160).alias("description"), chapters.alias("chapters"), notes.alias("warnings"),
    )


def parse_subsection_answers(df: DataFrame, response: str, valid: str, limit: int = MAX_SUBSECTIONS) -> DataFrame:
    """Subsection plans: mode split, keep or failed, subsections array<struct(title, shot_ids)> and warnings.

    A plan with a usable SUB block is ``split``; else a KEEP tag makes it ``keep``.
    """
    c = F.coalesce(F.col(response), F.lit(""))
    d = df.withColumn("_b", _settled(_with_ids(answer_blocks(c, "SUB", ("shots", "shot_ids"), 24), valid), limit))
    kept = _kept(F.col("_b"))
    removed = {"duplicate": "duplicate_subsection_removed:", "empty": "empty_subsection_removed:"}
    notes = F.concat(_warned(F.col("_b"), removed, "invalid_subsection_shots_removed:"), _overflow(F.size(tg.tag_blocks(c, "SUB")), F.size(kept), limit, "too_many_subsections_truncated:"))
    return d.select(
        *[x for x in df.columns if x not in (response, valid)],
        F.when(F.size(kept) > 0, "split").when(tg.has_flag_tag(c, "KEEP"), "keep").otherwise("failed").alias("mode"),
        F.transform(kept, lambda b: F.struct(b["title"].alias("title"), b["ids"].alias("shot_ids"))).alias("subsections"), notes.alias("warnings"),
    )

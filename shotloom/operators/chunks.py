"""Chunking of cards, chunk summaries and the per-video summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .cards import no_strings, or_default
from .ordered import top_k

K = ["video_id"]

# Fixed values.
DEFAULT_THEME = "视频博客笔记"
DEFAULT_SECTION = "内容概览"
DEFAULT_STYLE = "structured_report"
DEFAULT_TOPICS = ["内容提取", "知识点整理", "重点回顾", "总结"]
CHUNK_TOPIC = "视频笔记"
CHUNK_EMPTY = "该片段没有提取到可用于笔记的文字内容。"
MAX_SECTIONS = 6
MAX_IMPORTANT = 20


def chunk_number(ord_: Column, total: Column, size: int) -> Column:
    """1-based chunk of a position when ``ceil(total/size)`` chunks differ by at most one row."""
    p = ord_ - 1
    count = F.ceil(total / F.lit(max(1, size)))
    base = F.floor(total / count)
    extra = total % count
    wide = extra * (base + 1)
    return F.when(p < wide, F.floor(p / (base + 1))).otherwise(extra + F.floor((p - wide) / base)).cast("int") + 1


def balanced_chunks(cards: DataFrame, size: int, total: str = "card_count") -> DataFrame:
    """Adds ``chunk_no``; no shuffle, the position and the group size decide."""
    return cards.withColumn("chunk_no", chunk_number(F.col("ord"), F.col(total), size))


def summarize_chunks(chunked: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """One row per chunk: first and last shot, top 5 keywords, short text, 5 most important shots.

    A chunk holds at most the chunk size, so its cards are gathered whole.
    """
    body = tx.strip(F.coalesce("merged_summary", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("ord", "shot_id", "topic_tags", body.alias("body"), F.col("importance_score").alias("imp"))))
    d = chunked.groupBy(*keys, "chunk_no").agg(rows.alias("_r"))
    texts = F.filter(F.transform("_r", lambda r: r["body"]), lambda b: b != "")
    tags = F.flatten(F.transform("_r", lambda r: F.coalesce(r["topic_tags"], no_strings())))
    d = d.withColumn("_texts", texts).withColumn("_all", F.array_join("_texts", " "))
    best = F.slice(
        F.sort_array(F.transform("_r", lambda r: F.struct((-F.coalesce(r["imp"], F.lit(0.0))).alias("i"), r["ord"].alias("o"), r["shot_id"].alias("s")))), 1, 5
    )
    return d.select(
        *keys,
        "chunk_no",
        F.format_string("chunk_%03d", "chunk_no").alias("chunk_id"),
        F.size("_r").alias("card_count"),
        F.get("_r", F.lit(0))["shot_id"].alias("first_shot"),
        F.element_at("_r", -1)["shot_id"].alias("last_shot"),
        or_default(tx.keywords(F.array_join(F.concat(tags, "_texts"), " "), 5), CHUNK_TOPIC).alias("main_topics"),
        F.when(F.size("_texts") > 0, tx.compact_start(F.col("_all"), 280)).otherwise(CHUNK_EMPTY).alias("summary"),
        F.transform(best, lambda b: b["s"]).alias("important_shots"),
    )


def _first_seen(chunks: DataFrame, items: str, out: str, keys: Sequence[str]) -> DataFrame:
    """Cleaned items with the place of their first occurrence (chunk, position)."""
    flat = chunks.select(*keys, "chunk_no", F.posexplode(items).alias("pos", "_x"))
    flat = flat.withColumn(out, tx.clean_text(F.col("_x"))).where(F.col(out) != "")
    return flat.groupBy(*keys, out).agg(F.min(F.struct("chunk_no", "pos")).alias("first_at"))


def merge_topics(chunks: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Distinct topics with first occurrence; a lone placeholder topic is replaced by the four defaults."""
    seen = _first_seen(chunks, "main_topics", "topic", keys)
    stat = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("topic").alias("_t"))
    lone = stat.where((F.col("_n") == 1) & F.col("_t").isin("visual", "Visual timeline"))
    kept = seen.join(lone.select(*keys), list(keys), "left_anti")
    default = F.array(*[F.lit(t) for t in DEFAULT_TOPICS])
    fill = lone.select(*keys, F.posexplode(default).alias("pos", "topic")).select(
        *keys, "topic", F.struct(F.lit(1).alias("chunk_no"), "pos").alias("first_at")
    )
    return kept.unionByName(fill)


def important_shots(chunks: DataFrame, limit: int = MAX_IMPORTANT, keys: Sequence[str] = K) -> DataFrame:
    seen = _first_seen(chunks, "important_shots", "shot_id", keys)
    return top_k(seen, keys, [F.col("first_at")], limit).drop("first_at")


def suggest_sections(cards_n: Column, topics_n: Column, chunk_size: int) -> Column:
    half = max(1, chunk_size // 2)
    wanted = F.greatest(
        topics_n.cast("bigint"), F.ceil(cards_n / half), F.floor((cards_n + 7) / 8), F.lit(1).cast("bigint")
    )
    return F.when(cards_n <= 0, F.lit(1)).otherwise(
        F.least(F.lit(MAX_SECTIONS).cast("bigint"), cards_n.cast("bigint"), wanted)
    ).cast("int")


def target_chapters(manual: int | None, suggested: Column, sections_n: Column, cards_n: Column) -> Column:
    if manual is not None:
        return F.lit(min(8, max(1, manual)))
    auto = F.greatest(F.coalesce(F.nullif(suggested, F.lit(0)), F.lit(1)), sections_n, F.lit(1))
    fit = F.least(auto, F.coalesce(F.nullif(cards_n, F.lit(0)), F.lit(1)))
    return F.least(F.lit(8), F.greatest(F.lit(1), fit)).cast("int")


def sections_from_chunks(chunks: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Up to 6 sections: title from the first topic (else the summary) of each chunk, first occurrence per title."""
    topics = F.filter(F.transform("main_topics", tx.strip), lambda t: t != "")
    title = tx.clean_title(F.coalesce(F.get(topics, F.lit(0)), "summary"))
    d = chunks.select(*keys, "chunk_no", "chunk_id", title.alias("_title")).where("_title != ''")
    first = d.groupBy(*keys, "_title").agg(F.min(F.struct("chunk_no", "chunk_id")).alias("_f"))
    got = top_k(first, keys, [F.col("_f.chunk_no")], MAX_SECTIONS, "section_no")
    return got.select(*keys, "section_no", tx.compact_text(F.col("_title"), 28).alias("title"), F.array("_f.chunk_id").alias("source_chunks"))


def video_theme(chunks: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """First topic of the first chunk that has one, cut to 24."""
    topics = F.filter(F.transform("main_topics", tx.clean_text), lambda t: t != "")
    d = chunks.select(*keys, "chunk_no", F.get(topics, F.lit(0)).alias("_t")).where("_t is not null")
    return d.groupBy(*keys).agg(F.min_by("_t", "chunk_no").alias("_t")).select(*keys, tx.compact_text(F.col("_t"), 24).alias("theme"))


def build_global_summary(
    videos: DataFrame, chunks: DataFrame, sections: DataFrame, themes: DataFrame, chunk_size: int, keys: Sequence[str] = K
) -> tuple[DataFrame, DataFrame]:
    """Summary rows and section rows per video.

    ``videos``: keys, card_count. ``sections``: keys, section_no, title, source_chunks.
    Valid sections are cleaned, not placeholders, first of their title, at most 6, with known
    chunks only; a video without any falls back to its topics.
    """
    title = tx.clean_text(F.col("title"))
    valid = sections.withColumn("title", title).where((F.col("title") != "") & ~F.col("title").isin(tx.PLACEHOLDER_TOPICS))
    first = valid.groupBy(*keys, "title").agg(F.min_by(F.struct("section_no", "source_chunks"), "section_no").alias("_s"))
    picked = top_k(first, keys, [F.col("_s.section_no")], MAX_SECTIONS, "pos").select(
        *keys, "pos", "title", F.posexplode_outer(tx.ordered_distinct(F.col("_s.source_chunks"))).alias("_i", "chunk_id")
    )
    known = chunks.select(*keys, "chunk_id", F.lit(1).alias("_ok"))
    sourced = picked.join(known, [*keys, "chunk_id"], "left").groupBy(*keys, "pos", "title").agg(
        F.sort_array(F.collect_list(F.when(F.col("_ok") == 1, F.struct("_i", "chunk_id")))).alias("_c")
    )
    main = sourced.select(*keys, F.col("pos").alias("section_no"), "title", F.transform("_c", lambda c: c["chunk_id"]).alias("source_chunks"), F.lit(False).alias("fallback"))

    topics = merge_topics(chunks, keys)
    stat = topics.groupBy(*keys).agg(F.count_if(~F.col("topic").isin(tx.PLACEHOLDER_TOPICS)).cast("int").alias("topics_n"))
    lost = videos.join(main.select(*keys).distinct(), list(keys), "left_anti")
    ranked = topics.join(stat, list(keys)).where(~F.col("topic").isin(tx.PLACEHOLDER_TOPICS) | (F.col("topics_n") == 0))
    spare = top_k(ranked.join(lost.select(*keys), list(keys), "left_semi"), keys, [F.col("first_at")], MAX_SECTIONS, "section_no").select(
        *keys, "section_no", F.col("topic").alias("title"), no_strings().alias("source_chunks"), F.lit(True).alias("fallback")
    )
    bare = lost.join(topics.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys, F.lit(1).alias("section_no"), F.lit(DEFAULT_SECTION).alias("title"), no_strings().alias("source_chunks"), F.lit(True).alias("fallback")
    )
    rows = main.unionByName(spare).unionByName(bare)

    per = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("section_count"), F.min_by("title", "section_no").alias("_first"), F.max("fallback").alias("fallback")
    )
    head = videos.join(per, list(keys), "left").join(stat, list(keys), "left").join(themes, list(keys), "left")
    own = F.least(F.lit(MAX_SECTIONS), F.greatest(F.lit(1), F.col("card_count")), F.greatest(F.lit(1), F.col("section_count")))
    alt = suggest_sections(F.col("card_count"), F.coalesce("topics_n", F.lit(0)), chunk_size)
    theme = F.when(F.col("fallback"), F.col("_first")).otherwise(F.coalesce(F.nullif("theme", F.lit("")), "_first", F.lit(DEFAULT_THEME)))
    return (
        head.select(
            *keys, "card_count", theme.alias("video_main_theme"), "section_count",
            F.when(F.col("fallback"), alt).otherwise(own).alias("suggested_chapter_count"),
            F.lit(DEFAULT_STYLE).alias("narrative_style"), "fallback",
        ),
        rows,
    )


def reduce_summaries(cards: DataFrame, chunk_size: int, keys: Sequence[str] = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards to (chunks, summary, sections)."""
    from .staging import materialize

    chunks = materialize(summarize_chunks(balanced_chunks(cards, chunk_size), keys))
    videos = chunks.groupBy(*keys).agg(F.sum("card_count").cast("int").alias("card_count"))
    sections = materialize(sections_from_chunks(chunks, keys))
    summary, final = build_global_summary(videos, chunks, sections, video_theme(chunks, keys), chunk_size, keys)
    return chunks, summary, materialize(final)

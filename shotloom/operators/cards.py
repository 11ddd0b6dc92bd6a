"""Per-unit cards: keywords, scores and the text rows handed to a scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import tags as tg
from ..functions import text as tx
from .ordered import top_k

K = ["video_id"]

# Fixed values.
ROLES = ["introduction", "explanation", "demo", "transition", "conclusion", "unknown"]
NO_SUBTITLE = "该镜头没有可用字幕。"
NO_TEXT = "未提取到可用于笔记的文字内容。"
DEFAULT_TOPIC = "内容提取"
OCR_TOPIC = "文字提取"
NO_OCR_WARNING = "local_heuristic_no_ocr: 本地启发式模式不会读取关键帧文字。"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def or_default(items: Column, *default: str) -> Column:
    return tx.let(items, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(*[F.lit(i) for i in default])))


def keyword_rank(texts: DataFrame, limit: int, keys: Sequence[str] = K) -> DataFrame:
    """Top keywords over all texts of a key; counts are pre-aggregated before the shuffle."""
    counts = texts.select(*keys, F.explode(tx.words(F.col("text"))).alias("token")).groupBy(*keys, "token").agg(
        F.count(F.lit(1)).alias("n")
    )
    return top_k(counts, keys, [F.desc("n"), F.length("token"), F.col("token")], limit)


def heuristic_cards(packages: DataFrame) -> DataFrame:
    """Cards from subtitle text alone. ``packages``: ..., subtitle_text, frames, warnings."""
    body = tx.strip(F.coalesce("subtitle_text", F.lit("")))
    has = F.col("_t") != ""
    d = packages.withColumn("_t", body).withColumn("_k", tx.keywords(F.col("_t"), 6))
    summary = F.when(has, tx.compact_text(F.col("_t"), 180)).otherwise(NO_SUBTITLE)
    kept = F.filter(F.coalesce("warnings", no_strings()), lambda w: tx.strip(w) != "")
    note = F.lit(NO_OCR_WARNING)
    return d.select(
        *[c for c in packages.columns if c not in ("subtitle_text", "frames", "warnings")],
        summary.alias("subtitle_summary"),
        F.when(has, summary).otherwise(NO_TEXT).alias("merged_summary"),
        F.slice("_k", 1, 4).alias("key_entities"),
        or_default(F.slice("_k", 1, 3), DEFAULT_TOPIC).alias("topic_tags"),
        F.when(has, "explanation").otherwise("unknown").alias("narrative_role"),
        num.round_at(num.text_importance(F.col("_t")), 3).alias("importance_score"),
        F.get("frames", F.lit(0)).alias("recommended_display_frame"),
        F.when(has, 0.45).otherwise(0.2).alias("confidence"),
        F.when(F.array_contains(kept, note), kept).otherwise(F.concat(kept, F.array(note))).alias("warnings"),
    )


def ocr_cards(packages: DataFrame, frame_texts: DataFrame, max_images: int, keys: Sequence[str] = K) -> DataFrame:
    """Cards from on-screen text. ``frame_texts``: keys, shot_id, frame_no (1-based), frame, ord, text.

    A shot has few frames, so its texts are gathered per shot.
    """
    used = frame_texts.where(F.col("frame_no") <= max_images)
    got = used.groupBy(*keys, "shot_id").agg(
        F.sort_array(F.collect_list(F.struct("frame_no", "ord", "text", "frame"))).alias("_r")
    )
    best = used.groupBy(*keys, "shot_id", "frame_no", "frame").agg(F.count("text").alias("_n")).groupBy(*keys, "shot_id").agg(
        F.max_by("frame", F.struct("_n", -F.col("frame_no"))).alias("best_frame")
    )
    d = packages.join(got, [*keys, "shot_id"], "left").join(best, [*keys, "shot_id"], "left")
    screen = tx.ordered_distinct(F.transform(F.coalesce("_r", F.array().cast("array<struct<frame_no:int,ord:int,text:string,frame:string>>")), lambda r: r["text"]))
    d = d.withColumn("_s", screen).withColumn("_t", tx.strip(F.coalesce("subtitle_text", F.lit(""))))
    d = d.withColumn("_n", F.size("_s"))
    d = d.withColumn("_k", tx.keywords(F.concat_ws(" ", F.array_join("_s", " "), "_t"), 8))
    seen, has = F.col("_n") > 0, F.col("_t") != ""
    notes = F.concat(
        F.transform("_s", lambda t: F.concat(F.lit("- "), t)),
        F.when(has, F.array(F.concat(F.lit("- 字幕："), F.col("_t")))).otherwise(no_strings()),
    )
    return d.select(
        *keys, "shot_id",
        F.when(F.size(notes) > 0, F.array_join(notes, "\n")).otherwise("无可用知识点内容。").alias("merged_summary"),
        F.when(has, tx.compact_text(F.col("_t"), 240)).otherwise(NO_SUBTITLE).alias("subtitle_summary"),
        F.slice("_k", 1, 6).alias("key_entities"),
        F.when(F.size("_k") > 0, F.slice("_k", 1, 3)).when(seen, F.array(F.lit(OCR_TOPIC))).otherwise(F.array(F.lit(DEFAULT_TOPIC))).alias("topic_tags"),
        F.col("_s").alias("on_screen_text"),
        F.when(seen | has, "explanation").otherwise("unknown").alias("narrative_role"),
        num.round_at(num.ocr_importance(F.col("_t"), F.col("_n")), 3).alias("importance_score"),
        num.ocr_confidence(F.col("_t"), F.col("_n")).alias("confidence"),
        F.col("best_frame").alias("recommended_display_frame"),
    )


def parse_card_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Tagged answers to cards; ``status`` is failed with the missing tags when a required one is absent.

    ``df``: ..., response, frames, subtitle_text, warnings.
    """
    c = F.col(response)
    need = ["visual_summary", "merged_summary"]
    absent = F.filter(
        F.array(*[F.when(tg.extract_tag(c, t).isNull(), F.lit(t)) for t in need]), lambda x: x.isNotNull()
    )
    text = lambda t, default="": F.coalesce(tg.extract_tag(c, t), F.lit(default) if isinstance(default, str) else default)
    frame = tg.resolve_choice(tg.extract_tag(c, "recommended_display_frame"), F.col("frames"))
    sub = tx.strip(F.coalesce("subtitle_text", F.lit("")))
    role = F.lower(text("narrative_role", "unknown"))
    d = df.withColumn("_absent", absent).withColumn("_frame", frame).withColumn("_role", role)
    d = d.withColumn("_merged", text("merged_summary")).withColumn("_tags", tg.tag_list(c, "topic_tags"))
    ok_role = F.col("_role").isin(ROLES)
    frame_note = F.when(
        F.col("_frame.fell_back"),
        F.when(
            F.col("_frame.chosen").isNotNull(),
            F.concat(F.lit("模型返回的推荐帧不在候选关键帧中，已回退到 "), F.col("_frame.chosen"), F.lit("。")),
        ).otherwise("模型返回了推荐帧，但该镜头没有可用关键帧。"),
    )
    role_note = F.when(~ok_role, F.concat(F.lit("模型返回了未知 narrative_role="), F.col("_role"), F.lit("，已改为 unknown。")))
    own = F.filter(F.coalesce("warnings", no_strings()), lambda w: tx.strip(w) != "")
    notes = F.filter(F.array(frame_note, role_note), lambda w: w.isNotNull())
    score = lambda t: num.round_at(num.score_from_text(F.coalesce(tg.extract_tag(c, t), F.lit("")), 0.5), 3)
    return d.select(
        *[x for x in df.columns if x not in (response, "frames", "subtitle_text", "warnings")],
        F.when(F.size("_absent") > 0, "failed").otherwise("done").alias("status"),
        F.array_join("_absent", ", ").alias("missing_tags"),
        text("visual_summary").alias("visual_summary"),
        text("subtitle_summary", F.when(sub != "", tx.compact_text(sub, 160)).otherwise(NO_SUBTITLE)).alias("subtitle_summary"),
        F.col("_merged").alias("merged_summary"),
        tg.tag_list(c, "key_entities").alias("key_entities"),
        tg.tag_list(c, "actions").alias("actions"),
        tg.tag_list(c, "on_screen_text").alias("on_screen_text"),
        F.when(F.size("_tags") > 0, F.col("_tags")).otherwise(or_default(tx.keywords(F.col("_merged"), 3), DEFAULT_TOPIC)).alias("topic_tags"),
        F.when(ok_role, F.col("_role")).otherwise("unknown").alias("narrative_role"),
        score("importance_score").alias("importance_score"),
        score("confidence").alias("confidence"),
        F.col("_frame.chosen").alias("recommended_display_frame"),
        F.array_distinct(F.concat(own, tg.tag_list(c, "warnings"), notes)).alias("warnings"),
    )


def shot_briefs(cards: DataFrame) -> DataFrame:
    """Narrow view of cards: text up to 90 characters, up to 5 tags and entities."""
    def five(c: str) -> Column:
        return F.slice(F.filter(c, lambda x: tx.strip(x) != ""), 1, 5)

    return cards.select(
        "video_id", "ord", "shot_id", "start_sec", "end_sec",
        F.substring(tx.clean_text(F.col("merged_summary")), 1, 90).alias("text"),
        five("topic_tags").alias("topic_tags"), five("key_entities").alias("key_entities"), "importance_score",
    )


def subsection_briefs(chapters: DataFrame, chapter_shots: DataFrame) -> DataFrame:
    """Chapter text and targets with its card lines, one row per card: the planner's input in long form.

    ``chapters``: video_id, chapter_no, title, summary, target_subsections, max_subsections.
    """
    head = chapters.select(
        "video_id", "chapter_no", "title", compacted("summary", 180).alias("chapter_summary"), "target_subsections", "max_subsections"
    )
    def five(c: str) -> Column:
        return F.slice(F.filter(c, lambda x: tx.strip(x) != ""), 1, 5)

    rows = chapter_shots.select(
        "video_id", "chapter_no", "ord", "shot_id", "start_sec", "end_sec", "importance_score",
        five("topic_tags").alias("topic_tags"), five("key_entities").alias("key_entities"), compacted("merged_summary", 90).alias("text"),
    )
    return rows.join(head, ["video_id", "chapter_no"])


def compacted(c: str, limit: int) -> Column:
    return tx.compact_text(F.col(c), limit)


def context_line(text_limit: int, text: str = "merged_summary", frame: str | None = None) -> Column:
    """One ``- id; time a-b; score; text; topics; entities`` line of a card; empty parts are left out."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    when = num.time_range_text(F.col("start_sec"), F.col("end_sec"))
    pieces = [
        F.coalesce(F.nullif(tx.compact_text(F.col("shot_id"), 60), F.lit("")), F.lit("unknown_shot")),
        part("time ", when),
        F.concat(F.lit("score "), F.col("importance_score").cast("string")),
        part("text: ", tx.compact_text(F.col(text), text_limit)),
        part("topics: ", tx.plain_join(F.col("topic_tags"), "", 48, 5)),
        part("entities: ", tx.plain_join(F.col("key_entities"), "", 48, 5)),
    ]
    if frame:
        pieces.append(part("frame: ", tx.compact_text(F.coalesce(F.col(frame), F.lit("")), 140)))
    return F.concat(F.lit("- "), F.concat_ws("; ", *pieces))


def chunk_line() -> Column:
    """One line per chunk: id, range, topics, summary."""
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    rng = tx.plain_join(F.array("first_shot", "last_shot"), "", 60, 4)
    return F.concat(
        F.lit("- "),
        F.concat_ws(
            "; ", "chunk_id", part("shots ", rng), part("topics: ", tx.plain_join(F.col("main_topics"), "", 60, 5)),
            part("summary: ", tx.compact_text(F.col("summary"), 260)),
        ),
    )


def prompt_rows(units: DataFrame, header: Column, line: Column, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """Batch-inference input: one text per unit, a header then the ordered lines of its members.

    The unit is bounded by construction (a chunk or one write call).
    """
    got = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return units.groupBy(*keys).agg(got.alias("_l"), F.min(header).alias("_h")).select(
        *keys,
        F.concat(F.lit("Input context:\n"), F.col("_h"), F.lit("\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).alias("prompt"),
    )


def with_scorer(df: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """User scorer over prompt rows: ``scorer(batch iterator) -> batch iterator`` in Arrow batches."""
    return df.mapInPandas(scorer, schema)


def with_boxes(df: DataFrame, provider: Callable, column: str = "content") -> DataFrame:
    """User box provider: a function from a pandas Series of images to a Series of box lists, as a vectorised UDF."""
    boxes = F.pandas_udf(provider, "array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return df.withColumn("boxes", boxes(F.col(column)))

"""Subtitle tables: parsing, normalising, source choice and text output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_srt_time, round_at, srt_time, srt_time_ms
from ..functions.text import WS, strip
from .ordered import with_ordinal

K = ["video_id"]
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SEGMENT_JSON = (
    "array<struct<segment_id:string,start_sec:double,start:double,end_sec:double,end:double,text:string>>"
)


def _blocks(content: Column) -> Column:
    """Cue blocks of an SRT text as arrays of trimmed non-blank lines."""
    norm = F.regexp_replace(F.regexp_replace(content, r"^\x{feff}+", ""), r"\r\n?", "\n")
    return F.transform(
        F.split(norm, "\n\n"),
        lambda b: F.filter(F.transform(F.split(b, LINE_BREAK), strip), lambda ln: ln != ""),
    )


def _timing_at(lines: Column) -> Column:
    """1-based index of the first line with an arrow, 0 when there is none."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x.contains("-->")), True), F.lit(0)).cast("int")


def _first_word(c: Column) -> Column:
    return F.regexp_extract(strip(c), r"^([^\s]+)", 1)


def parse_srt(files: DataFrame, content: str = "content", keys: Sequence[str] = K) -> DataFrame:
    """SRT texts to segment rows; ids are numbered after empty and non-positive cues are dropped.

    The whole text of a file is one value, so the parse stays inside the row.
    """

    def cue(lines: Column) -> Column:
        at = _timing_at(lines)
        timing = F.get(lines, at - 1)
        return F.struct(
            parse_srt_time(_first_word(F.regexp_extract(timing, r"^(.*?)-->", 1))).alias("start_sec"),
            parse_srt_time(_first_word(F.regexp_extract(timing, r"^.*?-->(.*)$", 1))).alias("end_sec"),
            strip(F.array_join(F.slice(lines, at + 1, F.size(lines)), " ")).alias("text"),
            (at > 0).alias("timed"),
        )

    cues = F.filter(
        F.transform(_blocks(F.col(content)), cue),
        lambda c: c["timed"] & (c["text"] != "") & (c["end_sec"] > c["start_sec"]),
    )
    return files.select(*keys, F.posexplode(cues).alias("_p", "c")).select(
        *keys,
        F.format_string("sub_%04d", F.col("_p") + 1).alias("segment_id"),
        (F.col("_p") + 1).alias("seq"),
        round_at(F.col("c.start_sec"), 3).alias("start_sec"),
        round_at(F.col("c.end_sec"), 3).alias("end_sec"),
        F.col("c.text").alias("text"),
    )


def compact_srt(files: DataFrame, content: str = "content", keys: Sequence[str] = K) -> DataFrame:
    """One ``[start-end] body`` line per cue: white space collapsed first, then ``<tags>`` removed."""

    def line(lines: Column) -> Column:
        at = _timing_at(F.slice(lines, 1, 3))
        timing = F.get(lines, at - 1)
        parts = F.split(timing, "-->")
        body = F.array_join(F.slice(lines, at + 1, F.size(lines)), " ")
        body = F.regexp_replace(strip(F.regexp_replace(body, f"{WS}+", " ")), "<[^>]+>", "")
        return F.when(
            (at > 0) & (body != ""),
            F.concat(F.lit("["), strip(F.get(parts, F.lit(0))), F.lit("-"), strip(F.get(parts, F.lit(1))), F.lit("] "), body),
        )

    rows = F.filter(F.transform(_blocks(F.col(content)), line), lambda x: x.isNotNull())
    return files.select(*keys, F.posexplode(rows).alias("_p", "line")).select(
        *keys, (F.col("_p") + 1).alias("line_no"), "line"
    )


def segments_from_json(files: DataFrame, content: str = "content", keys: Sequence[str] = K) -> DataFrame:
    """Sidecar JSON, a list or ``{segments: [...]}``, to raw segment rows with their input position."""
    c = F.col(content)
    listed = F.from_json(c, SEGMENT_JSON)
    held = F.from_json(c, f"struct<segments:{SEGMENT_JSON}>")["segments"]
    seg = F.when(F.ltrim(c).startswith("["), listed).otherwise(held)
    return files.select(*keys, F.posexplode(seg).alias("_p", "s")).select(
        *keys,
        (F.col("_p") + 1).alias("seq"),
        "s.segment_id",
        F.coalesce("s.start_sec", "s.start").alias("start_sec"),
        F.coalesce("s.end_sec", "s.end").alias("end_sec"),
        "s.text",
    )


def normalize_segments(raw: DataFrame) -> DataFrame:
    """Trim, default and round; drop blank or non-positive segments; default ids use the input position ``seq``."""
    start = F.coalesce("start_sec", F.lit(0.0))
    end = F.coalesce(F.nullif("end_sec", F.lit(0.0)), start)
    text = strip(F.coalesce("text", F.lit("")))
    given = F.nullif("segment_id", F.lit(""))
    return (
        raw.withColumn("_s", start).withColumn("_e", end).withColumn("_t", text)
        .where((F.col("_t") != "") & (F.col("_e") > F.col("_s")))
        .select(
            *[c for c in raw.columns if c not in ("segment_id", "start_sec", "end_sec", "text")],
            F.coalesce(given, F.format_string("sub_%04d", "seq")).alias("segment_id"),
            round_at(F.col("_s"), 3).alias("start_sec"),
            round_at(F.col("_e"), 3).alias("end_sec"),
            F.col("_t").alias("text"),
        )
    )


def from_utterances(raw: DataFrame) -> DataFrame:
    """Recognised speech in milliseconds to segments in seconds; text falls back to transcript."""
    text = strip(F.coalesce(F.nullif("text", F.lit("")), "transcript", F.lit("")))
    return (
        raw.withColumn("_t", text)
        .where(F.col("_t") != "")
        .select(
            *[c for c in raw.columns if c not in ("start_time", "end_time", "text", "transcript")],
            F.format_string("sub_%04d", "seq").alias("segment_id"),
            round_at(F.coalesce("start_time", F.lit(0)) / 1000.0, 3).alias("start_sec"),
            round_at(F.coalesce("end_time", F.lit(0)) / 1000.0, 3).alias("end_sec"),
            F.col("_t").alias("text"),
        )
    )


def resolve_source(videos: DataFrame, sources: list[tuple[str, DataFrame]], keys: Sequence[str] = K) -> DataFrame:
    """Segments of the first source, in list order, that a video has; videos with none get one 'empty' row."""
    tagged = None
    for rank, (name, df) in enumerate(sources):
        part = df.select(*keys, F.lit(rank).alias("_rank"), F.lit(name).alias("source"), "segment_id", "start_sec", "end_sec", "text")
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    kept = tagged.join(best, list(keys)).where(F.col("_rank") == F.col("_best")).drop("_rank", "_best")
    empty = videos.select(*keys).distinct().join(best.select(*keys), list(keys), "left_anti")
    return kept.withColumn("warning", F.lit(None).cast("string")).unionByName(
        empty.select(
            *keys,
            F.lit("empty").alias("source"),
            *[F.lit(None).cast(t).alias(c) for c, t in (("segment_id", "string"), ("start_sec", "double"), ("end_sec", "double"), ("text", "string"))],
            F.lit("online_asr_disabled").alias("warning"),
        )
    )


def srt_cues(segments: DataFrame, bucket: Column, keys: Sequence[str] = K) -> DataFrame:
    """SRT cue text per segment; the number is the input position even when a blank segment is skipped."""
    d = with_ordinal(segments, keys, [F.col("seq")], bucket, "cue_no")
    return d.where(strip(F.col("text")) != "").select(
        *keys,
        "cue_no",
        F.concat(
            F.col("cue_no").cast("string"), F.lit("\n"), srt_time(F.col("start_sec")), F.lit(" --> "),
            srt_time(F.col("end_sec")), F.lit("\n"), strip(F.col("text")), F.lit("\n"),
        ).alias("cue"),
    )


def srt_cues_ms(utterances: DataFrame, bucket: Column, keys: Sequence[str] = K) -> DataFrame:
    """Same from milliseconds, but blank and non-positive rows are dropped before numbering."""
    text = strip(F.coalesce(F.nullif("text", F.lit("")), "transcript", F.lit("")))
    kept = utterances.withColumn("_t", text).where((F.col("_t") != "") & (F.col("end_time") > F.col("start_time")))
    d = with_ordinal(kept, keys, [F.col("seq")], bucket, "cue_no")
    return d.select(
        *keys,
        "cue_no",
        F.concat(
            F.col("cue_no").cast("string"), F.lit("\n"), srt_time_ms(F.col("start_time")), F.lit(" --> "),
            srt_time_ms(F.col("end_time")), F.lit("\n"), F.col("_t"), F.lit("\n"),
        ).alias("cue"),
    )


def txt_lines(utterances: DataFrame) -> DataFrame:
    """Non-blank text lines in order."""
    return utterances.withColumn("line", strip(F.col("text"))).where("line != ''").drop("text")


def concat_pages(pages: DataFrame, keys: Sequence[str], order: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Pages of a document as one text in page order (the document is the output value)."""
    got = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return pages.groupBy(*keys).agg(got.alias("_p")).select(
        *keys, F.array_join(F.transform("_p", lambda p: p["t"]), sep).alias("document"), F.size("_p").alias("n_pages")
    )


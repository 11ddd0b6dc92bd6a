"""Integrity checks over outline, bodies and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import missing_keys


def contract_check(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per-file status and the missing ``line_n:key`` rows of line-JSON files (path, line_no, line)."""
    gaps = rows.select("path", "line_no", F.explode(missing_keys(F.col("line"), required)).alias("key")).select(
        "path", F.concat(F.lit("line_"), F.col("line_no"), F.lit(":"), F.col("key")).alias("missing")
    )
    report = rows.groupBy("path").agg(
        F.sum(F.size(missing_keys(F.col("line"), required))).alias("n_missing")
    ).withColumn("status", F.when(F.col("n_missing") > 0, "failed").otherwise("passed"))
    return report, gaps


def json_checks(files: DataFrame) -> DataFrame:
    """Parse status per file of (path, line): failed when any line does not parse."""
    from ..functions.jsontext import json_valid

    return files.groupBy("path").agg(F.count_if(~json_valid(F.col("line"))).alias("bad_lines")).withColumn(
        "status", F.when(F.col("bad_lines") > 0, "failed").otherwise("passed")
    )


def orphan_refs(chapter_shots: DataFrame, heads: DataFrame, sub_shots: DataFrame, sub_heads: DataFrame, cards: DataFrame) -> DataFrame:
    """Distinct outline references without a target: video_id, shot_id.

    ``chapter_shots``: video_id, chapter_id, shot_id. ``heads``: video_id, shot_id (representatives).
    ``sub_shots``: video_id, chapter_id, subsection_id, shot_id. ``sub_heads`` likewise, one per subsection.
    """
    k, kc = ["video_id", "shot_id"], ["video_id", "chapter_id", "shot_id"]
    ks = ["video_id", "chapter_id", "subsection_id", "shot_id"]
    # Each reference is looked up once, however often it is made.
    made = chapter_shots.select(*k).unionByName(heads.select(*k)).unionByName(sub_shots.select(*k)).distinct()
    lost = [
        made.join(cards.select(*k), k, "left_anti"), sub_shots.join(chapter_shots.select(*kc), kc, "left_anti"), sub_heads.join(sub_shots.select(*ks), ks, "left_anti"),
    ]
    out = lost[0].select(*k)
    for part in lost[1:]:
        out = out.unionByName(part.select(*k))
    return out.distinct()


def chapter_ref_check(bodies: DataFrame, refs: DataFrame, outline: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows (video_id, chapter_id, shot_id, reason) of bodies outside the outline or referring outside their chapter."""
    kc, kcs = ["video_id", "chapter_id"], ["video_id", "chapter_id", "shot_id"]
    none = F.lit(None).cast("string")
    stray = bodies.select(*kc).join(outline.select(*kc), kc, "left_anti").select(*kc, none.alias("shot_id"), F.lit("missing_chapter").alias("reason"))
    empty = bodies.where(F.coalesce("body_markdown", F.lit("")) == "").join(outline.select(*kc), kc, "left_semi").select(
        *kc, none.alias("shot_id"), F.lit("missing_chapter_file").alias("reason")
    )
    bad = refs.select(*kcs).distinct().join(outline.select(*kc), kc, "left_semi").join(allowed.select(*kcs), kcs, "left_anti").select(
        *kcs, F.lit("invalid_ref").alias("reason")
    )
    return stray.unionByName(empty).unionByName(bad)


def heading_check(bodies: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """Planned titles against the level 2 to 6 headings of a body: keys, title, ord, line_no, status.

    A title is missing, out_of_order (its first heading lies before that of an earlier title) or ok.
    """
    pat = r"^\s*#{2,6}\s+(.*?)\s*$"
    heads = bodies.select(*keys, F.posexplode(F.split("body_markdown", "\n")).alias("line_no", "ln")).where(F.col("ln").rlike(pat))
    first = heads.select(*keys, F.regexp_extract("ln", pat, 1).alias("title"), "line_no").groupBy(*keys, "title").agg(F.min("line_no").alias("line_no"))
    d = planned.join(first, [*keys, "title"], "left")
    # A body has a few planned titles; the running maximum stays inside the chapter row.
    packed = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "title", "line_no"))).alias("_l"))
    x = packed.select(*keys, "_l", F.explode("_l").alias("h"))
    before = F.array_max(F.transform(F.filter("_l", lambda q: q["ord"] < F.col("h.ord")), lambda q: q["line_no"]))
    return x.select(
        *keys, "h.ord", "h.title", "h.line_no",
        F.when(F.col("h.line_no").isNull(), "missing").when(before > F.col("h.line_no"), "out_of_order").otherwise("ok").alias("status"),
    )


def qa_rollup(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Overall status with counts of failed checks and of warnings (skipped and warning)."""
    return checks.groupBy(*keys).agg(
        F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("passed").alias("status"),
        F.count_if(F.col("status") == "failed").alias("errors"),
        F.count_if(F.col("status").isin("skipped", "warning")).alias("warnings"),
        F.count(F.lit(1)).alias("checks"),
    )


def repair_lines(files: DataFrame) -> DataFrame:
    """Repair line-JSON files (path, line_no, line): file status ok, fixed or failed, and the lines to write."""
    from ..functions.jsontext import repaired_json

    d = files.withColumn("_r", repaired_json(F.col("line")))
    stat = d.groupBy("path").agg(
        F.max(F.when(F.col("_r.status") == "failed", 2).when(F.col("_r.status") == "fixed", 1).otherwise(0)).alias("_w")
    )
    return d.join(stat, "path").select(
        "path", "line_no",
        F.when(F.col("_w") == 2, "failed").when(F.col("_w") == 1, "fixed").otherwise("ok").alias("file_status"),
        F.when(F.col("_w") == 2, F.col("line")).otherwise(F.col("_r.text")).alias("line"),
    )


def reselect_frames(bodies: DataFrame, files: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Bodies whose frame has no file, with the first existing candidate: keys, frame, status."""
    from .refs import first_existing

    broken = bodies.join(files.select(F.col("path").alias("representative_frame")).distinct(), "representative_frame", "left_anti")
    found = first_existing(candidates, files, keys)
    return broken.select(*keys).join(found, keys, "left").select(
        *keys, F.col("path").alias("representative_frame"), F.when(F.col("path").isNull(), "failed").otherwise("fixed").alias("status")
    )


def collect_checks(parts: dict[str, DataFrame], key: str = "video_id") -> DataFrame:
    """Named check results (key, status) as one table: key, name, status."""
    out = None
    for name, df in parts.items():
        part = df.select(key, F.lit(name).alias("name"), "status")
        out = part if out is None else out.unionByName(part)
    return out


def qa_suite(
    videos: DataFrame, cards: DataFrame, outline: DataFrame, chapter_shots: DataFrame, heads: DataFrame, sub_shots: DataFrame, sub_heads: DataFrame,
    planned: DataFrame, bodies: DataFrame, refs: DataFrame, files: DataFrame,
) -> DataFrame:
    """All table checks of a library: video_id, name, status, n_bad; `qa_rollup` sums them up.

    ``outline``: video_id, chapter_id. ``planned``: video_id, chapter_id, ord, title of subsections. ``bodies``: video_id,
    chapter_id, body_markdown, representative_frame, warnings. ``refs``: video_id, chapter_id, shot_id named by bodies.
    ``files``: path. The others as in `orphan_refs`. A check whose inputs a video lacks is ``skipped``; null counts as empty.
    """
    key, kc = "video_id", ["video_id", "chapter_id"]
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    some = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    lost_frames = bodies.join(files.select(F.col("path").alias("representative_frame")).distinct(), "representative_frame", "left_anti")
    headed = bodies.join(planned.select(*kc).distinct(), kc, "left_semi").select(*kc, F.coalesce("body_markdown", F.lit("")).alias("body_markdown"))
    titles = planned.join(bodies.select(*kc), kc, "left_semi")
    told = bodies.select(key, F.explode(F.filter("warnings", lambda w: w.contains("oversized_subsection"))).alias("w"))
    bad = {
        "outline_shot_refs": orphan_refs(chapter_shots, heads, sub_shots, sub_heads, cards),
        "chapter_images": lost_frames,
        "chapter_body": bodies.where(blank("body_markdown")),
        "chapter_refs": chapter_ref_check(bodies.withColumn("body_markdown", F.lit("-")), refs, outline, chapter_shots),
        "chapter_subsection_body": heading_check(headed, titles, kc).where("status <> 'ok'"),
        "chapter_write_warnings": told,
    }
    needs = {
        "outline_shot_refs": ("_outline", "_cards"), "chapter_images": ("_bodies",), "chapter_body": ("_bodies",), "chapter_refs": ("_bodies", "_outline"),
        "chapter_subsection_body": ("_bodies", "_outline"), "chapter_write_warnings": ("_bodies",),
    }
    # one row per failing item, counted once for all checks
    items = None
    for name, df in bad.items():
        part = df.select(key, F.lit(name).alias("name"))
        items = part if items is None else items.unionByName(part)
    counts = items.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n_bad"))
    have = videos.select(key).distinct()
    for name, df in (("_outline", outline), ("_cards", cards), ("_bodies", bodies)):
        have = have.join(some(df, name), key, "left")
    ready = lambda cols: F.coalesce(*[F.when(F.col(c).isNull(), False) for c in cols], F.lit(True))
    wanted = have.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ready(c).alias("ready")) for n, c in needs.items()])).alias("c"))
    d = wanted.select(key, "c.name", "c.ready").join(counts, [key, "name"], "left").na.fill(0, ["n_bad"])
    failing = F.when(F.col("name") == "chapter_write_warnings", "warning").otherwise("failed")
    return d.select(key, "name", F.when(~F.col("ready"), "skipped").when(F.col("n_bad") > 0, failing).otherwise("passed").alias("status"), F.when(F.col("ready"), F.col("n_bad")).otherwise(0).alias("n_bad"))

"""Report tables: galleries, markdown structure, chapter rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mmss
from ..functions.text import strip


def gallery(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Images of a chapter in shot order; the first use of a path wins.

    ``frames``: keys, shot_ord, shot_id, start_sec, cand_ord, path. The label counts the kept frames of the
    shot and its candidates.
    """
    ids = [*keys, "shot_ord", "shot_id", "start_sec"]
    first = frames.groupBy(*keys, "path").agg(F.min(F.struct("shot_ord", "cand_ord")).alias("_f"))
    n = frames.groupBy(*keys, "shot_ord").agg(F.count_distinct("path").alias("_n"))
    kept = first.select(*keys, "path", F.col("_f.shot_ord").alias("shot_ord"), F.col("_f.cand_ord").alias("cand_ord")).join(
        frames.select(*ids).distinct(), [*keys, "shot_ord"]
    ).join(n, [*keys, "shot_ord"])
    w = Window.partitionBy(*keys, "shot_ord").orderBy("cand_ord", "path")  # frames of one shot
    i = F.row_number().over(w)
    t = mmss(F.col("start_sec"))
    label = F.concat_ws(
        " · ", F.col("shot_id").cast("string"), F.when(t != "", t), F.when(F.col("_n") > 1, F.concat(i.cast("string"), F.lit("/"), F.col("_n").cast("string")))
    )
    return kept.select(*keys, "shot_ord", "cand_ord", "path", label.alias("label"))


def gallery_slots(images: DataFrame, keys: Sequence[str], visible: int = 6) -> DataFrame:
    """First image is main, the next six are thumbs, the rest go to the drawer (top ranks only need a limit)."""
    w = Window.partitionBy(*keys).orderBy("shot_ord", "cand_ord")
    top = images.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= visible + 1)
    slot = F.when(F.col("_rn") == 1, "main").otherwise("thumb")
    head = top.select(*keys, "path", slot.alias("slot"))
    rest = images.join(head.select(*keys, "path"), [*keys, "path"], "left_anti").select(*keys, "path", F.lit("drawer").alias("slot"))
    return head.unionByName(rest)


def _kind(line: Column) -> Column:
    t = strip(line)
    return (
        F.when(t.startswith("```"), "fence")
        .when(t == "", "blank")
        .when(t.rlike(r"^#{1,6}\s+\S"), "heading")
        .when(t.rlike(r"^[-*_]\s*[-*_]\s*[-*_]\s*$"), "hr")
        .when(t.startswith(">"), "quote")
        .when(line.rlike(r"^\s*[-*+]\s+.+$"), "ul")
        .when(line.rlike(r"^\s*\d+[.)]\s+.+$"), "ol")
        .otherwise("paragraph")
    )


def markdown_lines(bodies: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Typed lines of markdown texts: keys, line_no, kind, level, block_no, text.

    A text is one row, so fence parity and block numbers are windows over the lines of that text.
    """
    text = F.regexp_replace(F.col(body), r"\r\n?", "\n")
    d = bodies.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    w = Window.partitionBy(*keys).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_f", strip(F.col("text")).startswith("```"))
    inside = F.coalesce(F.sum(F.col("_f").cast("int")).over(upto), F.lit(0)) % 2 == 1
    d = d.withColumn("_in", inside).withColumn("_k", _kind(F.col("text")))
    d = d.withColumn("kind", F.when(F.col("_f") | F.col("_in"), "code").otherwise(F.col("_k")))
    opens = (
        F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind"))
        | F.col("kind").isin("heading", "hr", "quote") | (F.col("_f") & ~F.col("_in"))
    )
    d = d.withColumn("_o", opens.cast("int"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(strip(F.col("text")), r"^(#{1,6})", 1))).otherwise(0)
    return d.select(*keys, "line_no", "kind", level.alias("level"), F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("block_no"), "text")


def markdown_profile(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Line counts per kind over a corpus."""
    return markdown_lines(bodies, ["doc_id"], body).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))


def report_rows(chapters: DataFrame, bodies: DataFrame, refs: DataFrame, images: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(chapter rows, per-video header). ``chapters``: video_id, keys, chapter_no, title."""
    n_ref = refs.groupBy(*keys).agg(F.count_distinct("shot_id").alias("ref_count"))
    n_img = images.groupBy(*keys).agg(F.count(F.lit(1)).alias("image_count"))
    rows = chapters.join(bodies, list(keys), "left").join(n_ref, list(keys), "left").join(n_img, list(keys), "left").na.fill(0, ["ref_count", "image_count"])
    head = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum("image_count").alias("keyframes"))
    return rows, head

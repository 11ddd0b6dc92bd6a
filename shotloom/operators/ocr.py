"""Recognised text and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import recognised_texts


def explode_ocr(df: DataFrame, keys: Sequence[str], result: str, min_score: float = 0.0) -> DataFrame:
    """Texts of JSON recognition results: low scores dropped, cleaned, first occurrence kept, in reading order, at any depth."""
    d = df.select(*keys, F.posexplode(recognised_texts(result, min_score)).alias("_p", "text"))
    return d.select(*keys, (F.col("_p") + 1).alias("ord"), "text")


def enclosing_box(boxes: DataFrame, images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest box around all boxes of an image; an image without boxes gets the zero box."""
    got = boxes.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return images.select(*keys).join(got, list(keys), "left").na.fill(0.0, ["x0", "y0", "x1", "y1"])


def sheet_bounds(
    cells: DataFrame, merges: DataFrame, images: DataFrame, keys: Sequence[str], max_rows: int | None = None
) -> DataFrame:
    """1-based row and column range of non-empty cells, merged ranges and 0-based image anchors, under a row cap."""
    cap = F.lit(max_rows) if max_rows is not None else F.lit(2**31 - 1)
    a = cells.where(F.col("value").isNotNull() & (F.col("row") <= cap)).select(
        *keys, F.col("row").alias("r1"), F.col("row").alias("r2"), F.col("col").alias("c1"), F.col("col").alias("c2")
    )
    b = merges.withColumn("r2", F.least("r2", cap)).where("r1 <= r2").select(*keys, "r1", "r2", "c1", "c2")
    c = images.where(F.col("row0") + 1 <= cap).select(
        *keys, (F.col("row0") + 1).alias("r1"), (F.col("row0") + 1).alias("r2"), (F.col("col0") + 1).alias("c1"), (F.col("col0") + 1).alias("c2")
    )
    return a.unionByName(b).unionByName(c).groupBy(*keys).agg(
        F.min("r1").alias("min_row"), F.max("r2").alias("max_row"), F.min("c1").alias("min_col"), F.max("c2").alias("max_col")
    )

"""Hard negatives by Four-Russians scoring: subset-sum tables of anchors, looked up with packed bit-planes of candidates.

Components are whole numbers. Eight components of an anchor make a table of their 256 subset sums; the bits of one weight in
the same eight components of a candidate make a byte. The sum of the looked-up entries over all groups of eight, shifted by the
weight and added over all bit-planes, is the exact inner product.

Anchors and candidates meet in cells of one anchor block and one candidate block. A cell scores its block against all of its
anchors and gives back only the first few rows of each list, so work spreads evenly whatever the labels are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.common import released, ship
from shotloom.operators.staging import materialize

#: Candidates and anchors of a block, about.
CANDIDATES, ANCHORS = 2048, 1024
#: Bytes of subset-sum tables held at once.
TABLE_BYTES = 16 << 20
GROUP = 8


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Packed two's-complement planes, lowest weight first: planes x groups x rows, one byte for eight components."""
    values = np.pad(values, ((0, 0), (0, -values.shape[1] % GROUP)))
    bits = ((values[None] >> np.arange(planes)[:, None, None]) & 1).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little").transpose(0, 2, 1))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: the sums of every subset of each eight components."""
    n = anchors.shape[0]
    parts = np.pad(anchors, ((0, 0), (0, -anchors.shape[1] % GROUP))).T.reshape(-1, GROUP, n)
    table = np.zeros((len(parts), 1 << GROUP, n), anchors.dtype)
    for j in range(GROUP):
        table[:, 1 << j:2 << j] = table[:, :1 << j] + parts[:, j, None]
    return table


def scores(planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, candidates x anchors, by shifting and adding looked-up subset sums; the top plane is the sign."""
    groups = planes.shape[1]
    out = np.zeros((planes.shape[2], len(anchors)), anchors.dtype)
    step = max(1, TABLE_BYTES // max(1, groups * (1 << GROUP) * anchors.itemsize))
    for lo in range(0, len(anchors), step):
        table = subset_sums(anchors[lo:lo + step])
        total = np.zeros((planes.shape[2], table.shape[2]), anchors.dtype)
        for p in range(len(planes) - 1, -1, -1):
            total <<= 1
            for g in range(groups):
                looked_up = table[g].take(planes[p, g], axis=0)
                if p == len(planes) - 1:
                    total -= looked_up
                else:
                    total += looked_up
        out[:, lo:lo + step] = total
    return out


def items(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v (whole numbers): the rows that take part."""
    x = lambda c: F.floor(c.cast("double") * scale)
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    some = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & usable)
    rows = some.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", x).alias("v"))
    # of rows that share an id the largest counts; the partial maximum runs in each task, so a common id is no hot key
    return rows.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("_m")).select("vec_id", "_m.label", "_m.v")


def _matrix(column, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def hard_negatives(
    vectors: DataFrame, anchors_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id (whole number), label, embedding (array of numbers). A component becomes floor(scale * x), a score is the
    exact inner product. Anchors are the rows whose id is divisible by ``anchors_every``, positives the first ``positives`` other
    rows of an anchor's label, negatives the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Rows that share an id are one item,
    the largest by label and then vector. A shorter vector counts as filled up with zeros; an empty one scores 0. An anchor without
    positives, and a positive without negatives in its range, give no row. An empty table gives an empty result. Other columns are
    ignored, whatever their names. Scores are longs: if components are so large that a score may pass 63 bits, a ValueError says so.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(items(vectors, scale))
    top = F.array_max(F.transform("v", lambda c: F.greatest(c, -c - 1)))
    n, n_anchors, dims, most = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % anchors_every == 0), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(top), F.lit(0))).first()
    planes = int(most).bit_length() + 1
    if dims * (most + 1) << planes >= 1 << 63:
        raise ValueError("components are too large for scores of 63 bits")
    kind = np.int32 if dims * (most + 1) << planes < 1 << 31 else np.int64
    blocks, anchor_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-n_anchors // ANCHORS))
    dims = max(1, dims)

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["label", "vec_id"])
        packed = bit_planes(_matrix(g["v"], dims), planes)
        return pd.DataFrame({"cb": g["cb"].iloc[:1], "ids": [g["vec_id"].to_numpy(np.int64).tobytes()], "labels": [g["label"].to_numpy(np.int64).tobytes()], "planes": [packed.tobytes()]})

    def pack_anchors(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["label", "vec_id"])
        return pd.DataFrame({"ab": g["ab"].iloc[:1], "a_ids": [g["vec_id"].to_numpy(np.int64).tobytes()], "a_labels": [g["label"].to_numpy(np.int64).tobytes()], "a_values": [_matrix(g["v"], dims).astype(kind).tobytes()]})

    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    packed = materialize(rows.withColumn("cb", block(blocks)).groupBy("cb").applyInPandas(pack, "cb int, ids binary, labels binary, planes binary"))
    asking = rows.filter(F.col("vec_id") % anchors_every == 0)
    asked = materialize(asking.withColumn("ab", block(anchor_blocks)).groupBy("ab").applyInPandas(pack_anchors, "ab int, a_ids binary, a_labels binary, a_values binary"))

    def cells(anchor_side: DataFrame) -> DataFrame:
        """Every candidate block with every anchor block, by one key that no two cells share."""
        left = packed.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
        right = anchor_side.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.join(right.hint("merge"), ["cb", "ab"])  # a shuffle, whose partitions bound what a task holds

    def opened(r) -> tuple[np.ndarray, ...]:
        ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
        a_ids, a_labels = np.frombuffer(r.a_ids, np.int64), np.frombuffer(r.a_labels, np.int64)
        return ids, labels, np.frombuffer(r.planes, np.uint8).reshape(planes, -1, len(ids)), a_ids, a_labels, np.frombuffer(r.a_values, kind).reshape(len(a_ids), dims)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First other rows of each anchor's label in a cell; only rows of that label are scored."""
        for b in batches:
            for r in b.itertuples(index=False):
                ids, labels, bits, a_ids, a_labels, values = opened(r)
                for label in np.unique(a_labels):
                    own, who = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                    if not len(own):
                        continue
                    got = scores(np.ascontiguousarray(bits[:, :, own[0]:own[-1] + 1]), values[who]).astype(np.int64)
                    order = np.argsort(-got, axis=0, kind="stable")[:positives + 1]  # rows of a label stand by id
                    at = np.broadcast_to(np.arange(len(who)), order.shape)
                    found = pd.DataFrame({"anchor_id": a_ids[who][at].ravel(), "positive_id": ids[own][order].ravel(), "positive_score": got[order, at].ravel(), "ab": r.ab})
                    yield found[found["anchor_id"] != found["positive_id"]]

    def firsts(df: DataFrame, keys: list[str], score: str, name: str, most_rows: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc(score), F.col(name))
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most_rows)

    near = cells(asked).mapInPandas(released(nearest), "anchor_id bigint, positive_id bigint, positive_score bigint, ab int")
    chosen = firsts(near, ["anchor_id"], "positive_score", "positive_id", positives)
    # at most `positives` for each anchor of a block
    lists = chosen.groupBy("ab").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("pairs"))
    ready = materialize(asked.join(lists, "ab"))

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """First rows of another label in the range of each anchor and positive in a cell."""
        for b in batches:
            for r in b.itertuples(index=False):
                ids, labels, bits, a_ids, a_labels, values = opened(r)
                by_id = np.argsort(ids)
                ids, labels = ids[by_id], labels[by_id]
                place = {int(a): i for i, a in enumerate(a_ids)}
                got = scores(np.ascontiguousarray(bits[:, :, by_id]), values).astype(np.int64)
                order = np.argsort(-got, axis=0, kind="stable")
                out = []
                for p in r.pairs:
                    s = int(p["positive_score"])
                    least, greatest = -(-low * s // 100), high * s // 100
                    if least > greatest:
                        continue
                    i = place[int(p["anchor_id"])]
                    down = got[order[:, i], i]
                    a, z = np.searchsorted(-down, [-greatest, 1 - least])
                    hits = order[a:z, i]
                    hits = hits[labels[hits] != a_labels[i]][:negatives]
                    out.append(pd.DataFrame({"anchor_id": a_ids[i], "positive_id": p["positive_id"], "positive_score": s, "negative_id": ids[hits], "negative_score": got[hits, i]}))
                if out:
                    yield pd.concat(out)

    hard = cells(ready).mapInPandas(released(within), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    return firsts(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql(anchors_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> str:
    return f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({scale} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % {anchors_every} = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= {negatives}"""

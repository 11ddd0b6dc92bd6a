"""Order-dependent steps that stay parallel inside one large group.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. A single video
may hold a third of a table, so every helper here works on ``(keys, bucket)``
instead, where ``bucket`` is a column that never decreases along the order. Only
one summary row per bucket is ever windowed by the bare key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def id_bucket(c: Column, width: int = 65536) -> Column:
    """Order-preserving bucket of a numeric order column."""
    return F.floor(c / F.lit(width))


def with_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, out: str = "ord",
    total: str | None = None,
) -> DataFrame:
    """1-based position inside each key group; ``total`` names an extra column with the group size.

    Rows are numbered inside ``(keys, bucket)``; the running total of earlier
    buckets is added. The bucket counts come from a narrow scan with map-side
    partial aggregation.
    """
    tagged = df.withColumn("_b", bucket)
    rn = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    sizes = tagged.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*keys)).cast("int").alias(total)] if total else []
    starts = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *extra)
    return (
        tagged.withColumn("_rn", rn)
        .join(starts, [*keys, "_b"])
        .withColumn(out, (F.col("_start") + F.col("_rn")).cast("int"))
        .drop("_b", "_rn", "_start")
    )


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str,
    how: str = "sum", inclusive: bool = True,
) -> DataFrame:
    """Running ``sum`` or ``max`` of ``value`` along the order, by bucket totals plus in-bucket windows."""
    fn = {"sum": F.sum, "max": F.max}[how]
    tagged = df.withColumn("_b", bucket).withColumn("_val", value)
    upto = 0 if inclusive else -1
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    totals = tagged.groupBy(*keys, "_b").agg(fn("_val").alias("_tot"))
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", fn("_tot").over(wk).alias("_prior"))
    got = tagged.withColumn("_in", fn("_val").over(w)).join(totals, [*keys, "_b"])
    zero = F.lit(0)
    both = F.coalesce("_in", zero) + F.coalesce("_prior", zero) if how == "sum" else F.greatest("_in", "_prior")
    return got.withColumn(out, both).drop("_b", "_val", "_in", "_prior")


def with_neighbors(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    prev: dict[str, str] | None = None,
    next_: dict[str, str] | None = None,
) -> DataFrame:
    """Values of the previous / next row: ``{new_column: source_column}``.

    Inside a bucket this is ``lag`` / ``lead``; at a bucket edge the value comes
    from the last / first row of the neighbouring non-empty bucket.
    """
    prev, next_ = prev or {}, next_ or {}
    tagged = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    wk = Window.partitionBy(*keys).orderBy("_b")
    head = F.struct(*order, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(next_.values())])
    tail = F.struct(*order, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(prev.values())])
    edges = tagged.groupBy(*keys, "_b").agg(F.min(head).alias("_nb_head"), F.max(tail).alias("_nb_tail"))
    edges = edges.select(
        *keys, "_b", F.lag("_nb_tail").over(wk).alias("_nb_tail"), F.lead("_nb_head").over(wk).alias("_nb_head")
    )
    out = tagged.withColumn("_nb_first", F.lag(F.lit(1)).over(w).isNull()).withColumn(
        "_nb_last", F.lead(F.lit(1)).over(w).isNull()
    )
    for name, src in prev.items():
        out = out.withColumn(name, F.lag(src).over(w))
    for name, src in next_.items():
        out = out.withColumn(name, F.lead(src).over(w))
    out = out.join(edges, [*keys, "_b"])
    for i, name in enumerate(prev):
        out = out.withColumn(name, F.when(F.col("_nb_first"), F.col(f"_nb_tail._v{i}")).otherwise(F.col(name)))
    for i, name in enumerate(next_):
        out = out.withColumn(name, F.when(F.col("_nb_last"), F.col(f"_nb_head._v{i}")).otherwise(F.col(name)))
    return out.drop("_b", "_nb_first", "_nb_last", "_nb_head", "_nb_tail")


def halo_blocks(df: DataFrame, ord_col: str, before: int, after: int, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Cut a dense 1-based order into blocks that each also hold their neighbours' edge rows.

    Adds ``_blk`` and ``_home``. A frame of at most ``before`` rows back and
    ``after`` rows ahead over ``(keys, _blk)`` is exact on the ``_home`` rows.
    """
    p = F.col(ord_col) - 1
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((p - after) / block))
    last = F.floor((p + before) / block)
    return df.withColumn("_blk", F.explode(F.sequence(first, last))).withColumn(
        "_home", F.col("_blk") == F.floor(p / block)
    )


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, Column], buckets: int = 65536
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: ``{name: probability column over keys}``.

    Equal values are counted first, then placed by running counts inside value
    slices, so no task ever holds all values of a key.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    counted = counted.withColumn("_b", F.floor(F.col("_v") * buckets))
    slices = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*keys)
    slices = slices.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(wk), F.lit(0)).alias("_start"),
        F.sum("_n").over(wt).alias("_total"),
    )
    wb = Window.partitionBy(*keys, "_b").orderBy("_v")
    placed = (
        counted.withColumn("_upto", F.sum("_c").over(wb))
        .join(slices, [*keys, "_b"])
        .withColumn("_hi", F.col("_start") + F.col("_upto"))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    aggs = [F.max("_total").alias("n_values")]
    for name, p in probs.items():
        pos = p * (F.col("_total") - 1)
        for tag, at in (("a", F.floor(pos)), ("z", F.ceil(pos))):
            hit = (F.col("_lo") <= at) & (at < F.col("_hi"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_{name}_f"))
    got = placed.groupBy(*keys).agg(*aggs)
    return got.select(
        *keys,
        "n_values",
        *[
            (F.col(f"_{n}_a") + (F.col(f"_{n}_z") - F.col(f"_{n}_a")) * F.col(f"_{n}_f")).alias(n)
            for n in probs
        ],
    )


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark prunes to ``k`` per partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def entry_states(blocks: DataFrame, keys: Sequence[str], fn: str = "fn", at: str = "_blk") -> DataFrame:
    """State in which each block of an order-dependent fold begins: keys, at, entry_state, entry_count.

    ``fn`` maps every state a block may begin in to ``struct<r, k>``: the state after the block and a count gained
    in it. Blocks numbered without a hole are composed by doubling (log2 rounds of equality joins over one
    row per block), so a fold over a huge group needs no single task. State 0 is the start state, also
    after a hole.
    """
    from .staging import materialize

    cur = materialize(blocks.select(*keys, at, F.col(at).alias("_lo"), fn))
    span = cur.groupBy(*keys).agg((F.max(at) - F.min(at) + 1).alias("n")).agg(F.max("n")).first()[0] or 0
    step = 1
    while step < span:
        prev = cur.select(*keys, (F.col(at) + step).alias(at), F.col("_lo").alias("_plo"), F.col(fn).alias("_pf"))
        joined = cur.join(prev, [*keys, at], "left")
        meets = F.col("_pf").isNotNull() & (F.col("_lo") == F.col(at) - step + 1)
        then = lambda s: F.try_element_at(F.col(fn), s["r"])
        both = F.transform_values(
            "_pf", lambda _, s: F.struct(then(s)["r"].alias("r"), (s["k"] + then(s)["k"]).alias("k"))
        )
        cur = materialize(
            joined.select(*keys, at, F.when(meets, F.col("_plo")).otherwise(F.col("_lo")).alias("_lo"), F.when(meets, both).otherwise(F.col(fn)).alias(fn))
        )
        step *= 2
    after = cur.select(*keys, (F.col(at) + 1).alias(at), F.try_element_at(F.col(fn), F.lit(0)).alias("_s"))
    return blocks.select(*keys, at).join(after, [*keys, at], "left").select(
        *keys, at, F.coalesce("_s.r", F.lit(0)).alias("entry_state"), F.coalesce("_s.k", F.lit(0)).cast("bigint").alias("entry_count")
    )

"""Interval, ordinal-range and nearest joins inside a video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_at
from ..functions.text import strip
from .ordered import with_running

K = ["video_id"]


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_pairs(
    shots: DataFrame, segments: DataFrame, bucket_sec: float = 21600.0, keys: Sequence[str] = K, instants: bool = False
) -> DataFrame:
    """Pairs of shot and segment that share more than a touching point.

    With ``instants`` every pair where each side begins before the other ends counts, so a side without length
    is met strictly inside the other, with an overlap of 0 (below 0 for a side that ends before it begins).

    Both sides are spread over fixed time buckets and joined on
    ``(keys, bucket)``; a pair is kept only in the bucket where its overlap
    begins, so no pair appears twice and one long video fans out over many tasks.
    """
    s = shots.select(*keys, "shot_id", "start_sec", "end_sec").where(F.lit(instants) | (F.col("end_sec") > F.col("start_sec")))
    s = s.withColumn("_b", F.explode(_buckets(F.col("start_sec"), F.col("end_sec"), bucket_sec)))
    g = segments.select(
        *keys, "segment_id", F.col("seq").alias("segment_seq"),
        F.col("start_sec").alias("seg_start"), F.col("end_sec").alias("seg_end"), "text",
    ).where(F.lit(instants) | (F.col("seg_end") > F.col("seg_start")))
    g = g.withColumn("_b", F.explode(_buckets(F.col("seg_start"), F.col("seg_end"), bucket_sec)))
    ov = F.least("end_sec", "seg_end") - F.greatest("start_sec", "seg_start")
    return (
        s.join(g, [*keys, "_b"])
        .where((F.col("start_sec") < F.col("seg_end")) & (F.col("seg_start") < F.col("end_sec")))
        .where(F.col("_b") == F.floor(F.greatest("start_sec", "seg_start") / bucket_sec))
        .select(
            *keys, "shot_id", "segment_id", "segment_seq", "text",
            round_at(ov, 3).alias("overlap_sec"),
            round_at(ov / F.greatest(F.lit(0.001), F.col("seg_end") - F.col("seg_start")), 4).alias("overlap_ratio"),
        )
    )


def align_subtitles(shots: DataFrame, pairs: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Every shot with its overlapping segments in order; shots without a hit keep an empty text."""
    hits = pairs.groupBy(*keys, "shot_id").agg(
        F.sort_array(
            F.collect_list(F.struct("segment_seq", "segment_id", "overlap_sec", "overlap_ratio", "text"))
        ).alias("subtitle_segments")
    )
    spoken = F.filter(F.transform("subtitle_segments", lambda s: s["text"]), lambda t: t != "")
    return shots.join(hits, [*keys, "shot_id"], "left").select(
        *shots.columns,
        "subtitle_segments",
        F.coalesce(strip(F.array_join(F.transform(spoken, strip), " ")), F.lit("")).alias("subtitle_text"),
        F.greatest(F.size("subtitle_segments"), F.lit(0)).alias("segment_count"),
    )


def time_range_join(
    ranges: DataFrame, cards: DataFrame, bucket_sec: float = 3600.0, keys: Sequence[str] = K
) -> DataFrame:
    """Cards met by closed time ranges; reversed ranges are swapped, one known end counts for both.

    ``ranges``: keys, range_id, lo_sec, hi_sec. ``cards``: keys, shot_id, ord, start_sec, end_sec.
    """
    r = ranges.select(
        *keys, "range_id",
        F.least("lo_sec", "hi_sec").alias("_lo"), F.greatest("lo_sec", "hi_sec").alias("_hi"),
    )
    c = cards.select(
        *keys, "shot_id", "ord",
        F.coalesce("start_sec", "end_sec").alias("_s"), F.coalesce("end_sec", "start_sec").alias("_e"),
    ).where(F.col("_s").isNotNull())
    r = r.withColumn("_b", F.explode(_buckets(F.col("_lo"), F.col("_hi"), bucket_sec)))
    span = _buckets(F.least("_s", "_e"), F.greatest("_s", "_e"), bucket_sec)
    c = c.withColumn("_b", F.explode(span))
    return (
        r.join(c, [*keys, "_b"])
        .where((F.col("_s") <= F.col("_hi")) & (F.col("_e") >= F.col("_lo")))
        .where(F.col("_b") == F.floor(F.greatest(F.col("_lo"), F.least("_s", "_e")) / bucket_sec))
        .select(*keys, "range_id", "shot_id", "ord")
    )


def ordinal_range_join(refs: DataFrame, shots: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Expand ``first..last`` id pairs to all ids between by position; unknown ends give nothing.

    ``refs``: keys, ref_id, first_id, last_id. Equality joins only: two look-ups
    of the ends, then one row per position in the range.
    """
    pos = shots.select(*keys, F.col("shot_id"), F.col("ord"))
    lo = pos.select(*keys, F.col("shot_id").alias("first_id"), F.col("ord").alias("_a"))
    hi = pos.select(*keys, F.col("shot_id").alias("last_id"), F.col("ord").alias("_z"))
    return (
        refs.join(lo, [*keys, "first_id"])
        .join(hi, [*keys, "last_id"])
        .select(*keys, "ref_id", F.explode(F.sequence(F.least("_a", "_z"), F.greatest("_a", "_z"))).alias("ord"))
        .join(pos, [*keys, "ord"])
        .select(*keys, "ref_id", "shot_id", "ord")
    )


def group_hulls(claims: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """One row per key with the ordinal hulls of its few groups (drafts or sections of one outline)."""
    return (
        claims.groupBy(*keys, "group_ord")
        .agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("group_ord", "lo", "hi"))).alias("hulls"))
    )


def nearest_interval_join(points: DataFrame, groups: DataFrame, keys: Sequence[str] = K, width: int = 4096) -> DataFrame:
    """Assign each point to its containing or nearest group. ``groups``: keys, group_ord, lo, hi.

    The first group that holds a point is found on slices of ``width`` positions, the nearest end below and above by
    running maxima over one order of points and ends; so no key's groups are gathered. Ties go to the earlier group.
    Each position is looked up once; points of a key without groups are left out.
    """
    found = _held_or_between(points, groups, keys, width)
    d1, d2 = F.col("_at") - F.col("_below.v"), -F.col("_above.v") - F.col("_at")
    near = (
        F.when(d2.isNull() | (d1 < d2), F.col("_below.g")).when(d1.isNull() | (d2 < d1), F.col("_above.g")).otherwise(F.least("_below.g", "_above.g"))
    )
    found = found.select(*keys, F.col("_at").alias("ord"), F.coalesce("_held", near).alias("group_ord"))
    return points.join(found, [*keys, "ord"]).select(*points.columns, "group_ord")


def growing_group_join(points: DataFrame, groups: DataFrame, keys: Sequence[str] = K, width: int = 1024) -> DataFrame:
    """Assign each point its group by the rule of `growing_group`, without a list of a key's groups. ``groups``: keys, group_ord, lo, hi.

    Each position is looked up once; points of a key without groups are left out.
    """
    found = _held_or_between(points, groups, keys, width)
    left, right = F.col("_below.g"), F.col("_above.g")
    open_ = F.when(left.isNull(), right).when(right.isNull() | (F.col("_at") < -F.col("_above.v") - 1), left).otherwise(F.least(left, right))
    found = found.select(*keys, F.col("_at").alias("ord"), F.coalesce("_held", open_).alias("group_ord"))
    return points.join(found, [*keys, "ord"]).select(*points.columns, "group_ord")


def _held_or_between(points: DataFrame, groups: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Per position `_at`: `_held`, the first group that holds it, and `_below` and `_above`, nearest end and its first group.

    `_below` is struct<v,g>, `_above` the same with the position negated.
    """
    at = points.join(groups.select(*keys).distinct(), list(keys), "left_semi").select(*keys, F.col("ord").alias("_at")).distinct()
    pieces = groups.select(*keys, "group_ord", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("_slice"))
    held = at.withColumn("_slice", F.floor(F.col("_at") / width)).join(pieces, [*keys, "_slice"]).where("lo <= _at AND _at <= hi")
    held = held.groupBy(*keys, "_at").agg(F.min("group_ord").alias("_held"))
    ends = groups.select(*keys, "group_ord", F.explode(F.array("lo", "hi")).alias("_at")).groupBy(*keys, "_at").agg(F.min("group_ord").alias("_g"))
    both = ends.withColumn("_kind", F.lit(0)).unionByName(at.withColumn("_kind", F.lit(1)), allowMissingColumns=True).withColumn("_back", -F.col("_at"))
    end = lambda v: F.when(F.col("_g").isNotNull(), F.struct(F.col(v).alias("v"), F.col("_g").alias("g")))
    run = with_running(both, list(keys), ["_at", "_kind"], F.floor(F.col("_at") / width), end("_at"), "_below", how="max")
    run = with_running(run, list(keys), ["_back", "_kind"], F.floor(F.col("_back") / width), end("_back"), "_above", how="max")
    return run.where("_kind = 1").select(*keys, "_at", "_below", "_above").join(held, [*keys, "_at"], "left")


def growing_group(hulls: Column, ord_: Column) -> Column:
    """Group of an unclaimed position when groups grow as positions are assigned in order.

    Closed form of that process. Inside a hull: the first group holding it. In a
    gap: the group that ends just before it takes the run, except the last
    position of the gap, where the group starting just after it competes and the
    earlier group wins. Before all hulls: the first group that starts next. After
    all hulls: the group that ends last.
    """
    inside = F.filter(hulls, lambda h: (h["lo"] <= ord_) & (ord_ <= h["hi"]))
    below = F.array_max(F.transform(F.filter(hulls, lambda h: h["hi"] < ord_), lambda h: h["hi"]))
    above = F.array_min(F.transform(F.filter(hulls, lambda h: h["lo"] > ord_), lambda h: h["lo"]))
    left = F.array_min(F.transform(F.filter(hulls, lambda h: h["hi"] == below), lambda h: h["group_ord"]))
    right = F.array_min(F.transform(F.filter(hulls, lambda h: h["lo"] == above), lambda h: h["group_ord"]))
    return (
        F.when(F.size(inside) > 0, F.get(inside, F.lit(0))["group_ord"])
        .when(below.isNull(), right)
        .when(above.isNull() | (ord_ < above - 1), left)
        .otherwise(F.least(left, right))
    )


def preceding_group(firsts: Column, ord_: Column) -> Column:
    """Last group in list order whose first position is at or before the point, else group 0."""
    hit = F.filter(firsts, lambda g: g["lo"] <= ord_)
    return F.coalesce(F.array_max(F.transform(hit, lambda g: g["group_ord"])), F.lit(0))


def preceding_group_join(points: DataFrame, groups: DataFrame, keys: Sequence[str] = K, width: int = 4096) -> DataFrame:
    """Assign each point the largest group that begins at or before it, else group 0. ``groups``: keys, group_ord, lo.

    Points and beginnings are one order, cut into slices of ``width`` positions; a running maximum gives each point its
    group, so no key's groups are gathered. Points of a key without groups are left out.
    """
    wanted = points.join(groups.select(*keys).distinct(), list(keys), "left_semi")
    row = F.struct(*[F.col(c) for c in points.columns])
    marks = wanted.select(*keys, F.col("ord").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(groups.schema["group_ord"].dataType).alias("_g"), row.alias("_row"))
    begins = groups.select(*keys, F.col("lo").alias("_at"), F.lit(0).alias("_kind"), F.col("group_ord").alias("_g"))
    both = marks.unionByName(begins, allowMissingColumns=True)
    run = with_running(both, list(keys), ["_at", "_kind"], F.floor(F.col("_at") / width), F.col("_g"), "group_ord", how="max")
    return run.where("_kind = 1").select("_row.*", F.coalesce("group_ord", F.lit(0)).alias("group_ord"))


_WORD, _OTHER = "[A-Za-z0-9_]+", "[^A-Za-z0-9_]"
#: Slots of the filter by the ids' hashes, which is broadcast.
ID_SLOTS = 2**20


def _words_of(runs: Column, shape: tuple[int, int, int]) -> Column:
    """All stretches of a text that could be an id of this shape: array of (w, pos), pos counting words from 1.

    ``runs``: the text cut into runs of word characters and of others. A shape is the number of characters before the
    first word, of words, and of characters after the last.
    """
    lead, words, tail = shape
    total = F.size(runs)
    first = F.when(F.get(runs, F.lit(0)).rlike(_WORD), 1).otherwise(2)  # of the word runs, which are every second one
    count = F.floor((total - first) / 2) + 1
    if not words:
        runs_at = F.filter(F.transform(runs, lambda r, j: F.struct(r.alias("r"), (j + 1).alias("j"))), lambda x: x["r"].rlike(_OTHER) & (F.length(x["r"]) >= lead))

        def inside(x: Column) -> Column:
            free = F.length(x["r"]) - lead
            starts = F.filter(F.sequence(F.lit(0), free), lambda q: ((q > 0) | (x["j"] == 1)) & ((q < free) | (x["j"] == total)))
            return F.transform(starts, lambda q: F.struct(F.substring(x["r"], q + 1, F.lit(lead)).alias("w"), (F.floor(x["j"] / 2) + 1).alias("pos")))

        return F.flatten(F.transform(runs_at, inside))

    def stretch(t: Column) -> Column:
        at = (first + 2 * t).cast("int")
        end = at + 2 * words - 1  # the run after the last word
        before, after = F.get(runs, at - 2), F.get(runs, end - 1)
        ok, parts = t + words <= count, [F.array_join(F.slice(runs, at, F.lit(2 * words - 1)), "")]
        if lead:
            ok = ok & ((F.length(before) > lead) | ((F.length(before) == lead) & (at == 2)))
            parts.insert(0, F.right(before, F.lit(lead)))
        if tail:
            ok = ok & ((F.length(after) > tail) | ((F.length(after) == tail) & (end == total)))
            parts.append(F.left(after, F.lit(tail)))
        return F.when(ok, F.struct(F.concat(*parts).alias("w"), (t + 1).cast("bigint").alias("pos")))

    at_words = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
    return F.filter(F.coalesce(F.transform(at_words, stretch), F.array()), lambda x: x.isNotNull())


def mention_join(texts: DataFrame, ids: DataFrame, id_col: str = "ref_id", keys: Sequence[str] = K, salts: int = 16) -> DataFrame:
    """Ids mentioned in free text on word boundaries, with the first position: that of the mention's first word, from 1
    (of an id without words, that of the word after it).

    ``texts``: keys, text_id, text. An id may hold any characters; it is mentioned where no ASCII letter, digit or
    underscore touches it. Texts are cut into the stretches that the ids' shapes allow (characters before the first word,
    words, characters after the last; only the few distinct shapes come to the driver), so ids are found by equality alone.
    Stretches whose hash no id has are left out where they are read (at most ID_SLOTS slots are broadcast), so few others
    are shuffled. A repeated stretch of a text is folded to its first position in each task. A frequent id is spread over
    ``salts`` keys by the text, each with a copy of the id. Null and empty texts and ids give nothing.
    """
    wanted = ids.where(F.col(id_col) != "").select(*keys, F.col(id_col).alias("_w")).distinct()
    found = F.size(F.regexp_extract_all("_w", F.lit(_WORD), F.lit(0)))
    lead = F.length(F.regexp_extract("_w", f"^{_OTHER}*", 0))
    tail = F.when(found > 0, F.length(F.regexp_extract("_w", f"{_OTHER}*$", 0))).otherwise(0)
    shapes = [tuple(r) for r in wanted.select(lead.alias("a"), found.alias("b"), tail.alias("c")).distinct().collect()]
    t = texts.select(*keys, "text_id", "text")
    if all(shape == (0, 1, 0) for shape in shapes):
        t = t.select(*keys, "text_id", F.posexplode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("pos", "_w")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    else:
        t = t.where(F.length("text") > 0).select(*keys, "text_id", F.regexp_extract_all("text", F.lit(f"{_WORD}|{_OTHER}+"), F.lit(0)).alias("_runs"))
        t = t.select(*keys, "text_id", F.explode(F.flatten(F.array(*[_words_of(F.col("_runs"), shape) for shape in sorted(shapes)]))).alias("_m"))
        t = t.select(*keys, "text_id", F.col("_m.w").alias("_w"), F.col("_m.pos").alias("pos"))
    slot = F.pmod(F.xxhash64(*keys, "_w"), F.lit(ID_SLOTS)).alias("_slot")
    t = t.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "_slot", "left_semi")
    t = t.groupBy(*keys, "text_id", "_w").agg(F.min("pos").alias("pos")).withColumn("_salt", F.pmod(F.xxhash64("text_id"), F.lit(salts)).cast("int"))
    spread = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return t.join(spread, [*keys, "_w", "_salt"]).select(*keys, "text_id", F.col("_w").alias(id_col), "pos")


def expand_refs(parents: DataFrame, cards: DataFrame, refs: str, keys: Sequence[str] = K) -> DataFrame:
    """Ordered id arrays to card rows; unknown ids are dropped, the array position is kept as ``pos``."""
    flat = parents.select(
        *[c for c in parents.columns if c != refs], F.posexplode(refs).alias("_p", "shot_id")
    ).withColumn("pos", F.col("_p") + 1).drop("_p")
    return flat.join(cards, [*keys, "shot_id"])

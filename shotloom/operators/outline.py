"""Chapter drafts, their normalising, metrics, and structure risk."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..session import ship
from .cards import no_strings
from .intervals import growing_group_join, ordinal_range_join, preceding_group_join, time_range_join
from .ordered import halo_blocks, id_bucket, top_k, with_ordinal, with_running
from .shots import min_gap_select
from .staging import materialize

K = ["video_id"]

# Fixed values.
MAX_CHAPTERS = 8
SINGLETON_SCORE = 0.85
WINDOW = 3
#: Slots of the counts that order title tokens and cut the frequent ones into blocks; bits of a title set's sketch; tokens before a shared one
#: that are compared; titles of one set in a row.
TOKEN_SLOTS = 2**20
SKETCH = 256
BEFORE = 8
TITLE_BLOCK = 512


# --- chunk ranges --------------------------------------------------------------------


def resolve_chunk_ranges(chunks: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk to shot bridge and the chunks whose range cannot be read.

    ``chunks``: video_id, chunk_id, range_items array<string>, range_text string (one of
    them null). ``cards``: video_id, shot_id, ord, start_sec, end_sec. Tried in order:
    id pair, known ids of a list, number pair; ids in text, numbers in text.
    """
    pos = cards.select("video_id", "shot_id", "ord")
    items = F.filter(F.coalesce("range_items", no_strings()), lambda x: tx.strip(x) != "")
    tokens = F.regexp_extract_all("range_text", F.lit("[A-Za-z0-9_]+"), F.lit(0))
    numbers = F.regexp_extract_all("range_text", F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    c = chunks.select("video_id", "chunk_id", "range_items", "range_text", items.alias("_items"), numbers.alias("_nums"))
    refs = c.select(
        "video_id", "chunk_id", F.size("_items").alias("_n"),
        F.posexplode(F.coalesce(F.when(F.col("range_items").isNotNull(), F.col("_items")), tokens)).alias("_p", "shot_id"),
        F.col("range_items").isNotNull().alias("_listed"),
    )
    hit = refs.join(pos, ["video_id", "shot_id"])
    found = hit.groupBy("video_id", "chunk_id", "_listed").agg(
        F.max("_n").alias("_n"),
        F.max(F.when(F.col("_p") == 0, F.col("ord"))).alias("_first"),
        F.max(F.when(F.col("_p") == F.col("_n") - 1, F.col("ord"))).alias("_last"),
        F.min_by("ord", "_p").alias("_text_first"),
        F.count_distinct("ord").alias("_known"),
        F.collect_set("ord").alias("_ords"),
    )
    # In text, the last id is the one whose first mention comes last.
    mention = hit.where(~F.col("_listed")).groupBy("video_id", "chunk_id", "ord").agg(F.min("_p").alias("_at"))
    tail = mention.groupBy("video_id", "chunk_id").agg(F.max_by("ord", "_at").alias("_text_end"))
    found = found.join(tail, ["video_id", "chunk_id"], "left")
    pair = F.col("_listed") & (F.col("_n") >= 2) & F.col("_first").isNotNull() & F.col("_last").isNotNull()
    lo = F.when(pair, F.col("_first")).when(~F.col("_listed"), F.col("_text_first"))
    hi = F.when(pair, F.col("_last")).when(~F.col("_listed"), F.col("_text_end"))
    spans = found.select(
        "video_id", "chunk_id",
        F.when(lo.isNotNull(), F.sequence(F.least(lo, hi), F.greatest(lo, hi))).otherwise(F.col("_ords")).alias("_o"),
    )
    by_id = spans.select("video_id", "chunk_id", F.explode("_o").alias("ord")).join(pos, ["video_id", "ord"])
    rest = c.join(found.select("video_id", "chunk_id"), ["video_id", "chunk_id"], "left_anti")
    a = F.when(F.col("range_items").isNotNull() & (F.size("_items") >= 2), F.get("_items", F.lit(0)).try_cast("double")).otherwise(
        F.when(F.size("_nums") >= 2, F.get("_nums", F.lit(0)).try_cast("double"))
    )
    z = F.when(F.col("range_items").isNotNull() & (F.size("_items") >= 2), F.get("_items", F.size("_items") - 1).try_cast("double")).otherwise(
        F.when(F.size("_nums") >= 2, F.get("_nums", F.size("_nums") - 1).try_cast("double"))
    )
    timed = rest.select("video_id", F.col("chunk_id").alias("range_id"), a.alias("lo_sec"), z.alias("hi_sec")).where(
        "lo_sec is not null and hi_sec is not null"
    )
    by_time = time_range_join(timed, cards).select("video_id", F.col("range_id").alias("chunk_id"), "ord", "shot_id")
    bridge = by_id.select("video_id", "chunk_id", "ord", "shot_id").unionByName(by_time)
    lost = rest.join(timed.select("video_id", F.col("range_id").alias("chunk_id")), ["video_id", "chunk_id"], "left_anti")
    return bridge, lost.select(
        "video_id", "chunk_id", F.concat(F.lit("outline_chunk_range_unparseable:"), "chunk_id").alias("warning")
    )


def chunk_bridge(chunks: DataFrame, cards: DataFrame) -> DataFrame:
    """Bridge of chunks whose range is a first and last shot id."""
    refs = chunks.select("video_id", F.col("chunk_id").alias("ref_id"), F.col("first_shot").alias("first_id"), F.col("last_shot").alias("last_id"))
    return ordinal_range_join(refs, cards).withColumnRenamed("ref_id", "chunk_id")


# --- drafts --------------------------------------------------------------------------


def ambiguous_keys(sections: DataFrame) -> DataFrame:
    """Chunks claimed by more than one section."""
    return (
        sections.select("video_id", "section_no", F.explode(F.array_distinct("source_chunks")).alias("chunk_id"))
        .groupBy("video_id", "chunk_id").agg(F.count(F.lit(1)).alias("sections"))
        .where("sections > 1")
    )


def section_drafts(sections: DataFrame, chunks: DataFrame, bridge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts from section sources: (drafts, draft shots).

    A video is rejected when a chunk is claimed twice or a section has no usable chunk.
    """
    good = sections.where(~F.col("title").isin(tx.PLACEHOLDER_TOPICS) & (F.col("title") != ""))
    usable = bridge.select("video_id", "chunk_id").distinct()
    src = good.select("video_id", "section_no", "title", F.posexplode_outer("source_chunks").alias("_p", "chunk_id"))
    ok = src.join(usable, ["video_id", "chunk_id"])
    count = good.groupBy("video_id").agg(F.count(F.lit(1)).alias("_want"))
    have = ok.groupBy("video_id").agg(F.count_distinct("section_no").alias("_have"))
    reject = (
        count.join(have, "video_id", "left").where(F.coalesce("_have", F.lit(0)) < F.col("_want")).select("video_id")
        .unionByName(ambiguous_keys(good).select("video_id")).distinct()
    )
    ok = ok.join(reject, "video_id", "left_anti")
    texts = chunks.select("video_id", "chunk_id", tx.clean_text(F.col("summary")).alias("_s"))
    # A section names a few chunks; their short summaries are gathered per section.
    per = ok.join(texts, ["video_id", "chunk_id"]).groupBy("video_id", "section_no", "title").agg(
        F.sort_array(F.collect_list(F.struct("_p", "_s", "chunk_id"))).alias("_l")
    )
    merged = F.array_join(F.filter(F.transform("_l", lambda x: x["_s"]), lambda s: s != ""), " ")
    drafts = per.select(
        "video_id", (F.col("section_no") - 1).alias("draft_ord"), "title",
        F.when(merged != "", F.substring(merged, 1, 220)).otherwise(F.col("title")).alias("summary"),
        F.lit("section_sources").alias("strategy"),
    )
    shots = ok.join(bridge, ["video_id", "chunk_id"]).select("video_id", (F.col("section_no") - 1).alias("draft_ord"), "ord").distinct()
    return drafts, shots


def planner_drafts(
    chunks: DataFrame, bridge: DataFrame, cards: DataFrame, sections: DataFrame, max_chapters: int = MAX_CHAPTERS, expand: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rule-based planner: one draft per chunk, else an even split with about 8 cards per chapter.

    ``expand=False`` keeps only the two end shots of a chunk's range.
    """
    head = chunks.where(F.col("chunk_no") <= max_chapters)
    topics = F.filter(F.transform("main_topics", tx.strip), lambda t: t != "")
    title = tx.compact_text(tx.clean_title(F.coalesce(F.get(topics, F.lit(0)), "summary")), 28)
    ends = bridge.groupBy("video_id", "chunk_id").agg(F.min("ord").alias("_lo"), F.max("ord").alias("_hi"))
    d = head.join(ends, ["video_id", "chunk_id"])
    first = d.groupBy("video_id", "_lo", "_hi").agg(F.min("chunk_no").alias("chunk_no"))
    d = d.join(first, ["video_id", "_lo", "_hi", "chunk_no"])
    rows = top_k(d, K, [F.col("chunk_no")], max_chapters, "_n").withColumn("_t", title)
    drafts = rows.select(
        "video_id", (F.col("_n") - 1).alias("draft_ord"),
        F.coalesce(F.nullif("_t", F.lit("")), F.format_string("Part %d", "_n")).alias("title"),
        tx.compact_text(F.coalesce(F.nullif("summary", F.lit("")), "_t"), 80).alias("summary"),
        F.lit("outline_planner").alias("strategy"),
    )
    shots = rows.select("video_id", "chunk_id", (F.col("_n") - 1).alias("draft_ord"), "_lo", "_hi").join(bridge, ["video_id", "chunk_id"])
    if not expand:
        shots = shots.where((F.col("ord") == F.col("_lo")) | (F.col("ord") == F.col("_hi")))
    shots = shots.select("video_id", "draft_ord", "ord")
    bare = cards.join(rows.select("video_id").distinct(), "video_id", "left_anti")
    count = F.least(F.lit(max(1, max_chapters)), F.greatest(F.lit(1), F.floor((F.col("card_count") + 7) / 8)))
    sd, ss = _even(bare, count, sections, "outline_planner")
    return drafts.unionByName(sd.withColumn("summary", F.col("title"))), shots.unionByName(ss)


def _even(cards: DataFrame, count: Column, sections: DataFrame, strategy: str) -> tuple[DataFrame, DataFrame]:
    per = F.greatest(F.lit(1), F.ceil(F.col("card_count") / count))
    shots = cards.withColumn("draft_ord", F.floor((F.col("ord") - 1) / per).cast("int"))
    groups = shots.groupBy("video_id", "draft_ord").agg(
        F.max_by(F.col("merged_summary"), F.struct(F.coalesce("importance_score", F.lit(0.0)), -F.col("ord"))).alias("_best")
    )
    named = sections.select("video_id", (F.col("section_no") - 1).alias("draft_ord"), F.col("title").alias("_t"))
    drafts = groups.join(named, ["video_id", "draft_ord"], "left").select(
        "video_id", "draft_ord",
        F.coalesce("_t", F.format_string("Part %d", F.col("draft_ord") + 1)).alias("title"),
        F.coalesce(F.nullif("_best", F.lit("")), "_t", F.format_string("Part %d", F.col("draft_ord") + 1)).alias("summary"),
        F.lit(strategy).alias("strategy"),
    )
    return drafts, shots.select("video_id", "draft_ord", "ord")


def even_split(cards: DataFrame, targets: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of ``ceil(n / target)`` cards. ``targets``: video_id, target."""
    return _even(cards.join(targets, "video_id"), F.col("target"), sections, "even_split_fallback")


def pick_strategy(options: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Per video, the drafts of the first option that has any."""
    drafts = shots = None
    for rank, (dr, sh) in enumerate(options):
        a, b = dr.withColumn("_rank", F.lit(rank)), sh.withColumn("_rank", F.lit(rank))
        drafts = a if drafts is None else drafts.unionByName(a)
        shots = b if shots is None else shots.unionByName(b)
    best = drafts.groupBy("video_id").agg(F.min("_rank").alias("_rank"))
    return drafts.join(best, ["video_id", "_rank"]).drop("_rank"), shots.join(best, ["video_id", "_rank"]).drop("_rank")


# --- normalising ---------------------------------------------------------------------


def fold_small_groups(groups: Column, min_size: int) -> Column:
    """Merge small groups of one outline, in order; returns the kept groups with their members.

    ``groups``: ordered array<struct<g,n,keep>>. Scanning from the left, the first group below
    ``min_size`` that is not ``keep`` (an important single card) joins its predecessor, or its
    successor when it is first, and the scan restarts. As a fold: a small first group is taken
    over by the next one; any other small group joins the one before, which may cascade.
    """
    def item(g: Column, n: Column, keep: Column, members: Column) -> Column:
        return F.struct(g.alias("g"), n.cast("bigint").alias("n"), keep.alias("keep"), members.alias("members"))

    seed = F.transform(groups, lambda x: item(x["g"], x["n"], x["keep"], F.array(x["g"])))
    small = lambda x: (x["n"] < min_size) & ~x["keep"]
    no = F.lit(False)

    def settle(acc: Column, _: Column) -> Column:
        top, prev = F.element_at(acc, -1), F.get(acc, F.size(acc) - 2)
        joined = item(prev["g"], prev["n"] + top["n"], no, F.concat(prev["members"], top["members"]))
        return F.when(
            (F.size(acc) > 1) & small(top), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 2), F.array(joined))
        ).otherwise(acc)

    def step(acc: Column, x: Column) -> Column:
        only = F.get(acc, F.lit(0))
        taken = item(x["g"], x["n"] + only["n"], no, F.concat(only["members"], x["members"]))
        grown = F.when((F.size(acc) == 1) & small(only), F.array(taken)).otherwise(F.concat(acc, F.array(x)))
        return F.aggregate(F.sequence(F.lit(1), F.size(acc) + 1), grown, settle)

    return F.aggregate(seed, F.slice(seed, 1, 0), step)


def _number_groups(full: DataFrame, keys: Sequence[str], group: str, order: Column, min_size: int, out: str) -> DataFrame:
    """Adds ``out`` (1-based) and ``lead_group`` to rows after small groups are merged.

    A group that is not small takes small ones in and is never taken in itself, so the order is cut before each of them and
    every piece is folded on its own. Only a piece before the first one that ends as one small group goes to the next piece.
    """
    stat = full.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n"), order.alias("_o"), F.max(F.coalesce("importance_score", F.lit(0.0))).alias("_i")
    )
    keep = (F.col("n") == 1) & (F.col("_i") >= SINGLETON_SCORE)
    stat = materialize(stat.select(*keys, F.col(group).alias("g"), "n", keep.alias("keep"), "_o"))
    cut = with_running(stat, keys, ["_o", "g"], id_bucket(F.col("_o")), (F.col("n") >= min_size).cast("bigint"), "_piece")
    packed = cut.groupBy(*keys, "_piece").agg(F.sort_array(F.collect_list(F.struct("_o", "g", "n", "keep"))).alias("_g"))
    folded = packed.withColumn("_f", F.when((F.size("_g") > 1) | (F.col("_piece") == 0), fold_small_groups(F.col("_g"), min_size)))
    only = F.get("_f", F.lit(0))
    goes = (F.col("_piece") == 0) & (F.size("_f") == 1) & (only["n"] < min_size) & ~only["keep"]
    some = folded.select(*keys).where("_piece > 0").distinct().withColumn("_next", F.lit(True))
    folded = folded.join(some, list(keys), "left").withColumn("_goes", F.coalesce(goes & F.col("_next"), F.lit(False)))
    own = F.transform("_g", lambda x: F.struct(x["g"].alias("g"), F.array(x["g"]).alias("members")))
    merged = F.coalesce(F.transform("_f", lambda x: F.struct(x["g"].alias("g"), x["members"].alias("members"))), own)
    parts = folded.select(*keys, "_piece", "_goes", F.posexplode(merged).alias("_p", "_k"))
    kept = with_ordinal(parts.where("NOT _goes").drop("_goes"), keys, [F.col("_piece"), F.col("_p")], id_bucket(F.col("_piece")), out)
    kept = kept.select(*keys, "_piece", "_p", F.col(out), F.col("_k.g").alias("lead_group"), F.col("_k.members").alias("_m"))
    first = kept.where("_piece = 1 AND _p = 0").select(*keys, out, "lead_group")
    moved = parts.where("_goes").join(first, list(keys)).select(*keys, out, "lead_group", F.col("_k.members").alias("_m"))
    mapping = kept.select(*keys, out, "lead_group", "_m").unionByName(moved).select(*keys, out, "lead_group", F.explode("_m").alias(group))
    return full.join(materialize(mapping), [*keys, group])


def normalize_drafts(drafts: DataFrame, draft_shots: DataFrame, cards: DataFrame, min_shots: int = 2) -> DataFrame:
    """Every card in exactly one chapter: video_id, chapter_no, draft_ord (of the title), ord, shot_id, ...

    The first draft to claim a card wins; untitled and empty drafts are dropped; unclaimed cards go
    to the nearest growing group; chapters are ordered by their first card; small ones are merged.
    """
    titled = drafts.where(tx.clean_text(F.col("title")) != "").select("video_id", "draft_ord")
    claims = (
        draft_shots.join(titled, ["video_id", "draft_ord"]).groupBy("video_id", "ord").agg(F.min("draft_ord").alias("_claim"))
        .join(cards.select("video_id", "ord"), ["video_id", "ord"])
    )
    claims = materialize(claims)
    hulls = claims.groupBy("video_id", F.col("_claim").alias("group_ord")).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    free = cards.select("video_id", "ord").join(claims, ["video_id", "ord"], "left_anti")
    placed = claims.withColumnRenamed("_claim", "_g").unionByName(growing_group_join(free, hulls).withColumnRenamed("group_ord", "_g"))
    full = cards.join(materialize(placed), ["video_id", "ord"])
    got = _number_groups(full, K, "_g", F.min("ord"), min_shots, "chapter_no")
    return got.withColumn("draft_ord", F.col("lead_group")).drop("_g", "lead_group")


def build_chapters(chapter_shots: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row per chapter with ends, representative and time span."""
    agg = chapter_shots.groupBy("video_id", "chapter_no", "draft_ord").agg(
        F.count(F.lit(1)).cast("int").alias("shot_count"),
        F.min_by("shot_id", "ord").alias("start_shot_id"),
        F.max_by("shot_id", "ord").alias("end_shot_id"),
        F.max_by("shot_id", F.struct(F.coalesce("importance_score", F.lit(0.0)), -F.col("ord"))).alias("representative_shot_id"),
        F.min("start_sec").alias("start_sec"),
        F.max("end_sec").alias("end_sec"),
    )
    d = drafts.select("video_id", "draft_ord", tx.clean_text(F.col("title")).alias("title"), "summary", "strategy")
    return agg.join(d, ["video_id", "draft_ord"]).select(
        "video_id", "chapter_no", F.format_string("chapter_%03d", "chapter_no").alias("chapter_id"), "title",
        F.coalesce(F.nullif(tx.clean_text(F.col("summary")), F.lit("")), "title").alias("summary"), "strategy",
        "shot_count", "start_shot_id", "end_shot_id", "representative_shot_id", "start_sec", "end_sec",
    )


def normalize_subsections(
    drafts: DataFrame, draft_shots: DataFrame, chapter_shots: DataFrame, max_subsections: int = 5, min_shots: int = 2, min_coverage: float = 0.6
) -> DataFrame:
    """Cards of chapters with a subsection number; chapters that end with fewer than 2 groups are left out.

    Keys video_id, chapter_no. Unclaimed cards join the last group that starts at or before them.
    """
    keys = ["video_id", "chapter_no"]
    titled = drafts.where(tx.clean_text(F.col("title")) != "").select(*keys, "draft_ord")
    claims = (
        draft_shots.join(titled, [*keys, "draft_ord"]).groupBy(*keys, "ord").agg(F.min("draft_ord").alias("_claim"))
        .join(chapter_shots.select(*keys, "ord"), [*keys, "ord"])
    )
    claims = materialize(claims)
    firsts = claims.groupBy(*keys, "_claim").agg(F.min("ord").alias("lo"))
    firsts = with_ordinal(firsts, keys, [F.col("_claim")], id_bucket(F.col("_claim")), "_i")
    firsts = materialize(firsts.select(*keys, "_claim", "lo", F.least(F.col("_i") - 1, F.lit(max_subsections - 1)).alias("group_ord")))
    free = chapter_shots.select(*keys, "ord").join(claims, [*keys, "ord"], "left_anti")
    placed = claims.join(firsts.drop("lo"), [*keys, "_claim"]).drop("_claim").unionByName(preceding_group_join(free, firsts, keys))
    full = chapter_shots.join(materialize(placed.withColumnRenamed("group_ord", "_g")), [*keys, "ord"])
    leads = firsts.groupBy(*keys, F.col("group_ord").alias("lead_group")).agg(F.min("_claim").alias("_lead"))
    got = _number_groups(full, keys, "_g", F.min("_g"), min_shots, "subsection_no").join(leads, [*keys, "lead_group"]).withColumn("draft_ord", F.col("_lead"))
    stat = got.groupBy(*keys).agg(F.max("subsection_no").alias("_n"), F.count(F.lit(1)).alias("_c"))
    size = chapter_shots.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    ok = stat.join(size, keys).where((F.col("_n") >= 2) & (F.col("_c") / F.col("_all") >= min_coverage)).select(*keys)
    return got.join(ok, keys, "left_semi").drop("_g", "lead_group", "_lead")


# --- metrics -------------------------------------------------------------------------


def topic_tokens(tags: Column, entities: Column, role: Column) -> Column:
    """Distinct cleaned tags and entities that are no placeholder, plus the role unless unknown."""
    words = tx.ordered_distinct(F.concat(F.coalesce(tags, no_strings()), F.coalesce(entities, no_strings())))
    r = tx.clean_text(role)
    role_set = F.when((r != "") & (r != "unknown"), F.array(r)).otherwise(no_strings())
    return F.array_union(F.filter(words, lambda w: ~w.isin(tx.PLACEHOLDER_TOPICS)), role_set)


def topic_shift(rows: DataFrame, keys: Sequence[str], pos: str = "pos", total: str = "chapter_size") -> DataFrame:
    """Number of topic shifts per group: keys, shifts.

    ``rows``: keys, pos (1-based dense), total, tokens. A boundary has a topic overlap below 0.25
    between the 3 rows before and the 3 rows from it on; boundaries within 3 rows merge.
    """
    d = halo_blocks(rows.select(*keys, pos, total, "tokens"), pos, WINDOW, WINDOW - 1)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    d = d.withColumn("_l", F.array_distinct(F.flatten(F.collect_list("tokens").over(w.rowsBetween(-WINDOW, -1)))))
    d = d.withColumn("_r", F.array_distinct(F.flatten(F.collect_list("tokens").over(w.rowsBetween(0, WINDOW - 1)))))
    b = F.col(pos) - 1
    cut = d.where(
        F.col("_home") & (F.col(total) >= 6) & (b >= 2) & (b < F.col(total) - 2)
        & (F.size("_l") > 0) & (F.size("_r") > 0) & (tx.jaccard(F.col("_l"), F.col("_r")) < 0.25)
    ).select(*keys, b.alias("boundary"))
    kept = min_gap_select(cut, WINDOW + 1, "boundary", keys, anchor=None)
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("shifts"))


def tertile(pos: Column, size: Column) -> Column:
    """Third (0 to 2) of a group of ``size`` in which the 1-based position lies."""
    return F.least(F.lit(2), F.floor((pos - 1) * 3 / size))


def tertile_hits(cards: DataFrame, keys: Sequence[str] = ("video_id", "chapter_no"), minimum: float = 0.7) -> DataFrame:
    """How many thirds of each group hold a card of at least ``minimum`` importance: keys, thirds (0 without one).

    ``cards``: keys, ord (any numbers that give the order), importance_score; a null score counts as 0.
    """
    rows = with_ordinal(cards.select(*keys, "ord", "importance_score"), list(keys), [F.col("ord")], id_bucket(F.col("ord")), "_pos", "_size")
    hit = F.when(F.coalesce("importance_score", F.lit(0.0)) >= minimum, tertile(F.col("_pos"), F.col("_size")))
    return rows.groupBy(*keys).agg(F.count_distinct(hit).alias("thirds"))


def coverage(assigned: DataFrame, members: DataFrame, keys: Sequence[str], item: str, minimum: float = 0.6) -> DataFrame:
    """Share of each group's members that were assigned: keys, assigned, total, coverage, enough.

    Repeated items of ``assigned`` count once, also those that are no member; rows of ``members`` all count. A group
    without an assigned item has coverage 0.
    """
    got = assigned.groupBy(*keys).agg(F.count_distinct(item).alias("assigned"))
    d = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).join(got, list(keys), "left").na.fill(0, ["assigned"])
    share = F.col("assigned") / F.greatest(F.lit(1), F.col("total"))
    return d.select(*keys, "assigned", "total", share.alias("coverage"), (share >= minimum).alias("enough"))


def truncate_and_merge(items: DataFrame, keep: int, keys: Sequence[str] = K, order: str = "group_ord") -> DataFrame:
    """Items with their group limited to the first ``keep`` of its key by ``order``; surplus groups go into the last kept one.

    Adds ``kept_ord``, from 0 and without holes. Groups are few per key (one row each is ranked); items are not shuffled to them by key alone.
    """
    groups = items.select(*keys, order).distinct()
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return items.join(groups.select(*keys, order, F.least(place, F.lit(keep - 1)).alias("kept_ord")), [*keys, order])


def chapter_metrics(chapter_shots: DataFrame) -> DataFrame:
    """Per chapter: shot count, duration, topics, shifts, thirds holding an important card, share of the video."""
    keys = ["video_id", "chapter_no"]
    narrow = chapter_shots.select(
        *keys, "ord", "start_sec", "end_sec", F.coalesce("importance_score", F.lit(0.0)).alias("imp"),
        topic_tokens(F.col("topic_tags"), F.col("key_entities"), F.col("narrative_role")).alias("tokens"),
    )
    rows = materialize(with_ordinal(narrow, keys, [F.col("ord")], id_bucket(F.col("ord")), "pos", "chapter_size"))
    third = tertile(F.col("pos"), F.col("chapter_size"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("shot_count"),
        F.coalesce(F.greatest(F.lit(0.0), F.max("end_sec") - F.min("start_sec")), F.lit(0.0)).alias("duration_sec"),
        F.count_distinct(F.when(F.col("imp") >= 0.7, third)).cast("int").alias("important_thirds"),
    )
    topics = rows.select(*keys, F.explode("tokens").alias("t")).distinct().groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("topic_count"))
    d = base.join(topics, keys, "left").join(topic_shift(rows, keys), keys, "left").na.fill(0, ["topic_count", "shifts"])
    w = Window.partitionBy("video_id")  # one row per chapter here
    return d.withColumn("video_shots", F.sum("shot_count").over(w)).withColumn("chapter_count", F.count(F.lit(1)).over(w))


def subsection_need(metrics: DataFrame, titles: DataFrame, min_score: int = 5, min_shots: int = 8, max_sub: int = 5, min_per: int = 2) -> DataFrame:
    """Decision per chapter: mode, score, target, reason codes. ``titles``: video_id, chapter_no, title."""
    d = metrics.join(titles.select("video_id", "chapter_no", "title"), ["video_id", "chapter_no"])
    n, dur, topics, shifts = F.col("shot_count"), F.col("duration_sec"), F.col("topic_count"), F.col("shifts")
    cap = F.least(F.lit(max_sub), F.greatest(F.lit(1), F.ceil(n / 4).cast("int")))
    d = d.withColumn("max_subsections", cap)
    d = d.withColumn("target_subsections", F.least("max_subsections", F.greatest(F.lit(2), shifts + 1)))
    rules = [
        (n >= 8, 2, "many_shots"), (n >= 14, 1, "very_many_shots"), (dur >= 180, 1, "long_duration"),
        (dur >= 360, 1, "very_long_duration"), (topics >= 3, 2, "many_topics"), (topics >= 5, 1, "very_many_topics"),
        (shifts >= 2, 2, "topic_shift"), (F.col("important_thirds") >= 2, 1, "distributed_importance"),
        (tx.is_generic_title(F.col("title")), 1, "generic_title"),
    ]
    score = F.lit(0)
    for cond, points, _ in rules:
        score = score + F.when(cond, points).otherwise(0)
    codes = F.filter(F.array(*[F.when(c, F.lit(code)) for c, _, code in rules]), lambda x: x.isNotNull())
    guard = (
        F.when((n <= 4) | (n < min_shots), "few_shots")
        .when((F.col("max_subsections") < 2) | (n < min_per * 2), "not_enough_subsection_capacity")
        .when((dur > 0) & (dur <= 90) & (topics <= 2), "compact_single_topic")
    )
    d = d.withColumn("_guard", guard).withColumn("_score", score).withColumn("_codes", codes)
    dominant = (n / F.col("video_shots") >= 0.25) & (F.col("chapter_count") <= 3)
    near = (F.col("_score") == min_score - 1) & dominant
    split = F.col("_guard").isNull() & ((F.col("_score") >= min_score) | near)
    reasons = F.concat("_codes", F.when(near, F.array(F.lit("dominant_chapter"))).otherwise(no_strings()))
    return d.select(
        "video_id", "chapter_no", "shot_count", num.round_at(dur, 3).alias("duration_sec"), "topic_count", "shifts",
        "max_subsections", "target_subsections",
        F.when(split, "split").otherwise("keep").alias("mode"),
        F.when(F.col("_guard").isNull(), F.col("_score")).otherwise(0).alias("need_score"),
        F.when(F.col("_guard").isNotNull(), F.array("_guard")).when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("low_need_score"))).alias("reason_codes"),
    )


def subsection_drafts(chapter_shots: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal groups of the chapters to split; title from the first tag, else the top keyword of the first card with text."""
    keys = ["video_id", "chapter_no"]
    want = decisions.where("mode = 'split'").select(*keys, "target_subsections", "max_subsections")
    d = with_ordinal(chapter_shots, keys, [F.col("ord")], id_bucket(F.col("ord")), "pos", "chapter_size").join(want, keys)
    half = F.greatest(F.lit(1), F.floor(F.col("chapter_size") / 2))
    count = F.least(F.col("max_subsections"), F.greatest(F.lit(2), F.col("target_subsections")), half)
    d = d.withColumn("_count", count).where((F.col("_count") >= 2) & (F.col("chapter_size") >= 2))
    per = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("chapter_size") / F.col("_count")))
    d = d.withColumn("draft_ord", F.floor((F.col("pos") - 1) / per).cast("int"))
    tag = F.get(tx.ordered_distinct("topic_tags"), F.lit(0))
    first = d.groupBy(*keys, "draft_ord").agg(F.min_by(tag, F.when(tag.isNotNull(), F.col("pos"))).alias("_t"))
    title = tx.compact_text(tx.clean_title(F.coalesce("_t", F.lit(""))), 24)
    drafts = first.select(*keys, "draft_ord", F.coalesce(F.nullif(title, F.lit("")), F.format_string("小节 %d", F.col("draft_ord") + 1)).alias("title"))
    return drafts, d.select(*keys, "draft_ord", "ord")


# --- similarity and risk ---------------------------------------------------------------


def adjacent_similarity(chapters: DataFrame, keys: Sequence[str] = K, order: str = "chapter_no") -> DataFrame:
    """Title similarity of each chapter with the next one (``order`` is dense)."""
    t = chapters.select(*keys, order, F.array_distinct(tx.title_tokens(F.col("title"))).alias("_a"))
    nxt = t.select(*keys, (F.col(order) - 1).alias(order), F.col("_a").alias("_b"))
    return t.join(nxt, [*keys, order]).select(*keys, order, tx.jaccard(F.col("_a"), F.col("_b")).alias("similarity"))


def _token_sets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a non-empty title: `_tokens`, its sorted distinct tokens, and `_set`, the same as one text."""
    tokens = F.array_sort(F.array_distinct(tx.title_tokens(F.col("title"))))
    d = df.select("*", F.explode(F.array(tokens)).alias("_tokens")).where(F.size("_tokens") > 0)  # a filter passes no explode, so tokens are cut once
    return d.withColumn("_set", F.array_join("_tokens", "\x1f"))


def set_members(df: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Rows with a non-empty title and `title_set`, the text that names its token set in `similar_sets`."""
    return _token_sets(df, keys).withColumnRenamed("_set", "title_set").drop("_tokens")


def similar_sets(left: DataFrame, right: DataFrame, minimum: float, keys: Sequence[str] = K, block: int = 2048) -> DataFrame:
    """Pairs of token sets with an overlap of at least ``minimum``: keys, set_a, n_a, set_b, n_b, similarity.

    ``left`` and ``right``: keys, title. Equal sets are one row with the number of its titles, so repeated titles never
    meet one by one; `set_members` gives the titles of a set, so pairs and members together grow with the titles.

    Sets meet only through a shared token; a pair can only reach a positive minimum when one of its rarest
    ``n - ceil(minimum * n) + 1`` tokens is shared, so only those are joined (`_met`). The sets of a token are cut into blocks of
    about ``block``, and each pair of blocks is a key of its own, so a token that very many sets hold is no single task.
    Pairs are then verified on the whole sets.
    """
    a, _, same, found = _similar(left, right, minimum, keys, block)
    out = [*keys, "set_a", "n_a", "set_b", "n_b", "similarity"]
    if not same:
        return found.select(*out)
    turned = F.array(F.struct("set_a", "n_a", "set_b", "n_b"), F.struct(F.col("set_b").alias("set_a"), F.col("n_b").alias("n_a"), F.col("set_a").alias("set_b"), F.col("n_a").alias("n_b")))
    equal = a.select(*keys, F.col("_set").alias("set_a"), F.col("_n").alias("n_a"), F.col("_set").alias("set_b"), F.col("_n").alias("n_b"), F.lit(1.0).alias("similarity"))
    return found.select(*keys, F.explode(turned).alias("_x"), "similarity").select(*keys, "_x.*", "similarity").unionByName(equal)


def _same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables are one, though their columns may have been dropped in other steps."""
    left_plan, right_plan = (x._jdf.queryExecution().optimizedPlan() for x in (left, right))
    return left_plan.sameResult(right_plan)


def _similar(left: DataFrame, right: DataFrame, minimum: float, keys: Sequence[str], block: int) -> tuple[DataFrame, DataFrame, bool, DataFrame]:
    """(sets of the left, sets of the right, are they one table, pairs): keys, _id, _set, _n (titles); keys, _ia, set_a, n_a, _ib, set_b, n_b, similarity.

    Equal sides are one table; its pairs of different sets are then there once, whichever way round.
    """
    def fold(df: DataFrame) -> DataFrame:
        d = _token_sets(df, keys).dropna(subset=list(keys)) if keys else _token_sets(df, keys)
        got = d.groupBy(*keys, "_set").agg(F.count(F.lit(1)).alias("_n"))
        return materialize(got.select(*keys, F.monotonically_increasing_id().alias("_id"), "_set", "_n"))

    same = _same_rows(left.select(*keys, "title"), right.select(*keys, "title"))
    a = fold(left)
    b = a if same else fold(right)
    side = lambda x, s: x.select(*keys, F.col("_id").alias(f"_i{s}"), F.col("_n").alias(f"n_{s}"), F.col("_set").alias(f"set_{s}"))
    pairs = _met(a, b, same, minimum, keys, block).repartition("_ia").dropDuplicates(["_ia", "_ib"])
    full = pairs.join(side(a, "a"), "_ia").join(side(b, "b"), ["_ib", *keys])
    # sets hold no word twice, so the intersection gives the union; a filter passes no explode, so both are counted once
    shared = lambda w: tx.let(F.size(F.array_intersect(w["a"], w["b"])), lambda k: k / (F.size(w["a"]) + F.size(w["b"]) - k))
    similarity = tx.let(F.struct(F.split("set_a", "\x1f").alias("a"), F.split("set_b", "\x1f").alias("b")), shared)
    found = full.select("*", F.explode(F.filter(F.array(similarity), lambda x: x >= minimum)).alias("similarity"))
    return a, b, same, found


def _met(a: DataFrame, b: DataFrame, same: bool, minimum: float, keys: Sequence[str], block: int) -> DataFrame:
    """_ia, _ib of sets that may reach ``minimum``: all that do, few others, hardly any of them twice.

    A token is a hash of 32 bits. Tokens are ordered by the number of sets in their slot of TOKEN_SLOTS, then by value;
    any order serves, and tokens of one value only let more pairs through. A row for each token of a set's prefix holds the
    set's size, the tokens that follow, a sketch of SKETCH bits (each token turns one over) and the first tokens before it. Two
    rows of a token give a pair if the sizes allow the minimum, if enough tokens follow, if the sketches differ in no more bits than
    the sets may differ in tokens, and if no token met before; so what leaves the task of a token is nearly the result, and
    no token list goes along with a candidate.
    """
    hashed = lambda x: x.select("_id", *keys, F.split("_set", "\x1f").alias("_w")).select("_id", F.transform("_w", lambda w: F.hash(*keys, w)).alias("_h"))
    ha = hashed(a)
    hb = ha if same else hashed(b)
    slot = lambda c: F.pmod(c, F.lit(TOKEN_SLOTS))
    used = (ha if same else ha.unionByName(hb)).select(F.explode("_h").alias("_t")).groupBy(slot(F.col("_t")).alias("_s")).agg(F.count(F.lit(1)).alias("_f")).toArrow()
    counts = np.zeros(TOKEN_SLOTS, np.int64)
    counts[used["_s"].to_numpy()] = used["_f"].to_numpy()
    ship(a.sparkSession)
    sketch = [f"_g{k}" for k in range(SKETCH // 64)]
    shape = "_id long, _n int, _skip int, _p array<int>, " + ", ".join(f"{g} long" for g in sketch)
    parts = lambda batches: (x.slice(k, 256) for x in batches for k in range(0, x.num_rows, 256))
    prefixes = lambda h: materialize(h.mapInArrow(lambda batches: (_prefixes(x, counts, minimum) for x in parts(batches)), shape))
    la = prefixes(ha)
    lb = la if same else prefixes(hb)

    def rows(x: DataFrame, s: str) -> DataFrame:
        got = x.select("*", F.posexplode("_p").alias("_j", "_t"))
        before = F.slice("_p", F.lit(1), F.least("_j", F.lit(BEFORE)))
        left = F.col("_n") - F.col("_skip") - F.col("_j") - 1
        return got.select(F.col("_id").alias(f"_i{s}"), F.col("_n").alias(f"_n{s}"), left.alias(f"_left{s}"), *[F.col(g).alias(g + s) for g in sketch], before.alias(f"_before{s}"), "_t")

    ra, rb = rows(la, "a"), rows(lb, "b")
    if same:  # the smaller set of a pair shares one of fewer tokens
        ra = ra.where(F.col("_lefta") + 1 >= F.ceil(2 * minimum / (1 + minimum) * F.col("_na") - 1e-9))
    both = ra.select(slot(F.col("_t")).alias("_s"), F.lit(1).alias("_x"), F.lit(0).alias("_y")).unionByName(rb.select(slot(F.col("_t")).alias("_s"), F.lit(0).alias("_x"), F.lit(1).alias("_y")))
    cuts = both.groupBy("_s").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(c) / block)).alias(name) for c, name in (("_x", "_ba"), ("_y", "_bb"))))
    cuts = F.broadcast(materialize(cuts.where("_ba > 1 or _bb > 1")))  # at most TOKEN_SLOTS rows

    def dealt(p: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(f"_i{own}"), F.coalesce(f"_b{own}", F.lit(1)))
        others = F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"_b{other}", F.lit(1)) - 1)
        return p.withColumn("_s", slot(F.col("_t"))).join(cuts, "_s", "left").select(*p.columns, mine.alias(f"_k{own}"), F.explode(others).alias(f"_k{other}"))

    na, nb = F.col("_na"), F.col("_nb")
    sizes = na >= minimum * nb - 1e-9
    sizes &= ((na < nb) | ((na == nb) & (F.col("_ia") < F.col("_ib")))) if same else nb >= minimum * na - 1e-9
    least = F.ceil(minimum / (1 + minimum) * (na + nb) - 1e-9)
    bits = sum((F.bit_count(F.col(f"{g}a").bitwiseXOR(F.col(f"{g}b"))) for g in sketch[1:]), F.bit_count(F.col(f"{sketch[0]}a").bitwiseXOR(F.col(f"{sketch[0]}b"))))
    near = sizes & (1 + F.least("_lefta", "_leftb") >= least) & (bits <= na + nb - 2 * least) & ~F.arrays_overlap("_beforea", "_beforeb")
    return dealt(ra, "a", "b").join(dealt(rb, "b", "a"), ["_t", "_ka", "_kb"]).where(near).select("_ia", "_ib")


def _prefixes(batch: pa.RecordBatch, counts: np.ndarray, minimum: float) -> pa.RecordBatch:
    """For `_id`, `_h` (token hashes): size, how many tokens at the start of the prefix no other set has, the rest of the prefix in order, sketch."""
    lists = batch.column("_h")
    h, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    bit = ((h.astype(np.int64) * 0x9E3779B1) >> 20) % SKETCH
    turned = np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64))
    sketch = [np.bitwise_xor.reduceat(np.where(bit // 64 == k, turned, np.uint64(0)), start).view(np.int64) for k in range(SKETCH // 64)]
    f = counts[h % len(counts)]
    order = np.lexsort((h, f, row))
    h, f = h[order], f[order]
    at = np.arange(len(h)) - start[row]
    kept = at < (n - np.ceil(n * minimum - 1e-9).astype(np.int64) + 1)[row]
    skip = np.bincount(row[kept & (f <= 1)], minlength=len(n))
    kept &= f > 1
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(n)))])
    columns = [batch.column("_id"), pa.array(n, pa.int32()), pa.array(skip, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[kept], pa.int32())), *map(pa.array, sketch)]
    return pa.RecordBatch.from_arrays(columns, ["_id", "_n", "_skip", "_p", *(f"_g{k}" for k in range(len(sketch)))])


def _similar_ids(left: DataFrame, right: DataFrame, minimum: float, keys: Sequence[str], block: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets of the left, sets of the right, pairs): keys, _id, _set, _n (titles) and _ia, _ib, similarity, each pair both ways round if the sides are one."""
    a, b, same, found = _similar(left, right, minimum, keys, block)
    found = found.select("_ia", "_ib", "similarity")
    if same:
        turned = F.array(F.struct("_ia", "_ib"), F.struct(F.col("_ib").alias("_ia"), F.col("_ia").alias("_ib")))
        found = found.select(F.explode(turned).alias("_x"), "similarity").select("_x._ia", "_x._ib", "similarity")
        found = found.unionByName(a.select(F.col("_id").alias("_ia"), F.col("_id").alias("_ib"), F.lit(1.0).alias("similarity")))
    return a, b, found


def cross_similarity(left: DataFrame, right: DataFrame, minimum: float, keys: Sequence[str] = K) -> DataFrame:
    """Title pairs of different chapters with a token overlap of at least ``minimum``, one row each.

    ``left``: keys, chapter_no, item_no, title. ``right``: keys, chapter_no, title. Sets are compared once
    (``similar_sets``). Titles go along in blocks of about TITLE_BLOCK, and pairs of blocks are dealt to all tasks before they become
    pairs of titles, so what is shuffled grows with the titles and with the pairs of blocks.
    """
    sa, sb, pairs = _similar_ids(left, right, minimum, keys)
    parts = F.ceil(F.col("_n") / TITLE_BLOCK)

    def blocks(df: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        d = _token_sets(df, keys).select(*keys, *columns, "_set").join(sets.select(*keys, "_set", "_id", "_n"), [*keys, "_set"])
        return d.groupBy(*keys, "_id", F.pmod(F.xxhash64(*columns), parts).alias("_k")).agg(F.collect_list(F.struct(*columns)).alias("_l"))

    one = _same_rows(left.select(*keys, "chapter_no", "title"), right.select(*keys, "chapter_no", "title"))
    a = blocks(left, sa, "chapter_no", "item_no")
    a = materialize(a) if one else a
    b = a.withColumn("_l", F.col("_l.chapter_no")) if one else blocks(right, sb, "chapter_no").withColumn("_l", F.col("_l.chapter_no"))
    a = a.select(*keys, F.col("_id").alias("_ia"), F.col("_k").alias("_ka"), F.col("_l").alias("_la"))
    b = b.select(F.col("_id").alias("_ib"), F.col("_k").alias("_kb"), F.col("_l").alias("_lb"))
    dealt = sb.select(F.col("_id").alias("_ib"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("_kb"))
    full = pairs.join(dealt, "_ib").join(a, "_ia").join(b, ["_ib", "_kb"])
    # few rows that become very many: dealt anew, and no partitions are put together
    full = full.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_ia", "_ka", "_ib", "_kb")
    full = full.select(*keys, "similarity", F.explode("_la").alias("_a"), "_lb").select(*keys, "_a.*", "similarity", F.explode("_lb").alias("other_no"))
    return full.where(F.col("chapter_no") != F.col("other_no")).select(*keys, "chapter_no", "item_no", "other_no", "similarity")


def outline_risk(metrics: DataFrame, chapters: DataFrame, source_chunks: DataFrame, subsections: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, risk per video). ``source_chunks``: video_id, chapter_no, n_chunks."""
    m = metrics.join(source_chunks, ["video_id", "chapter_no"], "left").na.fill(0, ["n_chunks"])
    ratio = F.col("shot_count") / F.greatest(F.lit(1), F.col("video_shots"))
    m = m.withColumn("_ratio", ratio)

    def signal(df: DataFrame, name: str, cond: Column, value: Column, high: Column) -> DataFrame:
        return df.where(cond).select(
            "video_id", F.col("chapter_no").cast("int").alias("chapter_no"), F.lit(name).alias("signal"), value.cast("double").alias("value"),
            F.when(high, "high").otherwise("medium").alias("severity"),
        )

    no = F.lit(False)
    per_chapter = F.array(
        _flag("chapter_shot_ratio", (F.col("chapter_count") > 1) & (F.col("_ratio") >= 0.5), num.round_at(F.col("_ratio"), 3), F.col("_ratio") >= 0.6),
        _flag("topic_shift_count", F.col("shifts") >= 5, F.col("shifts"), F.col("shifts") >= 8),
        _flag("section_source_crossing", F.col("n_chunks") >= 4, F.col("n_chunks"), no),
        _flag(
            "chapter_count_low_for_long_video",
            (F.col("chapter_count") <= 2) & (F.col("video_shots") >= 80) & (F.col("chapter_no") == 1), F.col("chapter_count"), F.lit(True),
        ),
    )
    rows = m.select("video_id", F.col("chapter_no").cast("int").alias("chapter_no"), F.explode(F.filter(per_chapter, lambda s: s.isNotNull())).alias("s")).select(
        "video_id", "chapter_no", "s.signal", "s.value", "s.severity"
    )
    adj = adjacent_similarity(chapters)
    rows = rows.unionByName(signal(adj, "chapter_title_duplicate_topic", F.col("similarity") >= 0.65, num.round_at(F.col("similarity"), 3), no))
    if subsections is not None:
        cross = cross_similarity(subsections, chapters, 0.6)
        rows = rows.unionByName(
            signal(cross, "subsection_title_similar_to_chapter", F.lit(True), num.round_at(F.col("similarity"), 3), F.col("similarity") >= 0.75)
        )
    return rows, risk_rollup(chapters.select("video_id").distinct(), rows)


def _flag(name: str, cond: Column, value: Column, high: Column) -> Column:
    return F.when(
        cond,
        F.struct(F.lit(name).alias("signal"), value.cast("double").alias("value"), F.when(high, "high").otherwise("medium").alias("severity")),
    )


def risk_rollup(videos: DataFrame, signals: DataFrame) -> DataFrame:
    """high if any signal is high, medium if there is any, else low."""
    top = signals.groupBy("video_id").agg(F.max(F.when(F.col("severity") == "high", 2).otherwise(1)).alias("_r"))
    return videos.join(top, "video_id", "left").select(
        "video_id", F.when(F.col("_r") == 2, "high").when(F.col("_r") == 1, "medium").otherwise("low").alias("risk_level")
    )


def plan_outline(
    cards: DataFrame, chunks: DataFrame, sections: DataFrame, summary: DataFrame, manual_count: int | None = None, min_shots: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(chapters, chapter shots) with the strategy cascade: section sources, planner, even split."""
    from .chunks import target_chapters

    pos = materialize(cards.drop("merged_summary", "topic_tags", "key_entities", "narrative_role"))
    empty = None
    if manual_count is None:
        bridge = chunk_bridge(chunks, pos)
        first = _kept(section_drafts(sections, chunks, bridge))
        left = chunks.join(first[0].select("video_id").distinct(), "video_id", "left_anti")
        rest = pos.join(first[0].select("video_id").distinct(), "video_id", "left_anti").withColumn("merged_summary", F.lit(""))
        second = _kept(planner_drafts(left, chunk_bridge(left, rest), rest, sections))
        empty = first[0].select("video_id").unionByName(second[0].select("video_id")).distinct()
    named = sections.where(~F.col("title").isin(tx.PLACEHOLDER_TOPICS)).groupBy("video_id").agg(F.count(F.lit(1)).alias("_s"))
    targets = summary.join(named, "video_id", "left").select(
        "video_id", target_chapters(manual_count, F.col("suggested_chapter_count"), F.coalesce("_s", F.lit(0)).cast("int"), F.col("card_count")).alias("target")
    )
    bare = cards if empty is None else cards.join(empty, "video_id", "left_anti")
    last = _kept(even_split(bare, targets, sections))
    parts = [last] if empty is None else [first, second, last]
    drafts, shots = parts[0]
    for dr, sh in parts[1:]:
        drafts, shots = drafts.unionByName(dr), shots.unionByName(sh)
    placed = materialize(normalize_drafts(drafts, shots, pos, min_shots))
    return build_chapters(placed, drafts), placed


def _kept(option: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return materialize(option[0]), materialize(option[1])

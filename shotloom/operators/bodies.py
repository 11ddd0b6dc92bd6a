"""Chapter bodies: write batches, drafts, assembly, response parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as tg
from ..functions import text as tx
from .answers import answer_blocks
from .cards import no_strings
from .ordered import entry_states, top_k
from .staging import materialize

# Fixed values.
MAX_SHOTS_PER_CALL = 20
EMPTY_BODY = "本章节没有提取到足够的画面文字或字幕内容。"


def rename_duplicates(units: DataFrame, keys: Sequence[str], id_col: str, order: str = "ord") -> DataFrame:
    """A repeated id becomes ``<id>_dup_%03d`` with the unit's position; adds ``warning``.

    Only the first unit of an id keeps it, found by a pre-aggregated minimum.
    """
    first = units.groupBy(*keys, id_col).agg(F.min(order).alias("_first"))
    d = units.join(first, [*keys, id_col])
    again = F.col(order) > F.col("_first")
    return d.select(
        *[c for c in units.columns if c != id_col],
        F.when(again, F.format_string("%s_dup_%03d", id_col, order)).otherwise(F.col(id_col)).alias(id_col),
        F.when(again, F.concat(F.lit("duplicate_subsection_id_renamed:"), id_col)).alias("warning"),
    )


def greedy_batches(
    units: DataFrame, cap: int, keys: Sequence[str], size: str = "shot_count", order: str = "ord", block: int = 256
) -> DataFrame:
    """Batch number per unit, in order: a unit over the cap stands alone; else a batch closes when it would exceed the cap.

    ``order`` is the dense 1-based position. The rule is a small automaton: state 0 is "no open batch", state
    ``s + 1`` is an open batch of ``s`` shots. Each block of units is folded on its own; chapters longer than a
    block first learn the state in which each block begins.
    """
    spot = F.floor((F.col(order) - 1) / block).cast("int")
    rest = [c for c in units.columns if c not in (*keys, order)]
    unit = F.struct(F.col(order).cast("int").alias("o"), F.col(size).cast("int").alias("s"), F.struct(order, *rest).alias("row"))
    placed = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    packed = units.groupBy(*keys, spot.alias("_blk")).agg(F.array_sort(F.collect_list(unit), placed).alias("_u"))
    packed = materialize(packed)

    def advance(r: Column, k: Column, s: Column) -> Column:
        fits = (r > 0) & (r - 1 + s <= cap)
        return F.struct(
            F.when(s > cap, 0).when(fits, r + s).otherwise(s + 1).cast("int").alias("r"),
            F.when((s <= cap) & fits, k).otherwise(k + 1).cast("bigint").alias("k"),
        )

    zero = F.lit(0).cast("bigint")
    long = packed.where("_blk > 0").select(*keys).distinct()
    if long.isEmpty():
        d = packed.withColumn("entry_state", F.lit(0)).withColumn("entry_count", zero)
    else:
        every = F.sequence(F.lit(0), F.lit(cap + 1))
        ends = F.transform(
            every, lambda r0: F.aggregate("_u", F.struct(r0.alias("r"), zero.alias("k")), lambda a, u: advance(a["r"], a["k"], u["s"]))
        )
        table = F.map_from_arrays(every, ends)
        entry = entry_states(packed.join(long, list(keys), "left_semi").withColumn("fn", table), keys)
        d = packed.join(entry, [*keys, "_blk"], "left")

    def step(acc: Column, u: Column) -> Column:
        top = F.get(acc, F.size(acc) - 1)
        r = F.coalesce(top["r"], "entry_state", F.lit(0))
        k = F.coalesce(top["k"], "entry_count", zero)
        nxt = advance(r, k, u["s"])
        return F.concat(acc, F.array(F.struct(nxt["r"].alias("r"), nxt["k"].alias("k"))))

    empty = F.array().cast("array<struct<r:int,k:bigint>>")
    # The units travel with their block, so they are read and gathered once.
    numbered = F.zip_with("_u", F.aggregate("_u", empty, step), lambda u, x: F.struct(u["row"].alias("row"), x["k"].cast("int").alias("k")))
    return d.select(*keys, F.explode(numbered).alias("_x")).select(*keys, "_x.row.*", F.col("_x.k").alias("batch_no"))


def write_batches(batched: DataFrame, cap: int, keys: Sequence[str], unit: str, size: str = "shot_count") -> DataFrame:
    """One log row per batch; a batch holds at most ``cap`` shots or one oversize unit."""
    return batched.groupBy(*keys, "batch_no").agg(
        F.count(F.lit(1)).cast("int").alias("units"),
        F.sum(size).cast("int").alias("shot_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(unit).cast("string").alias("u")))), lambda x: x["u"]), ",").alias("unit_ids"),
        F.max(F.col(size) > cap).alias("oversized"),
    )


def draft_bodies(members: DataFrame, keys: Sequence[str], limit: int = 900, points: int = 5) -> DataFrame:
    """Extractive body and key points per group. ``members``: keys, ord, merged_summary, frame.

    Only the start of the joined text is used, so rows and characters far beyond ``limit`` can not matter; they are
    dropped before the group is gathered. Two characters more than the limit stay, since one of them may be a blank.
    """
    d = members.withColumn("_t", tx.strip(F.coalesce("merged_summary", F.lit(""))))
    lines = d.where("_t != ''").withColumn("_x", F.substring(tx.clean_text(F.col("_t")), 1, max(limit, 80) + 2))
    head = top_k(lines.select(*keys, "ord", "_x"), keys, [F.col("ord")], limit // 2 + 2)
    got = head.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "_x"))).alias("_l"))
    texts = F.transform("_l", lambda x: x["_x"])
    frame = d.where(F.coalesce("frame", F.lit("")) != "").groupBy(*keys).agg(F.min_by("frame", "ord").alias("representative_frame"))
    base = d.select(*keys).distinct().join(got, list(keys), "left").join(frame, list(keys), "left")
    return base.select(
        *keys,
        F.when(F.col("_l").isNull(), EMPTY_BODY).otherwise(tx.compact_text(F.array_join(texts, " "), limit)).alias("body_markdown"),
        F.coalesce(F.transform(F.slice(texts, 1, points), lambda t: tx.compact_text(t, 80)), no_strings()).alias("key_points"),
        "representative_frame",
    )


def assemble_bodies(outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Subsection outputs of a chapter to one body and its distinct key points.

    ``outputs``: keys, ord, title, body_markdown, key_points. A chapter has a few subsections.
    """
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), tx.strip_repeated_heading(F.col("body_markdown"), F.col("title")))
    got = outputs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", part.alias("p"), "key_points"))).alias("_l"))
    return got.select(
        *keys,
        F.array_join(F.transform("_l", lambda x: x["p"]), "\n\n").alias("body_markdown"),
        tx.ordered_distinct(F.flatten(F.transform("_l", lambda x: x["key_points"]))).alias("key_points"),
        F.size("_l").alias("subsection_count"),
    )


def expand_shot_refs(tokens: DataFrame, valid: DataFrame, keys: Sequence[str], ref_keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(expanded, invalid) of reference tokens: an id, or ``a-b`` over the valid order.

    ``tokens``: keys, ref_keys, tok_no, token. ``valid``: keys, shot_id, ord (dense).
    """
    ids = [*keys, *ref_keys]
    pos = valid.select(*keys, "shot_id", "ord")
    one = tokens.join(pos.withColumnRenamed("shot_id", "token"), [*keys, "token"]).select(*ids, "tok_no", "token", F.col("ord").alias("lo"), F.col("ord").alias("hi"))
    rest = tokens.join(pos.select(*keys, F.col("shot_id").alias("token")), [*keys, "token"], "left_anti").where(F.col("token").contains("-"))
    a = pos.select(*keys, F.col("shot_id").alias("_a"), F.col("ord").alias("_x"))
    b = pos.select(*keys, F.col("shot_id").alias("_b"), F.col("ord").alias("_y"))
    cut = rest.withColumn("_a", tx.strip(F.substring_index("token", "-", 1))).withColumn("_b", tx.strip(F.expr("substring(token, locate('-', token) + 1)")))
    two = cut.join(a, [*keys, "_a"]).join(b, [*keys, "_b"]).select(*ids, "tok_no", "token", F.least("_x", "_y").alias("lo"), F.greatest("_x", "_y").alias("hi"))
    spans = one.unionByName(two)
    flat = spans.select(*ids, "tok_no", F.explode(F.sequence("lo", "hi")).alias("ord"))
    first = flat.groupBy(*ids, "ord").agg(F.min("tok_no").alias("tok_no"))
    expanded = first.join(pos, [*keys, "ord"]).select(*ids, "shot_id", "ord", "tok_no")
    invalid = tokens.join(spans.select(*ids, "tok_no"), [*ids, "tok_no"], "left_anti").select(*ids, "tok_no", "token")
    return expanded, invalid


def response_tokens(df: DataFrame, keys: Sequence[str], refs: Column) -> DataFrame:
    """Reference tokens of a text column, numbered from 1."""
    return df.select(*keys, F.posexplode(tx.split_refs(refs)).alias("_p", "token")).select(*keys, (F.col("_p") + 1).alias("tok_no"), "token")


def outline_blocks(df: DataFrame, keys: Sequence[str], response: str, tag: str, title_limit: int | None, attrs: tuple[str, ...]) -> DataFrame:
    """Titled blocks of an outline answer: cleaned title, reference attribute, and whether an earlier block has the title.

    One answer is one row, so duplicates are settled inside it. ``block_no`` counts all blocks, those without a title
    too, as in ``block_summaries``; ``total`` is their number. `answers` puts blocks, limits and warnings together.
    """
    blocks = answer_blocks(F.col(response), tag, attrs, title_limit)
    d = df.select(*keys, blocks.alias("_b")).withColumn("_t", F.transform("_b", lambda b: b["title"]))
    d = d.select(*keys, F.size("_b").alias("total"), "_t", F.posexplode("_b").alias("_p", "b")).where(F.col("b.title") != "")
    dup = F.array_position("_t", F.col("b.title")) < F.col("_p") + 1
    return d.select(*keys, "total", (F.col("_p") + 1).alias("block_no"), F.col("b.title").alias("title"), F.col("b.refs").alias("refs"), dup.alias("duplicate"))


def block_summaries(df: DataFrame, keys: Sequence[str], response: str, tag: str, limit: int) -> DataFrame:
    """SUMMARY text that follows each block, before the next opening of ``tag``; numbered like the blocks."""
    s = F.transform(answer_blocks(F.col(response), tag, ()), lambda b: tx.compact_text(b["summary"], limit))
    return df.select(*keys, F.posexplode(s).alias("_p", "summary")).select(*keys, (F.col("_p") + 1).alias("block_no"), "summary")


def parse_chapter_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Tagged chapter answers: required body, title, key points with fallback, raw references.

    ``df``: ..., response, chapter_id, chapter_title, chapter_summary, frames.
    """
    c = F.col(response)
    body = F.coalesce(tg.extract_tag(c, "BODY_MARKDOWN"), F.lit(""))
    legacy = F.when(F.ltrim(c).startswith("{") & tg.extract_tag(c, "BODY_MARKDOWN").isNull(), F.try_parse_json(c))
    told = F.coalesce(tg.extract_tag(c, "CHAPTER_ID"), F.lit(""))
    title = F.coalesce(F.nullif(tg.extract_tag(c, "TITLE"), F.lit("")), "chapter_title")
    points = tg.tag_list(c, "KEY_POINTS")
    d = df.withColumn("_v", legacy).withColumn("_p", points).withColumn("_f", tg.resolve_choice(tg.extract_tag(c, "REPRESENTATIVE_FRAME"), F.col("frames")))
    spare = tx.compact_text(F.coalesce(F.nullif("chapter_summary", F.lit("")), title), 80)
    raw_refs = tg.extract_tag(c, "REFERENCED_SHOTS")
    js = F.col("_v").isNotNull()
    notes = F.filter(
        F.array(
            F.when((told != "") & (told != F.col("chapter_id")), F.concat(F.lit("chapter_id_mismatch_ignored:"), told)),
            F.when(raw_refs.isNull(), "referenced_shots_missing_fallback"),
            F.when(F.size("_p") == 0, "key_points_missing_fallback"),
        ),
        lambda x: x.isNotNull(),
    )
    return d.select(
        *[x for x in df.columns if x not in (response, "chapter_title", "chapter_summary", "frames")],
        F.when(js, "legacy_json_chapter").when(body != "", "tagged_chapter_v1").otherwise("failed").alias("format"),
        F.when(js, F.coalesce(F.try_variant_get("_v", "$.title", "string"), "chapter_title")).otherwise(title).alias("title"),
        F.when(js, F.coalesce(F.try_variant_get("_v", "$.body_markdown", "string"), F.lit(""))).otherwise(body).alias("body_markdown"),
        F.when(js, F.coalesce(F.try_variant_get("_v", "$.key_points", "array<string>"), no_strings())).when(F.size("_p") > 0, F.col("_p")).otherwise(F.array(spare)).alias("key_points"),
        raw_refs.alias("raw_refs"),
        F.when(js, F.try_variant_get("_v", "$.representative_frame", "string")).otherwise(F.col("_f.chosen")).alias("representative_frame"),
        F.when(js, no_strings()).otherwise(notes).alias("warnings"),
    )


def parse_subsection_responses(df: DataFrame, expected: DataFrame, keys: Sequence[str], response: str = "response") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outputs, ignored blocks, missing ids) of batch answers; one block per expected id, first one wins.

    ``expected``: keys, subsection_id.
    """
    blocks = df.select(*keys, F.posexplode(tg.tag_blocks(F.col(response), "SUBSECTION")).alias("_p", "b")).select(
        *keys, F.col("_p").alias("block_no"), F.coalesce(tg.attr(F.col("b.attrs"), "id", "subsection_id"), F.lit("<missing_id>")).alias("subsection_id"), F.col("b.body").alias("block")
    )
    known = blocks.join(expected, [*keys, "subsection_id"], "left_semi")
    first = known.groupBy(*keys, "subsection_id").agg(F.min("block_no").alias("block_no"))
    used = known.join(first, [*keys, "subsection_id", "block_no"])
    body = F.coalesce(tg.extract_tag(F.col("block"), "BODY_MARKDOWN"), tg.extract_tag(F.col("block"), "BODY"))
    outputs = used.select(
        *keys, "subsection_id", body.alias("body_markdown"), tg.tag_list(F.col("block"), "KEY_POINTS").alias("key_points"),
        tg.extract_tag(F.col("block"), "REFERENCED_SHOTS").alias("raw_refs"), F.when(F.coalesce(body, F.lit("")) == "", "failed").otherwise("done").alias("status"),
    )
    ignored = blocks.join(expected, [*keys, "subsection_id"], "left_anti").select(*keys, "block_no", "subsection_id", F.lit("invalid").alias("reason")).unionByName(
        known.join(first, [*keys, "subsection_id", "block_no"], "left_anti").select(*keys, "block_no", "subsection_id", F.lit("duplicate").alias("reason"))
    )
    missing = expected.join(first.select(*keys, "subsection_id"), [*keys, "subsection_id"], "left_anti")
    return outputs, ignored, missing


def write_bodies(units: DataFrame, unit_shots: DataFrame, cards: DataFrame, cap: int = MAX_SHOTS_PER_CALL) -> tuple[DataFrame, DataFrame]:
    """(chapter bodies, batch log) of chapters with subsections, written extractively.

    ``units``: video_id, chapter_id, ord, subsection_id, title. ``unit_shots``: video_id, chapter_id, subsection_id, shot_id.
    ``cards``: video_id, shot_id, ord, merged_summary, frame. Unknown shots are skipped; repeated ids are renamed.
    """
    keys = ["video_id", "chapter_id"]
    named = rename_duplicates(units, keys, "subsection_id")
    known = unit_shots.join(cards.select("video_id", "shot_id"), ["video_id", "shot_id"], "left_semi")
    sizes = known.groupBy(*keys, "subsection_id").agg(F.count(F.lit(1)).cast("int").alias("shot_count"))
    sized = named.join(sizes, [*keys, "subsection_id"], "left").na.fill(0, ["shot_count"])
    log = write_batches(greedy_batches(sized, cap, keys), cap, keys, "subsection_id")
    members = known.join(cards, ["video_id", "shot_id"])
    drafts = draft_bodies(members, [*keys, "subsection_id"], 520, 3)
    outputs = named.join(drafts, [*keys, "subsection_id"], "left").withColumn(
        "body_markdown", F.coalesce("body_markdown", F.lit(EMPTY_BODY))
    ).withColumn("key_points", F.when(F.size("key_points") > 0, F.col("key_points")).otherwise(F.array("title")))
    return assemble_bodies(outputs, keys), log

"""Queries over chapter drafts, outlines and their risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..operators import chunks as ck
from ..operators import outline as ol
from ..operators.staging import materialize
from . import oracle as o
from . import views as v
from .registry import query

SIZE = o.SIZE


def slim(spark, d):
    """Card positions without text work."""
    return v.texts(spark, d).select(
        "video_id", "doc_id", "ord", "card_count", F.format_string("shot_%03d", "ord").alias("shot_id"),
        (F.col("ord") * 10.0).alias("start_sec"), (F.col("ord") * 10.0 + 8).alias("end_sec"),
        num.round_at(num.text_importance(tx.strip(F.col("text"))), 3).alias("importance_score"),
    )


def chapters3(cards):
    per = F.ceil(F.col("card_count") / 3)
    return cards.withColumn("chapter_no", (F.floor((F.col("ord") - 1) / per) + 1).cast("int"))


def metrics(spark, d):
    return ol.chapter_metrics(chapters3(v.cards(spark, d).drop("merged_summary")))


def heads(spark, d):
    """First text line of each document: a title per card."""
    return v.table(spark, d, "documents").select(
        F.col("lang").alias("video_id"), F.col("source"), "doc_id", tx.clean_text(F.substring_index("text", "\n", 1)).alias("title")
    )


# --- ranges ------------------------------------------------------------------------


@query("resolve_chunk_ranges", o.with_views("v_text", """
  SELECT c.video_id, c.chunk_id, t.ord, printf('shot_%03d', t.ord) AS shot_id FROM c JOIN v_text t ON t.video_id = c.video_id AND CASE k
    WHEN 0 THEN t.ord BETWEEN a AND least(a + 2, n) AND a + 2 <= n OR (a + 2 > n AND t.ord = a)
    WHEN 1 THEN t.ord IN (a, a + 1) WHEN 2 THEN 10 * t.ord <= 10 * a + 12 AND 10 * t.ord + 8 >= 10 * a
    WHEN 3 THEN t.ord BETWEEN greatest(1, a - 2) AND a AND a > 2 OR (a <= 2 AND t.ord = a) WHEN 4 THEN 10 * t.ord <= 10 * a + 3 AND 10 * t.ord + 8 >= 10 * a - 10 ELSE false END""",
    {"c": "SELECT video_id, 'c' || doc_id AS chunk_id, ord AS a, doc_id // 20 % 6 AS k, count(*) OVER (PARTITION BY video_id) AS n FROM v_text"}))
def _(spark, d):
    c = slim(spark, d)
    sid = lambda e: F.format_string("shot_%03d", e)
    a, k = F.col("ord"), F.floor(F.col("doc_id") / 20) % 6
    items = (
        F.when(k == 0, F.array(sid(a), sid(a + 2))).when(k == 1, F.array(F.lit("x"), sid(a + 1), F.lit(" "), sid(a), F.lit("y")))
        .when(k == 2, F.array((a * 10 + 12).cast("string"), (a * 10).cast("string")))
    )
    text = (
        F.when(k == 3, F.concat(F.lit("from "), sid(a), F.lit("-"), sid(a - 2), F.lit(" (again "), sid(a), F.lit(")")))
        .when(k == 4, F.concat((a * 10 - 10).cast("string"), F.lit(".0 - "), (a * 10 + 3).cast("string"), F.lit("s"))).when(k == 5, F.lit("n/a 7"))
    )
    chunks = c.select("video_id", F.concat(F.lit("c"), "doc_id").alias("chunk_id"), items.alias("range_items"), text.alias("range_text"))
    return ol.resolve_chunk_ranges(chunks, c)[0]


@query("unparseable_chunk_ranges", """
  SELECT source AS video_id, 'c' || doc_id AS chunk_id, 'outline_chunk_range_unparseable:c' || doc_id AS warning FROM documents WHERE lang <> 'en'""")
def _(spark, d):
    c = slim(spark, d)
    lang = v.table(spark, d, "documents").select("doc_id", "lang")
    c = c.join(lang, "doc_id")
    chunks = c.select(
        "video_id", F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.when(F.col("lang") == "en", F.array("shot_id")).alias("range_items"),
        F.when(F.col("lang") != "en", "some words 12").alias("range_text"),
    )
    return ol.resolve_chunk_ranges(chunks, c)[1]


@query("chunk_shot_bridge", o.with_views("v_chunked", """
  SELECT video_id, printf('chunk_%03d', chunk_no) AS chunk_id, shot_id, ord FROM v_chunked"""))
def _(spark, d):
    c = slim(spark, d)
    ends = ck.balanced_chunks(c, SIZE).groupBy("video_id", "chunk_no").agg(F.min_by("shot_id", "ord").alias("first_shot"), F.max_by("shot_id", "ord").alias("last_shot"))
    return ol.chunk_bridge(ends.withColumn("chunk_id", F.format_string("chunk_%03d", "chunk_no")), c)


@query("ambiguous_keys", """
  SELECT CAST(l_suppkey AS VARCHAR) AS video_id, 'p' || l_partkey AS chunk_id, count(DISTINCT l_linenumber) AS sections FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber) > 1""")
def _(spark, d):
    li = v.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("video_id"), F.col("l_linenumber").alias("section_no"), F.array(F.concat(F.lit("p"), "l_partkey")).alias("source_chunks")
    ).distinct()
    return ol.ambiguous_keys(li)


# --- drafts ------------------------------------------------------------------------


@query("section_drafts", o.with_views("v_final_sections", """
  SELECT s.video_id, s.section_no - 1 AS draft_ord, s.title, left(c.summary, 220) AS summary, 'section_sources' AS strategy, c.card_count AS shots
  FROM v_final_sections s JOIN v_chunks c ON c.video_id = s.video_id AND c.chunk_id = s.chunk_id"""))
def _(spark, d):
    cards = v.cards(spark, d)
    chunks, _, sections = ck.reduce_summaries(cards, SIZE)
    drafts, shots = ol.section_drafts(sections, chunks, ol.chunk_bridge(chunks, slim(spark, d)))
    return drafts.join(shots.groupBy("video_id", "draft_ord").agg(F.count(F.lit(1)).alias("shots")), ["video_id", "draft_ord"])


@query("planner_drafts", o.with_views("v_chunks", f"""
  SELECT video_id, chunk_no - 1 AS draft_ord, coalesce(nullif(t, ''), 'Part ' || chunk_no) AS title, {o.compact("coalesce(nullif(summary, ''), t)", 80)} AS summary, 'outline_planner' AS strategy, card_count AS shots
  FROM (SELECT *, {o.compact(o.title("coalesce(nullif(main_topics[1], ''), summary)"), 28)} AS t FROM v_chunks) WHERE chunk_no <= 8"""))
def _(spark, d):
    chunks = ck.summarize_chunks(ck.balanced_chunks(v.cards(spark, d), SIZE))
    cards = slim(spark, d).withColumn("merged_summary", F.lit(""))
    none = chunks.select("video_id", F.lit(1).alias("section_no"), F.lit("x").alias("title")).where(F.lit(False))
    drafts, shots = ol.planner_drafts(chunks, ol.chunk_bridge(chunks, cards), cards, none)
    return drafts.join(shots.groupBy("video_id", "draft_ord").agg(F.count(F.lit(1)).alias("shots")), ["video_id", "draft_ord"])


@query("even_split", o.with_views("v_cards", """
  SELECT video_id, g AS draft_ord, CASE WHEN g = 0 THEN 'Intro ' || video_id ELSE 'Part ' || (g + 1) END AS title, md5(arg_max(merged_summary, importance_score * 1e6 - ord)) AS best, count(*) AS shots
  FROM (SELECT *, (ord - 1) // CAST(ceil(n / 4.0) AS BIGINT) AS g FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM v_cards)) GROUP BY ALL"""))
def _(spark, d):
    t = v.texts(spark, d)
    cards = t.select("video_id", "ord", "card_count", F.col("text").alias("merged_summary"), num.round_at(num.text_importance(tx.strip(F.col("text"))), 3).alias("importance_score"))
    vids = v.table(spark, d, "documents").select(F.col("source").alias("video_id")).distinct()
    names = vids.select("video_id", F.lit(1).alias("section_no"), F.concat(F.lit("Intro "), "video_id").alias("title"))
    drafts, shots = ol.even_split(cards, vids.withColumn("target", F.lit(4)), names)
    n = shots.groupBy("video_id", "draft_ord").agg(F.count(F.lit(1)).alias("shots"))
    return drafts.join(n, ["video_id", "draft_ord"]).select("video_id", "draft_ord", "title", F.md5("summary").alias("best"), "shots")


# Drafts with gaps, double claims, an untitled draft and reversed list order.
DRAFT_SQL = """
  d AS (SELECT video_id, ord, CASE WHEN ord % 12 BETWEEN 3 AND 8 THEN 10 - ord // 12 END AS a, CASE WHEN ord % 12 = 8 AND ord > 12 THEN 10 - ord // 12 + 1 END AS b FROM v_text),
  cl AS (SELECT video_id, ord, min(g) AS g FROM (SELECT video_id, ord, a AS g FROM d UNION ALL SELECT video_id, ord, b FROM d) WHERE g IS NOT NULL AND g <> 8 GROUP BY ALL)"""


def gap_drafts(cards):
    q = F.floor(F.col("ord") / 12).cast("int")
    a = F.when((F.col("ord") % 12).between(3, 8), F.lit(10) - q)
    b = F.when((F.col("ord") % 12 == 8) & (F.col("ord") > 12), F.lit(11) - q)
    shots = cards.select("video_id", "ord", F.explode(F.array(a, b)).alias("draft_ord")).where("draft_ord is not null")
    drafts = shots.select("video_id", "draft_ord").distinct().select(
        "video_id", "draft_ord", F.when(F.col("draft_ord") == 8, " ").otherwise(F.concat(F.lit("draft "), "draft_ord")).alias("title"),
        F.lit("").alias("summary"), F.lit("fixture").alias("strategy"),
    )
    return drafts, shots


NORMAL_SQL = f"""{DRAFT_SQL},
  h AS (SELECT video_id, list({{'g': g, 'lo': lo, 'hi': hi}} ORDER BY g) AS hs FROM (SELECT video_id, g, min(ord) AS lo, max(ord) AS hi FROM cl GROUP BY ALL) GROUP BY video_id),
  st AS (SELECT video_id, 0::BIGINT AS i, hs, NULL::BIGINT AS g FROM h UNION ALL
    SELECT x.video_id, x.i, list_transform(x.hs, lambda q: CASE WHEN q.g = x.g THEN {{'g': q.g, 'lo': least(q.lo, x.i), 'hi': greatest(q.hi, x.i)}} ELSE q END), x.g FROM (
      SELECT st.video_id, v.ord AS i, st.hs, coalesce(cl.g, list_filter(st.hs, lambda q: q.lo <= v.ord AND v.ord <= q.hi)[1].g,
        list_sort(list_transform(st.hs, lambda q: {{'d': least(abs(v.ord - q.lo), abs(v.ord - q.hi)), 'g': q.g}}))[1].g) AS g
      FROM st JOIN v_text v ON v.video_id = st.video_id AND v.ord = st.i + 1 LEFT JOIN cl ON cl.video_id = v.video_id AND cl.ord = v.ord) x),
  pl AS (SELECT video_id, i AS ord, g FROM st WHERE i > 0),
  ch AS (SELECT video_id, g, row_number() OVER (PARTITION BY video_id ORDER BY min(ord)) AS chapter_no FROM pl GROUP BY video_id, g)"""


@query("normalize_chapters", o.recursive(o.with_views("v_text", f""", {NORMAL_SQL}
  SELECT pl.video_id, pl.ord, ch.chapter_no, pl.g AS draft_ord FROM pl JOIN ch ON ch.video_id = pl.video_id AND ch.g = pl.g""")))
def _(spark, d):
    cards = slim(spark, d)
    drafts, shots = gap_drafts(cards)
    return ol.normalize_drafts(drafts, shots, cards, min_shots=1).select("video_id", "ord", "chapter_no", "draft_ord")


@query("build_chapters", o.recursive(o.with_views("v_text v_cards", f""", {NORMAL_SQL}
  SELECT pl.video_id, ch.chapter_no, printf('chapter_%03d', ch.chapter_no) AS chapter_id, 'draft ' || pl.g AS title, 'draft ' || pl.g AS summary, 'fixture' AS strategy, count(*) AS shot_count,
    min_by(c.shot_id, c.ord) AS start_shot_id, max_by(c.shot_id, c.ord) AS end_shot_id, arg_max(c.shot_id, c.importance_score * 1e6 - c.ord) AS representative_shot_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec
  FROM pl JOIN ch ON ch.video_id = pl.video_id AND ch.g = pl.g JOIN v_cards c ON c.video_id = pl.video_id AND c.ord = pl.ord GROUP BY pl.video_id, ch.chapter_no, pl.g""")))
def _(spark, d):
    cards = slim(spark, d)
    drafts, shots = gap_drafts(cards)
    return ol.build_chapters(ol.normalize_drafts(drafts, shots, cards, min_shots=1), drafts)


@query("merge_small_groups")
def _(spark, d):
    c = v.table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("ord"), F.floor(F.length("text") % 5).cast("int").alias("draft_ord"),
        F.concat(F.lit("t"), "turn").alias("shot_id"), F.when(F.length("text") > 900, 0.9).otherwise(0.3).alias("importance_score"),
        F.col("turn").cast("double").alias("start_sec"), (F.col("turn") + 1.0).alias("end_sec"),
    ).dropDuplicates(["video_id", "ord"])
    drafts = c.select("video_id", "draft_ord", F.concat(F.lit("g"), "draft_ord").alias("title")).distinct()
    return ol.normalize_drafts(drafts, c.select("video_id", "draft_ord", "ord"), c.drop("draft_ord"), 2).select("video_id", "ord", "chapter_no", "draft_ord")


@query("plan_outline", o.recursive(o.with_views("v_final_sections v_text", """
  , sc AS (SELECT c.video_id, c.ord, s.section_no - 1 AS g FROM v_chunked c JOIN v_final_sections s ON s.video_id = c.video_id AND s.chunk_id = printf('chunk_%03d', c.chunk_no)),
  h AS (SELECT video_id, g, min(ord) AS lo, max(ord) AS hi FROM sc GROUP BY ALL),
  pl AS (SELECT t.video_id, t.ord, coalesce(sc.g, (SELECT arg_max(g, hi) FROM h WHERE h.video_id = t.video_id AND h.hi < t.ord), (SELECT arg_min(g, lo) FROM h WHERE h.video_id = t.video_id)) AS g
    FROM v_text t LEFT JOIN sc ON sc.video_id = t.video_id AND sc.ord = t.ord)
  SELECT pl.video_id, row_number() OVER (PARTITION BY pl.video_id ORDER BY min(pl.ord)) AS chapter_no, s.title, 'section_sources' AS strategy, count(*) AS shot_count
  FROM pl JOIN v_final_sections s ON s.video_id = pl.video_id AND s.section_no - 1 = pl.g GROUP BY pl.video_id, pl.g, s.title""")))
def _(spark, d):
    cards = materialize(v.cards(spark, d))
    chunks, summary, sections = ck.reduce_summaries(cards, SIZE)
    chapters, _ = ol.plan_outline(cards, chunks, sections, summary)
    return chapters.select("video_id", "chapter_no", "title", "strategy", "shot_count")


@query("union_priority", """
  WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS video_id, l_partkey AS g, 1 AS r FROM lineitem WHERE l_discount > 0.08::DOUBLE
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_custkey, 2 FROM orders)
  SELECT s.video_id, s.g AS draft_ord, CASE r WHEN 1 THEN 'lines' ELSE 'order' END AS strategy FROM s JOIN (SELECT video_id, min(r) AS b FROM s GROUP BY ALL) m ON m.video_id = s.video_id AND r = b""")
def _(spark, d):
    a = v.table(spark, d, "lineitem").where("l_discount > 0.08").select(F.col("l_orderkey").cast("string").alias("video_id"), F.col("l_partkey").alias("draft_ord"), F.lit("lines").alias("strategy"))
    b = v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_custkey").alias("draft_ord"), F.lit("order").alias("strategy"))
    return ol.pick_strategy([(a, a), (b, b)])[0]


# --- metrics -----------------------------------------------------------------------


@query("topic_count", o.with_views("v_card_tokens", "SELECT video_id, chapter_no, count(DISTINCT t) AS topic_count FROM (SELECT video_id, chapter_no, unnest(tokens) AS t FROM v_card_tokens) GROUP BY ALL"))
def _(spark, d):
    c = chapters3(v.cards(spark, d).drop("merged_summary"))
    t = ol.topic_tokens(F.col("topic_tags"), F.col("key_entities"), F.col("narrative_role"))
    return c.select("video_id", "chapter_no", F.explode(t).alias("t")).distinct().groupBy("video_id", "chapter_no").agg(F.count(F.lit(1)).alias("topic_count"))


@query("topic_shift", o.recursive(o.with_views("v_shift_pick", "SELECT video_id, chapter_no, count(*) AS shifts FROM v_shift_pick GROUP BY ALL")))
def _(spark, d):
    return metrics(spark, d).where("shifts > 0").select("video_id", "chapter_no", "shifts")


@query("tertile_hits", o.with_views("v_chapter_cards", "SELECT video_id, chapter_no, count(DISTINCT least(2, pos * 3 // chap_n)) AS thirds FROM v_chapter_cards WHERE importance_score >= 0.7 GROUP BY ALL"))
def _(spark, d):
    return ol.tertile_hits(chapters3(slim(spark, d))).where("thirds > 0")


@query("outline_metrics", o.recursive(o.with_views("v_metrics", f"""
  SELECT video_id, chapter_no, shot_count, {o.rnd('shot_count::DOUBLE / video_shots', 3)} AS shot_ratio, duration_sec, topic_count, shifts, important_thirds FROM v_metrics""")))
def _(spark, d):
    return metrics(spark, d).select(
        "video_id", "chapter_no", "shot_count", num.round_at(F.col("shot_count") / F.col("video_shots"), 3).alias("shot_ratio"), "duration_sec", "topic_count", "shifts", "important_thirds"
    )


NEED_SQL = """
  SELECT *, CASE WHEN shot_count <= 4 OR shot_count < 8 THEN 'few_shots' WHEN cap < 2 OR shot_count < 4 THEN 'not_enough_subsection_capacity' WHEN duration_sec > 0 AND duration_sec <= 90 AND topic_count <= 2 THEN 'compact_single_topic' END AS guard,
    CASE WHEN shot_count >= 8 THEN 2 ELSE 0 END + CASE WHEN shot_count >= 14 THEN 1 ELSE 0 END + CASE WHEN duration_sec >= 180 THEN 1 ELSE 0 END + CASE WHEN duration_sec >= 360 THEN 1 ELSE 0 END
    + CASE WHEN topic_count >= 3 THEN 2 ELSE 0 END + CASE WHEN topic_count >= 5 THEN 1 ELSE 0 END + CASE WHEN shifts >= 2 THEN 2 ELSE 0 END + CASE WHEN important_thirds >= 2 THEN 1 ELSE 0 END
    + CASE WHEN chapter_no = 1 THEN 1 ELSE 0 END AS score
  FROM (SELECT *, least(5, greatest(1, CAST(ceil(shot_count / 4.0) AS BIGINT))) AS cap FROM v_metrics)"""


@query("subsection_need", o.recursive(o.with_views("v_metrics", f""", nd AS ({NEED_SQL})
  SELECT video_id, chapter_no, CASE WHEN guard IS NULL AND (score >= 5 OR (score = 4 AND shot_count::DOUBLE / video_shots >= 0.25 AND chapter_count <= 3)) THEN 'split' ELSE 'keep' END AS mode,
    CASE WHEN guard IS NULL THEN score ELSE 0 END AS need_score, least(cap, greatest(2, shifts + 1)) AS target_subsections, cap AS max_subsections,
    coalesce(guard, nullif(concat_ws(',', CASE WHEN shot_count >= 8 THEN 'many_shots' END, CASE WHEN shot_count >= 14 THEN 'very_many_shots' END, CASE WHEN duration_sec >= 180 THEN 'long_duration' END,
      CASE WHEN duration_sec >= 360 THEN 'very_long_duration' END, CASE WHEN topic_count >= 3 THEN 'many_topics' END, CASE WHEN topic_count >= 5 THEN 'very_many_topics' END, CASE WHEN shifts >= 2 THEN 'topic_shift' END,
      CASE WHEN important_thirds >= 2 THEN 'distributed_importance' END, CASE WHEN chapter_no = 1 THEN 'generic_title' END, CASE WHEN score = 4 AND shot_count::DOUBLE / video_shots >= 0.25 AND chapter_count <= 3 THEN 'dominant_chapter' END), ''), 'low_need_score') AS reasons
  FROM nd""")))
def _(spark, d):
    m = metrics(spark, d)
    titles = m.select("video_id", "chapter_no", F.when(F.col("chapter_no") == 1, "Overview").otherwise("Real title").alias("title"))
    got = ol.subsection_need(m, titles)
    return got.select("video_id", "chapter_no", "mode", "need_score", "target_subsections", "max_subsections", F.array_join("reason_codes", ",").alias("reasons"))


@query("split_subsections")
def _(spark, d):
    c = materialize(chapters3(v.cards(spark, d).drop("merged_summary")))
    m = ol.chapter_metrics(c)
    need = ol.subsection_need(m, m.select("video_id", "chapter_no", F.lit("Overview").alias("title")))
    drafts, shots = ol.subsection_drafts(c, need)
    placed = ol.normalize_subsections(drafts, shots, c)
    return placed.groupBy("video_id", "chapter_no", "subsection_no", "draft_ord").agg(F.count(F.lit(1)).alias("shots"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query("normalize_subsections", """
  WITH t AS (SELECT source AS video_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord, doc_id FROM documents),
  n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS k FROM t),
  p AS (SELECT video_id, ord, CASE WHEN ord < 4 THEN 0 ELSE least(4, CAST(floor(ord / 9.0) AS BIGINT) + CASE WHEN ord % 9 >= 4 THEN 0 ELSE -1 END) END AS g FROM n)
  SELECT video_id, ord, g + 1 AS subsection_no FROM p""")
def _(spark, d):
    c = slim(spark, d).withColumn("chapter_no", F.lit(1))
    claimed = c.where((F.col("ord") % 9).between(4, 6))
    shots = claimed.select("video_id", "chapter_no", F.floor(F.col("ord") / 9).cast("int").alias("draft_ord"), "ord")
    drafts = shots.select("video_id", "chapter_no", "draft_ord").distinct().withColumn("title", F.concat(F.lit("s"), "draft_ord"))
    return ol.normalize_subsections(drafts, shots, c).select("video_id", "ord", "subsection_no")


@query("group_coverage", """
  SELECT o_custkey, count(DISTINCT o_orderkey) FILTER (o_orderstatus <> 'P') AS assigned, count(*) AS total, count(DISTINCT o_orderkey) FILTER (o_orderstatus <> 'P')::DOUBLE / greatest(1, count(*)) >= 0.6 AS enough FROM orders GROUP BY o_custkey""")
def _(spark, d):
    orders = v.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return ol.coverage(orders.where("o_orderstatus <> 'P'"), orders, ["o_custkey"], "o_orderkey").drop("coverage")


# --- similarity and risk --------------------------------------------------------------

TITLES = f"""tt AS (SELECT lang AS video_id, doc_id, source, {o.clean("string_split(text, chr(10))[1]")} AS title FROM documents),
  tk AS (SELECT *, {o.title_words('title')} AS tok FROM tt)"""


@query("adjacent_pair_similarity", f"""
  WITH {TITLES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter_no FROM tk)
  SELECT a.source AS video_id, a.chapter_no, {o.rnd('CASE WHEN len(a.tok) = 0 AND len(b.tok) = 0 THEN 1.0 ELSE len(list_intersect(a.tok, b.tok))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.tok, b.tok)))) END', 6)} AS similarity
  FROM r a JOIN r b ON a.source = b.source AND b.chapter_no = a.chapter_no + 1""")
def _(spark, d):
    t = v.texts(spark, d).select("video_id", F.col("ord").alias("chapter_no"), tx.clean_text(F.substring_index("text", "\n", 1)).alias("title"))
    return ol.adjacent_similarity(t).withColumn("similarity", num.round_at(F.col("similarity"), 6))


@query("cross_title_similarity", f"""
  WITH {TITLES}, c AS (SELECT video_id, list_sort(list_distinct(tok)) AS tok, count(*) AS n FROM tk WHERE len(tok) > 0 GROUP BY ALL)
  SELECT a.video_id, array_to_string(a.tok, ' ') AS set_a, array_to_string(b.tok, ' ') AS set_b, a.n * b.n - CASE WHEN a.tok = b.tok THEN a.n ELSE 0 END AS title_pairs,
    {o.rnd('len(list_intersect(a.tok, b.tok))::DOUBLE / len(list_distinct(list_concat(a.tok, b.tok)))', 6)} AS similarity
  FROM c a JOIN c b ON a.video_id = b.video_id WHERE len(list_intersect(a.tok, b.tok))::DOUBLE / len(list_distinct(list_concat(a.tok, b.tok))) >= 0.6""")
def _(spark, d):
    t = heads(spark, d).select("video_id", "title")
    got = ol.similar_sets(t, t, 0.6)
    same = F.when(F.col("set_a") == F.col("set_b"), F.col("n_a")).otherwise(0)
    words = [F.replace(c, F.lit("\x1f"), F.lit(" ")).alias(c) for c in ("set_a", "set_b")]
    return got.select("video_id", *words, (F.col("n_a") * F.col("n_b") - same).alias("title_pairs"), num.round_at(F.col("similarity"), 6).alias("similarity"))


@query("cross_title_pairs", f"""
  WITH {TITLES}, c AS (SELECT video_id, doc_id, tok FROM tk WHERE len(tok) > 0), e AS (SELECT video_id, doc_id, tok FROM c)
  SELECT a.video_id, a.doc_id AS chapter_no, b.doc_id AS other_no, {o.rnd('len(list_intersect(a.tok, b.tok))::DOUBLE / len(list_distinct(list_concat(a.tok, b.tok)))', 6)} AS similarity
  FROM c a JOIN e b ON a.video_id = b.video_id AND a.doc_id <> b.doc_id WHERE len(list_intersect(a.tok, b.tok))::DOUBLE / len(list_distinct(list_concat(a.tok, b.tok))) >= 0.6""")
def _(spark, d):
    t = heads(spark, d).select("video_id", F.col("doc_id").alias("chapter_no"), F.lit(1).alias("item_no"), "title")
    got = ol.cross_similarity(t, t.drop("item_no"), 0.6)
    return got.select("video_id", "chapter_no", "other_no", num.round_at(F.col("similarity"), 6).alias("similarity"))


RISK_SQL = f""", src AS (SELECT video_id, chapter_no, count(DISTINCT pos // 4) AS n_chunks FROM v_chapter_cards GROUP BY ALL),
  sg AS (SELECT m.video_id, m.chapter_no, 'topic_shift_count' AS signal, shifts::DOUBLE AS value, CASE WHEN shifts >= 8 THEN 'high' ELSE 'medium' END AS severity FROM v_metrics m WHERE shifts >= 5
    UNION ALL SELECT video_id, chapter_no, 'chapter_shot_ratio', {o.rnd('shot_count::DOUBLE / video_shots', 3)}, CASE WHEN shot_count::DOUBLE / video_shots >= 0.6 THEN 'high' ELSE 'medium' END FROM v_metrics WHERE chapter_count > 1 AND shot_count::DOUBLE / video_shots >= 0.5
    UNION ALL SELECT video_id, chapter_no, 'section_source_crossing', n_chunks, 'medium' FROM src WHERE n_chunks >= 4
    UNION ALL SELECT video_id, 2, 'chapter_title_duplicate_topic', 1.0, 'medium' FROM v_metrics WHERE chapter_no = 2)"""


def risk(spark, d):
    c = chapters3(v.cards(spark, d).drop("merged_summary"))
    m = ol.chapter_metrics(c)
    per = F.ceil(F.col("card_count") / 3)
    src = chapters3(slim(spark, d)).groupBy("video_id", "chapter_no").agg(F.count_distinct(F.floor((F.col("ord") - 1) % per / 4)).alias("n_chunks"))
    chapters = m.select("video_id", "chapter_no", F.when(F.col("chapter_no") == 1, "opening words").otherwise("closing remarks").alias("title"))
    return ol.outline_risk(m, chapters, src)


@query("outline_risk_signals", o.recursive(o.with_views("v_metrics", f"{RISK_SQL} SELECT * FROM sg")))
def _(spark, d):
    return risk(spark, d)[0]


@query("outline_risk", o.recursive(o.with_views("v_metrics", f"""{RISK_SQL} SELECT v.video_id, CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level
  FROM (SELECT DISTINCT video_id FROM v_cards) v LEFT JOIN sg ON sg.video_id = v.video_id GROUP BY v.video_id""")))
def _(spark, d):
    return risk(spark, d)[1]

"""Queries over cards, chunks and the per-video summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..operators import cards as cd
from ..operators import chunks as ck
from ..operators import ordered as od
from ..operators.staging import materialize
from . import oracle as o
from . import views as v
from .registry import query, typed

SIZE = o.SIZE


def join(c, sep="|"):
    return F.array_join(c, sep)


def chunks(spark, d):
    """Chunk rows, written once: several steps read them."""
    return materialize(ck.summarize_chunks(ck.balanced_chunks(v.cards(spark, d), SIZE)))


@query("heuristic_cards", typed(o.with_views("v_card_keys", f"""
  SELECT t.video_id, t.ord, CASE WHEN b = '' THEN '该镜头没有可用字幕。' ELSE {o.compact('b', 180)} END AS subtitle_summary,
    coalesce(l4, '') AS key_entities, coalesce(l3, '内容提取') AS topic_tags, CASE WHEN b = '' THEN 'unknown' ELSE 'explanation' END AS narrative_role,
    {o.rnd('least(0.9::DOUBLE, greatest(0.15::DOUBLE, 0.25::DOUBLE + least(length(b), 180) / 260.0::DOUBLE))', 3)} AS importance_score,
    CASE WHEN b = '' THEN 0.2 ELSE 0.45 END AS confidence, 'kf/' || ord || '.jpg' AS frame,
    CASE WHEN ord % 2 = 0 THEN 'no_keyframes|' ELSE '' END || '{cd.NO_OCR_WARNING}' AS warnings
  FROM (SELECT video_id, ord, {o.strip('text')} AS b FROM v_text) t LEFT JOIN (SELECT video_id, ord, string_agg(token, '|' ORDER BY rank) FILTER (rank <= 4) AS l4,
    string_agg(token, '|' ORDER BY rank) FILTER (rank <= 3) AS l3 FROM v_card_keys GROUP BY ALL) k USING (video_id, ord)"""), double="confidence"))
def _(spark, d):
    p = v.texts(spark, d).select(
        "video_id", "ord", F.col("text").alias("subtitle_text"), F.array(F.concat(F.lit("kf/"), "ord", F.lit(".jpg"))).alias("frames"),
        F.when(F.col("ord") % 2 == 0, F.array(F.lit("no_keyframes"), F.lit(" "))).otherwise(cd.no_strings()).alias("warnings"),
    )
    return cd.heuristic_cards(p).select(
        "video_id", "ord", "subtitle_summary", join("key_entities").alias("key_entities"), join("topic_tags").alias("topic_tags"),
        "narrative_role", "importance_score", "confidence", F.col("recommended_display_frame").alias("frame"), join("warnings").alias("warnings"),
    )


@query("ocr_cards", f"""
  WITH c AS (SELECT conv_id, turn, role, {o.clean('text')} AS t FROM conversations),
  s AS (SELECT conv_id, string_agg(t, ' ' ORDER BY f) AS screen, count(*) AS n FROM (SELECT conv_id, t, min(turn) AS f FROM c WHERE t <> '' GROUP BY ALL) GROUP BY conv_id),
  k AS (SELECT conv_id, string_agg(w, '|' ORDER BY n DESC, length(w), w) AS kw FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, length(w), w) AS r FROM (
     SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest({o.words("screen || ' conv subtitle ' || conv_id")}) AS w FROM s) GROUP BY ALL)) WHERE r <= 3 GROUP BY conv_id)
  SELECT CAST(s.conv_id AS VARCHAR) AS video_id, kw AS topic_tags, s.n AS n_texts, {o.rnd("least(0.95::DOUBLE, greatest(0.85::DOUBLE, 0.25::DOUBLE + s.n * 0.08::DOUBLE + least(length('conv subtitle ' || s.conv_id), 160) / 320.0::DOUBLE))", 3)} AS importance_score,
   'f' || b.turn AS frame FROM s JOIN k ON k.conv_id = s.conv_id JOIN (SELECT conv_id, min(turn) AS turn FROM c GROUP BY conv_id) b ON b.conv_id = s.conv_id""")
def _(spark, d):
    c = v.table(spark, d, "conversations")
    vid = F.col("conv_id").cast("string").alias("video_id")
    packs = c.select(vid, F.lit("s1").alias("shot_id"), F.concat(F.lit("conv subtitle "), "conv_id").alias("subtitle_text")).distinct()
    texts = c.select(
        vid, F.lit("s1").alias("shot_id"), (F.col("turn") + 1).cast("int").alias("frame_no"), F.concat(F.lit("f"), "turn").alias("frame"), F.lit(1).alias("ord"), "text"
    )
    got = cd.ocr_cards(packs, texts, 1_000_000)
    return got.select("video_id", join("topic_tags").alias("topic_tags"), F.size("on_screen_text").alias("n_texts"), "importance_score", F.col("recommended_display_frame").alias("frame"))




@query("parse_card_responses", typed(f"""
  SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN page_id % 7 = 0 THEN 'merged_summary' ELSE '' END AS missing_tags,
   'see ' || page_id AS visual_summary, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'alpha beta ' || url END AS merged_summary,
   'e1|e2' AS key_entities, CASE WHEN page_id % 2 = 0 THEN 't1|t2' WHEN page_id % 7 = 0 THEN '内容提取' ELSE NULL END AS topic_tags,
   CASE WHEN page_id % 3 = 0 THEN 'demo' ELSE 'unknown' END AS narrative_role, CASE WHEN page_id % 5 = 0 THEN 1.0 ELSE 0.25 END AS importance_score, 0.5 AS confidence,
   CASE WHEN page_id % 4 = 0 THEN 'kf/b.jpg' ELSE 'kf/a.jpg' END AS frame,
   concat_ws('|', 'w0', CASE WHEN page_id % 4 = 1 THEN '模型返回的推荐帧不在候选关键帧中，已回退到 kf/a.jpg。' END, CASE WHEN page_id % 3 > 0 THEN '模型返回了未知 narrative_role=odd，已改为 unknown。' END) AS warnings FROM pages""", double="importance_score confidence"))
def _(spark, d):
    k = F.col("page_id")
    resp = F.concat_ws(
        "\n", F.concat(F.lit("<visual_summary> see "), k, F.lit("</visual_summary>")),
        F.when(k % 7 != 0, F.concat(F.lit("<merged_summary x='1'>alpha beta "), "url", F.lit("</merged_summary>"))),
        F.lit("<key_entities>- e1\n- e2\n- e1</key_entities>"),
        F.when(k % 2 == 0, F.lit("<topic_tags>t1、t2</topic_tags>")),
        F.when(k % 3 == 0, F.lit("<narrative_role>Demo</narrative_role>")).otherwise("<narrative_role>odd</narrative_role>"),
        F.when(k % 5 == 0, F.lit("<importance_score>about 1.7</importance_score>")).otherwise("<importance_score>0.25</importance_score>"),
        F.when(k % 4 == 0, F.lit("<recommended_display_frame>`b.jpg`</recommended_display_frame>")).when(k % 4 == 1, F.lit("<recommended_display_frame>zz</recommended_display_frame>")),
        F.lit("<warnings>none</warnings>"),
    )
    p = v.table(spark, d, "pages").select(
        "page_id", resp.alias("response"), F.array(F.lit("kf/a.jpg"), F.lit("kf/b.jpg")).alias("frames"), F.lit("").alias("subtitle_text"), F.array(F.lit("w0")).alias("warnings")
    )
    got = cd.parse_card_responses(p)
    tags = F.when((k % 2 == 1) & (k % 7 != 0), F.lit(None).cast("string")).otherwise(join("topic_tags"))
    return got.select(
        "page_id", "status", "missing_tags", "visual_summary", "merged_summary", join("key_entities").alias("key_entities"), tags.alias("topic_tags"),
        "narrative_role", "importance_score", "confidence", F.col("recommended_display_frame").alias("frame"), join("warnings").alias("warnings"),
    )


@query("shot_briefs", o.with_views("v_cards", """
  SELECT video_id, shot_id, start_sec, end_sec, left(clean_text, 90) AS text, array_to_string(topic_tags, '|') AS topic_tags,
    array_to_string(key_entities, '|') AS key_entities, importance_score FROM v_cards"""))
def _(spark, d):
    return cd.shot_briefs(v.cards(spark, d)).select(
        "video_id", "shot_id", "start_sec", "end_sec", "text", join("topic_tags").alias("topic_tags"), join("key_entities").alias("key_entities"), "importance_score"
    )


@query("chunk_briefs", o.with_views("v_chunks", f"""
  SELECT video_id, chunk_id, first_shot, last_shot, array_to_string(main_topics, '|') AS topics, {o.compact('summary', 240)} AS outline_text, {o.compact('summary', 260)} AS planner_text FROM v_chunks"""))
def _(spark, d):
    s = F.col("summary")
    return chunks(spark, d).select(
        "video_id", "chunk_id", "first_shot", "last_shot", join(F.slice("main_topics", 1, 5)).alias("topics"),
        tx.compact_text(s, 240).alias("outline_text"), tx.compact_text(s, 260).alias("planner_text"),
    )


CONTEXT_LINE = f"""'- ' || shot_id || '; time ' || printf('%.2fs', start_sec) || '-' || printf('%.2fs', end_sec) || '; score ' || CAST(importance_score AS VARCHAR)
   || CASE WHEN clean_text <> '' THEN '; text: ' || {o.cut('clean_text', 180)} ELSE '' END
   || '; topics: ' || array_to_string(list_transform(topic_tags, lambda x: {o.cut('x', 48)}), ', ')
   || CASE WHEN len(key_entities) > 0 THEN '; entities: ' || array_to_string(list_transform(key_entities, lambda x: {o.cut('x', 48)}), ', ') ELSE '' END"""


@query("prompt_rows", o.with_views("v_chunked", f"""
  SELECT video_id, chunk_no, 'Input context:' || chr(10) || 'Chunk id: ' || printf('chunk_%03d', chunk_no) || chr(10) || 'Shot range: ' || min_by(shot_id, ord) || ' to ' || max_by(shot_id, ord)
    || chr(10) || 'Shots:' || chr(10) || string_agg({CONTEXT_LINE}, chr(10) ORDER BY ord) AS prompt FROM v_chunked GROUP BY video_id, chunk_no"""))
def _(spark, d):
    c = ck.balanced_chunks(v.cards(spark, d), SIZE)
    ends = F.struct(F.min_by("shot_id", "ord").alias("a"), F.max_by("shot_id", "ord").alias("z"))
    lines = F.sort_array(F.collect_list(F.struct("ord", cd.context_line(180).alias("l"))))
    got = c.groupBy("video_id", "chunk_no").agg(lines.alias("l"), ends.alias("e"))
    head = F.concat(
        F.lit("Input context:\nChunk id: "), F.format_string("chunk_%03d", "chunk_no"), F.lit("\nShot range: "), F.col("e.a"), F.lit(" to "), F.col("e.z"), F.lit("\nShots:\n")
    )
    return got.select("video_id", "chunk_no", F.concat(head, join(F.transform("l", lambda x: x["l"]), "\n")).alias("prompt"))


@query("outline_prompt_rows", o.with_views("v_chunks", f"""
  SELECT video_id, 'Input context:' || chr(10) || 'Chunk summaries:' || chr(10) || string_agg('- ' || chunk_id || '; shots ' || first_shot || ', ' || last_shot || '; topics: ' ||
    array_to_string(list_transform(main_topics, lambda x: {o.cut('x', 60)}), ', ') || CASE WHEN summary <> '' THEN '; summary: ' || {o.compact('summary', 260)} ELSE '' END, chr(10) ORDER BY chunk_no) AS prompt
  FROM v_chunks GROUP BY video_id"""))
def _(spark, d):
    return cd.prompt_rows(chunks(spark, d), F.lit("Chunk summaries:"), cd.chunk_line(), ["video_id"], "chunk_no")


@query("scored_prompts", o.with_views("v_text", f"""SELECT video_id, ord, length({o.compact('text', 180)}) AS prompt_chars FROM v_text"""))
def _(spark, d):
    def scorer(batches):
        for b in batches:
            yield b.assign(prompt_chars=b.prompt.str.len())[["video_id", "ord", "prompt_chars"]]

    t = v.texts(spark, d).select("video_id", "ord", tx.compact_text(F.col("text"), 180).alias("prompt"))
    return cd.with_scorer(t, scorer, "video_id string, ord int, prompt_chars long")


# --- chunks ------------------------------------------------------------------------


@query("balanced_chunks", o.with_views("v_chunked", "SELECT video_id, doc_id, ord, chunk_no FROM v_chunked"))
def _(spark, d):
    return ck.balanced_chunks(v.texts(spark, d).drop("text"), SIZE).select("video_id", "doc_id", "ord", "chunk_no")


@query("summarize_chunks", o.with_views("v_chunks", """
  SELECT video_id, chunk_id, card_count, first_shot, last_shot, array_to_string(main_topics, '|') AS main_topics, summary, array_to_string(important_shots, '|') AS important_shots FROM v_chunks"""))
def _(spark, d):
    return chunks(spark, d).withColumn("main_topics", join("main_topics")).withColumn("important_shots", join("important_shots")).drop("chunk_no")


@query("merge_topics", o.with_views("v_topics", "SELECT video_id, topic, first_at // 1000 AS chunk_no, first_at % 1000 - 1 AS pos FROM v_topics"))
def _(spark, d):
    return ck.merge_topics(chunks(spark, d)).select("video_id", "topic", "first_at.chunk_no", "first_at.pos")


@query("important_shots", o.with_views("v_chunks", """
  SELECT video_id, shot_id, rank FROM (SELECT video_id, shot_id, row_number() OVER (PARTITION BY video_id ORDER BY p) AS rank FROM (
    SELECT video_id, shot_id, min(chunk_no * 1000 + i) AS p FROM (SELECT video_id, chunk_no, unnest(important_shots) AS shot_id, generate_subscripts(important_shots, 1) AS i FROM v_chunks) GROUP BY ALL)) WHERE rank <= 20"""))
def _(spark, d):
    return ck.important_shots(chunks(spark, d))


@query("suggest_section_count", o.with_views("v_topics", f"""
  SELECT c.video_id, least(6, n, greatest(coalesce(t, 0), CAST(ceil(n / {SIZE // 2}::DOUBLE) AS BIGINT), (n + 7) // 8, 1)) AS suggested FROM (SELECT video_id, sum(card_count)::BIGINT AS n FROM v_chunks GROUP BY ALL) c
  LEFT JOIN (SELECT video_id, count(*) AS t FROM v_topics WHERE topic NOT IN ({o.PLACEHOLDERS}) GROUP BY ALL) k ON k.video_id = c.video_id"""))
def _(spark, d):
    c = chunks(spark, d)
    n = c.groupBy("video_id").agg(F.sum("card_count").alias("n"))
    t = ck.merge_topics(c).where(~F.col("topic").isin(tx.PLACEHOLDER_TOPICS)).groupBy("video_id").agg(F.count(F.lit(1)).alias("t"))
    return n.join(t, "video_id", "left").select("video_id", ck.suggest_sections(F.col("n"), F.coalesce("t", F.lit(0)), SIZE).alias("suggested"))


@query("target_chapter_count", """
  SELECT source AS video_id, least(8, greatest(1, least(greatest(count(*) % 7, count(DISTINCT lang), 1), count(*)))) AS chapters, 8 AS manual_high, 1 AS manual_low FROM documents GROUP BY source""")
def _(spark, d):
    g = v.table(spark, d, "documents").groupBy(F.col("source").alias("video_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("s"))
    none = F.lit(0)
    return g.select(
        "video_id", ck.target_chapters(None, F.col("n") % 7, F.col("s"), F.col("n")).alias("chapters"),
        ck.target_chapters(99, none, none, none).alias("manual_high"), ck.target_chapters(0, none, none, none).alias("manual_low"),
    )


@query("sections_from_chunks", o.with_views("v_sections", "SELECT video_id, section_no, title, chunk_id AS source_chunks FROM v_sections"))
def _(spark, d):
    return ck.sections_from_chunks(chunks(spark, d)).withColumn("source_chunks", join("source_chunks"))


@query("build_global_summary", typed(o.with_views("v_final_sections v_topics", f"""
  SELECT c.video_id, n AS card_count, {o.compact('theme', 24)} AS video_main_theme, k AS section_count, least(6, greatest(1, n), greatest(1, k)) AS suggested_chapter_count, 'structured_report' AS narrative_style
  FROM (SELECT video_id, sum(card_count) AS n FROM v_chunks GROUP BY ALL) c JOIN (SELECT video_id, count(*) AS k FROM v_final_sections GROUP BY ALL) s ON s.video_id = c.video_id
  JOIN (SELECT video_id, min_by(topic, first_at) AS theme FROM v_topics GROUP BY ALL) t ON t.video_id = c.video_id"""), bigint="card_count suggested_chapter_count"))
def _(spark, d):
    return ck.reduce_summaries(v.cards(spark, d), SIZE)[1].drop("fallback")


@query("reduce_summaries", o.with_views("v_final_sections", "SELECT video_id, section_no, title, chunk_id AS source_chunks FROM v_final_sections"))
def _(spark, d):
    return ck.reduce_summaries(v.cards(spark, d), SIZE)[2].select("video_id", "section_no", "title", join("source_chunks").alias("source_chunks"))


@query("top_k_stable", o.with_views("v_cards", """
  SELECT video_id, shot_id, rank FROM (SELECT video_id, shot_id, row_number() OVER (PARTITION BY video_id ORDER BY importance_score DESC, ord) AS rank FROM v_cards) WHERE rank <= 5"""))
def _(spark, d):
    t = v.texts(spark, d).select(
        "video_id", "ord", F.format_string("shot_%03d", "ord").alias("shot_id"), num.round_at(num.text_importance(tx.strip(F.col("text"))), 3).alias("importance_score")
    )
    return od.top_k(t, ["video_id"], [F.desc("importance_score"), F.col("ord")], 5).select("video_id", "shot_id", "rank")


@query("argmax_row", o.with_views("v_cards", "SELECT video_id, arg_max(shot_id, importance_score * 1e6 - ord) AS shot_id FROM v_cards GROUP BY video_id"))
def _(spark, d):
    t = v.texts(spark, d).select(
        "video_id", "ord", F.format_string("shot_%03d", "ord").alias("shot_id"), num.round_at(num.text_importance(tx.strip(F.col("text"))), 3).alias("i")
    )
    return t.groupBy("video_id").agg(F.max_by("shot_id", F.struct("i", -F.col("ord"))).alias("shot_id"))


@query("subsection_briefs", o.with_views("v_chapter_cards", f"""
  SELECT video_id, chapter_no, shot_id, 'Chapter ' || chapter_no AS title, array_to_string(topic_tags, '|') AS topic_tags, {o.cut('clean_text', 90)} AS text, 2 AS target_subsections FROM v_chapter_cards"""))
def _(spark, d):
    c = v.cards(spark, d)
    shots = c.withColumn("chapter_no", (F.floor((F.col("ord") - 1) / F.ceil(F.col("card_count") / 3)) + 1).cast("int"))
    heads = shots.select("video_id", "chapter_no").distinct().select(
        "*", F.concat(F.lit("Chapter "), "chapter_no").alias("title"), F.lit("s").alias("summary"), F.lit(2).alias("target_subsections"), F.lit(3).alias("max_subsections")
    )
    got = cd.subsection_briefs(heads, shots)
    return got.select("video_id", "chapter_no", "shot_id", "title", join("topic_tags").alias("topic_tags"), "text", "target_subsections")

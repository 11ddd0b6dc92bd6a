"""Known small facts, each under two video ids to show that videos stay apart."""

from pyspark.sql import functions as F

from shotloom.functions import jsontext as js
from shotloom.functions import numbers as num
from shotloom.functions import tags as tg
from shotloom.functions import text as tx
from shotloom.operators import cards as cd
from shotloom.operators import chunks as ck
from shotloom.operators import intervals as iv
from shotloom.operators import ocr
from shotloom.operators import outline as ol
from shotloom.operators import qa
from shotloom.operators import shots as sh


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_overlap_and_touching(spark):
    shots = spark.createDataFrame([(v, "shot_001", 0.0, 2.0) for v in "ab"], "video_id string, shot_id string, start_sec double, end_sec double")
    segs = spark.createDataFrame(
        [("a", "sub_0001", 1, 1.0, 3.0, "hello"), ("b", "sub_0002", 1, 2.0, 3.0, "touch")],
        "video_id string, segment_id string, seq int, start_sec double, end_sec double, text string",
    )
    pairs = iv.overlap_pairs(shots, segs, bucket_sec=0.5)
    row = pairs.collect()
    assert [(r.video_id, r.overlap_sec, r.overlap_ratio) for r in row] == [("a", 1.0, 0.5)]
    got = {r.video_id: r.subtitle_text for r in iv.align_subtitles(shots, pairs).collect()}
    assert got == {"a": "hello", "b": ""}


def test_time_codes(spark):
    assert one(spark, num.srt_time(F.lit(65.25))) == "00:01:05,250"
    assert one(spark, num.parse_srt_time(F.lit("00:00:02,5"))) == 2.5
    assert one(spark, num.parse_srt_time(F.lit("0:2"))) is None
    assert one(spark, num.srt_time(F.lit(-3.0))) == "00:00:00,000"


def test_chunk_sizes(spark):
    for n, sizes in ((41, [21, 20]), (81, [27, 27, 27]), (40, [40]), (1, [1])):
        d = spark.range(1, n + 1).select(F.col("id").cast("int").alias("ord"), F.lit(n).alias("card_count"))
        got = ck.balanced_chunks(d, 40).groupBy("chunk_no").count().orderBy("chunk_no").collect()
        assert [r["count"] for r in got] == sizes


def test_missing_frame_warning(spark):
    shots = spark.createDataFrame([("a", "s1", 1)], "video_id string, shot_id string, seq long").withColumn("warnings", F.array().cast("array<string>"))
    aligned = spark.createDataFrame([("a", "s1", "hi")], "video_id string, shot_id string, subtitle_text string")
    missing = spark.createDataFrame([("a", "s1", "missing.jpg")], "video_id string, shot_id string, path string")
    row = sh.build_packages(shots, aligned, missing, F.lit(0)).first()
    assert row.warnings == ["missing_frame:missing.jpg"] and row.subtitle_text == "hi" and row.previous_shot_id is None


def test_damaged_json(spark):
    r = one(spark, js.repaired_json(F.lit('```json\n{"a": 1,}\n```')))
    assert r.status == "fixed" and r.text == '{"a": 1}'
    assert one(spark, js.repaired_json(F.lit("nothing"))).status == "failed"


def test_low_ocr_scores_drop(spark):
    d = spark.createDataFrame([("a", '[{"res":{"rec_texts":["One","low"," Two "],"rec_scores":[0.98,0.2,0.9]}}]')], "video_id string, r string")
    assert [x.text for x in ocr.explode_ocr(d, ["video_id"], "r", 0.5).orderBy("ord").collect()] == ["One", "Two"]


def test_tags(spark):
    t = F.lit("<Topic_Tags a='1'>- x\n- `y`\n- x</Topic_Tags><KEEP/>")
    assert one(spark, tg.tag_list(t, "topic_tags")) == ["x", "y"]
    assert one(spark, tg.has_flag_tag(t, "KEEP")) is True
    assert one(spark, tg.extract_tag(t, "none")) is None
    assert one(spark, tg.attr_map(F.lit(' A="1" b=\'2\' a="3"'))) == {"a": "3", "b": "2"}


def test_text_rules(spark):
    assert one(spark, tx.compact_text(F.lit("a  b" + "c" * 20), 10)) == "a bcccccc..."
    assert one(spark, tx.clean_title(F.lit("第3章：**标题** "))) == "标题"
    assert one(spark, tx.keywords(F.lit("the Shot beta alpha beta 视频 视频 c"), 3)) == ["视频", "beta", "alpha"]
    assert one(spark, tx.keywords(F.lit("the this"), 3)) == []
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, tx.error_category(F.lit("HTTP 500 timed out"))) == "timeout"
    assert one(spark, tx.inline_plain(F.lit("`a*b*` **x** __y__ *z* _w_ [t](http://u)"))) == "a*b* x y z w t"


def cards_frame(spark, n, video="a", tags=None):
    rows = [(video, i, f"shot_{i:03d}", 10.0 * i, 10.0 * i + 8, [tags[(i - 1) % len(tags)] if tags else "topic"], 0.5, n, f"text {i}") for i in range(1, n + 1)]
    return spark.createDataFrame(
        rows, "video_id string, ord int, shot_id string, start_sec double, end_sec double, topic_tags array<string>, importance_score double, card_count int, merged_summary string"
    ).withColumn("key_entities", F.array().cast("array<string>")).withColumn("narrative_role", F.lit("unknown"))


def test_section_sources_make_chapters(spark):
    cards = cards_frame(spark, 6).unionByName(cards_frame(spark, 6, "b"))
    chunks = spark.createDataFrame(
        [(v, i, f"chunk_{i:03d}", f"shot_{2 * i - 1:03d}", f"shot_{2 * i:03d}", ["t"], f"sum {i}") for v in "ab" for i in (1, 2, 3)],
        "video_id string, chunk_no int, chunk_id string, first_shot string, last_shot string, main_topics array<string>, summary string",
    )
    sections = spark.createDataFrame(
        [(v, 1, "One", ["chunk_001"]) for v in "ab"] + [(v, 2, "Two", ["chunk_002", "chunk_003"]) for v in "ab"],
        "video_id string, section_no int, title string, source_chunks array<string>",
    )
    summary = spark.createDataFrame([("a", 6, 2), ("b", 6, 2)], "video_id string, card_count int, suggested_chapter_count int")
    chapters, placed = ol.plan_outline(cards, chunks, sections, summary)
    got = sorted((r.video_id, r.chapter_no, r.title, r.strategy, r.shot_count) for r in chapters.collect())
    assert got == [(v, n, t, "section_sources", c) for v in "ab" for n, t, c in ((1, "One", 2), (2, "Two", 4))]
    assert placed.count() == 12
    chapters, _ = ol.plan_outline(cards, chunks, sections, summary, manual_count=1)
    assert [(r.strategy, r.shot_count) for r in chapters.collect()] == [("even_split_fallback", 6)] * 2


def test_twice_claimed_chunk_rejects_sections(spark):
    cards = cards_frame(spark, 4)
    chunks = spark.createDataFrame(
        [("a", 1, "c1", "shot_001", "shot_002", ["alpha"], "x"), ("a", 2, "c2", "shot_003", "shot_004", ["beta"], "y")],
        "video_id string, chunk_no int, chunk_id string, first_shot string, last_shot string, main_topics array<string>, summary string",
    )
    sections = spark.createDataFrame([("a", 1, "One", ["c1"]), ("a", 2, "Two", ["c1", "c2"])], "video_id string, section_no int, title string, source_chunks array<string>")
    summary = spark.createDataFrame([("a", 4, 2)], "video_id string, card_count int, suggested_chapter_count int")
    chapters, _ = ol.plan_outline(cards, chunks, sections, summary)
    assert [(r.title, r.strategy) for r in chapters.orderBy("chapter_no").collect()] == [("alpha", "outline_planner"), ("beta", "outline_planner")]


def test_sparse_and_dense_chapters(spark):
    sparse = cards_frame(spark, 2).withColumn("chapter_no", F.lit(1))
    dense = cards_frame(spark, 8, "b", ["t1", "t2", "t3", "t4"]).withColumn("chapter_no", F.lit(1)).withColumn(
        "importance_score", F.when(F.col("ord").isin(1, 8), 0.9).otherwise(0.3)
    )
    m = ol.chapter_metrics(sparse.unionByName(dense))
    got = {r.video_id: r for r in ol.subsection_need(m, m.select("video_id", "chapter_no", F.lit("A title").alias("title"))).collect()}
    assert (got["a"].mode, got["a"].reason_codes) == ("keep", ["few_shots"])
    assert got["b"].mode == "split" and got["b"].need_score >= 5 and "many_topics" in got["b"].reason_codes


def test_headings(spark):
    b = spark.createDataFrame([("c1", "## First\n\ntext")], "chapter_id string, body_markdown string")
    p = spark.createDataFrame([("c1", 1, "First"), ("c1", 2, "Second")], "chapter_id string, ord int, title string")
    assert {r.title: r.status for r in qa.heading_check(b, p, ["chapter_id"]).collect()} == {"First": "ok", "Second": "missing"}


def test_cut_in_three_colour_clip(spark):
    rows = []
    for i in range(42):
        level = (10.0, 120.0, 240.0)[i // 14]
        hist = [0.0] * 4
        hist[i // 14] = 1.0
        rows.append(("a", i, [level] * 8, hist, [0.0] * 8))
    d = spark.createDataFrame(rows, "video_id string, frame_idx int, gray array<double>, hist array<double>, edge array<double>")
    got = [(r.start_frame, r.end_frame) for r in sh.detect_shots(d, fps=12.0).orderBy("shot_no").collect()]
    assert got == [(0, 13), (14, 27), (28, 41)]


def test_card_response_needs_tags(spark):
    d = spark.createDataFrame([("a", "<visual_summary>v</visual_summary>")], "video_id string, response string").select(
        "*", F.array().cast("array<string>").alias("frames"), F.lit("").alias("subtitle_text"), F.array().cast("array<string>").alias("warnings")
    )
    r = cd.parse_card_responses(d).first()
    assert (r.status, r.missing_tags) == ("failed", "merged_summary")

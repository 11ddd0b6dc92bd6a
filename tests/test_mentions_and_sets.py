"""Mentions, title sets and small public rules against plain Python."""

import random
import re

from pyspark.sql import functions as F

from shotloom.functions import text as tx
from shotloom.operators import calls, intervals, outline


def brute_mentions(text, ids):
    out = {}
    for ref in ids:
        m = re.search(rf"(?<![A-Za-z0-9_]){re.escape(ref)}(?![A-Za-z0-9_])", text) if ref else None
        if m:
            at = m.start() + (0 if not re.search("[A-Za-z0-9_]", ref) else re.search("[A-Za-z0-9_]", ref).start())
            out[ref] = len(re.findall("[A-Za-z0-9_]+", text[:at])) + 1
    return out


def test_mentions_of_any_ids_equal_brute_force(spark):
    rng = random.Random(6)
    ids = ["shot_1", "shot-1", "shot-1.a", "a.b", "1", "-1", "a-", "镜头1", "镜头", "--", "-", "a  b", "é", "(x)", "x.", ".", "", None, "shot_1"]
    bits = ["shot_1", "shot", "-", "1", ".", "a", "b", " ", "  ", "镜头", "é", "(", ")", "x", "_", "--"]
    texts = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))) for k in range(400)] + [(900, None), (901, ""), (902, "shot_1 " * 20_000)]
    t = spark.createDataFrame(texts, "text_id long, text string")
    got = {}
    for r in intervals.mention_join(t, spark.createDataFrame([(i,) for i in ids], "ref_id string"), keys=[]).collect():
        assert got.setdefault(r.text_id, {}).setdefault(r.ref_id, r.pos) == r.pos
    want = {k: found for k, text in texts if (found := brute_mentions(text or "", [i for i in dict.fromkeys(ids) if i]))}
    assert got == want


def test_a_word_in_every_text_is_spread_over_keys(spark):
    t = spark.range(2_000).select(F.col("id").alias("text_id"), F.lit("the shot-7 the").alias("text"))
    ids = spark.createDataFrame([("the",), ("shot-7",), ("none",)], "ref_id string")
    got = intervals.mention_join(t, ids, keys=[])
    assert {(r.ref_id, r.pos, r.n) for r in got.groupBy("ref_id", "pos").agg(F.count("*").alias("n")).collect()} == {("the", 1, 2_000), ("shot-7", 2, 2_000)}
    assert "_salt" in got._jdf.queryExecution().executedPlan().toString()
    assert intervals.mention_join(t, ids.limit(0), keys=[]).count() == 0


def test_title_sets_in_blocks_equal_brute_force(spark):
    """Half of the titles are one title, one word is in all of them, and blocks hold a few sets only."""
    rng = random.Random(7)
    words = [f"word{k}" for k in range(14)]
    titles = [("v", "common same title") for _ in range(150)] + [("v", "common " + " ".join(rng.sample(words, rng.randint(1, 5)))) for _ in range(150)] + [("w", "common"), ("w", None), ("w", "")]
    df = spark.createDataFrame(titles, "video_id string, title string")
    tok = {r.title: frozenset(r.t) for r in df.select("title", tx.title_tokens(F.col("title")).alias("t")).distinct().collect() if r.t}
    for minimum in (0.5, 0.6, 0.75, 1.0):
        want = {}
        for va, a in titles:
            for vb, b in titles:
                if va == vb and tok.get(a) and tok.get(b) and len(tok[a] & tok[b]) / len(tok[a] | tok[b]) >= minimum:
                    want[va, tok[a], tok[b]] = want.get((va, tok[a], tok[b]), 0) + 1
        got = outline.similar_sets(df, df, minimum, block=8).collect()
        as_set = lambda s: frozenset(s.split("\x1f"))
        assert len(got) == len(want) and {(r.video_id, as_set(r.set_a), as_set(r.set_b)): r.n_a * r.n_b for r in got} == want
    assert outline.set_members(df).count() == sum(1 for _, t in titles if tok.get(t))


def test_tertiles_coverage_and_surplus_groups(spark):
    cards = spark.createDataFrame([("v", 1, k, 0.9 if k in (1, 2, 9) else None) for k in range(1, 10)] + [("v", 2, 5, 0.1)], "video_id string, chapter_no int, ord int, importance_score double")
    assert {(r.chapter_no, r.thirds) for r in outline.tertile_hits(cards).collect()} == {(1, 2), (2, 0)}
    members = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 1)], "video_id string, shot_id int")
    got = outline.coverage(members.where("shot_id < 3").unionByName(members.where("shot_id = 1 and video_id = 'a'")), members, ["video_id"], "shot_id")
    assert {tuple(r) for r in got.collect()} == {("a", 3, 5, 0.6, True), ("b", 1, 1, 1.0, True)}
    items = spark.createDataFrame([("v", g, k) for k, g in enumerate((3, 3, 7, 9, 12, 40))], "video_id string, group_ord int, k int")
    assert {(r.k, r.kept_ord) for r in outline.truncate_and_merge(items, 3).collect()} == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 2)}


def test_usage_and_last_status(spark):
    rows = ['{"usage":{"total_tokens":7,"x":{"y":1}},"choices":[{"finish_reason":"stop"},{"finish_reason":"length"}]}', '{"usage":null,"choices":[]}', '[{"usage":1}]', "oops", None, '{"choices":{"finish_reason":"stop"},"usage":3}']
    got = [tuple(r)[1:] for r in calls.usage_fields(spark.createDataFrame(list(enumerate(rows)), "k int, response string")).orderBy("k").drop("response").collect()]
    none = (None,) * 5
    assert got == [('{"total_tokens":7,"x":{"y":1}}', None, None, 7, "stop"), none, none, none, none, ("3", None, None, None, None)]
    log = spark.createDataFrame([("f", 1, 1, "failure"), ("f", 2, 1, None), ("g", 5, 1, "success"), ("g", 5, 2, "failure")], "function string, time long, call_id long, status string")
    assert {tuple(r) for r in calls.last_status(log).collect()} == {("f", None), ("g", "failure")}


def test_title_sets_of_two_sides_and_their_title_pairs(spark):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(9)]
    make = lambda n: [("v", k, 1, " ".join(rng.sample(words, rng.randint(1, 5)))) for k in range(n)]
    left, right = make(60), make(45)
    schema = "video_id string, chapter_no int, item_no int, title string"
    l_df, r_df = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    near = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) >= 0.6
    got = [(r.chapter_no, r.other_no) for r in outline.cross_similarity(l_df, r_df.drop("item_no"), 0.6).collect()]
    assert sorted(got) == sorted((a[1], b[1]) for a in left for b in right if a[1] != b[1] and near(a[3], b[3]))
    got = [(r.chapter_no, r.other_no) for r in outline.cross_similarity(l_df, l_df.drop("item_no"), 0.6).collect()]
    assert sorted(got) == sorted((a[1], b[1]) for a in left for b in left if a[1] != b[1] and near(a[3], b[3]))


def test_no_title_text_goes_along_with_its_tokens(spark):
    """Sets meet by number; the pairs hold no title."""
    t = spark.range(20).select(F.lit("v").alias("video_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id")) for k in range(400)]).alias("title"))
    met = outline._similar_ids(t, t, 0.6, ["video_id"])[2]
    assert met.columns == ["_ia", "_ib", "similarity"] and met.count() == 20


def brute_sets(rows, others, minimum):
    near = lambda a, b: len(a & b) / len(a | b) >= minimum
    sets, more = ({(v, frozenset(t.split())) for v, t in x if v and t} for x in (rows, others))
    return {(v, a, b) for v, a in sets for w, b in more if v == w and near(a, b)}


def found_sets(left, right, minimum, **more):
    got = [(r.video_id, frozenset(r.set_a.split("\x1f")), frozenset(r.set_b.split("\x1f"))) for r in outline.similar_sets(left, right, minimum, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_what_leaves_the_task_of_a_token_is_nearly_the_result(spark):
    """Sets that share rare tokens but are not alike stay there, and alike ones leave it once."""
    rng = random.Random(3)
    words = [f"word{k}" for k in range(120)]
    rows = [("v", " ".join(rng.sample(words, 30))) for _ in range(400)]
    rows += [("v", " ".join(words[:30] + rng.sample(words[30:], 3))) for _ in range(60)]
    df = spark.createDataFrame(rows, "video_id string, title string")
    a, b, same, found = outline._similar(df, df, 0.6, ["video_id"], 64)
    pairs = outline._met(a, b, same, 0.6, ["video_id"], 64).collect()
    want = (len(brute_sets(rows, rows, 0.6)) - len({frozenset(t.split()) for _, t in rows})) // 2
    assert found.count() == want >= 60 * 59 // 2 and len({tuple(p) for p in pairs}) <= 1.05 * want and len(pairs) <= 2 * want
    assert {t for _, t in outline._met(a, b, same, 0.6, ["video_id"], 64).dtypes} == {"bigint"}


def test_tokens_of_one_hash_and_of_one_slot_lose_no_pair(spark, monkeypatch):
    both = spark.range(400_000).select(F.concat(F.lit("w"), "id").alias("w")).groupBy(F.hash(F.lit("v"), "w")).agg(F.collect_list("w").alias("w")).where("size(w) > 1")
    twins = [sorted(r.w)[:2] for r in both.limit(3).collect()]
    assert twins
    rng = random.Random(5)
    words = [w for t in twins for w in t] + [f"word{k}" for k in range(8)]
    rows = [("v", " ".join(rng.sample(words, rng.randint(1, 7)))) for _ in range(120)] + [(None, "some title"), ("w", "some title")]
    others = [("v", " ".join(rng.sample(words, rng.randint(1, 7)))) for _ in range(80)] + [(None, "some title")]
    left, right = (spark.createDataFrame(x, "video_id string, title string") for x in (rows, others))
    for slots, before in ((2**20, 8), (4, 1)):
        monkeypatch.setattr(outline, "TOKEN_SLOTS", slots)
        monkeypatch.setattr(outline, "BEFORE", before)
        assert found_sets(left, left, 0.6, block=16) == brute_sets(rows, rows, 0.6)
        assert found_sets(left, right, 0.5, block=16) == brute_sets(rows, others, 0.5)


def test_a_set_of_a_null_video_meets_nothing(spark):
    df = spark.createDataFrame([(None, "some title"), (None, "some title"), ("v", "some title")], "video_id string, title string")
    assert [r.video_id for r in outline.similar_sets(df, df, 0.6).collect()] == ["v"]


def test_titles_of_one_set_become_pairs_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(outline, "TITLE_BLOCK", 32, raising=False)
    t = spark.range(300).select(F.lit("v").alias("video_id"), F.col("id").alias("chapter_no"), F.lit(1).alias("item_no"), F.lit("one title of many").alias("title"))
    got = outline.cross_similarity(t, t.drop("item_no"), 0.6)
    tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 300 * 299 and max(tasks) < 0.4 * sum(tasks)
    assert got.select("chapter_no", "other_no").distinct().count() == 300 * 299


def test_a_table_without_its_item_column_is_the_same_side(spark):
    t = spark.createDataFrame([("v", 1, 1, "a title"), ("v", 1, 2, "a title"), ("v", 2, 1, "a title")], "video_id string, chapter_no int, item_no int, title string")
    titles = lambda x: x.select("video_id", "title")
    assert outline._same_rows(titles(t), titles(t.drop("item_no"))) and not outline._same_rows(titles(t), titles(t.where("item_no = 1")))
    got = [(r.chapter_no, r.item_no, r.other_no) for r in outline.cross_similarity(t, t.drop("item_no"), 0.6).collect()]
    assert sorted(got) == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 1, 1)]

"""Further cases of the review of round 3."""

import duckdb
from pyspark.sql import functions as F

from shotloom.operators import shots as sh
from tests.test_reviewed import both


def test_a_cut_on_the_last_frame_opens_a_shot(spark, tmp_path):
    con = duckdb.connect()
    vectors = con.execute("""SELECT i::BIGINT AS vec_id, 1::INT AS label,
      list_transform(range(64), lambda j: CASE WHEN i = 59 THEN (j % 7)::FLOAT / 7 ELSE (j % 2)::FLOAT / 2 + 0.25::FLOAT END) AS embedding FROM range(60) t(i)""").df()
    got, want = both(spark, tmp_path, "detect_shots", {"embeddings": vectors})
    assert len(got) == 2 and got == want
    # left to itself the operator merges so short a scene
    frames = spark.createDataFrame([("a", i, [9.0 * (i == 29)] * 4, [1.0 + i // 29, 1.0], [0.0] * 4) for i in range(30)], "video_id string, frame_idx int, gray array<double>, hist array<double>, edge array<double>")
    assert [(r.start_frame, r.end_frame) for r in sh.detect_shots(frames, fps=12.0).collect()] == [(0, 29)]


def test_sensitive_values_are_taken_out_inside_the_row_as_in_the_shuffle(spark, monkeypatch):
    from shotloom.functions import nested

    many = ",".join(f'{{"k":{i},"token_secret":[{i},{{"a":[1]}}]}}' for i in range(200))
    rows = [
        '{"secret":{"a":[1,{"b":2}],"c":{}},"d":[{"password":[]},{"x":{"Bearer":{"y":[[1]]}}}]}', f"[{many}]", f'{{"secret":[{many}],"z":1}}',
        '[1]],"secret":[3', '{"secret":1,"a":[true,null]}', "no json {", None,
    ]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, p string")
    got = {}
    for tokens in (0, 1024, 100_000):
        monkeypatch.setattr(nested, "IN_ROW", tokens)
        got[tokens] = [r.p for r in nested.redact_payloads(d, "p").orderBy("i").collect()]
    assert got[0] == got[1024] == got[100_000]
    mask = '"***redacted***"'
    assert got[1024][0] == f'{{"secret":{mask},"d":[{{"password":{mask}}},{{"x":{{"Bearer":{mask}}}}}]}}'
    assert got[1024][1] == "[" + ",".join(f'{{"k":{i},"token_secret":{mask}}}' for i in range(200)) + "]"
    assert got[1024][2:4] == [f'{{"secret":{mask},"z":1}}', f'[1]],"secret":{mask}']  # what never closes is masked to the end


def test_mentions_do_not_depend_on_the_filter_of_hashes(spark, monkeypatch):
    from shotloom.operators import intervals as iv

    texts = spark.createDataFrame([(i, f"see a-{i % 7} and b.{i % 5}, a-{i % 3}; x{i}") for i in range(60)] + [(99, None)], "text_id int, text string")
    ids = spark.createDataFrame([("a-1",), ("b.3",), ("x7",), ("a-6",), ("none-1",)], "ref_id string")
    got = {}
    for slots in (1, 2**20):
        monkeypatch.setattr(iv, "ID_SLOTS", slots)
        found = iv.mention_join(texts, ids, keys=[])
        got[slots] = sorted(map(tuple, found.collect()))
    assert got[1] == got[2**20] and len(got[1]) == len({(i, w) for i in range(60) for w in (f"a-{i % 7}", f"b.{i % 5}", f"a-{i % 3}", f"x{i}")} & {(i, w) for i in range(60) for w in ("a-1", "b.3", "x7", "a-6")})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan.split("Aggregate")[1]  # before stretches are grouped and shuffled


def test_keywords_and_the_start_of_long_texts(spark):
    import random

    from pyspark.sql import functions as F

    from shotloom.functions import text as tx

    rng = random.Random(5)
    parts = ["the", "Cat", "cat-x", "视频笔记", "视频", "笔", "a", "Ab", "Kelvin", "x_1", "9z", ",", "\n\n", "\t ", "　", "é", "字" * 3, "😀"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " " * 500 + "ab " * 40), (1003, "a" + " " * 400 + "b" * 30), (1004, "c" * 20), (1005, "c" * 21)]
    d = spark.createDataFrame(rows, "i int, t string")
    t = F.col("t")
    old = F.transform(tx.ranked_keywords(tx.words(t), 5), lambda k: k["token"])
    for r in d.select("t", old.alias("a"), tx.keywords(t, 5).alias("b"), tx.compact_text(t, 20).alias("c"), tx.compact_start(t, 20).alias("d")).collect():
        assert r.a == r.b and r.c == r.d, r.t


def test_batched_units_travel_with_their_block(spark):
    from shotloom.operators import bodies as bd

    rows = [("a", i, (7 * i) % 13 + 1, {"n": i}) for i in range(1, 40)] + [("b", 1, 50, {}), ("b", 2, 3, None)]
    d = spark.createDataFrame(rows, "chapter_id string, ord int, shot_count int, notes map<string,int>")
    got = bd.greedy_batches(d, 20, ["chapter_id"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == ["chapter_id", "ord", "shot_count", "notes", "batch_no"]
    want, held, batch = [], 0, 0
    for k, i, s, notes in rows:
        if k == "b":
            want.append((k, i, s, notes, i))
            continue
        if not batch or held + s > 20:
            held, batch = 0, batch + 1
        held += s
        want.append((k, i, s, notes, batch))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want


def test_each_reference_is_looked_up_once(spark):
    from shotloom.operators import qa

    one = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    cs = one([("v", "c1", "s1"), ("v", "c1", "s2"), ("v", "c1", "s2"), ("w", "c1", "x1")], "video_id chapter_id shot_id")
    heads = one([("v", "c1", "s0")], "video_id chapter_id shot_id")
    sub = one([("v", "c1", "1", "s1"), ("v", "c1", "1", "s9"), ("v", "c2", "1", "s2")], "video_id chapter_id subsection_id shot_id")
    sub_heads = one([("v", "c1", "1", "s1"), ("v", "c1", "2", "s1")], "video_id chapter_id subsection_id shot_id")
    cards = one([("v", "s1"), ("v", "s2"), ("v", "s2"), ("v", "s9")], "video_id shot_id")
    got = qa.orphan_refs(cs, heads, sub, sub_heads, cards)
    assert sorted(map(tuple, got.collect())) == [("v", "s0"), ("v", "s1"), ("v", "s2"), ("v", "s9"), ("w", "x1")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 3


def test_expected_keys_are_not_gathered_in_the_tasks_that_read_them(spark):
    """the keys go to their partitions first; copies, keys that are null and keys on one side only count as before."""
    from shotloom.operators import refs as rf

    e = spark.createDataFrame([(1,), (1,), (2,), (2,), (None,), (5,)], "k int")
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1), (3, "z", 1), (None, "n", 1)], "k int, val string, n int")
    parts = rf.expected_vs_actual(e, a, ["k"], "n")
    kept, extra, miss = [sorted((tuple(r) for r in p.collect()), key=str) for p in parts]
    assert kept == [(1, "y", 2)] and extra == [(3, "z", 1), (3, "z", 1), (None, "n", 1)] and miss == [(2,), (5,), (None,)]
    for p in rf.expected_vs_actual(spark.range(9).select((F.col("id") % 3).cast("int").alias("k")), a, ["k"], "n"):
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "HashAggregate" not in plan.split("REPARTITION_BY_NUM")[1].split("Range")[0]

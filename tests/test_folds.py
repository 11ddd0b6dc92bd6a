"""Parallel forms of order-dependent rules against plain loops over random data."""

import random

import pytest
from pyspark.sql import functions as F

from shotloom.functions import boxes as bx
from shotloom.operators import bodies as bd
from shotloom.operators import intervals as iv
from shotloom.operators import ordered as od
from shotloom.operators import outline as ol
from shotloom.operators import shots as sh


def test_ordinals_and_neighbors_cross_buckets(spark):
    d = spark.createDataFrame([(k, x) for k in "ab" for x in random.Random(1).sample(range(500), 60)], "k string, x int")
    o = od.with_ordinal(d, ["k"], [F.col("x")], F.floor(F.col("x") / 7), total="n")
    o = od.with_neighbors(o, ["k"], ["x"], F.floor(F.col("x") / 7), prev={"p": "x"}, next_={"q": "x"})
    for k in "ab":
        rows = sorted((r.x, r.ord, r.n, r.p, r.q) for r in o.where(F.col("k") == k).collect())
        xs = [r[0] for r in rows]
        assert rows == [(x, i + 1, 60, xs[i - 1] if i else None, xs[i + 1] if i < 59 else None) for i, x in enumerate(xs)]


def test_quantiles(spark):
    np = pytest.importorskip("numpy")
    rng = random.Random(2)
    vals = {k: [round(rng.random(), rng.choice([1, 6])) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 301))}
    d = spark.createDataFrame([(k, v) for k, vs in vals.items() for v in vs], "k string, s double")
    got = od.group_quantiles(d, ["k"], "s", {"m": F.lit(0.5), "p": F.lit(0.968)}, buckets=16).collect()
    for r in got:
        assert abs(r.m - np.percentile(vals[r.k], 50)) < 1e-12 and abs(r.p - np.percentile(vals[r.k], 96.8)) < 1e-12


def test_min_gap(spark):
    rng = random.Random(3)
    pts = {k: sorted(rng.sample(range(1, 400), 90)) for k in "ab"}
    d = spark.createDataFrame([(k, x) for k, xs in pts.items() for x in xs], "video_id string, frame_idx int")
    for gap, anchor, block in ((9, 0, 4096), (9, 0, 10), (4, None, 4), (30, 0, 30)):
        got = sorted((r.video_id, r.frame_idx) for r in sh.min_gap_select(d, gap, anchor=anchor, block=block).collect())
        want = []
        for k, xs in pts.items():
            kept = [anchor] if anchor is not None else [xs[0]]
            for x in xs:
                if x - kept[-1] >= gap:
                    kept.append(x)
            want += [(k, x) for x in kept]
        assert got == sorted(want)


def test_merge_short_scenes(spark):
    rng = random.Random(4)
    rows = []
    for k in "abcdef":
        at = 0
        for i in range(40):
            at += rng.randint(-3, 9)
            rows.append((k, i, at, at + rng.randint(-2, 12), 150))
    rows += [("z", 0, 9, 3, 20)]
    d = spark.createDataFrame(rows, "video_id string, seq long, start_frame long, end_frame long, frame_count long")
    got = sorted((r.video_id, r.start_frame, r.end_frame) for r in sh.merge_short_scenes(d, 6).collect())
    want = []
    for k in sorted({r[0] for r in rows}):
        kept = []
        for _, _, s, e, n in [r for r in rows if r[0] == k]:
            s, e = max(0, s), min(n - 1, e)
            if e < s:
                continue
            if kept and s <= kept[-1][1]:
                kept[-1][1] = max(kept[-1][1], e)
            elif not kept or e - s + 1 >= 6:
                kept.append([s, e])
            else:
                kept[-1][1] = e
        want += [(k, s, e) for s, e in kept or [[0, 19]]]
    assert got == sorted(want)


def test_greedy_batches(spark):
    rng = random.Random(5)
    sizes = {k: [rng.choice([0, 1, 2, 3, 5, 9, 14]) for _ in range(30)] for k in "abcd"}
    sizes["e"] = [2, 5, 2]
    d = spark.createDataFrame([(k, i + 1, s) for k, ss in sizes.items() for i, s in enumerate(ss)], "chapter_id string, ord int, shot_count int")
    for cap, block in ((4, 1024), (4, 3), (10, 4)):
        got = {(r.chapter_id, r.ord): r.batch_no for r in bd.greedy_batches(d, cap, ["chapter_id"], block=block).collect()}
        for k, ss in sizes.items():
            no, run, open_ = 0, 0, False
            for i, s in enumerate(ss):
                if s > cap:
                    no, open_ = no + 1, False
                elif open_ and run + s <= cap:
                    run += s
                else:
                    no, run, open_ = no + 1, s, True
                assert got[(k, i + 1)] == no, (cap, k, i)
    assert len({b for (k, _), b in got.items() if k == "e"}) == 1


def test_fold_small_groups(spark):
    rng = random.Random(6)
    cases = [[(g, rng.randint(1, 4), rng.random() < 0.3) for g in range(rng.randint(1, 8))] for _ in range(60)]
    cases = [[(g, n, keep and n == 1) for g, n, keep in c] for c in cases]
    for least in (2, 3, 5):
        d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, gs array<struct<g:int,n:int,keep:boolean>>")
        got = {r.i: [(k.g, k.n, sorted(k.members)) for k in r.f] for r in d.select("i", ol.fold_small_groups(F.col("gs"), least).alias("f")).collect()}
        for i, c in enumerate(cases):
            items = [[g, n, keep, [g]] for g, n, keep in c]
            while len(items) > 1:
                at = next((j for j, x in enumerate(items) if x[1] < least and not x[2]), None)
                if at is None:
                    break
                x = items.pop(at)
                to = items[at - 1] if at else items[0]
                to[1], to[2], to[3] = to[1] + x[1], False, to[3] + x[3]
            assert got[i] == [(g, n, sorted(m)) for g, n, _, m in items]


def test_growing_groups(spark):
    rng = random.Random(7)
    cases = []
    for i in range(80):
        hulls = []
        for g in range(rng.randint(1, 5)):
            a = rng.randint(1, 30)
            hulls.append((g, a, min(30, a + rng.randint(0, 6))))
        cases.append((i, hulls))
    d = spark.createDataFrame(cases, "i int, hulls array<struct<group_ord:int,lo:int,hi:int>>").withColumn("o", F.explode(F.sequence(F.lit(1), F.lit(30))))
    got = {(r.i, r.o): r.g for r in d.select("i", "o", iv.growing_group(F.col("hulls"), F.col("o")).alias("g")).collect()}
    for i, hulls in cases:
        # The end positions of a hull are claimed; a claimed position belongs to its first claimer.
        claimed = {}
        for g, lo, hi in hulls:
            claimed.setdefault(lo, g)
            claimed.setdefault(hi, g)
        own = {g: [p for p, c in claimed.items() if c == g] for g, _, _ in hulls}
        if any(not ps or (min(ps), max(ps)) != (lo, hi) for (g, lo, hi), ps in zip(hulls, own.values())):
            continue
        live = {g: [lo, hi] for g, lo, hi in hulls}
        for p in range(1, 31):
            if p in claimed:
                continue
            inside = [g for g in sorted(live) if live[g][0] <= p <= live[g][1]]
            g = inside[0] if inside else min(sorted(live), key=lambda q: min(abs(p - live[q][0]), abs(p - live[q][1])))
            live[g] = [min(live[g][0], p), max(live[g][1], p)]
            assert got[(i, p)] == g, (hulls, p)


def test_topic_shift_blocks(spark):
    rng = random.Random(8)
    toks = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 3))] for _ in range(60)]
    d = spark.createDataFrame([("v", i + 1, 60, t) for i, t in enumerate(toks)], "video_id string, pos int, chapter_size int, tokens array<string>")
    cuts = []
    for b in range(2, 58):
        left, right = set(sum(toks[max(0, b - 3):b], [])), set(sum(toks[b:b + 3], []))
        if left and right and len(left & right) / len(left | right) < 0.25 and (not cuts or b - cuts[-1] > 3):
            cuts.append(b)
    got = ol.topic_shift(d, ["video_id"]).collect()
    assert (got[0].shifts if got else 0) == len(cuts)


def test_halo_is_exact_for_small_blocks(spark):
    from pyspark.sql import Window

    d = spark.range(1, 101).select(F.lit("v").alias("k"), F.col("id").cast("int").alias("ord"))
    b = od.halo_blocks(d, "ord", 3, 2, block=5)
    w = Window.partitionBy("k", "_blk").orderBy("ord").rowsBetween(-3, 2)
    got = {r.ord: r.s for r in b.withColumn("s", F.sum("ord").over(w)).where("_home").collect()}
    assert got == {i: sum(x for x in range(i - 3, i + 3) if 1 <= x <= 100) for i in range(1, 101)}


def test_dedupe_boxes(spark):
    rng = random.Random(9)
    rows = [[(float(x), float(y), float(x + rng.randint(1, 40)), float(y + rng.randint(1, 40))) for x, y in [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(12)]] for _ in range(20)]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = {r.i: [tuple(b) for b in r.k] for r in d.select("i", bx.dedupe_boxes(F.col("b")).alias("k")).collect()}
    for i, bs in enumerate(rows):
        kept = []
        for b in sorted(bs, key=lambda q: (q[2] - q[0]) * (q[3] - q[1])):
            size = max(1.0, (b[2] - b[0]) * (b[3] - b[1]))
            share = [max(0, min(b[2], k[2]) - max(b[0], k[0])) * max(0, min(b[3], k[3]) - max(b[1], k[1])) / size for k in kept]
            if not any(s > 0.9 for s in share):
                kept.append(b)
        assert got[i] == kept


def test_group_joins_with_thousands_of_groups_of_one_key(spark):
    rng = random.Random(17)
    groups = {"hot": 3000, "b": 4}
    g = [(k, i, lo, lo + rng.choice([0, 3, 40, 9000])) for k, n in groups.items() for i in range(1, n + 1) for lo in [rng.randrange(0, 400_000)]]
    points = [(k, s, rng.randrange(-50, 420_000)) for k, n in (("hot", 1500), ("b", 50), ("no", 5)) for s in range(n)]
    p_df = spark.createDataFrame(points, "video_id string, seq bigint, ord bigint")
    g_df = spark.createDataFrame(g, "video_id string, group_ord int, lo bigint, hi bigint")
    near, before = set(), set()
    for k, s, m in points:
        own = [x for x in g if x[0] == k]
        if own:
            near.add((k, s, m, min((0 if lo <= m <= hi else 1, 0 if lo <= m <= hi else min(abs(m - lo), abs(m - hi)), i) for _, i, lo, hi in own)[2]))
            before.add((k, s, m, max((i for _, i, lo, _ in own if lo <= m), default=0)))
    assert {tuple(r) for r in iv.nearest_interval_join(p_df, g_df).collect()} == near
    assert {tuple(r) for r in iv.preceding_group_join(p_df, g_df).collect()} == before


def _settled(items, least):
    """Plain form of the merging of small groups: items [group, size, keep] to [(group, members)]."""
    items = [[g, n, keep, [g]] for g, n, keep in items]
    while len(items) > 1:
        at = next((j for j, x in enumerate(items) if x[1] < least and not x[2]), None)
        if at is None:
            break
        x = items.pop(at)
        to = items[at - 1] if at else items[0]
        to[1], to[2], to[3] = to[1] + x[1], False, to[3] + x[3]
    return [(g, m) for g, _, _, m in items]


def _grown(hulls, at):
    inside = [g for g, lo, hi in hulls if lo <= at <= hi]
    if inside:
        return min(inside)
    below, above = max((hi for _, _, hi in hulls if hi < at), default=None), min((lo for _, lo, _ in hulls if lo > at), default=None)
    left, right = min((g for g, _, hi in hulls if hi == below), default=None), min((g for g, lo, _ in hulls if lo == above), default=None)
    return right if left is None else left if right is None or at < above - 1 else min(left, right)


def test_drafts_are_normalized_without_a_list_of_a_videos_groups(spark):
    rng = random.Random(23)
    sizes = {f"v{k}": (rng.randint(1, 40), rng.randint(1, 12)) for k in range(30)} | {"hot": (3000, 700)}
    cards = [(v, o, f"s{o}", rng.choice([0.9, 0.3, None])) for v, (n, _) in sizes.items() for o in range(1, n + 1)]
    claims = [(v, rng.randint(1, g), o) for v, (n, g) in sizes.items() for o in range(1, n + 1) if rng.random() < 0.5] + [("none", 1, 1)]
    claims += [("hot", 2 + o // 5, o) for o in range(1, 3001) if o % 5]
    c = spark.createDataFrame(cards, "video_id string, ord int, shot_id string, importance_score double")
    shots = spark.createDataFrame(claims, "video_id string, draft_ord int, ord int")
    drafts = shots.select("video_id", "draft_ord").distinct().withColumn("title", F.concat(F.lit("t"), "draft_ord"))
    for least in (1, 2, 4):
        got = {(r.video_id, r.ord): (r.chapter_no, r.draft_ord) for r in ol.normalize_drafts(drafts, shots, c, least).collect()}
        want = {}
        for v, (n, _) in sizes.items():
            claim = {}
            for w, g, o in claims:
                if w == v:
                    claim[o] = min(g, claim.get(o, g))
            by = {}
            for o, g in claim.items():
                by.setdefault(g, []).append(o)
            if not by:
                continue
            hulls = [(g, min(x), max(x)) for g, x in sorted(by.items())]
            place = {o: claim[o] if o in claim else _grown(hulls, o) for o in range(1, n + 1)}
            score = {o: s or 0.0 for w, o, _, s in cards if w == v}
            full = {}
            for o, g in place.items():
                full.setdefault(g, []).append(o)
            items = [(g, len(x), len(x) == 1 and score[x[0]] >= 0.85) for g, x in sorted(full.items(), key=lambda q: (min(q[1]), q[0]))]
            for no, (lead, members) in enumerate(_settled(items, least), 1):
                want |= {(v, o): (no, lead) for g in members for o in full[g]}
        assert got == want
    assert "hulls" not in ol.normalize_drafts(drafts, shots, c, 1)._jdf.queryExecution().executedPlan().toString()


def test_subsections_are_normalized_without_a_list_of_a_chapters_claims(spark):
    rng = random.Random(29)
    sizes = {k: (rng.randint(1, 40), rng.randint(1, 9)) for k in range(30)} | {99: (3000, 700)}
    c = spark.createDataFrame([("v", k, o, f"s{o}", rng.choice([0.9, 0.3])) for k, (n, _) in sizes.items() for o in range(1, n + 1)], "video_id string, chapter_no int, ord int, shot_id string, importance_score double")
    score = {(r.chapter_no, r.ord): r.importance_score for r in c.collect()}
    claims = [(k, rng.randint(1, g), o) for k, (n, g) in sizes.items() for o in range(1, n + 1) if rng.random() < 0.5]
    shots = spark.createDataFrame([("v", *x) for x in claims], "video_id string, chapter_no int, draft_ord int, ord int")
    drafts = shots.select("video_id", "chapter_no", "draft_ord").distinct().withColumn("title", F.lit("t"))
    got = {(r.chapter_no, r.ord): (r.subsection_no, r.draft_ord) for r in ol.normalize_subsections(drafts, shots, c).collect()}
    want = {}
    for k, (n, _) in sizes.items():
        claim = {}
        for w, g, o in claims:
            if w == k:
                claim[o] = min(g, claim.get(o, g))
        names = sorted(set(claim.values()))
        group = {g: min(i, 4) for i, g in enumerate(names)}
        lo = {g: min(o for o, x in claim.items() if x == g) for g in names}
        full = {}
        for o in range(1, n + 1):
            g = group[claim[o]] if o in claim else max((group[x] for x in names if lo[x] <= o), default=0)
            full.setdefault(g, []).append(o)
        done = _settled([(g, len(x), len(x) == 1 and score[k, x[0]] >= 0.85) for g, x in sorted(full.items())], 2) if names else []
        if len(done) >= 2:
            for no, (lead, members) in enumerate(done, 1):
                want |= {(k, o): (no, names[lead]) for g in members for o in full[g]}
    assert got == want

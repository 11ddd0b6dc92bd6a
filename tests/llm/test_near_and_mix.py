"""Near-duplicates and mixing against brute force."""

import random

import numpy as np
import pytest

from shotloom.llm import mixing, near_dedup
from .brute import brute_components

ODD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE two"), (6, "one"), (None, "one two"), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "word " * 30_000)]


def near_group(rng, base, many, edits, first):
    out = []
    for k in range(many):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10_000)}"
        out.append((first + k, " ".join(words)))
    return out


def ids_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_odd_rows(docs_of):
    got = ids_of(near_dedup.near_duplicates(docs_of(ODD, True), words=4))
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[6] == (1, 6, True)
    assert got[None][1:] == (None, True) and got[7] == (5, 7, True) and got[8] == (1, 8, True)
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_components_equal_brute_force(docs_of):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(90)]
    rows = near_group(rng, base, 120, 9, 0)  # one bucket-filling group with pairs on both sides of the limit
    for g in range(25):
        rows += near_group(rng, [f"g{g}x{k}" for k in range(rng.randint(3, 60))], 4, 3, 1000 + 10 * g)
    passage = " ".join(f"p{k}" for k in range(14))
    rows += [(3000 + k, f"{passage} " + " ".join(f"u{k}_{j}" for j in range(rng.randint(1, 12)))) for k in range(80)]
    rows += [(5000 + k, rows[k * 3][1]) for k in range(40)]  # exact copies
    rng.shuffle(rows)
    docs = docs_of(rows)
    got = ids_of(near_dedup.near_duplicates(docs, words=4))
    want = brute_components(rows, 4, 80)
    assert {i: v[1] for i, v in got.items()} == want
    kept = near_dedup.keep_one(docs, words=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_estimate_follows_similarity():
    shingler = near_dedup.Shingler(1)
    texts = [" ".join(f"a{k}" for k in range(lo, lo + 400)).encode() for lo in (0, 40, 200, 400)]
    packed = near_dedup._signatures(*shingler.sets(texts))[2].view(np.uint64)
    x = packed ^ packed[0]
    off = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(near_dedup._LOW)).sum(1)
    share = 1 - off / near_dedup.HASHES
    estimate = (share - 0.25) / 0.75
    assert np.abs(estimate - [1, 360 / 440, 200 / 600, 0]).max() < 0.15
    assert off[1] <= near_dedup.most_mismatches(0.8) < off[3]


def test_mix_odd_rows_and_margins(docs_of):
    rng = random.Random(3)
    rows = [(k, "w " * rng.randint(1, 60) + rng.choice(["", " | ", "!!"]), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", None])) for k in range(1500)]
    rows += [(None, "x y", None, None), (9000, None, "en", "a"), (9001, "", "en", "zz"), (1, "again", "en", "a")]
    got = mixing.mix(docs_of(rows, True)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.probability <= 1 for r in got) and next(r for r in got if r.doc_id == 9001).kept
    total = sum(r.n_tokens for r in got)
    expected = sum(r.n_tokens * r.probability for r in got)
    assert abs(expected / total - mixing.BUDGET) < 0.02
    kept = sum(r.n_tokens for r in got if r.kept)
    assert abs(kept / expected - 1) < 0.1
    again = mixing.mix(docs_of(rows, True)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert {r.doc_id for r in mixing.sample_mix(docs_of(rows)).collect()} == {r.doc_id for r in got if r.kept}
    assert mixing.mix(docs_of([])).count() == 0


def test_rake_meets_its_targets(spark):
    rows = [(s, v, t, n) for s, v, t, n in [("a", "en", "p", 9000), ("a", "fr", "p", 700), ("b", "en", "p", 600), ("b", "fr", "q", 800), ("c", "en", "q", 500), ("c", "fr", "p", 400)]]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    got = mixing.rake(cells, budget=0.2, rounds=25).collect()
    tokens = sum(r[3] for r in rows)
    for margin, at in (("source", 0), ("lang", 1), ("topic", 2)):
        values = sorted({r[at] for r in rows})
        raised = np.array([sum(r[3] for r in rows if r[at] == v) ** mixing.POWERS[margin] for v in values])
        have = np.array([sum(r.tokens * r.probability for r in got if r[margin] == v) for v in values])
        assert have == pytest.approx(0.2 * tokens * raised / raised.sum(), rel=0.02)


def test_mix_main_path_has_no_python(docs_of):
    plan = mixing.mix(docs_of([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

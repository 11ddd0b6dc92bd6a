"""Collocations against plain counting; automata against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from shotloom.llm import collocations as co


def brute(rows, least, top):
    out, by_lang = [], {}
    for text, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).append(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    for lang, texts in by_lang.items():
        f = Counter()
        for t in texts:
            for piece in re.split("[.,;:!?\x0a-\x0d]", t):
                w = re.findall("[^\x20\x09]+", piece)
                f.update(tuple(w[i:i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= 50 * a and p in (q[:2], q[1:]) for q, c in cand.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(docs, least, top):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in co.collocations(docs, least, top).collect())


def text(rng, n):
    return "".join(rng.choice(["a", "B", "c", "dé", "e\x1f", "f", "g h i", "\x85", "𝒳"]) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(n))


@pytest.mark.parametrize("tight", [False, True])
def test_against_plain_counting(spark, docs_of, monkeypatch, tight):
    if tight:  # many flushes, ranges, split ranges and parts of texts
        for name, value in {"RANGE_BYTES": 400, "CHUNK": 50, "TASK_PATHS": 60, "TASK_WORDS": 20}.items():
            monkeypatch.setattr(co, name, value)
    rng = random.Random(7)
    rows = [(i, text(rng, rng.randrange(0, 60)), rng.choice(["en", "en", "", None]), "s") for i in range(200)]
    rows += [(1 << 60, None, "en", "s"), (None, "g h i " * 500, "en", "s"), (3, "", "xx", "s"), (4, "q r s, " * 40, "de", None), (4, "q r s, " * 40, "de", None)]
    want = brute([(t, lang) for _, t, lang, _ in rows], 3, 40)
    assert found(docs_of(rows, extra=True), 3, 40) == want and len(want) > 100


def test_split_ranges(spark, docs_of, monkeypatch):
    monkeypatch.setattr(co, "RANGE_PATHS", 10)
    rng = random.Random(8)
    rows = [(i, "very common " + rng.choice("abcdefghijklmnopqrstuvwxyz") + " " + rng.choice("xyz")) for i in range(300)]
    assert found(docs_of(rows), 3, 100) == brute([(t, "en") for _, t in rows], 3, 100)


def test_large_counts_are_exact(spark):
    rows = spark.createDataFrame([("en", "p q", 2, 3_000_000_007, [(1, "l", "p", 0), (1, "r", "q", 0)])], "lang string, phrase string, size int, a bigint, cuts array<struct<k:int,side:string,part:string,range:int>>")
    got = rows.selectExpr("(CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(4000000007 AS DECIMAL(19,0)) * CAST(5000000029 AS DECIMAL(19,0))) AS s").first().s
    assert got == 1000000 * 3_000_000_007**2 // (4000000007 * 5000000029)


def test_empty_and_wordless(spark, docs_of):
    assert found(docs_of([]), 1, 5) == []
    assert found(docs_of([(1, " .,\n"), (2, None)]), 1, 5) == []


def random_counts(rng, words, n):
    return Counter(tuple(rng.choice(words) for _ in range(rng.choice([1, 2, 3]))) for _ in range(n))


def as_automaton(counts):
    words = sorted({w for p in counts for w in p})
    number = {w: i for i, w in enumerate(words, 1)}
    keys = np.array([co.coded(*map(number.get, p)) for p in counts], np.uint64)
    return co.from_ngrams(words, *co.summed(keys, np.array(list(counts.values()), np.int64)))


def as_counts(a):
    keys, counts = a.paths()
    return {tuple(a.words[i - 1] for i in p if i): c for *p, c in zip(*(x.tolist() for x in co.parts(keys)), counts.tolist())}


def test_automata_hold_share_unite_and_compose():
    rng = random.Random(2)
    words = [bytes([c]) * k for c in b"abcdefgh" for k in (1, 2)]
    one, two = random_counts(rng, words, 3000), random_counts(rng, words[4:], 2000)
    x, y = as_automaton(one), as_automaton(two)
    assert as_counts(x) == dict(one) and as_counts(co.CountAutomaton.from_bytes(x.to_bytes())) == dict(one)
    assert as_counts(co.union([x, y])) == dict(one + two)
    keys, counts = y.compose(x)
    got = {tuple(y.words[i - 1] for i in p if i): c for *p, c in zip(*(v.tolist() for v in co.parts(keys)), counts.tolist())}
    assert {p: c for p, c in got.items() if c} == {p: one[p] for p in two if len(p) < 3 and one[p]}
    same = as_automaton(Counter({(a, b, c): 1 for a in words for b in words for c in words[:5]}))
    assert len(same.off2) == 2 and len(same.off1) == 2  # every prefix has the same continuations

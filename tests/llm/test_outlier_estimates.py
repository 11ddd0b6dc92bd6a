"""The robust estimate behind the outlier rule, against plain numpy."""

import math
import random

import numpy as np

from shotloom.llm import quality_outliers as qo
from shotloom.llm.common import WordTable

S = qo.STATS


def plain(texts):
    """Estimate and scaled squared distances of one group, from sorted values and plain loops; base counts beside them."""
    base, full = qo.statistics(WordTable(qo._word_values), [t.encode() for t in texts])
    x, noise = full[:, :S], np.diag(np.sort(full[:, S:], axis=0)[(len(full) - 1) // 2])
    bin_of = lambda d: np.floor(np.log2(d + 1e-6) * qo.BINS)
    dist = lambda m, c: np.maximum([(r - m) @ np.linalg.inv(c) @ (r - m) for r in x], 0)

    def upto(d, share):
        bins = bin_of(d)
        return bins <= min(b for b in bins if (bins <= b).sum() >= share * len(x) or b == bins.max())

    def step(m, c):
        keep = upto(dist(m, c), qo.SHARE)
        return x[keep].mean(0), np.cov(x[keep].T, bias=True) + noise

    med = np.sort(x, axis=0)[(len(x) - 1) // 2]
    spread = 1.4826 * np.sort(abs(x - med), axis=0)[(len(x) - 1) // 2]
    z = (x - med) / np.sqrt(spread**2 + np.diag(noise))
    starts = [np.eye(S)]
    for v in (z / np.sqrt((z * z).sum(1) + 1e-9)[:, None], np.tanh(z)):
        m = v.T @ v / len(v)
        size = np.sqrt(np.maximum(np.diag(m), 1e-12))
        starts.append(m / np.outer(size, size))
    ends = []
    for corr in starts:
        m, c = med, corr * np.outer(spread, spread) + noise
        for _ in range(qo.FIRST_STEPS):
            m, c = step(m, c)
        ends.append((np.linalg.slogdet(c)[1], m, c))
    best = min(ends, key=lambda e: e[0])
    m, c = best[1:]
    for _ in range(qo.LAST_STEPS):
        m, c = step(m, c)
    d = dist(m, c)
    middle = bin_of(d)[upto(d, 0.5)].max()
    return base, d * min(1.0, qo._CHI_MEDIAN / 2 ** ((middle + 1) / qo.BINS)), [e[0] for e in ends]


def prose(rng, lang):
    """Texts of `marks` hold many symbols as a habit; the others none."""
    words = [rng.choice("ship water stone cloud river garden paper letter".split()) + rng.choice("aeiou") * rng.randint(0, 4) for _ in range(rng.randint(60, 140))]
    if lang == "marks":
        rate = rng.uniform(0.1, 0.5)
        words = [w + "#" if rng.random() < rate else w for w in words]
    return ". ".join(" ".join(words[i:i + 9]).capitalize() for i in range(0, len(words), 9)) + "."


def test_distances_and_verdicts_equal_plain_numpy(docs_of):
    rng = random.Random(6)
    texts = [prose(rng, "plain") for _ in range(400)] + [prose(rng, "plain").upper() for _ in range(30)] + ["one two", "", "!!! " * 200]
    got = {r.doc_id: r for r in qo.reject_outliers(docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    base, want, _ = plain(texts)
    assert np.allclose([got[i].distance for i in range(len(texts))], want, rtol=1e-6, atol=1e-6)
    judged = [w for i, w in enumerate(want) if not got[i].base_failed]
    edge = math.ceil(math.log2(qo._CHI_FAR) * qo.BINS)
    while sum(2 ** (edge / qo.BINS) <= w + 1e-6 < 2 ** (edge / qo.BINS + 1) for w in judged) > len(judged) * qo.GAP_SHARE:
        edge += 1
    assert all(got[i].kept == (not got[i].base_failed and w <= 2 ** (edge / qo.BINS + 1)) for i, w in enumerate(want))
    assert all(got[i].kept for i in range(400)) and not any(got[i].kept for i in range(400, 433))


def test_the_same_text_is_judged_by_its_language(docs_of):
    rng = random.Random(9)
    rows = [(k, prose(rng, lang), lang, "s") for k, lang in enumerate(["plain", "marks"] * 300)]
    odd = prose(rng, "marks")
    rows += [(1_000, odd, "plain", "s"), (1_001, odd, "marks", "s")]
    got = {r.doc_id: r for r in qo.reject_outliers(docs_of(rows)).collect()}
    assert not got[1_000].kept and got[1_001].kept and got[1_000].n_symbols == got[1_001].n_symbols > 5
    assert all(got[k].kept for k in range(600))


def test_one_text_many_times_and_an_empty_language_name(docs_of):
    """Statistics without any spread have the sampling variances alone; a language named "" is not the group of all rows."""
    rng = random.Random(3)
    same = prose(rng, "plain")
    rows = [(k, same, "", "hot") for k in range(300)] + [(k, prose(rng, "plain"), "", "hot") for k in range(300, 400)] + [(500, prose(rng, "marks"), "xx", "t")]
    got = {r.doc_id: r for r in qo.reject_outliers(docs_of(rows)).collect()}
    assert len(got) == 401 and all(got[k].kept for k in range(400)) and got[0].distance == got[299].distance


def test_the_least_determinant_is_kept(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.05, (300, S)), rng.normal(0.8, 0.01, (60, S))])
    rows = spark.createDataFrame([("g", [*map(float, v), *[1e-4] * S], str(i)) for i, v in enumerate(x)], "g string, x array<double>, _id string")
    got = qo.concentrated(rows).first()
    assert np.allclose(got["mean"], 0, atol=0.02)
    near = x[:300][np.argsort((x[:300] ** 2).sum(1))[:270]]
    assert abs(got.logdet - np.linalg.slogdet(np.cov(near.T, bias=True) + 1e-4 * np.eye(S))[1]) < 0.8


def test_cut_lies_where_the_tail_runs_out():
    body = {k: 1_000 // (k + 1) for k in range(60)}
    assert qo.cut_from_counts({}) == 2.0 ** ((math.ceil(math.log2(qo._CHI_FAR) * qo.BINS) + qo.BINS) / qo.BINS)
    cut = qo.cut_from_counts(body | {100: 900})
    assert 2 ** (60 / qo.BINS) <= cut * 2 and cut <= 2 ** (100 / qo.BINS)
    assert cut == qo.cut_from_counts({k: 10 * v for k, v in (body | {100: 900}).items()})

"""Quality, toxicity and language: held-out accuracy on the given tables, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.llm import language_id, quality_knn, toxicity
from shotloom.llm.common import fold

from .conftest import LABELS

ODD = [(9001, None), (9002, ""), (9003, "12 34 ..."), (None, "the word of it"), (9004, "the word of it"), (9004, "the word of it"), (9005, "of " * 30_000)]


def prose(rng, lang, n=40):
    words = {"en": "the of and to in is that ship water stone", "de": "der die und das ist nicht schiff wasser stein", "fr": "le la et les des est que eau pierre", "es": "el los y que del para agua piedra con"}[lang].split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "ing", "en", "a"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out, labels = [], []
    for k in range(800):
        lang = ("en", "de", "fr", "es")[k % 4]
        text, quality, toxic = prose(rng, lang), 1, int(k % 5 == 0)
        if k % 3 == 0:
            text, quality = " ".join(f"{w}***" for w in text.split()), 0
        if toxic:
            at = rng.randrange(len(text))
            text = text[:at] + {"en": " idiot ", "de": " grobi" + rng.choice(["ab", "um", "er"]), "fr": " sottu" + rng.choice(["on", "et"]), "es": " brutu" + rng.choice(["al", "ez"])}[lang] + " " + text[at:]
        out.append((k, text, lang, "s"))
        labels.append((k, quality, toxic))
    return out, labels


def test_quality_votes(docs_of, spark, rows):
    docs, labels = docs_of(rows[0] + [(i, t, "en", "s") for i, t in ODD], True), spark.createDataFrame(rows[1], LABELS)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None), (99_999, 1, 1), (5, 1, 0)], LABELS))
    model = quality_knn.fit(docs, labels, fold("doc_id", 3) != 1)
    got = [r for r in quality_knn.predict(docs, model).collect()]
    assert len(got) == len(rows[0]) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    of = {r.doc_id: r for r in got}
    held = [(of[i].predicted, q) for i, q, _ in rows[1] if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert of[9001].score == of[9002].score == 0.0
    good = quality_knn.keep_good(docs, model)
    assert good.columns == docs.columns and good.count() == sum(r.predicted for r in got)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    x, y = rng.random((60, quality_knn.DIMS)).astype(np.float32) * (rng.random((60, quality_knn.DIMS)) < 0.02), rng.integers(0, 2, 60)
    model = quality_knn.QualityModel(x, y)
    z = (x[:9] * model.weight) @ model.axes
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for row, score in zip(z, model.score_rows(x[:9])):
        near = sorted(((float(row @ b), int(v)) for b, v in zip(model.bank, model.y)), reverse=True)[: quality_knn.NEIGHBOURS]
        weight = [max(s, 0) ** quality_knn.SHARPNESS for s, _ in near]
        assert score == pytest.approx(sum(w * v for w, (_, v) in zip(weight, near)) / sum(weight), abs=1e-4)


def test_toxicity_network(docs_of, spark, rows):
    docs, labels = docs_of(rows[0] + [(i, t, "en", "s") for i, t in ODD], True), spark.createDataFrame(rows[1], LABELS)
    model = toxicity.fit(docs, labels, fold("doc_id", 5) != 0)
    of = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = [(of[i].predicted, t) for i, _, t in rows[1] if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p for p, t in held if t]) > 0.9 and np.mean([p for p, t in held if not t]) < 0.03
    assert of[9001].score == of[9002].score == 0.0 and 0 <= of[None].score <= 1
    none = toxicity.fit(docs, spark.createDataFrame([], LABELS), fold("doc_id", 5) != 0)
    assert {r.score for r in toxicity.predict(docs, none).collect()} == {0.0}


def test_convolution_equals_brute_force():
    rng = np.random.default_rng(2)
    counts = np.array([5, 1, 2, 7])
    ends = np.cumsum(counts)
    parts = [rng.normal(size=(15, 3)) for _ in range(3)]
    got = toxicity.ToxicityModel._windows(parts, ends)
    for end, n in zip(ends, counts):
        for i in range(end - n, end):
            want = sum(parts[j][i + j] for j in range(3) if i + j < end)
            assert got[i] == pytest.approx(want)


def test_a_text_scores_alike_in_any_company(rows):
    model = toxicity.ToxicityModel()
    ids = [toxicity.word_rows(t.encode().split()) for _, t, _, _ in rows[0][:200]]
    hits = np.stack([toxicity._language_hits(t.encode().split()).sum(0) for _, t, _, _ in rows[0][:200]])
    model.train(ids, np.array([t for _, _, t in rows[1][:200]], float), hits)
    texts = [t.encode() for _, t, _, _ in rows[0][200:260]]
    together = model.score(texts)
    model.table = None
    assert together == pytest.approx(np.concatenate([model.score([t]) for t in texts]), abs=1e-5)


def test_language(docs_of, rows):
    docs = docs_of(rows[0] + [(9001, None, "en", "s"), (9002, "", "en", "s"), (9003, "12 34 ...", "de", "s"), (9006, "the of", None, "s"), (None, "der die das", "de", "s"), (9005, "of the " * 20_000, "en", "s")], True)
    model = language_id.fit(docs, fold("doc_id", 3) != 1)
    assert set(model.langs) == {"de", "en", "es", "fr"} and set(model.families) == {"germanic", "romance"} and len(model.pairs) == 2
    of = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert np.mean([of[i].lang_pred == lang for i, _, lang, _ in rows[0]]) > 0.97
    assert [of[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3
    assert of[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in of.values())
    assert language_id.fit(docs_of([]), fold("doc_id", 3) != 1) is None
    assert {r.lang_pred for r in language_id.predict(docs_of([(1, "abc")]), None).collect()} == {"und"}


def test_one_language_is_enough(docs_of):
    docs = docs_of([(k, "le la des") for k in range(6)])
    model = language_id.fit(docs, fold("doc_id", 3) != 5)
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} == {"en"}


def test_toxicity_cut_follows_the_true_label_shares(docs_of, spark, monkeypatch):
    """A mark on all 100 toxic and 80 of 1,000 clean documents: calling marked documents toxic costs more than leaving them."""
    monkeypatch.setattr(toxicity, "FIT_PER_LABEL", 60)
    rng = random.Random(3)
    texts = [(k, prose(rng, "en") + (" grumpf" if k < 180 else "")) for k in range(1100)]
    labels = spark.createDataFrame([(k, 1, int(k < 100)) for k, _ in texts], LABELS)
    docs = docs_of(texts)
    model = toxicity.fit(docs, labels, F.lit(True))
    of = {r.doc_id: r.predicted for r in toxicity.predict(docs, model).collect()}
    assert np.mean([of[k] for k in range(100, 1100)]) < 0.02


def test_the_form_of_a_word_is_taken_from_all_of_it():
    head = "abC0" * 20
    assert quality_knn._form(head + "***") == "aA0" * 20 + "*"
    a, b = (quality_knn._terms([(head + tail).encode()])[0][0] for tail in ("***", "###"))
    assert a != b
    assert quality_knn._form("x" * 100_000 + "7") == "a0"


def test_every_language_is_learned(docs_of, monkeypatch):
    """60 languages of their own letters, more than any fixed number of classes would take; the sample bound holds."""
    monkeypatch.setattr(language_id, "FIT_ROWS", 300)
    rng = random.Random(4)
    alphabet = [chr(0x4E00 + k) for k in range(600)]
    rows = [(lang * 100 + k, " ".join("".join(rng.choices(alphabet[10 * lang:10 * lang + 10], k=4)) for _ in range(20)), f"q{lang:02d}x", "s") for lang in range(60) for k in range(12)]
    docs = docs_of(rows)
    model = language_id.fit(docs, fold("doc_id", 3) != 1)
    assert len(model.langs) == 60
    of = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert np.mean([of[i] == lang for i, _, lang, _ in rows]) > 0.95


def test_repeated_and_null_ids_keep_the_language_sample_bounded(docs_of, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.LanguageModel, "__init__", lambda self, x, langs: seen.append((x.shape, sorted(langs))))
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(4)).otherwise(F.lit(None).cast("long")).alias("doc_id"), F.concat(F.lit("text of "), F.col("id")).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"),
    )
    language_id.fit(rows.unionByName(docs_of([(k, "le la", "fr", "s") for k in range(700)])), F.lit(True))
    (size, langs), = seen
    assert size == (502, language_id.DIMS) and langs.count("en") == 2 and langs.count("fr") == 500


def test_language_votes_equal_brute_force(rows):
    """Margins of the text as a whole, the family with the largest, then one vote for each pair of its languages."""
    texts = [t.encode() for _, t, _, _ in rows[0]]
    model = language_id.LanguageModel(language_id.frequencies(texts[:200]), [r[2] for r in rows[0][:200]])
    langs, scores = model.predict(texts[200:260])
    for text, lang, score in zip(texts[200:260], langs, scores):
        counts = np.zeros(language_id.DIMS)
        for w in text.split():
            for b in language_id.grams([language_id.letters(w)])[0]:
                counts[b] += 1
        margin = [sum(counts[b] * model.weights[b, c] for b in np.flatnonzero(counts)) / counts.sum() + model.bias[c] for c in range(len(model.bias))]
        family = int(np.argmax(margin[:len(model.families)]))
        want, sure = None, 1 / (1 + np.exp(-2 * margin[family]))
        for (a, b), m in zip(model.pairs, margin[len(model.families):]):
            if model.fam[a] == family:
                want, sure = (a, min(sure, 1 / (1 + np.exp(-2 * m)))) if m >= 0 else (b, min(sure, 1 / (1 + np.exp(2 * m))))
        assert lang == model.langs[want] and score == pytest.approx(sure, abs=1e-6)


@pytest.mark.parametrize("module", [quality_knn, toxicity], ids=["op3", "op4"])
def test_one_id_on_very_many_rows_keeps_the_sample_bounded(module, docs_of, spark, monkeypatch):
    """One labelled id on 20,000 rows is one row of the sample, whatever order the rows lie in."""
    seen = []
    model = {quality_knn: "QualityModel", toxicity: "ToxicityModel"}[module]
    if module is quality_knn:
        monkeypatch.setattr(module, model, lambda x, y, totals: seen.append((len(x), x.tobytes())))
    else:
        def train(self, ids, y, hits):
            seen.append((len(ids), b"".join(i.tobytes() for i in ids)))
            self.constant = 0.0
        monkeypatch.setattr(toxicity.ToxicityModel, "train", train)
    hot = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text of "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = hot.unionByName(docs_of([(k, f"some words {k}") for k in range(20, 60)]))
    labels = spark.createDataFrame([(7, 1, 1)] + [(k, k % 2, k % 2) for k in range(20, 60)], LABELS)
    module.fit(docs, labels, F.lit(True))
    module.fit(docs.repartition(5), labels, F.lit(True))
    assert seen[0][0] == 41 and seen[0] == seen[1]


def test_thresholds_never_come_from_rows_trained_on(docs_of, spark, rows, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.ToxicityModel, "calibrate", lambda self, counts, weights=(1.0, 1.0): seen.append((sum(counts.values()), weights)))
    used = []
    held = toxicity.ToxicityModel.held_rows
    monkeypatch.setattr(toxicity.ToxicityModel, "held_rows", staticmethod(lambda n: used.append(int((~held(n)).sum())) or held(n)))
    toxicity.fit(docs_of(rows[0]), spark.createDataFrame(rows[1], LABELS), F.lit(True))
    assert seen[-1][0] == len(rows[0]) - used[-1] and min(seen[-1][1]) > 1

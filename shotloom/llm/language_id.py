"""Hierarchical language identification: family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.common import WordTable, mix, per_text, released, ship, text_slices, with_exact_ids
from shotloom.operators.staging import materialize

#: Hashed character n-gram space and n-gram lengths.
DIMS = 4096
ORDERS = (1, 2, 3)
#: Bound of the fitting sample: documents of one language, and of all together. Every language is learned; with many, each
#: gives fewer documents, and at least one.
FIT_PER_LANG = 500
FIT_ROWS = 12_000
#: Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.lower()[:2] in codes), lang)


def letters(word: bytes) -> str:
    """The letters of a word in lower case."""
    w = word.decode()
    return w.lower() if w.isalpha() else "".join(c for c in w if c.isalpha()).lower()


def grams(words: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, with word edges marked, and the word that each belongs to. Words without letters have none."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    marked = np.where(lens > 0, lens + 2, 0)
    codes = np.frombuffer("".join(f"_{w}_" for w in words if w).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), marked)
    buckets, owners = [], []
    hashed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        hashed = hashed[:m] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(1)
        if n in ORDERS:
            inside = own[:m] == own[n - 1:]
            buckets.append((mix(hashed[inside] + np.uint64(n << 40)) & np.uint64(dims - 1)).astype(np.int64))
            owners.append(own[:m][inside])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def frequencies(texts: list[bytes], dims: int = DIMS) -> np.ndarray:
    """n-gram shares of each text, for fitting."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        buckets, _ = grams([letters(w) for w in t.split()], dims)
        if len(buckets):
            out[i] = np.bincount(buckets, minlength=dims) / len(buckets)
    return out


def _svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 250) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, both sides weighted alike; y is 1 or -1. `x` is float32."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = 1.0 / (reg + 2 * float(weight @ np.einsum("ij,ij->i", x, x)) + 2)  # the bias counts as one more feature
    for _ in range(steps):
        slack = weight * np.maximum(0, 1 - y * (x @ w.astype(np.float32) + b)) * y
        vw = 0.95 * vw + rate * (2 * (slack.astype(np.float32) @ x) - reg * w)
        vb = 0.95 * vb + rate * 2 * slack.sum()
        w, b = w + vw, b + vb
    return w, b


class LanguageModel:
    """Linear machines over n-gram shares; every machine is folded into one column of `weights`.

    `family` machines tell one family from the rest; `pairs` tell two languages of one family apart.
    """

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(v) for v in self.langs})
        of = np.array([self.langs.index(v) for v in langs])
        fam = np.array([self.families.index(family_of(v)) for v in self.langs])
        mean = x.mean(0, dtype=np.float64)
        z = x - mean.astype(np.float32)
        scale = 1 / (np.sqrt(np.einsum("ij,ij->j", z, z) / len(z)) + 1e-3)
        z *= scale
        size = 3 / np.sqrt(float(np.einsum("ij,ij->i", z, z).mean()) + 1e-12)
        z *= np.float32(size)
        scale = scale.astype(np.float64) * size
        columns, self.pairs = [], []
        if len(self.families) > 1:
            columns += [_svm(z, np.where(fam[of] == k, 1, -1)) for k in range(len(self.families))]
        for k in range(len(self.families)):
            for a, b in combinations(np.flatnonzero(fam == k), 2):
                some = (of == a) | (of == b)
                columns.append(_svm(z[some], np.where(of[some] == a, 1, -1)))
                self.pairs.append((int(a), int(b)))
        w = np.array([c[0] for c in columns]).reshape(len(columns), x.shape[1]) * scale
        self.weights = np.ascontiguousarray(w.T)
        self.bias = np.array([c[1] for c in columns]) - mean @ self.weights
        self.fam = fam
        self.table: WordTable | None = None

    def _values(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buckets, own = grams([letters(w) for w in words])
        columns = [np.bincount(own, self.weights[buckets, c], len(words)) for c in range(self.weights.shape[1])]
        return np.array(columns).reshape(-1, len(words)).T.copy(), np.bincount(own, minlength=len(words)).astype(np.float64)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if self.table is None:
            self.table = WordTable(self._values)
        words, counts = self.table.number(texts)
        if self.table.rows is None or not len(words):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        size = per_text(self.table.rows[1][words], counts)
        margin = per_text(self.table.rows[0][words], counts) / np.maximum(size, 1)[:, None] + self.bias
        sure = 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))
        n = len(self.families) if len(self.families) > 1 else 0
        best = margin[:, :n].argmax(1) if n else np.zeros(len(texts), int)
        score = sure[np.arange(len(texts)), best] if n else np.ones(len(texts))
        votes = np.zeros((len(texts), len(self.langs)))
        for c, (a, b) in enumerate(self.pairs, n):
            votes[:, a] += (margin[:, c] >= 0) + 0.5 * sure[:, c]
            votes[:, b] += (margin[:, c] < 0) + 0.5 * (1 - sure[:, c])
        votes[self.fam[None, :] != best[:, None]] = -1
        pick = votes.argmax(1)
        for c, (a, b) in enumerate(self.pairs, n):
            score = np.where(pick == a, np.minimum(score, sure[:, c]), np.where(pick == b, np.minimum(score, 1 - sure[:, c]), score))
        known = size > 0
        return [self.langs[p] if k else UNKNOWN for p, k in zip(pick, known)], np.where(known, score, 0.0)


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel | None:
    """Fit on rows that `learn` marks, with text and language: every language, with at most FIT_PER_LANG documents each.

    All languages together give at most FIT_ROWS documents (or one each), so many languages give fewer each. Ids are taken
    by their hash: those below a threshold from the language's number of ids, of these the smallest, so a few rows of a
    language come together. Rows of one id (null is one id) count as one document, the text of the smallest hash; so
    repeats never pass the bound. None without rows.
    """
    ship(docs.sparkSession)
    rows = docs.filter(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(id_col).alias("_h"))
    sizes = materialize(rows.groupBy("_lang").agg(F.approx_count_distinct("_h").alias("_m")))
    n_langs = sizes.count()
    if not n_langs:
        return None
    per = max(1, min(FIT_PER_LANG, FIT_ROWS // n_langs))
    place = F.pmod(F.col("_h"), F.lit(1 << 40)) / float(1 << 40)
    some = rows.select("_lang", "_h").join(sizes, "_lang").filter(place * F.col("_m") < 4 * per + 40).select("_lang", "_h").distinct()
    smallest = Window.partitionBy("_lang").orderBy(place, "_h")
    chosen = materialize(some.withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= per).select("_lang", "_h"))
    top = rows.join(chosen, ["_lang", "_h"], "left_semi").groupBy("_lang", "_h").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    top = top.repartition(docs.sparkSession.sparkContext.defaultParallelism, "_lang", "_h")  # so few texts would else be one task

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_lang": b["_lang"], "_h": b["_h"], "x": [row.tobytes() for _, _, texts in text_slices(b["_text"]) for row in frequencies(texts)]})

    got = top.mapInPandas(released(features), "_lang string, _h bigint, x binary").toPandas().sort_values(["_lang", "_h"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), DIMS)
    return LanguageModel(x, got["_lang"].tolist())


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, lang_pred, score (0 to 1), from the whole text alone.

    Null text and texts without letters give `und` with score 0, as does every text when there was nothing to learn from.
    Repeated rows get the same answer; ties between languages go to the first by name. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            langs, scores = [], []
            for lo, hi, texts in text_slices(b["_text"]):
                found = own.predict(texts) if own is not None else ([UNKNOWN] * (hi - lo), np.zeros(hi - lo))
                langs += found[0]
                scores.append(found[1])
            yield pd.DataFrame({"_id": b["_id"], "lang_pred": langs, "score": np.concatenate(scores) if scores else np.empty(0)})
        if own is not None:
            own.table = None  # a worker keeps the model between tasks, but not the words

    out = with_exact_ids(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, "lang_pred string, score double")
    return out.withColumnRenamed("_id", id_col)

"""Quality by nearest-neighbour voting over labelled latent-semantic vectors, with exact blocked cosine products."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotloom.llm.common import WordTable, fnv, one_row_per_id, released, sample_rows, ship, text_slices

#: Hashed term space: forms of words in the first part, words in the second, repetition terms at the end.
FORMS, WORDS, REPEATS = 512, 1024, 4
DIMS = FORMS + WORDS + REPEATS
#: Weight of word terms against form terms; without it, the few words of a short text outweigh its form.
WORD_WEIGHT = 0.3
#: Latent dimensions, neighbours that vote, and the power of the cosine that weights a vote.
RANK, NEIGHBOURS, SHARPNESS = 32, 15, 8
#: Bound of the labelled vectors that are broadcast: rows of each label.
BANK_PER_LABEL = 1500

_RUNS = re.compile(r"(.)\1+")


def _form(word: str) -> str:
    """Shape of a word: letters by case, digits, other characters as they are; runs shortened."""
    shape = "".join("a" if c.islower() else "A" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", shape)


def _terms(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    text = [w.decode() for w in words]
    forms = fnv([_form(w).encode() for w in text], 3) % np.uint64(FORMS)
    plain = fnv(["".join(c for c in w if c.isalpha()).lower().encode() for w in text], 5) % np.uint64(WORDS)
    return forms.astype(np.int64), plain.astype(np.int64) + FORMS


class TermCounter:
    """Log-weighted term counts of whole texts, as a dense block of rows per slice."""

    def __init__(self):
        self.table = WordTable(_terms)

    def rows(self, texts: list[bytes]) -> np.ndarray:
        words, counts = self.table.number(texts)
        out = np.zeros((len(texts), DIMS), np.float32)
        if not len(words):
            return out
        forms, plain = (x[words] for x in self.table.rows)
        own = np.repeat(np.arange(len(texts)), counts) * DIMS
        out += np.bincount(own + forms, minlength=out.size).reshape(out.shape)
        out += np.bincount(own + plain, minlength=out.size).reshape(out.shape)
        for lag in range(1, REPEATS + 1):  # words equal to the one `lag` before, as terms
            same = np.flatnonzero((words[lag:] == words[:-lag]) & (own[lag:] == own[:-lag])) + lag
            out[:, FORMS + WORDS + lag - 1] = np.bincount(own[same] // DIMS, minlength=len(texts))
        share = out / np.maximum(counts, 1)[:, None]
        return np.log1p(1000 * share).astype(np.float32)


class QualityModel:
    """Latent-semantic axes and the labelled vectors; both have a fixed bound."""

    def __init__(self, x: np.ndarray, y: np.ndarray, totals: dict[int, int] | None = None):
        """totals: labelled rows of each label; a vote counts by the square root of how many rows its vector stands for."""
        self.y = y.astype(np.float32)
        stands = {k: max(1, (totals or {}).get(k, 0)) / max(1, int((y == k).sum())) if totals else 1.0 for k in (0, 1)}
        self.stands = np.sqrt(np.where(self.y > 0, stands[1], stands[0]))
        seen = (x > 0).sum(0)
        self.weight = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 0.2
        self.weight[FORMS:FORMS + WORDS] *= WORD_WEIGHT
        z = self._unit(x * self.weight)
        rng = np.random.default_rng(3)
        rank = min(RANK, *x.shape)
        q = np.linalg.qr(z.T @ (z @ rng.normal(size=(DIMS, rank + 8)).astype(np.float32)))[0]
        for _ in range(3):  # subspace iterations
            q = np.linalg.qr(z.T @ (z @ q))[0]
        _, _, vt = np.linalg.svd(z @ q, full_matrices=False)
        self.axes = np.ascontiguousarray((q @ vt.T)[:, :rank], np.float32)
        self.bank = self._unit(z @ self.axes)
        self.counter: TermCounter | None = None

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by a power of the cosine; 0 for rows without terms."""
        near = self._unit((x * self.weight) @ self.axes) @ self.bank.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sure = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** SHARPNESS * self.stands[at]
        out = (sure * self.y[at]).sum(1) / np.maximum(sure.sum(1), 1e-12)
        return np.where(x.any(1), np.clip(out, 0, 1), 0.0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.counter is None:
            self.counter = TermCounter()
        return self.score_rows(self.counter.rows(texts))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    """Axes and labelled vectors from at most BANK_PER_LABEL rows of each label, chosen by the hash of the id.

    Rows with a null label, and labels without a document, are left out; of repeated labels of one id the largest counts,
    of documents of one id the text of the smallest hash is learned from.
    None if nothing is labelled.
    """
    ship(docs.sparkSession)
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    totals = {r["_y"]: r["count"] for r in marked.groupBy("_y").count().collect()}
    chosen = [sample_rows(marked.filter(F.col("_y") == k), BANK_PER_LABEL, F.xxhash64("_id")) for k in (0, 1)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")
    rows = one_row_per_id(rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TermCounter()
        for b in batches:
            rows = [r.astype("<f4").tobytes() for _, _, texts in text_slices(b["_text"]) for r in counter.rows(texts)]
            yield pd.DataFrame({"_id": b["_id"], "_y": b["_y"], "x": rows})

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInPandas(released(features), f"_id {kind}, _y int, x binary").toPandas().sort_values(["_y", "_id"])
    if not len(got):
        return None
    return QualityModel(np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, DIMS), got["_y"].to_numpy(), totals)


def with_score(df: DataFrame, model: QualityModel | None, text: str, out: str) -> DataFrame:
    """Add the score column `out`; every other column passes through, so no join back to the texts is needed.

    Null and empty texts score 0; without a model every score is 0.5. Repeated rows get the same score.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            score = [own.score(texts) if own is not None else np.full(hi - lo, 0.5) for lo, hi, texts in text_slices(b[text])]
            b[out] = np.concatenate(score).astype(float) if score else np.empty(0)
            yield b
        if own is not None:
            own.counter = None  # a worker keeps the model between tasks, but not the words

    # whole numbers pass as text, since a null beside them would turn them into floats
    whole = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    fields = [T.StructField(f.name, T.StringType() if f.name in whole else f.dataType) for f in df.schema.fields]
    scored = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in whole}).mapInPandas(released(run), T.StructType([*fields, T.StructField(out, T.DoubleType())]))
    return scored.withColumns({c: F.col(f"`{c}`").cast(kind) for c, kind in whole.items()})


def predict(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, score (0 to 1), predicted. Cases as in `with_score`; other columns are ignored."""
    out = with_score(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text", "score")
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, with all their columns; a classifier without labels keeps all."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    scored = with_score(plain, model, f"c{docs.columns.index(text_col)}", "_score").filter(F.col("_score") >= least)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

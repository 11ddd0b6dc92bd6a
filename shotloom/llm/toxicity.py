"""Convolutional text classifier for toxicity: hashed word embeddings, several filter widths, max pooling, trained in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import WordTable, fnv, in_slots, one_row_per_id, per_text, released, sample_rows, ship, slot_of, text_slices, with_exact_ids
from shotloom.llm.language_id import letters

#: Hashed embedding rows (row 0 stays zero), embedding size, filter widths and filters per width.
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
#: A word's embedding is the mean of those of the word and of its first letters, by these lengths.
STEMS = (3, 4, 5, 6, 7)
#: Buckets seen in fewer fitting documents have no embedding.
LEAST_DOCS = 3
#: Bound of the fitting sample: documents of each label.
FIT_PER_LABEL = 2000
EPOCHS, BATCH, RATE = 8, 32, 0.05
#: Steps of a logit in which labelled rows are counted for the thresholds.
LOGIT_STEPS = 256
#: Common function words, which tell the text's language for the choice of threshold.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit ein eine zu den von auf im für",
    "en": "the of and to in is that for with was are this by from",
    "es": "el los las de que y en un una por con para del se su",
    "fr": "le la les et des un une est que pour du dans sur par qui",
}
LANGS = sorted(FUNCTION_WORDS)


def word_rows(words: list[bytes]) -> np.ndarray:
    """Embedding rows of each word: the word's own and one for each stem that is shorter than the word."""
    plain = [letters(w) for w in words]
    out = np.zeros((len(words), 1 + len(STEMS)), np.int32)
    for c, n in enumerate((None, *STEMS)):
        keys = [w[:n].encode() if w and (n is None or len(w) > n) else b"" for w in plain]
        rows = (fnv(keys, 0 if n is None else n) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
        out[:, c] = np.where([bool(k) for k in keys], rows, 0)
    return out


def _language_hits(words: list[bytes]) -> np.ndarray:
    sets = [frozenset(FUNCTION_WORDS[v].split()) for v in LANGS]
    plain = [letters(w) for w in words]
    return np.array([[w in s for s in sets] for w in plain], np.float32).reshape(len(words), len(LANGS))


def guess(hits: np.ndarray) -> np.ndarray:
    """Language number by function words; the last number stands for texts without any."""
    return np.where(hits.sum(1) > 0, hits.argmax(1), len(LANGS))


class ToxicityModel:
    """Parameters, training and scoring of the network. Scoring uses the projections of each word, worked out once per word."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.known = np.zeros(BUCKETS, bool)
        self.filters = [rng.normal(0, (SIZE * w) ** -0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0] = 0.5  # the first embedding part starts as log-odds
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.head = rng.uniform(0.05, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.base = np.float32(0)
        self.cut = np.zeros(len(LANGS) + 1)
        self.constant: float | None = None
        self.table: WordTable | None = None

    @staticmethod
    def _windows(parts: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
        """Responses of one width: part j belongs to the j-th word of a window; past a text's end there are zeros."""
        out = parts[0].copy()
        for j in range(1, len(parts)):
            after = parts[j][j:].copy()
            for k in range(j):  # windows that start k words before a text's end
                at = ends - 1 - k
                at = at[(at >= 0) & (at < len(after))]
                after[at] = 0
            out[: len(after)] += after
        return out

    def _pooled(self, parts: list[list[np.ndarray]], counts: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum(counts)
        return [self._windows(p, ends) for p in parts]

    @staticmethod
    def held_rows(n: int) -> np.ndarray:
        return np.arange(n) % 4 == 3

    def train(self, rows: list[np.ndarray], y: np.ndarray, hits: np.ndarray, seed: int = 11) -> None:
        """rows: embedding rows of each document's words; every fourth document (`held_rows`) sets first thresholds and is not trained on."""
        if y.min() == y.max():
            self.constant = float(y[0])
            return
        rng = np.random.default_rng(seed)
        held = self.held_rows(len(y))
        fit_at = np.flatnonzero(~held & np.array([len(r) > 0 for r in rows]))
        self._start([rows[i] for i in fit_at], y[fit_at])
        rows = [np.where(self.known[r], r, 0) for r in rows]
        sums = {k: 1e-6 for k in ("head", "base")}
        acc_embed = np.full(BUCKETS, 1e-6, np.float32)
        acc = [[1e-6, 1e-6] for _ in WIDTHS]
        balance = 0.5 / max(1e-9, y[fit_at].mean()), 0.5 / max(1e-9, 1 - y[fit_at].mean())
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 0.005
            order = rng.permutation(fit_at)
            for lo in range(0, len(order), BATCH):
                some = order[lo:lo + BATCH]
                counts = np.array([len(rows[i]) for i in some])
                ids = np.concatenate([rows[i] for i in some])
                used = np.maximum(1, (ids > 0).sum(1))[:, None].astype(np.float32)
                vec = self.embed[ids].sum(1) / used
                starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
                ends = starts + counts
                pooled, best = [], []
                for f, s in zip(self.filters, self.shift):
                    r = self._windows([vec @ f[j] for j in range(len(f))], ends) + s
                    at = np.empty((len(some), FILTERS), np.int64)
                    for i, (a, b) in enumerate(zip(starts, ends)):
                        at[i] = a + r[a:b].argmax(0)
                    best.append(at)
                    pooled.append(r[at, np.arange(FILTERS)])
                z = np.concatenate(pooled, 1)
                act = np.maximum(z, 0)
                logit = act @ self.head + self.base
                grad = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[some]) * np.where(y[some] > 0, *balance) / len(some)
                g_head, g_base = act.T @ grad + 1e-4 * self.head, grad.sum()
                back = grad[:, None] * self.head * (z > 0)
                touched, moved = [], []
                for k, (f, at) in enumerate(zip(self.filters, best)):
                    g = back[:, k * FILTERS:(k + 1) * FILTERS]
                    g_f = np.zeros_like(f)
                    for j in range(len(f)):
                        pos = at + j
                        inside = pos < ends[:, None]
                        pos = np.where(inside, pos, 0)
                        gj = g * inside
                        g_f[j] = np.einsum("bfd,bf->df", vec[pos], gj)
                        touched.append(ids[pos].reshape(-1, ids.shape[1]))
                        moved.append((gj[:, :, None] * f[j].T[None] / used[pos]).reshape(-1, SIZE))
                    g_s = g.sum(0)
                    acc[k][0] += float((g_f ** 2).mean())
                    acc[k][1] += float((g_s ** 2).mean())
                    self.filters[k] = f - rate * 0.3 * g_f / np.sqrt(acc[k][0])
                    self.shift[k] = self.shift[k] - rate * 0.1 * g_s / np.sqrt(acc[k][1])
                sums["head"] += float((g_head ** 2).mean())
                sums["base"] += float(g_base ** 2)
                self.head = self.head - rate * 0.3 * g_head / np.sqrt(sums["head"])
                self.base = self.base - rate * 0.1 * g_base / np.sqrt(sums["base"])
                at = np.concatenate(touched)
                step = np.repeat(np.concatenate(moved), at.shape[1], 0)
                at = at.ravel()
                real = (at > 0) & (np.abs(step).sum(1) > 0)
                which, inverse = np.unique(at[real], return_inverse=True)
                total = np.stack([np.bincount(inverse, step[real][:, d], len(which)) for d in range(SIZE)], 1) if len(which) else np.zeros((0, SIZE))
                acc_embed[which] += (total ** 2).mean(1)
                self.embed[which] -= (rate * total / np.sqrt(acc_embed[which])[:, None]).astype(np.float32)
        self._calibrate([rows[i] for i in np.flatnonzero(held)], y[held], hits[held])

    def _start(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """Known buckets are those of LEAST_DOCS fitting documents or more; their first part starts as the smoothed log-odds of the label."""
        seen = np.zeros((2, BUCKETS))
        for r, label in zip(rows, y):
            seen[int(label > 0), np.unique(r)] += 1
        self.known = seen.sum(0) >= LEAST_DOCS
        self.known[0] = False
        share = (seen + 0.5) / (np.array([[(y == 0).sum()], [(y > 0).sum()]]) + 1)
        self.embed[:, 0] = np.log(share[1] / share[0])
        self.embed[~self.known] = 0

    def _vectors(self, ids: np.ndarray) -> np.ndarray:
        ids = np.where(self.known[ids], ids, 0)
        return self.embed[ids].sum(1) / np.maximum(1, (ids > 0).sum(1))[:, None]

    def _calibrate(self, rows: list[np.ndarray], y: np.ndarray, hits: np.ndarray) -> None:
        step = [int(np.floor(self._logit_of(r) * LOGIT_STEPS)) for r in rows]
        self.calibrate(Counter(zip(guess(hits).tolist(), (y > 0).astype(int).tolist(), step)), (1.0, 1.0))

    def calibrate(self, counts: dict[tuple[int, int, int], int], weights: tuple[float, float]) -> None:
        """One threshold per guessed language: midway in the range of thresholds with the fewest errors; languages with under 5 rows of a label share the overall one.

        counts: rows by language, label and logit step; weights: what a row of each label stands for.
        """

        def best(some: dict[tuple[int, int], int]) -> float:
            steps = sorted({k for _, k in some})
            z = (np.array(steps) + 0.5) / LOGIT_STEPS
            n = np.array([[some.get((t, k), 0) for k in steps] for t in (0, 1)]) * np.array(weights)[:, None]
            cuts = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
            false, missed = (np.concatenate(([0.0], np.cumsum(x))) for x in n)
            wrong = (false[-1] - false) * 2 + missed
            good = cuts[np.isclose(wrong, wrong.min(), rtol=1e-9, atol=1e-6)]
            return float((good[0] + good[-1]) / 2)

        everyone, by_lang = Counter(), {}
        for (lang, t, k), n in counts.items():
            everyone[t, k] += n
            by_lang.setdefault(lang, Counter())[t, k] += n
        least = lambda some: min(sum(n for (t, _), n in some.items() if t == label) for label in (0, 1))
        common = best(everyone) if least(everyone) else 0.0
        for lang in range(len(self.cut)):
            some = by_lang.get(lang, {})
            self.cut[lang] = common if least(some) < 5 else best(some)

    def _logit_of(self, ids: np.ndarray) -> float:
        if not len(ids):
            return -30.0
        vec, ends = self._vectors(ids), np.array([len(ids)])
        z = [self._windows([vec @ f[j] for j in range(len(f))], ends).max(0) + s for f, s in zip(self.filters, self.shift)]
        return float(np.maximum(np.concatenate(z), 0) @ self.head + self.base)

    def _values(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        vec = self._vectors(word_rows(words))
        return (vec @ np.concatenate([m for f in self.filters for m in f], 1)).astype(np.float32), _language_hits(words)

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, guessed language and number of words of each text."""
        if self.table is None:
            self.table = WordTable(self._values)
        words, counts = self.table.number(texts)
        if not len(words):
            return np.full(len(texts), -30.0), np.full(len(texts), len(LANGS)), counts
        parts, hits = self.table.rows
        ends, at, pooled = np.cumsum(counts), 0, []
        for width, s in zip(WIDTHS, self.shift):
            own = [parts[:, (at + j) * FILTERS:(at + j + 1) * FILTERS][words] for j in range(width)]
            pooled.append(per_text(self._windows(own, ends), counts, np.maximum) + s)
            at += width
        logit = np.maximum(np.concatenate(pooled, 1), 0) @ self.head + self.base
        return np.where(counts > 0, logit, -30.0), guess(per_text(hits[words], counts)), counts

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        logit, lang, counts = self.logits(texts)
        out = 1 / (1 + np.exp(-np.clip(logit - self.cut[lang], -30, 30)))
        return np.where(counts > 0, out, 0.0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Train on at most FIT_PER_LABEL labelled rows of each label, chosen by the hash of the id, with their whole texts.

    The thresholds come from all labelled rows that were not trained on, scored where they lie and counted by guessed
    language, label and logit step; a row of a label stands for the label's rows, those trained on included.

    Rows with a null label, and labels without a document, are left out; of repeated labels of one id the largest counts,
    of documents of one id the text of the smallest hash is learned from.
    Without labelled rows every score is 0, with one label alone it is that label.
    """
    ship(docs.sparkSession)
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = [sample_rows(marked.filter(F.col("_y") == k), FIT_PER_LABEL, F.xxhash64("_id")) for k in (0, 1)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "_id")
    rows = one_row_per_id(rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(lambda words: (word_rows(words), _language_hits(words)))
        for b in batches:
            out = []
            for _, _, texts in text_slices(b["_text"]):
                for t in texts:
                    words, _ = table.number([t])
                    ids, hits = (x[words] for x in table.rows) if len(words) else (np.zeros((0, 1 + len(STEMS)), np.int32), np.zeros((0, len(LANGS))))
                    out.append((ids.astype("<i4").tobytes(), hits.sum(0).tolist()))
            yield pd.DataFrame({"_id": b["_id"], "_y": b["_y"], "ids": [x[0] for x in out], "hits": [x[1] for x in out]})

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInPandas(released(features), f"_id {kind}, _y int, ids binary, hits array<double>").toPandas().sort_values(["_y", "_id"])
    model = ToxicityModel()
    if not len(got):
        model.constant = 0.0
        return model
    ids = [np.frombuffer(x, "<i4").reshape(-1, 1 + len(STEMS)) for x in got["ids"]]
    order = np.argsort(fnv([str(v).encode() for v in got["_id"]]), kind="stable")
    model.train([ids[i] for i in order], got["_y"].to_numpy(float)[order], np.stack(got["hits"].tolist())[order])
    if model.constant is None:
        trained = set(map(str, got["_id"].to_numpy()[order][~model.held_rows(len(order))].tolist()))  # ids pass batches as text
        counts = _logit_counts(docs, marked, model, trained, id_col, text_col)
        total, held = ([sum(n for (_, y, _, fresh), n in counts.items() if y == label and fresh >= least) for label in (0, 1)] for least in (0, 1))
        weights = tuple(a / b if b else 1.0 for a, b in zip(total, held))
        model.calibrate({k[:3]: n for k, n in counts.items() if k[3]}, weights)
    return model


def _logit_counts(docs: DataFrame, marked: DataFrame, model: ToxicityModel, trained: set, id_col: str, text_col: str) -> dict[tuple[int, int, int, int], int]:
    """All labelled rows by guessed language, label, logit step and whether they were not trained on. Texts are scored before the join, so none is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast((model, trained))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, used = shared.value
        for b in batches:
            some = [own.logits(texts)[:2] for _, _, texts in text_slices(b["_text"])]
            logit, lang = (np.concatenate([x[i] for x in some]) if some else np.empty(0) for i in (0, 1))
            yield pd.DataFrame({"_id": b["_id"], "_lang": lang.astype(int), "_step": np.floor(logit * LOGIT_STEPS).astype(int), "_fresh": [int(v not in used) for v in b["_id"].tolist()]})
        own.table = None

    rows = in_slots(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), marked.select(slot_of("_id").alias("slot")), slot_of("_id")).select("_id", "_text")
    scored = with_exact_ids(rows, run, "_lang int, _step int, _fresh int")
    by = ["_lang", "_y", "_step", "_fresh"]
    got = scored.join(marked.select("_id", (F.col("_y") > 0).cast("int").alias("_y")), "_id").groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()
    return {tuple(r[c] for c in by): r["n"] for r in got}


def predict(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, score (0 to 1), predicted, from the whole text alone.

    Null and empty texts score 0. Repeated rows get the same score. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            score = [own.score(texts) for _, _, texts in text_slices(b["_text"])]
            yield pd.DataFrame({"_id": b["_id"], "score": np.concatenate(score).astype(float) if score else np.empty(0)})
        own.table = None  # a worker keeps the model between tasks, but not the words

    out = with_exact_ids(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, "score double")
    return out.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Secret scan: fixed base patterns, and formats inferred as probabilistic automata from the credentials they find."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import fnv, released, ship, text_slices, with_exact_ids
from shotloom.operators.staging import materialize

#: Fixed patterns; a match with a shorter value or length is dropped.
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Kinds in the order in which spans of one start are listed; `format` spans come from the automata.
KINDS = ("assign", "access", "hex", "format")
#: Candidates of the method: runs of these characters of at least this length.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RUN_LENGTH = 16
#: Ordinary words are runs of at least this length.
WORD = re.compile(r"[A-Za-z0-9+/_=-]{9,}")
WORD_LENGTH = 9
#: Bound of the fitting sample: strings of one kind out of all documents, and their characters. Strings are taken whole.
FIT_STRINGS, FIT_CHARS = 1000, 200_000
#: Steps of a score in which scores are counted, and scores that a task remembers.
SCORE_STEPS, SCORES_KEPT = 1024, 100_000
#: Confidence of the state comparison.
ALPHA = 0.05

_RUN_BYTES = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_CLASSES = str.maketrans(
    {c: "d" for c in "0123456789"} | {c: "h" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
    | {c: "H" for c in "ABCDEF"} | {c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, leftmost and without overlap for each kind, by start and kind."""
    low = text.lower()
    keyed = any(k in low for k in KEYS)
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if keyed else []
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def credentials(text: str) -> list[tuple[str, str]]:
    """Labelled credentials of a text: its base matches, of assignments the value alone."""
    return (
        [("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        + [("access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
        + [("hex", m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    )


class Automaton:
    """Deterministic probabilistic automaton over character classes, inferred by merging states of the strings' prefix tree.

    Two states are merged if the shares of ending and of every next class agree within Hoeffding bounds, in them and in
    all states reached from them; a merge folds the subtrees together. States are taken breadth first.
    """

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.seen, self.ends = [0], [0]
        self.out: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            self.seen[0] += 1
            for c in s.translate(_CLASSES):
                self.out[at][c] = self.out[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.out.append({})
                    self.seen.append(0)
                    self.ends.append(0)
                at = self.next[at][c]
                self.seen[at] += 1
            self.ends[at] += 1
        self._infer()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > np.sqrt(0.5 * np.log(2 / ALPHA)) * (n ** -0.5 + m ** -0.5)

    def _alike(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.seen[p], self.seen[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.out[p].keys() | self.out[q].keys():
                if self._differ(self.out[p].get(c, 0), n, self.out[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the subtree of q to state p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.seen[p] += self.seen[q]
            self.ends[p] += self.ends[q]
            for c, n in self.out[q].items():
                self.out[p][c] = self.out[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _infer(self) -> None:
        kept, known, at = [0], {0}, 0
        while at < len(kept):
            state = kept[at]
            for c in sorted(self.next[state]):
                child = self.next[state][c]
                if child in known:
                    continue
                for old in kept:
                    if self._alike(old, child):
                        self.next[state][c] = old
                        self._fold(old, child)
                        break
                else:
                    kept.append(child)
                    known.add(child)
            # a fold can give an earlier state a new next state
            at = next((i for i, s in enumerate(kept) if any(v not in known for v in self.next[s].values())), len(kept))
        self.states = len(kept)
        self.steps: list[dict[str, tuple[float, int]]] = [{} for _ in self.next]

    def log_likelihood(self, classes: str) -> float:
        """Of a string of classes; a class that a state never saw costs a smoothed share and leaves the state as it is."""
        total, at, steps = 0.0, 0, self.steps
        for c in classes:
            step = steps[at].get(c)
            if step is None:
                step = steps[at][c] = self._share(self.out[at].get(c, 0), at), self.next[at].get(c, at)
            total += step[0]
            at = step[1]
        return total + self._share(self.ends[at], at)

    def _share(self, n: int, at: int) -> float:
        return math.log((n + 0.05) / (self.seen[at] + 0.6))


class FormatModel:
    """One automaton per kind of credential and one of ordinary words; the score is the log ratio for each character."""

    def __init__(self, strings: dict[str, list[str]], words: list[str]):
        self.words = Automaton(words)
        self.kinds = {k: Automaton(v) for k, v in strings.items() if v}
        self.cut = np.inf

    def set_cut(self, plain: dict[int, int], good: dict[int, int]) -> None:
        """From the number of ordinary words and of credentials of RUN_LENGTH or more by score step; without credentials nothing passes."""
        top = _quantile(plain, 0.999) if plain else 0.0
        self.cut = max(top + 0.05, (top + _quantile(good, 0.05)) / 2) if self.kinds and good else np.inf

    def score(self, text: str) -> float:
        classes = text.translate(_CLASSES)
        if not self.kinds:
            return -np.inf
        return (max(a.log_likelihood(classes) for a in self.kinds.values()) - self.words.log_likelihood(classes)) / len(classes)


def _quantile(counts: dict[int, int], share: float) -> float:
    """Middle of the score step that holds this share of the counted scores and those below."""
    steps = sorted(counts)
    upto = np.cumsum([counts[k] for k in steps])
    return (steps[int(np.searchsorted(upto, share * upto[-1]))] + 0.5) / SCORE_STEPS


def free_runs(text: str, taken: list[tuple[int, int]], runs: re.Pattern, least: int) -> Iterator[tuple[int, int]]:
    """Runs without the taken spans (by start): each part of at least this length that is left."""
    k, end = 0, 0
    for m in runs.finditer(text):
        at = max(m.start(), end)
        while k < len(taken) and taken[k][0] < m.end():
            if taken[k][0] - at >= least:
                yield at, taken[k][0]
            end = max(end, taken[k][1])
            at = max(at, end)
            k += 1
        if m.end() - at >= least:
            yield at, m.end()


def _runs(data: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of at least this length of candidate characters."""
    inside = _RUN_BYTES[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    full = (edges[1::2] - edges[::2]) >= least
    return edges[::2][full], edges[1::2][full]


def _has_long_run(texts: list[bytes]) -> np.ndarray:
    """Whether each text has RUN_LENGTH candidate characters in a row, for all texts at once."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts, _ = _runs(b"\n".join(texts) + b"\n", RUN_LENGTH)
    ends = np.cumsum(sizes + 1)
    return np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(texts)) > 0


def spans(text: str, model: FormatModel | None) -> list[tuple[str, int, int, float]]:
    """Base spans, and candidates outside them whose format is likelier than the threshold; of a run that holds base spans, the parts beside them."""
    found = [(*s, 1.0) for s in base_spans(text)]
    if model is not None and np.isfinite(model.cut):
        for a, b in free_runs(text, [s[1:3] for s in found], RUN, RUN_LENGTH):
            score = model.score(text[a:b])
            if score >= model.cut:
                found.append(("format", a, b, float(score)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _maybe(texts: list[bytes]) -> np.ndarray:
    """Texts that can hold a span: a key word, or a long run (which every access key, hex value and candidate is)."""
    out = _has_long_run(texts)
    for i in np.flatnonzero(~out):
        low = texts[i].lower()
        out[i] = any(k.encode() in low for k in KEYS)
    return out


def _within(lengths: np.ndarray) -> int:
    """How many strings of these lengths, in the order of their hashes, the bound takes."""
    return int(np.searchsorted(np.cumsum(lengths[:FIT_STRINGS]), FIT_CHARS, "right"))


def _smallest(values: set[str]) -> dict[str, int]:
    """The values of the smallest hashes within FIT_STRINGS and FIT_CHARS, with these; values over FIT_CHARS never fit."""
    some = [v for v in values if len(v) <= FIT_CHARS]
    hashes = (fnv([v.encode() for v in some]) >> np.uint64(1)).astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    order = order[: _within(np.fromiter((len(some[i]) for i in order[:FIT_STRINGS]), np.int64))]
    return {some[i]: int(hashes[i]) for i in order}


def _labelled(column: pd.Series) -> Iterator[tuple[list[tuple[str, str]], list[str]]]:
    """Credentials and ordinary words of each slice of texts."""
    for _, _, texts in text_slices(column):
        found, words, plain = [], [], []
        for raw, maybe in zip(texts, _maybe(texts)):
            if not maybe:
                plain.append(raw)
                continue
            t = raw.decode()
            base = base_spans(t)
            found += credentials(t) if base else []
            words += [t[a:e] for a, e in free_runs(t, [s[1:] for s in base], WORD, WORD_LENGTH)]
        data = b"\n".join(plain) + b"\n"
        starts, ends = _runs(data, WORD_LENGTH)
        words += [data[a:e].decode() for a, e in zip(starts.tolist(), ends.tolist())]
        yield found, words


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> FormatModel:
    """Infer the automata from all documents: of each kind's distinct strings those of the smallest hashes, at
    most FIT_STRINGS and FIT_CHARS characters, each whole. One string is enough for an automaton of its kind.

    Labelled credentials are the base matches; ordinary words are the long runs outside of base matches. The threshold
    is set from the scores of all words and credentials of all documents, counted in steps. Tasks send on a bounded
    number of strings and of counts. Without credentials the model adds no spans.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("_text"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, dict[str, int]] = {"assign": {}, "access": {}, "hex": {}, "word": {}}
        for b in batches:
            for found, words in _labelled(b["_text"]):
                fresh = {kind: set(some) for kind, some in kept.items()}
                fresh["word"].update(words)
                for kind, value in found:
                    fresh[kind].add(value)
                kept = {kind: _smallest(some) for kind, some in fresh.items()}
        out = [(kind, value, h) for kind, some in kept.items() for value, h in some.items()]
        yield pd.DataFrame(out, columns=["kind", "value", "hash"])

    found = materialize(rows.mapInPandas(released(gather), "kind string, value string, hash bigint").distinct())
    strings = {}
    for kind in ("assign", "access", "hex", "word"):
        first = found.filter(F.col("kind") == kind).select("hash", F.length("value").alias("size")).orderBy("hash").limit(FIT_STRINGS).collect()
        first = first[: _within(np.array([r["size"] for r in first], np.int64))]
        some = found.filter((F.col("kind") == kind) & (F.col("hash") <= (first[-1]["hash"] if first else -1)))
        strings[kind] = [r["value"] for r in some.orderBy("hash", "value").collect()]
    words = strings.pop("word", [])
    model = FormatModel(strings, words)
    if model.kinds:
        model.set_cut(*_score_counts(rows, model))
    return model


def _score_counts(rows: DataFrame, model: FormatModel) -> tuple[dict[int, int], dict[int, int]]:
    """How many words, and how many credentials of RUN_LENGTH or more, of all texts have a score in each step."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, steps = Counter(), {}
        for b in batches:
            for found, words in _labelled(b["_text"]):
                seen = Counter(("word", w) for w in words) + Counter(("good", v) for _, v in found if len(v) >= RUN_LENGTH)
                for (kind, value), n in seen.items():
                    if value not in steps:
                        if len(steps) >= SCORES_KEPT:
                            steps.clear()
                        steps[value] = math.floor(shared.value.score(value) * SCORE_STEPS)
                    counts[kind, steps[value]] += n
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "step", "n"])

    got = rows.mapInPandas(released(run), "kind string, step bigint, n bigint").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect()
    return tuple({r["step"]: r["n"] for r in got if r["kind"] == kind} for kind in ("word", "good"))


def find(docs: DataFrame, model: FormatModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, spans: array of (kind, start, end, score), in code points, end exclusive.

    Null and empty texts have no spans. Repeated rows get the same spans. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, _, texts in text_slices(b["_text"]):
                out += [
                    [{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in spans(t.decode(), shared.value)] if maybe else []
                    for t, maybe in zip(texts, _maybe(texts))
                ]
            yield pd.DataFrame({"_id": b["_id"], "spans": out})

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return with_exact_ids(out, run, "spans array<struct<kind:string,start:bigint,end:bigint,score:double>>").withColumnRenamed("_id", id_col)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

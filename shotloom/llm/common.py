"""Helpers shared by the document operators: table access, bounded broadcasts, skew-safe look-ups, word tables."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.operators.staging import materialize
from shotloom.session import ship  # noqa: F401

#: Width of the slot space used for bounded broadcast filters; a filter never holds more rows than this.
SLOTS = 1 << 18
#: Keys that get their own broadcast row in `lookup`; every other key takes part in an ordinary shuffle join.
HOT_KEYS = 256
#: Bytes of text that a Python task works on at once.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def slot_of(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SLOTS)).cast("int")


def in_slots(df: DataFrame, keys: DataFrame, slot: Column) -> DataFrame:
    """Rows of `df` whose slot is one of `keys.slot`; no shuffle of `df`.

    The broadcast holds at most SLOTS integers whatever the input size. Other keys can share a slot, so this only
    narrows: an exact step must follow.
    """
    wanted = keys.select(F.col("slot").alias("_wanted")).distinct()
    return df.join(F.broadcast(wanted), slot == F.col("_wanted"), "left_semi")


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join `left` to `right`, which has one row per key and in `weight` how often the key occurs on the left.

    The HOT_KEYS most frequent keys are broadcast (a fixed number of rows), so their rows on the left are never
    shuffled; all others go through an ordinary join in which no key is larger than the last hot one.
    """
    hot = materialize(right.orderBy(F.desc(weight), F.col(key)).limit(HOT_KEYS))
    keys = F.broadcast(hot.select(key))
    joined = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(keys, left[key].eqNullSafe(hot[key]), "left_anti").join(right, key, how)
    return joined.unionByName(rest)


def released(run: Callable) -> Callable:
    """A task on Arrow batches that gives its memory back when it ends; workers live on and would hold it beside the JVM."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return wrapped


def with_exact_ids(rows: DataFrame, run: Callable, rest: str) -> DataFrame:
    """`rows` (with a column _id) through a task on pandas batches that returns _id and the columns of `rest`.

    The id passes as text: in pandas a null would turn a column of whole numbers into floats and change all ids beyond 2^53.
    """
    kind = rows.schema["_id"].dataType
    out = rows.withColumn("_id", F.col("_id").cast("string")).mapInPandas(released(run), f"_id string, {rest}")
    return out.withColumn("_id", F.col("_id").cast(kind))


def give_back() -> None:
    """Hand freed memory back to the system, as at the end of a `released` task."""
    for _ in released(iter)(()):
        pass


def text_slices(column, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of positions with their texts in UTF-8, about `most` bytes and at most `rows` texts each; null counts as empty.

    Texts are encoded slice by slice, so only one slice is held beside the column. A longer text stands alone.
    """
    start, size, own = 0, 0, []
    for i, t in enumerate(column):
        t = t.encode() if isinstance(t, str) else b""
        if own and (size + len(t) > most or len(own) == rows):
            yield start, i, own
            start, size, own = i, 0, []
        own.append(t)
        size += len(t)
    if own:
        yield start, start + len(own), own


def byte_slices(column: list[bytes | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """As `text_slices`, for texts that are bytes already."""
    start, size = 0, 0
    for i, t in enumerate(column):
        if i > start and size + len(t or b"") > most:
            yield start, i, [x or b"" for x in column[start:i]]
            start, size = i, 0
        size += len(t or b"")
    if start < len(column):
        yield start, len(column), [x or b"" for x in column[start:]]


class _Ids(dict):
    """Numbers words in order of first sight and keeps the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTable:
    """Dense numbers for words and one row of values per word, filled as words are first seen.

    `values(words)` returns a tuple of arrays with one row per word. The table is emptied when it holds `limit`
    words, so its memory is bounded; that only costs the values being worked out again.
    """

    def __init__(self, values: Callable[[list[bytes]], tuple[np.ndarray, ...]], limit: int = 150_000):
        self.values, self.limit = values, limit
        self.ids, self.rows, self.size = _Ids(), None, 0

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the number of words of each text."""
        if len(self.ids) > self.limit:
            self.ids, self.rows, self.size = _Ids(), None, 0
        words = [t.split() for t in texts]  # ASCII white space only: space and \t to \r
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        if self.ids.new:
            self._add(self.values(self.ids.new))
            self.ids.new = []
        return flat, counts

    def _add(self, fresh: tuple[np.ndarray, ...]) -> None:
        n = len(fresh[0])
        if self.rows is None:
            self.rows = tuple(np.empty((n + 1024, *x.shape[1:]), x.dtype) for x in fresh)
        if self.size + n > len(self.rows[0]):
            self.rows = tuple(np.concatenate([x[: self.size], np.empty((n + self.size // 4, *x.shape[1:]), x.dtype)]) for x in self.rows)
        for x, y in zip(self.rows, fresh):
            x[self.size:self.size + n] = y
        self.size += n


def fnv(words: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash per word that is the same in every process, worked out for all words at once."""
    words = [w if len(w) <= 64 else hashlib.blake2b(w, digest_size=16).digest() for w in words]
    lens = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full(len(words), 0xCBF29CE484222325 ^ seed, np.uint64)
    if not len(words):
        return out
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    order = np.argsort(-lens, kind="stable")
    sorted_lens = -lens[order]
    for at in range(int(lens.max())):
        live = order[: np.searchsorted(sorted_lens, -at, "left")]
        out[live] = (out[live] ^ data[starts[live] + at]) * np.uint64(0x100000001B3)
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def per_text(flat: np.ndarray, counts: np.ndarray, op=np.add) -> np.ndarray:
    """`op` over the rows of each text; zero where a text has none."""
    out = np.zeros((len(counts), *flat.shape[1:]), flat.dtype)
    full = counts > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
        out[full] = op.reduceat(flat, starts, axis=0)
    return out


def sample_rows(df: DataFrame, most: int, by: Column) -> DataFrame:
    """At most `most` rows, the same ones each time; only `most` rows leave each task."""
    return df.withColumn("_by", by).orderBy("_by").limit(most).drop("_by")


def one_row_per_id(rows: DataFrame, text: str = "_text") -> DataFrame:
    """Of rows of one _id the text of the smallest hash, other columns as its first row has them.

    For samples chosen by id: a repeated id brings one row, before any feature is made of it. Each task folds its own rows first.
    The rows are spread over all cores again, since so few texts would else be one task.
    """
    rest = [c for c in rows.columns if c not in ("_id", text)]
    one = rows.groupBy("_id").agg(F.min_by(text, F.xxhash64(text)).alias(text), *[F.first(c).alias(c) for c in rest])
    return one.repartition(rows.sparkSession.sparkContext.defaultParallelism, "_id")

"""Best-fit packing planned on the histogram of piece lengths; documents take planned slots by rank within length."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotloom.llm.common import WordTable, ship, text_slices, with_exact_ids
from shotloom.operators.staging import materialize

CAPACITY = 2048
END_ID = 0
#: Rows of one length that one window task numbers, on average.
RANK_ROWS = 50_000
PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"
#: ASCII characters that are neither letters, digits nor white space.
_MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}|~"
#: Parts after which the encoder starts anew.
PART_LIMIT = 300_000

_encoders: dict[str, "WordEncoder"] = {}


def _one_part(text: str) -> bool:
    """Whether text is letters alone before and after normalising, so that marks after it begin a part of their own."""
    return text.isalpha() and "Σ" not in text and normalize("NFC", text).lower().isalpha()


class WordEncoder:
    """Token ids of texts by a tokenizer whose tokens never cross ASCII white space and that marks the end of each part.

    A word is a core of letters and ASCII marks after it, which the tokenizer's own split also parts, or else one part as
    it stands. A part is encoded once while it stays in the table. Cores and marks are encoded many at a time, as one text
    with a space between them, and told apart by the tokens that end a part.
    """

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.table = WordTable(self._values)
        ends = [t.endswith("</w>") for t, _ in sorted(self.model.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self._clear()

    def _clear(self) -> None:
        self.parts: dict[bytes, int] = {b"": 0}
        self.lens, self.starts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool = np.empty(0, np.int64)

    def _values(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.table.size == 0 and len(self.parts) > PART_LIMIT:
            self._clear()
        parts, plain, odd = self.parts, [], []
        at = np.zeros((2, len(words)), np.int64)
        for i, w in enumerate(words):
            core = w.rstrip(_MARKS)
            marks = w[len(core):]
            if core.isalpha():  # ASCII letters
                core = core.lower()
            elif core and not _one_part(core.decode()):
                core, marks = w, b""
                if core not in parts:
                    parts[core] = len(parts)
                    odd.append(core)
            k = parts.get(core)
            if k is None:
                k = parts[core] = len(parts)
                plain.append(core)
            at[0, i] = k
            if marks:
                k = parts.get(marks)
                if k is None:
                    k = parts[marks] = len(parts)
                    plain.append(marks)
                at[1, i] = k
        self._encode_parts(plain, odd)
        return at[0], at[1]

    def _encode_parts(self, plain: list[bytes], odd: list[bytes]) -> None:
        new = plain + odd
        if not new:
            return
        ids, lens = [], []
        for lo in range(0, len(plain), 500):
            some = plain[lo:lo + 500]
            code = np.array(self.model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.ends[code]) + 1
            if len(stops) == len(some):
                ids.append(code)
                lens.append(np.diff(stops, prepend=0))
            else:  # some part is not one part for the tokenizer
                for one in self.model.encode_batch_fast([x.decode() for x in some], add_special_tokens=False):
                    ids.append(np.array(one.ids, np.int64))
                    lens.append(np.array([len(one.ids)]))
        for one in self.model.encode_batch_fast([x.decode() for x in odd], add_special_tokens=False):
            ids.append(np.array(one.ids, np.int64))
            lens.append(np.array([len(one.ids)]))
        lens_new = np.concatenate(lens)
        order = np.array([self.parts[x] for x in new])
        size = len(self.parts)
        starts = np.zeros(size, np.int64)
        starts[: len(self.starts)] = self.starts
        starts[order] = len(self.pool) + np.cumsum(lens_new) - lens_new
        all_lens = np.zeros(size, np.int64)
        all_lens[: len(self.lens)] = self.lens
        all_lens[order] = lens_new
        self.starts, self.lens, self.pool = starts, all_lens, np.concatenate([self.pool, *ids])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each text."""
        words, counts = self.table.number(texts)
        if not len(words):
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        parts = np.stack([x[words] for x in self.table.rows], 1).ravel()
        lens = self.lens[parts]
        ends = np.cumsum(lens)
        ids = self.pool[np.repeat(self.starts[parts] - (ends - lens), lens) + np.arange(int(ends[-1]))]
        edges = np.concatenate(([0], ends))[2 * np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(edges)


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: _id, piece, start, length, ids_crc32. Only documents above `capacity` are cut."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(model_path)
        for b in batches:
            for lo, hi, texts in text_slices(b["_text"]):
                ids, counts = encoder.encode(texts)
                out, at = [], 0
                for i, n in zip(range(lo, hi), counts.tolist()):
                    own = np.append(ids[at:at + n], END_ID).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        part = own[start:start + capacity]
                        out.append((b["_id"].iat[i], k, start, len(part), zlib.crc32(part.tobytes())))
                frame = pd.DataFrame(out, columns=["_id", "piece", "start", "length", "ids_crc32"])
                frame["_id"] = frame["_id"].astype(b["_id"].dtype)
                yield frame

    return with_exact_ids(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), cut, PIECES)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over counts: rows (length, first rank, first sequence, pieces per sequence, offset), and the number of sequences.

    Sequences with the same free space are kept as ranges, so a step handles any number of equal pieces at once. A length
    adds at most two ranges, so the plan's size depends on `capacity` and not on the number of documents.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []
    rows, made = [], 0

    def put(space: int, base: int, many: int) -> None:
        if many and space:
            if space not in free:
                free[space] = []
                keys.insert(bisect_left(keys, space), space)
            free[space].append((base, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for space in keys[bisect_left(keys, length):]:
            if not left:
                break
            each, ranges = space // length, free.pop(space)
            keys.remove(space)
            for base, many in ranges:
                full = min(many, left // each)
                if full:
                    rows.append((length, rank, base, each, capacity - space))
                    put(space - each * length, base, full)
                    left, rank = left - full * each, rank + full * each
                if full < many and 0 < left < each:
                    rows.append((length, rank, base + full, left, capacity - space))
                    put(space - left * length, base + full, 1)
                    left, rank, full = 0, rank + left, full + 1
                put(space, base + full, many - full)
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                rows.append((length, rank, made, each, 0))
                put(capacity - each * length, made, full)
            if rest:
                rows.append((length, rank + full * each, made + full, rest, 0))
                put(capacity - rest * length, made + full, 1)
            made += full + bool(rest)
    return np.array(rows, np.int64).reshape(-1, 5), made


def take_slots(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with _id, piece, start, length and ids_crc32.

    The histogram has at most `capacity` rows, whatever the input. Ranks within a length are counted in buckets, so that a
    length of a third of all pieces is numbered by many tasks; the bucket totals then give each bucket its first rank.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    plan, _ = plan_slots(counts, capacity)
    shared = spark.sparkContext.broadcast(plan)
    buckets = max(16, max(counts.values(), default=0) // RANK_ROWS + 1)
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64("_id", "piece"), F.lit(buckets)))
    totals = parts.groupBy("length", "_bucket").count()
    first = totals.select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_id", "piece", "start", "ids_crc32"))
    ranked = parts.withColumn("_own", own).join(first, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_own") - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.lexsort((shared.value[:, 1], shared.value[:, 0]))
        length, lo, base, each, offset = shared.value[order].T
        wide = np.int64(1) << 50
        for b in batches:
            own, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            at = np.searchsorted(length * wide + lo, own * wide + rank, "right") - 1
            step = rank - lo[at]
            b["sequence_id"] = base[at] + step // each[at]
            b["offset"] = offset[at] + (step % each[at]) * own
            yield b[["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return with_exact_ids(ranked.select("_id", "piece", "start", "length", "ids_crc32", "_rank"), place, PIECES + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: `id_col`, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is its token ids and one end id. A null or empty text is the end id alone. Documents above `capacity`
    are cut into full pieces and a rest; all others stay whole. Repeated rows are packed once each. Equal lengths are
    ranked by id, piece and digest. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    parts = materialize(pieces(docs, model_path, id_col, text_col, capacity))
    return take_slots(parts, capacity).withColumnRenamed("_id", id_col)

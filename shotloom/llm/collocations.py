"""Phrase collocations from weighted acyclic automata.

A task counts the n-grams of its shard, sorts them and builds, for every prefix range, a minimal acyclic automaton over words whose paths
are the n-grams; the count of a path is stored by the path's rank. A range is a share of the hash space of the first two words. The
automata of a range are united and their weights summed. The candidates are read off the united automata; the counts of their parts
come from composing the acceptor of all wanted parts of a range with its automaton.

Words and pairs are counted first. Three words can only be a candidate if both their pairs are, so the second pass leaves out those
with a pair that is not in the bitmap of candidate pairs. The bitmap has a fixed size: pairs that share a bit let a few more pass, and
with far more candidate pairs than bits everything passes, which costs shuffled bytes and nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.common import _Ids, byte_slices, fnv, give_back, lookup, mix, per_text, released, ship
from shotloom.operators.staging import materialize

#: Bytes of text for one prefix range, and paths of a range above which it is split by the whole n-gram.
RANGE_BYTES, RANGE_PATHS = 32 << 20, 4_000_000
#: N-grams and words that a task holds before it gives back its automata.
TASK_PATHS, TASK_WORDS = 2_500_000, 600_000
#: Bits of the bitmap of candidate pairs, as a power of two.
PAIR_BITS = 25
#: Bytes of a text that are split into words at once.
CHUNK = 4 << 20

_BITS = np.uint64(21)
_LOW = np.uint64((1 << 21) - 1)
_BREAK = 0xFF  # a byte that no UTF-8 text has, between pieces
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else _BREAK if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else c for c in range(256))


def coded(first: np.ndarray, second: np.ndarray | int = 0, third: np.ndarray | int = 0) -> np.ndarray:
    """N-grams of word numbers from 1 as sortable keys; 0 stands for no word."""
    u = lambda x: np.asarray(x, np.uint64)
    return (u(first) << (_BITS + _BITS)) | (u(second) << _BITS) | u(third)


def parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple((keys >> s & _LOW).astype(np.int64) for s in (_BITS + _BITS, _BITS, np.uint64(0)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new)


def _shared(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Registers equal lists once: the state of each list, and the offsets and values of the states."""
    values = values.astype(np.uint64)
    sign = mix(per_text(mix(values + np.uint64(1)), sizes) + mix(per_text(mix(values ^ np.uint64(0x5BD1E995)), sizes, np.bitwise_xor)) + sizes.astype(np.uint64))
    _, index, state = np.unique(sign, return_index=True, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    model = index[state]
    within = np.arange(len(values)) - np.repeat(starts, sizes)
    same = sizes == sizes[model]
    like = np.repeat(starts[model], sizes) + within
    like = np.minimum(like, max(0, len(values) - 1))
    differs = per_text((values[like] != values).astype(np.int64), sizes) > 0
    odd = np.flatnonzero(~same | differs)  # lists that share a hash only: states of their own
    index = np.concatenate([index, odd])
    state = state.copy()
    state[odd] = len(index) - len(odd) + np.arange(len(odd))
    n = sizes[index]
    at = np.repeat(starts[index] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return state, np.concatenate(([0], np.cumsum(n))), values[at].astype(np.int64)


class CountAutomaton:
    """N-grams of up to three words with counts. States with the same continuations are one; counts stand by the rank of their path."""

    ARRAYS = ("first", "state1", "off1", "label2", "state2", "off2", "label3", "count1", "count2", "count3")

    def __init__(self, words: list[bytes], keys: np.ndarray, counts: np.ndarray):
        """``words`` are the alphabet in order, ``keys`` distinct sorted n-grams over its numbers from 1."""
        self.words = words
        w1, w2, w3 = parts(keys)
        self.first, row1 = np.unique(w1, return_inverse=True)
        self.count1 = np.zeros(len(self.first), np.int64)
        self.count1[row1[w2 == 0]] = counts[w2 == 0]
        long = w2 > 0
        pair = keys[long] >> _BITS
        new = np.concatenate(([True], pair[1:] != pair[:-1])) if len(pair) else np.empty(0, bool)
        row2 = np.cumsum(new) - 1
        pairs, parent = w2[long][new], row1[long][new]
        self.count2 = np.zeros(len(pairs), np.int64)
        two = w3[long] == 0
        self.count2[row2[two]] = counts[long][two]
        self.count3 = counts[long][~two]
        state2, self.off2, self.label3 = _shared(w3[long][~two], np.bincount(row2[~two], minlength=len(pairs)))
        wide = max(1, len(self.off2))
        self.state1, self.off1, both = _shared(pairs * wide + state2, np.bincount(parent, minlength=len(self.first)))
        self.label2, self.state2 = both // wide, both % wide

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams with a count, as keys, and their counts."""
        n1 = np.diff(self.off1)[self.state1]
        at2 = np.repeat(self.off1[self.state1] - (np.cumsum(n1) - n1), n1) + np.arange(int(n1.sum()))
        w1, w2, s2 = np.repeat(self.first, n1), self.label2[at2], self.state2[at2]
        n2 = np.diff(self.off2)[s2]
        at3 = np.repeat(self.off2[s2] - (np.cumsum(n2) - n2), n2) + np.arange(int(n2.sum()))
        keys = np.concatenate([coded(self.first), coded(w1, w2), coded(np.repeat(w1, n2), np.repeat(w2, n2), self.label3[at3])])
        counts = np.concatenate([self.count1, self.count2, self.count3])
        return keys[counts > 0], counts[counts > 0]

    def compose(self, other: CountAutomaton) -> tuple[np.ndarray, np.ndarray]:
        """Paths of one or two words that this acceptor and the transducer `other` share, as own keys, with the other's counts."""
        number = {w: i for i, w in enumerate(other.words, 1)}
        theirs = np.array([0, *(number.get(w, 0) for w in self.words)], np.int64)
        keys, _ = self.paths()
        w1, w2, w3 = parts(keys)
        known = (theirs[w1] > 0) & ((w2 == 0) | (theirs[w2] > 0)) & (w3 == 0)
        keys, w1, w2 = keys[known], theirs[w1[known]], theirs[w2[known]]
        out = np.zeros(len(keys), np.int64)
        if not len(other.first):
            return keys, out
        at1 = np.minimum(np.searchsorted(other.first, w1), len(other.first) - 1)
        met = other.first[at1] == w1
        one = met & (w2 == 0)
        out[one] = other.count1[at1[one]]
        two = np.flatnonzero(met & (w2 > 0))
        if len(two) and len(other.label2):
            n1 = np.diff(other.off1)
            wide = len(other.words) + 1
            arcs = np.repeat(np.arange(len(n1)), n1) * wide + other.label2
            state = other.state1[at1[two]]
            want = state * wide + w2[two]
            arc = np.minimum(np.searchsorted(arcs, want), len(arcs) - 1)
            hit = arcs[arc] == want
            degree = n1[other.state1]
            rank = (np.cumsum(degree) - degree)[at1[two]] + arc - other.off1[state]
            out[two[hit]] = other.count2[rank[hit]]
        return keys, out

    def to_bytes(self) -> bytes:
        out = [b"\n".join(self.words)]
        for name in self.ARRAYS:
            a = getattr(self, name)
            out.append(a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)).tobytes())
        sizes = [len(self.words), *(len(getattr(self, n)) for n in self.ARRAYS), *map(len, out)]
        return zlib.compress(np.array(sizes, np.int64).tobytes() + b"".join(out), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        self, k, data = cls.__new__(cls), len(cls.ARRAYS), zlib.decompress(data)
        sizes = np.frombuffer(data, np.int64, 2 * (k + 1))
        at = sizes.nbytes
        text = data[at:at + int(sizes[k + 1])]
        self.words = text.split(b"\n") if sizes[0] else []
        at += int(sizes[k + 1])
        for name, n, size in zip(cls.ARRAYS, sizes[1:k + 1].tolist(), sizes[k + 2:].tolist()):
            setattr(self, name, np.frombuffer(data, f"u{size // n}" if n else "u1", n, at).astype(np.int64))
            at += size
        return self


def in_order(words: list[bytes]) -> np.ndarray:
    """Rank of each word, from number 1, among all words in byte order; 0 keeps 0."""
    rank = np.zeros(len(words) + 1, np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64) + 1] = np.arange(1, len(words) + 1)
    return rank


def from_ngrams(words: list[bytes], keys: np.ndarray, counts: np.ndarray, rank: np.ndarray | None = None) -> CountAutomaton:
    """Automaton of distinct n-grams over any numbered words; its alphabet holds the used words only, in order.

    ``rank`` is the order of all words, for callers that build several automata over them.
    """
    used = np.zeros(len(words) + 1, bool)
    for w in parts(keys):
        used[w] = True
    used = np.flatnonzero(used[1:]) + 1
    own = [words[i - 1] for i in used.tolist()]
    order = np.argsort(rank[used] if rank is not None else in_order(own)[1:])
    number = np.zeros(len(words) + 1, np.int64)
    number[used[order]] = np.arange(1, len(used) + 1)
    new = coded(*(number[w] for w in parts(keys)))
    by = np.argsort(new)
    return CountAutomaton([own[i] for i in order.tolist()], new[by], counts[by])


def merged(automata: Iterator[CountAutomaton]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, distinct paths and summed counts of all automata. One automaton is held beside the sums so far."""
    number = _Ids()
    keys, counts, size, least = [], [], 0, 1 << 20
    for a in automata:
        own = np.concatenate(([0], np.fromiter(map(number.__getitem__, a.words), np.int64, len(a.words)) + 1))
        k, c = a.paths()
        keys.append(coded(*(own[w] for w in parts(k))))
        counts.append(c)
        size += len(k)
        if size > least:  # the sums double before the next time, so each path is sorted a few times only
            _fold(keys, counts)
            size, least = len(keys[0]), max(1 << 20, 2 * len(keys[0]))
    _fold(keys, counts)
    return number.new, keys[0], counts[0]


def _fold(keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
    """Sum the lists to one entry each, without holding the old entries beside the new ones."""
    whole = [np.concatenate(counts), np.concatenate(keys)]
    keys.clear()
    counts.clear()
    k, c = summed(whole.pop(), whole.pop())
    keys.append(k)
    counts.append(c)


def union(automata: Iterator[CountAutomaton], least: int = 1) -> CountAutomaton:
    """The paths of all automata with a summed count of `least` or more."""
    words, keys, counts = merged(automata)
    return from_ngrams(words, keys[counts >= least], counts[counts >= least])


def prefix_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def hashed(words: list[bytes]) -> np.ndarray:
    """Hashes of the words from number 1; 0 keeps 0."""
    return np.concatenate((np.zeros(1, np.uint64), fnv(words)))


def ranges_of(h: np.ndarray, keys: np.ndarray, ranges: int) -> np.ndarray:
    """Prefix range of each n-gram: its first two words decide."""
    w1, w2, _ = parts(keys)
    return (prefix_hash(h[w1], h[w2]) % np.uint64(ranges)).astype(np.int64)


def pair_slots(h: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    return prefix_hash(h[w1], h[w2]) >> np.uint64(64 - PAIR_BITS)


def _chunks(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in bounded parts cut at spaces, each with the number of words repeated from the part before."""
    carried, lo = b"", 0
    while lo < len(text):
        hi = len(text) if len(text) - lo <= CHUNK else text.find(b" ", lo + CHUNK)
        hi = len(text) if hi < 0 else hi
        body = carried + text[lo:hi]
        yield len(carried.split()), body
        carried = b" ".join(body.rsplit(None, 2)[-2:]) + b" "
        lo = hi


class Shard:
    """Counts n-grams of texts in some languages, and gives them back as automata by prefix range.

    Without `pairs`, words and pairs are counted; with it, three words whose pairs are both in that bitmap.
    """

    def __init__(self, ranges: int, pairs: np.ndarray | None = None):
        self.ranges, self.pairs = ranges, pairs
        self.clear()

    def clear(self) -> None:
        self.ids = _Ids()
        self.ids[bytes([_BREAK])]
        self.hashes = np.zeros(1, np.uint64)
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def _ngrams(self, x: np.ndarray, known: int) -> Iterator[np.ndarray]:
        """N-grams in a row of words (0 is a break) that end after the first `known` words."""
        if self.pairs is None:
            yield coded(x[known:][x[known:] > 0])
            x = x[max(known - 1, 0):]
            both = (x[:-1] > 0) & (x[1:] > 0)
            yield coded(x[:-1][both], x[1:][both])
            return
        self.hashes = np.concatenate((self.hashes, fnv(self.ids.new[len(self.hashes):])))
        x = x[max(known - 2, 0):]
        slot = pair_slots(self.hashes, x[:-1], x[1:])
        good = (x[:-1] > 0) & (x[1:] > 0) & (self.pairs[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        both = good[:-1] & good[1:]
        yield coded(x[:-2][both], x[1:-1][both], x[2:][both])

    def add(self, lang: str, texts: list[bytes]) -> Iterator[tuple[str, int, int, bytes]]:
        """Counts texts; gives back automata early where a very long text fills the task."""
        text = b"\xff".join(texts).translate(_PLAIN).replace(b"\xff", b" \xff ")
        for known, chunk in _chunks(text):
            words = chunk.split()  # line breaks are piece breaks by now, so this parts at spaces only
            x = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
            keys = np.concatenate(list(self._ngrams(x, known)))
            if len(keys):
                got, counts = np.unique(keys, return_counts=True)
                self.held.setdefault(lang, []).append((got, counts.astype(np.int64)))
                self.size += len(got)
            if self.size > TASK_PATHS:
                for k, v in self.held.items():
                    self.held[k] = [summed(*map(np.concatenate, zip(*v)))]
                self.size = sum(len(v[0][0]) for v in self.held.values())
            if self.size > TASK_PATHS * 3 // 4 or len(self.ids) > TASK_WORDS:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[str, int, int, bytes]]:
        """(lang, range, paths, automaton) of everything counted so far."""
        words = self.ids.new[1:]
        hashes, rank = hashed(words), in_order(words)
        for lang in list(self.held):
            keys, counts = summed(*map(np.concatenate, zip(*self.held.pop(lang))))
            rng = ranges_of(hashes, keys, self.ranges)
            order = np.argsort(rng, kind="stable")
            keys, counts, rng = keys[order], counts[order], rng[order]
            cuts = np.flatnonzero(np.concatenate(([True], rng[1:] != rng[:-1], [True])))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield lang, int(rng[lo]), hi - lo, from_ngrams(words, keys[lo:hi], counts[lo:hi], rank).to_bytes()
        self.clear()


def shard_automata(docs: DataFrame, ranges: int, text_col: str, lang_col: str, pairs: np.ndarray | None = None) -> DataFrame:
    """lang, range, paths, automaton: what each task counted, cut by prefix range."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(ranges, pairs)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]

        def out(found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["lang", "range", "paths", "automaton"])

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lo, hi, texts in byte_slices(b.column(1).to_pylist()):
                for lang in sorted(set(langs[lo:hi])):
                    own = [t for t, x in zip(texts, langs[lo:hi]) if x == lang]
                    if found := list(shard.add(lang, own)):
                        yield out(found)
        if found := list(shard.flush()):
            yield out(found)

    return rows.mapInArrow(released(count), "lang string, range int, paths bigint, automaton binary")


def united(pieces: DataFrame, least: int) -> DataFrame:
    """lang, range, n (occurrences of words), automaton: the automata of a range as one, without n-grams under `least`.

    A range of very many paths (a prefix with very many continuations) is split by the whole n-gram first, so no group is larger than
    about RANGE_PATHS.
    """
    wide = materialize(pieces.groupBy("lang", "range").agg(F.ceil(F.sum("paths") / F.lit(RANGE_PATHS)).cast("int").alias("ways")).filter("ways > 1"))
    few = wide.count() <= 10_000  # usually none; so the automata are shuffled once only

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                a = CountAutomaton.from_bytes(r.automaton)
                keys, counts = a.paths()
                h = hashed(a.words)
                way = np.zeros(len(keys), np.uint64)
                for w in parts(keys):
                    way = prefix_hash(way, h[w])
                way %= np.uint64(r.ways)
                rank = in_order(a.words)
                yield pd.DataFrame([(r.lang, r.range, int(k), from_ngrams(a.words, keys[way == k], counts[way == k], rank).to_bytes()) for k in np.unique(way)], columns=["lang", "range", "way", "automaton"])

    wide_key = F.broadcast(wide) if few else wide
    split_up = pieces.join(wide_key, ["lang", "range"]).mapInPandas(released(split), "lang string, range int, way int, automaton binary")
    rest = pieces.join(wide_key, ["lang", "range"], "left_anti").select("lang", "range", F.lit(0).alias("way"), "automaton")

    def unite(g: pd.DataFrame) -> pd.DataFrame:
        words, keys, counts = merged(CountAutomaton.from_bytes(x) for x in g["automaton"])
        often, n = counts >= least, int(counts[parts(keys)[1] == 0].sum())
        data = from_ngrams(words, keys[often], counts[often]).to_bytes()
        del words, keys, counts, often
        give_back()
        return pd.DataFrame({"lang": g["lang"].iloc[:1], "range": g["range"].iloc[:1], "n": [n], "automaton": [data]})

    return split_up.unionByName(rest).groupBy("lang", "range", "way").applyInPandas(unite, "lang string, range int, n bigint, automaton binary")


def pair_bitmap(automata: DataFrame) -> np.ndarray:
    """Bits of all pairs in the automata: a fixed number of longs, whatever the input."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["automaton"]:
                a = CountAutomaton.from_bytes(data)
                w1, w2, _ = parts(a.paths()[0])
                slot = pair_slots(hashed(a.words), w1[w2 > 0], w2[w2 > 0])
                at, own = np.unique(slot >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(at), np.uint64)
                np.bitwise_or.at(bits, own, np.uint64(1) << (slot & np.uint64(63)))
                yield pd.DataFrame({"at": at.astype(np.int64), "bits": bits.view(np.int64)})

    rows = automata.select("automaton").mapInPandas(slots, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (PAIR_BITS - 6), np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def candidates(automata: DataFrame, ranges: int) -> DataFrame:
    """lang, phrase, size, a, cuts (k, side, part, range): phrases of two and three words, with the parts of every cut."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                a = CountAutomaton.from_bytes(r.automaton)
                keys, counts = a.paths()
                long = parts(keys)[1] > 0
                if not long.any():
                    continue
                keys, counts = keys[long], counts[long]
                hashes, w = hashed(a.words), parts(keys)
                text = np.array(["", *(x.decode("utf-8", "replace") for x in a.words)], object)
                part = lambda x, y: {"part": np.where(y > 0, text[x] + np.where(y > 0, " ", "") + text[y], text[x]), "range": ranges_of(hashes, coded(x, y), ranges)}
                none = np.zeros_like(w[0])
                sides = {"l1": part(w[0], none), "r1": part(w[1], w[2]), "l2": part(w[0], w[1]), "r2": part(w[2], none)}
                yield pd.DataFrame({"lang": r.lang, "phrase": sides["l1"]["part"] + " " + sides["r1"]["part"], "size": np.where(w[2] > 0, 3, 2), "a": counts, **{f"{s}_{f}": v for s, x in sides.items() for f, v in x.items()}})

    sides = ("l1", "r1", "l2", "r2")
    found = automata.select("lang", "automaton").mapInPandas(released(read), "lang string, phrase string, size int, a bigint, " + ", ".join(f"{s}_part string, {s}_range int" for s in sides))
    cut = lambda s: F.struct(F.lit(int(s[1])).alias("k"), F.lit(s[0]).alias("side"), F.col(f"{s}_part").alias("part"), F.col(f"{s}_range").alias("range"))
    return found.select("lang", "phrase", "size", "a", F.slice(F.array(*map(cut, sides)), F.lit(1), 2 * (F.col("size") - 1)).alias("cuts"))


def part_counts(automata: DataFrame, wanted: DataFrame) -> DataFrame:
    """lang, part, f for the distinct (lang, range, part) in `wanted`: acceptor of the parts composed with the automata of their range."""

    def compose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"lang": np.empty(0, object), "part": np.empty(0, object), "f": np.empty(0, np.int64)})
        if not len(left) or not len(right):
            return none
        number = _Ids()
        words = [p.encode().partition(b" ")[::2] for p in right["part"]]
        first, second = ([number[w] + 1 if w else 0 for w in side] for side in zip(*words))
        keys = np.unique(coded(first, second))
        acceptor = from_ngrams(number.new, keys, np.ones(len(keys), np.int64))
        found, counts = summed(*map(np.concatenate, zip(*(acceptor.compose(CountAutomaton.from_bytes(data)) for data in left["automaton"]))))
        if not len(found):
            return none
        word = ["", *(w.decode() for w in acceptor.words)]
        w1, w2, _ = parts(found)
        text = [f"{word[x]} {word[y]}" if y else word[x] for x, y in zip(w1.tolist(), w2.tolist())]
        return pd.DataFrame({"lang": right["lang"].iloc[0], "part": text, "f": counts})

    return automata.select("lang", "range", "automaton").groupBy("lang", "range").cogroup(wanted.groupBy("lang", "range")).applyInPandas(compose, "lang string, part string, f bigint")


def _key(lang: str, part: str) -> Column:
    return F.concat(F.col(part), F.lit("\t"), F.col(lang))  # parts hold no tab


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first phrases of each language by how much more often their words stand together than apart.

    Texts have A-Z lower-cased and are cut at ``. , ; : ! ?`` and line breaks into pieces, pieces at spaces and tabs into words. Phrases
    of two or three words that occur at least ``least`` times are candidates; ``a`` counts a phrase, ``l`` and ``r`` the parts of its
    lowest-scoring cut (ties to the first), ``n`` the words of the language; the score is floor(1000000 * a * a / (l * r)), exact.
    A phrase inside a longer candidate with half of its count or more is dropped. Of each language the first ``top`` by score, a and
    phrase (UTF-8 order) come back: lang, rank, phrase, a, l, r, n, score.

    A null language counts as ``und``, an empty one is a language of its own; null and empty texts have no words. Very long texts are
    worked through in parts that share their border words. Repeated rows count each. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    automata = materialize(united(materialize(shard_automata(docs, ranges, text_col, lang_col)), least))
    longer = united(materialize(shard_automata(docs, ranges, text_col, lang_col, pair_bitmap(automata))), least)
    found = materialize(candidates(automata, ranges).unionByName(candidates(longer, ranges)))
    cut = found.select("lang", "phrase", F.explode("cuts").alias("c")).select("lang", "phrase", "c.*")
    asked = cut.groupBy("lang", "range", "part").agg(F.count("*").alias("_n"))
    answers = part_counts(automata, asked.drop("_n")).join(asked.select("lang", "part", "_n"), ["lang", "part"]).select(_key("lang", "part").alias("key"), "f", "_n")
    known = lookup(cut.withColumn("key", _key("lang", "part")), materialize(answers), "key", "_n")
    sides = {f"{side}{k}": F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in (1, 2) for side in "lr"}
    counted = found.select("lang", "phrase", "size", "a").join(known.groupBy("lang", "phrase").agg(*sides.values()), ["lang", "phrase"])
    for k in (1, 2):
        counted = counted.withColumn(f"s{k}", F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0)))"))
    second = F.col("s2") < F.col("s1")  # null for two words
    scored = counted.select(
        "lang", "phrase", "size", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least("s1", "s2").cast("long").alias("score"),
    )
    inner = F.explode(F.array(F.regexp_extract("phrase", r"^([^ ]+ [^ ]+) [^ ]+$", 1), F.regexp_extract("phrase", r"^[^ ]+ ([^ ]+ [^ ]+)$", 1)))
    outer = found.filter("size = 3").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(outer, ["lang", "phrase"], "left").filter("size = 3 OR _longer IS NULL OR 100 * _longer < 50 * a").drop("_longer", "size")
    totals = automata.groupBy("lang").agg(F.sum("n").alias("n"))
    # rank within slices of the score, so that no language is ordered in one task
    placed = materialize(kept.withColumn("_slice", F.floor(F.log2(F.col("score") + 1) * 32)))
    slices = placed.groupBy("lang", "_slice").agg(F.count("*").alias("_n"))
    above = Window.partitionBy("lang").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("lang", "_slice", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above")).filter(F.col("_above") < top)
    w = Window.partitionBy("lang", "_slice").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = placed.join(slices, ["lang", "_slice"]).withColumn("rank", F.col("_above") + F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 10, top: int = 2000) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest([array_to_string(ws[i:i + m - 1], ' ') FOR i IN range(1, len(ws) - m + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= {least}),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * k.a * k.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k.k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT s.lang, row_number() OVER v AS rank, s.phrase, s.a, s.l, s.r, CAST(n.n AS BIGINT) AS n, CAST(s.score AS BIGINT) AS score
FROM s JOIN n USING (lang) LEFT JOIN o ON o.lang = s.lang AND o.phrase = s.phrase AND s.m = 2 WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a
WINDOW v AS (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) QUALIFY row_number() OVER v <= {top}"""

"""Near-duplicates by b-bit MinHash: banded candidates, packed low bits for an estimate, and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import WordTable, fnv, in_slots, lookup, mix, released, ship, slot_of, text_slices, with_exact_ids
from shotloom.operators.staging import materialize

#: Hash functions, rows of a band, and bits kept of each minimum. At similarity 0.8, (1 - 0.8 ** 4) ** 32 = 5e-8 of the links share no band.
HASHES, ROWS, BITS = 128, 4, 2
BANDS = HASHES // ROWS
#: Standard deviations below the limit at which an estimate still leads to confirmation.
MARGIN = 5.0
#: Buckets up to this size are compared as pairs of rows, larger ones in blocks of about BLOCK_SHINGLES.
SMALL, BLOCK_SHINGLES = 16, 1_000_000
#: Texts per slice; the number of a text in its slice takes the top bits of a sort key.
SLICE_TEXTS = 4000
_TEXT_BITS = np.uint64(52)

_RNG = np.random.default_rng(20_240_501)
_MUL = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) << 1) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_LOW = 0x5555555555555555


class Shingler:
    """Distinct shingles of whole texts as 52-bit hashes; A-Z are lower-cased, words are parted by ASCII white space."""

    def __init__(self, words: int):
        self.words = words
        self.table = WordTable(lambda new: (fnv(new),))

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All sets in a row, each sorted, and the size of each. Texts with fewer words have their whole sequence as one shingle."""
        numbers, counts = self.table.number([t.lower() for t in texts])
        size = np.where(counts == 0, 0, np.maximum(1, counts - self.words + 1))
        if not len(numbers):
            return np.empty(0, np.uint64), size
        hashed = self.table.rows[0][numbers]
        own = np.repeat(np.arange(len(texts)), size)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        at = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + first[own]
        left = np.minimum(self.words, counts[own])
        out = mix(left.astype(np.uint64) + np.uint64(0x51ED))
        for j in range(self.words):
            word = hashed[np.minimum(at + j, len(hashed) - 1)]
            out = np.where(left > j, mix(out * np.uint64(0x9E3779B97F4A7C15) + word), out)
        key = np.sort((own.astype(np.uint64) << _TEXT_BITS) | (out >> np.uint64(12)))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        return key & np.uint64((1 << 52) - 1), np.bincount((key >> _TEXT_BITS).astype(np.int64), minlength=len(texts))


def _signatures(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per non-empty set: identity (two longs), band hashes, and the packed low bits of the minima."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    low = (sets ^ (sets >> np.uint64(20))).astype(np.uint32)
    mins = np.stack([np.minimum.reduceat(low * a + b, starts) for a, b in zip(_MUL, _ADD)], 1)
    same = np.column_stack([np.add.reduceat(mix(sets), starts), np.bitwise_xor.reduceat(mix(sets + np.uint64(99)), starts)])
    bands = np.zeros((len(starts), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + mins[:, r::ROWS])
    per = 64 // BITS
    bits = (mins & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(starts), -1, per)
    packed = (bits << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)
    return same.view(np.int64), bands.view(np.int64), packed.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per input row: _id, n, same (identity of the set), bands, packed; the arrays are empty for empty sets."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in batches:
            for lo, hi, texts in text_slices(b["_text"], rows=SLICE_TEXTS):
                sets, sizes = shingler.sets(texts)
                empty = [np.empty(0, np.int64)] * (hi - lo)
                out = pd.DataFrame({"_id": b["_id"].iloc[lo:hi].to_numpy(), "n": sizes.astype(np.int64), "same": empty, "bands": empty, "packed": empty})
                out["_id"] = out["_id"].astype(b["_id"].dtype)
                full = np.flatnonzero(sizes > 0)
                if len(full):
                    for name, rows in zip(("same", "bands", "packed"), _signatures(sets, sizes)):
                        column = list(empty)
                        for i, row in zip(full, rows):
                            column[i] = row
                        out[name] = column
                yield out

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return with_exact_ids(rows, run, "n bigint, same array<bigint>, bands array<bigint>, packed array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Full shingle sets of the documents in `ids` (column _id). A bounded slot filter narrows the scan before texts are shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    slots = materialize(ids.select(slot_of("_id").alias("slot")).distinct())
    some = in_slots(rows, slots, slot_of("_id")).join(ids, "_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for b in batches:
            for lo, hi, texts in text_slices(b["_text"], rows=SLICE_TEXTS):
                sets, sizes = shingler.sets(texts)
                yield pd.DataFrame({"_id": b["_id"].iloc[lo:hi].to_numpy(), "shingles": np.split(sets.view(np.int64), np.cumsum(sizes)[:-1])})

    return some.mapInPandas(released(run), f"_id {kind}, shingles array<bigint>")


def most_mismatches(limit: float) -> int:
    """Mismatching positions up to which the collision-corrected estimate does not rule out `limit`."""
    chance = 0.5 ** BITS
    match = chance + (1 - chance) * limit
    return int(HASHES * (1 - match) + MARGIN * np.sqrt(HASHES * match * (1 - match)))


def _mismatches(a: str, b: str) -> Column:
    """Positions whose kept bits differ, by bit counts over the packed longs."""
    total = F.lit(0)
    for k in range(HASHES * BITS // 64):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW)))
    return total


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the estimate and then the limit on full sets."""
    side = lambda df, k, value: df.select(F.col("_id").alias(k), F.col(value).alias(f"{value}_{k}"))
    likely = pairs.join(side(reps, "a", "packed"), "a").join(side(reps, "b", "packed"), "b").filter(_mismatches("packed_a", "packed_b") <= most_mismatches(percent / 100)).select("a", "b")
    full = materialize(likely).join(side(sets, "a", "shingles"), "a").join(side(sets, "b", "shingles"), "b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return full.filter(both * 100 >= (F.size("shingles_a") + F.size("shingles_b") - both) * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of each linked id: _id, comp.

    Alternates linking larger neighbours, then smaller ones, to a vertex's least neighbour, until nothing changes. Every
    round is written; no vertex has its links gathered.
    """
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = both.filter("v < u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        near = both.join(least, "u")  # Spark splits a vertex with very many links here, since nothing above needs it whole
        if large:
            out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return materialize(out.filter("u != v").distinct())

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None
    while (now := mark(edges)) != before:
        before, edges = now, star(star(edges, True), False)
    # every vertex now has one link, to the least id of its component
    return edges.select(F.col("u").alias("_id"), F.col("v").alias("comp"))


def _finish(members: DataFrame, reps: DataFrame, sets: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket, found without listing the pairs of a bucket.

    Only buckets of three or more that still hold two components matter. In a small one, pairs of different components
    are rows. In a larger one, the members outside its main component are compared with all members, block by block, and
    a task gives back only links that join two components. A pair is confirmed in the first band that it shares.
    """
    of = comps.select(F.col("_id").alias("rep"), "comp")
    some = materialize(members.filter("size > 2").join(of, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
    per = some.groupBy("band", "comp").agg(F.count("*").alias("k"))
    main = per.groupBy("band").agg(F.max(F.struct("k", "comp"))["comp"].alias("main"), F.count("*").alias("_comps"), F.sum("k").alias("_n")).filter("_comps > 1")
    open_ = materialize(lookup(some, materialize(main), "band", "_n"))
    few = open_.filter(F.col("size") <= SMALL)
    right = few.select("band", F.col("rep").alias("b"), F.col("comp").alias("comp_b"))
    pairs = few.select("band", F.col("rep").alias("a"), "comp").join(right, "band").filter("a < b AND comp != comp_b").select("a", "b").distinct()
    links = _confirmed(materialize(pairs), reps, sets, percent)

    many = materialize(open_.filter(F.col("size") > SMALL).select("band", "pos", F.col("rep").alias("_id"), "n", "comp", (F.col("comp") != F.col("main")).alias("active")))
    total = materialize(many.groupBy("band").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.count("*").alias("_n")))
    # a document's places, at most one for each band, meet its set once and part again after that
    places = lookup(many, total, "band", "_n").groupBy("_id").agg(F.collect_list(F.struct("band", "pos", "comp", "active", "blocks")).alias("places"))
    own = F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int")
    rows = places.join(reps.select("_id", "n", "bands", "packed").join(sets, "_id"), "_id").select("_id", "n", "bands", "packed", "shingles", F.explode("places").alias("p")).select("_id", "n", "bands", "packed", "shingles", "p.*").withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_member = F.transform(every, lambda k: F.struct(k.alias("ob"), F.col("own").alias("ab"), F.lit(False).alias("asks")))
    as_asker = F.transform(every, lambda k: F.struct(F.col("own").alias("ob"), k.alias("ab"), F.lit(True).alias("asks")))
    parts = rows.withColumn("part", F.explode(F.concat(as_member, F.when(F.col("active"), as_asker).otherwise(F.slice(as_asker, 1, 0))))).select("*", "part.*").drop("part", "own", "blocks")
    most = most_mismatches(percent / 100)

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        ask, all_ = g[g["asks"]], g[~g["asks"]]
        out = []
        if len(ask) and len(all_):
            parent: dict = {}

            def find(x):
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            pos = int(g["pos"].iloc[0])
            ids, comp = all_["_id"].to_numpy(), all_["comp"].to_numpy()
            packed, bands = (np.stack(all_[c].to_numpy()).view(np.uint64) for c in ("packed", "bands"))
            n, flat = all_["n"].to_numpy(), np.concatenate(all_["shingles"].to_numpy())
            starts = np.cumsum(n) - n
            words = np.unique(flat)
            flat = np.searchsorted(words, flat)
            hit = np.zeros(len(words) + 1, np.int64)
            asked = ask.rename(columns={"_id": "doc"})
            for r in asked.itertuples(index=False):
                x = packed ^ np.asarray(r.packed).view(np.uint64)
                off = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(_LOW)).sum(1)
                likely = (off <= most) & (np.minimum(n, r.n) * 100 >= np.maximum(n, r.n) * percent) & (comp != r.comp)
                at = np.flatnonzero(likely)
                if not len(at):
                    continue
                first = (bands[at] == np.asarray(r.bands).view(np.uint64)).argmax(1)
                at = at[first == pos]
                if not len(at):
                    continue
                own = np.searchsorted(words, r.shingles)
                own = np.where(np.take(words, np.minimum(own, len(words) - 1)) == r.shingles, own, len(words))
                hit[own] = 1
                hit[-1] = 0
                both = np.add.reduceat(hit[flat], starts)[at]
                hit[own] = 0
                for k in at[both * 100 >= (n[at] + r.n - both) * percent]:
                    p, q = find(r.comp), find(comp[k])
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        out.append((r.doc, ids[k]))
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": g["_id"].dtype, "b": g["_id"].dtype})

    kind = reps.schema["_id"].dataType.simpleString()
    blocks = parts.groupBy("band", "ob", "ab").applyInPandas(compare, f"a {kind}, b {kind}")
    return materialize(links.unionByName(blocks))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: `id_col`, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles. Documents
    with equal sets are one class first. Classes that share a band are candidates: each is compared with one member of
    its bucket, drawn by hash, and where a bucket then still holds two components, the rest of it is compared too, so no
    candidate pair is left out. Candidates pass the estimate from the packed bits, then the full sets are compared.

    component_id is the smallest id reachable by links; `kept` marks it. Null or empty text, and text without words, has
    the empty set and is linked with nothing. A null id takes no part: its component is null and it is kept. Rows that
    share an id are one document with all their sets. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    signed = materialize(signatures(docs, id_col, text_col, words))
    named = signed.filter("n > 0 AND _id IS NOT NULL")
    classes = named.groupBy("same", "n").agg(F.min("_id").alias("rep"), F.first("bands").alias("bands"), F.first("packed").alias("packed"), F.count("*").alias("_n"))
    classes = materialize(classes)
    reps = classes.select(F.col("rep").alias("_id"), "n", "bands", "packed")
    entries = reps.select(F.col("_id").alias("rep"), "n", F.posexplode("bands").alias("pos", "band"))
    center = F.min(F.struct(F.xxhash64("rep", "band").alias("h"), F.col("rep").alias("rep")))["rep"].alias("center")
    buckets = materialize(entries.groupBy("band").agg(F.count("*").alias("size"), center).filter("size > 1"))
    members = materialize(lookup(entries, buckets, "band", "size"))
    sets = materialize(_sets(docs, members.select(F.col("rep").alias("_id")).distinct(), id_col, text_col, words))
    stars = members.filter("rep != center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()
    links = materialize(_confirmed(materialize(stars), reps, sets, percent))
    comps = materialize(components(links))
    comps = materialize(components(comps.select(F.col("_id").alias("a"), F.col("comp").alias("b")).unionByName(_finish(members, reps, sets, comps, percent))))
    # back to the rows: equal sets, then linked classes
    by_class = classes.select("same", "n", "rep", "_n").join(comps, F.col("rep") == F.col("_id"), "left").select(
        F.concat_ws(":", F.col("same").cast("array<string>"), F.col("n").cast("string")).alias("key"), F.coalesce("comp", "rep").alias("component_id"), "_n",
    )
    rows = signed.select("_id", "n", F.when((F.col("n") > 0) & F.col("_id").isNotNull(), F.concat_ws(":", F.col("same").cast("array<string>"), F.col("n").cast("string"))).alias("key"))
    found = lookup(rows.filter("key IS NOT NULL"), materialize(by_class), "key", "_n").select("_id", "n", "component_id")
    alone = rows.filter("key IS NULL").select("_id", "n", F.col("_id").alias("component_id"))
    return found.unionByName(alone).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("_id").isNull() | (F.col("_id") == F.col("component_id"))).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near-copies, with all their columns; of each component the smallest id stays.

    Only the ids that go are looked up, so that the texts are shuffled at most once.
    """
    gone = materialize(near_duplicates(docs, id_col, text_col, words, percent).filter(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct())
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_gone"), "left_anti")

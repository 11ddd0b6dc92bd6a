"""Exact deduplication, token counts and packing against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shotloom.llm import exact_dedup, packing, token_counts
from shotloom.llm.queries import PIECE_MODEL, WORD_MODEL

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "a"), (None, "a"), (None, None), (5, "x" * 70 + "1"), (6, "x" * 70 + "2"), (7, "x" * 70 + "2"), (8, "ab " * 40_000), (9, "é日本 语")]


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((v for v in ids if v is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup_odd_rows(docs_of, extra):
    got = exact_dedup.exact_dedup(docs_of(ODD, extra), digest_all=True).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected_groups(ODD)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in ODD}) and all(r.doc_id == r.keep_id for r in kept)


def test_digest_is_read_for_surviving_groups_only(docs_of):
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_dedup(docs_of([(1, "alone here"), (2, "copy"), (3, "copy")])).collect()}
    assert got[1] is None and got[2] == got[3] == hashlib.sha256(b"copy").hexdigest()


def test_drop_copies_keeps_one_row_per_text(docs_of):
    docs = docs_of(ODD, True)
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, ""), (4, "a"), (5, ODD[7][1]), (7, ODD[9][1]), (8, ODD[10][1]), (9, ODD[11][1])], key=str)


def test_empty_tables(docs_of, spark):
    none = docs_of([])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert token_counts.count_tokens(none, PIECE_MODEL, token_counts.new_cache_path(spark)).count() == 0
    assert packing.pack(none, WORD_MODEL).count() == 0


def test_token_counts_and_cache(docs_of, spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    path = token_counts.new_cache_path(spark)
    first, more = ODD[:6], [*ODD, (20, "new text <s> </s> <unk>")]
    token_counts.count_tokens(docs_of(first), PIECE_MODEL, path).collect()
    assert token_counts.read_cache(spark, path).count() == 2  # "" and "a"
    got = token_counts.count_tokens(docs_of(more, True), PIECE_MODEL, path).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in more]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    cache = token_counts.read_cache(spark, path)
    assert cache.count() == cache.select("content").distinct().count() == len({t or "" for _, t in more})


def test_a_count_in_the_cache_is_used(docs_of, spark):
    path = token_counts.new_cache_path(spark)
    row = (hashlib.sha256(b"known").hexdigest(), token_counts.tokenizer_digest(PIECE_MODEL), 77)
    other = (hashlib.sha256(b"fresh").hexdigest(), "another tokenizer", 88)
    spark.createDataFrame([row, row, other], token_counts.CACHE_SCHEMA).write.parquet(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of([(1, "known"), (2, "fresh")]), PIECE_MODEL, path).collect()}
    assert got[1] == 77 and got[2] != 88


def check_packing(rows, got):
    model = Tokenizer.from_file(WORD_MODEL)
    want = []
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s:s + 2048], "<u4")
            want.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(filled), -(-sum(w[3] for w in want) // 2048)


def test_packing_round_trip(docs_of, texts):
    rows = [*ODD, *[(i + 100, t) for i, t, _, _ in texts], (10, "it's <|endoftext|> 3rd ΑΣ ÉA! a_b-c' \x1cq\x0bz"), (11, "naïve!!! Ǆ ½")]
    made, least = check_packing(rows, packing.pack(docs_of(rows, True), WORD_MODEL).collect())
    assert made <= least + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=30))
def test_plan_places_every_piece_once(counts):
    plan, made = packing.plan_slots(counts, 50)
    used = defaultdict(list)
    for length, many in counts.items():
        own = plan[plan[:, 0] == length]
        own = own[np.argsort(own[:, 1])]
        for rank in range(many):
            _, lo, base, each, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            used[int(base + (rank - lo) // each)].append((int(offset + (rank - lo) % each * length), length))
    assert set(used) == set(range(made))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 50


def test_plan_size_does_not_follow_the_counts():
    small, _ = packing.plan_slots({n: 3 for n in range(1, 2049)})
    large, _ = packing.plan_slots({n: 3_000_000_000 for n in range(1, 2049)})
    assert len(large) <= 4 * len(small)


def test_every_letter_before_marks_is_encoded_as_by_the_library():
    """Also the letters that the tokenizer's normalizer turns into a letter and a mark of its own."""
    words = [chr(c) + marks for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() for marks in ("!", "a.")]
    assert {"İ!", "क़!", "ড়!", "ਲ਼a."} <= set(words)
    encoder = packing.WordEncoder(WORD_MODEL)
    ids, lens = encoder.encode([w.encode() for w in words])
    want = [x.ids for x in encoder.model.encode_batch_fast(words, add_special_tokens=False)]
    assert [len(x) for x in want] == lens.tolist() and [i for x in want for i in x] == ids.tolist()

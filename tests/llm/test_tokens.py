from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqforge.llm import packing, tokenfile
from seqforge.llm.common import shared_folder, tokenizer_path
from seqforge.llm.tokenizing import BatchTokenizer

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
made = {f: BatchTokenizer(tokenizer_path(f), remember=500) for f in FILES}


def library(f, texts):
    return made[f]._library_ids(texts)


@pytest.mark.parametrize("f", FILES)
def test_ids_are_the_librarys_on_random_texts(f):
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "S", " ", "  ", "\n", "\t", "é", "É", "ß", "1", "²", "½", "!", "\xa0", "\x85", "\x1c", "º", "Ÿ", "ŉ", "ƀ", "Ω", "İ", "漢", "́", "’", "<|endoftext|>", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", "x" * 5000]
    ids, at = made[f].ids(pa.array(texts))
    for i, want in enumerate(library(f, texts)):
        assert ids[at[i] : at[i + 1]].tolist() == want


@pytest.mark.parametrize("f", FILES)
def test_added_tokens_are_those_of_the_untouched_file(f):
    plain = Tokenizer.from_file(tokenizer_path(f))
    tokens = [x.content for x in plain.get_added_tokens_decoder().values()]
    texts = ["end <|endoftext|> next", "END <|EndOfText|>", "<|endoftext|", "|>", "<|endoftext|><|startoftext|>é", "", "plain", *tokens, *(f"a {x}b" for x in tokens), "漢 <|endoftext|>", "last"]
    ids, at = made[f].ids(pa.array(texts))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    assert any(plain.token_to_id("<|endoftext|>") in x for x in want)


@pytest.mark.parametrize("f", FILES)
def test_runs_of_more_than_a_million_ids(f):
    run = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=2_600_000))
    texts = ["before it", run + " and after", "after it"]
    ids, at = made[f].ids(pa.array(texts))
    plain = Tokenizer.from_file(tokenizer_path(f))
    assert at[2] - at[1] > 1 << 20
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), max_size=20), min_size=1, max_size=5))
def test_ids_are_the_librarys(texts):
    for f in FILES:
        ids, at = made[f].ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(f, texts)


def check_plan(counts, capacity):
    entries, n = packing.plan(dict(counts), capacity)
    bins = {}
    placed = Counter()
    for length, rank, number, first, each, offset in entries:
        assert placed[length] == rank
        placed[length] += number
        for k in range(number):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert placed == Counter(counts) and set(bins) == set(range(n))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * length > capacity for _, length in own) <= 2
    return n


def test_plans_are_whole_and_tight():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 80)))
        n = check_plan(counts, capacity)
        total = sum(k * v for k, v in counts.items())
        large = sum(v for k, v in counts.items() if 2 * k > capacity)
        assert n <= max(large, -(-total * 4 // (3 * capacity)) + 1)
    assert packing.plan({}, 8) == ([], 0) and packing.plan({8: 3}, 8)[1] == 3


def test_pairs_of_large_pieces_are_as_many_as_can_be():
    counts = {60: 5, 50: 7, 45: 4, 40: 9}
    sizes = sorted((k for k, v in counts.items() for _ in range(v)), reverse=True)
    lo, hi, best = 0, len(sizes) - 1, 0
    while lo <= hi:  # two pointers: the largest with the smallest
        if lo < hi and sizes[lo] + sizes[hi] <= 100:
            hi -= 1
        lo += 1
        best += 1
    assert check_plan(counts, 100) <= best


def test_packing(spark, odd, odd_texts, none):
    path = tokenizer_path(FILES[0])
    rows = packing.pack(odd, path, capacity=64).collect()
    want = []
    for (doc, _), ids in zip(odd_texts, library(FILES[0], [t or "" for _, t in odd_texts])):
        own = np.array([*ids, 1], "<u4")
        want += [(doc, k, at, len(own[at : at + 64]), zlib.crc32(own[at : at + 64].tobytes())) for k, at in enumerate(range(0, len(own), 64))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(none, path).count() == 0


def test_files_round_trip(spark, odd, odd_texts, none):
    path = tokenizer_path(FILES[1])
    folder = f"{shared_folder(spark)}/test-files"
    dictionary = tokenfile.train(odd, path)
    files = tokenfile.write(odd, path, folder, dictionary)
    rows = tokenfile.read(spark, files, dictionary).orderBy("start").collect()
    ids = library(FILES[1], [t or "" for _, t in odd_texts])
    want = sorted((d is not None, d or 0, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for (d, _), x in zip(odd_texts, ids))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [x[:2] for x in want]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    for f in files:
        reader = tokenfile.Reader(f["url"], dictionary)
        with pytest.raises(ValueError, match="another dictionary"):
            tokenfile.Reader(f["url"], b"other")
        if (found := reader.find(13)) is not None:
            assert found.tolist() == [*ids[16], 2]
    assert tokenfile.read(spark, tokenfile.write(none, path, folder, b""), b"").count() == 0


def test_a_trained_dictionary_is_used(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 9)) for _ in range(60))) for i in range(400)]
    docs, path = spark.createDataFrame(texts, "doc_id long, text string"), tokenizer_path(FILES[1])
    dictionary = tokenfile.train(docs, path)
    assert dictionary
    files = tokenfile.write(docs, path, f"{shared_folder(spark)}/test-dict", dictionary)
    assert tokenfile.read(spark, files, dictionary).count() == 400


def test_ids_are_as_wide_as_the_tokenizer_needs(spark, monkeypatch):
    path = tokenizer_path(FILES[1])
    assert tokenfile.id_width(path) == 2 and tokenfile.id_width(path, end_id=1 << 16) == 4
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    files = tokenfile.write(docs, path, f"{shared_folder(spark)}/test-wide", b"", end_id=70_000)
    rows = tokenfile.read(spark, files, b"").orderBy("doc_id").collect()
    assert rows[1].ids_crc32 == zlib.crc32(np.array([70_000], "<u4").tobytes()) and rows[0].n_tokens == 3

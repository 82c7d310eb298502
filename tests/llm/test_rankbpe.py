from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from seqforge.llm import rankbpe
from seqforge.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
coder = rankbpe.RankEncoder(PATH, remember=2000)
library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def rescanned(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain way: look at all neighbours, join the leftmost of the least rank, look again."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[x] for x in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def same(texts):
    ids, at = coder.ids(pa.array(texts))
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == library.encode_ordinary(t)
        assert rankbpe.spelled(own, coder.bytes) == t.encode()


def test_the_queue_gives_ranks_in_order_and_positions_from_the_left():
    rng = random.Random(3)
    for size in (1, 64, 65, 5000, 300_000):
        queue, held = rankbpe.RankQueue(size), []
        for _ in range(400):
            if held and rng.random() < 0.4:
                held.sort()
                assert queue.pop() == held.pop(0)
            else:
                held.append((rng.randrange(size), rng.randrange(50)))
                queue.push(*held[-1])
        assert [queue.pop() for _ in held] == sorted(held)
        assert queue.pop() is None and not any(map(any, queue.levels)) and not queue.buckets


def test_random_ranks_against_rescanning():
    rng = random.Random(5)
    for _ in range(300):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        words = sorted({bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(40)}, key=lambda _: rng.random())
        ranks |= {w: 3 + i for i, w in enumerate(words)}
        queue = rankbpe.RankQueue(len(ranks))
        for _ in range(10):
            piece = bytes(rng.choices(b"abc", weights=(5, 2, 1), k=rng.randint(1, 60)))
            assert rankbpe.merged(piece, ranks, queue) == rescanned(piece, ranks)


def test_random_texts_against_the_library():
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "S", " ", "  ", "\n", "\t", "é", "É", "ß", "1", "²", "½", "!", "\xa0", "\x85", "\x1c", "\x1f", "º", "Ω", "İ", "漢字", "́", "’", " ", "　", "​", "٣", "Ⅷ", "😀", "한국", "<|endoftext|>", "word"]
    same(["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs", "Cn"]), max_size=20), min_size=1, max_size=5))
def test_any_texts_against_the_library(texts):
    same(texts)


def test_very_long_pieces():
    rng = random.Random(2)
    same(["a" * 100_000, "".join(rng.choices("abcdefghij", k=200_000)), " " * 50_000 + "x", "漢" * 20_000, "".join(rng.choices("!?#$%", k=50_000))])


def test_rows(spark, odd, odd_texts, none):
    found = rankbpe.digests(odd, PATH).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for doc, text in odd_texts:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert rankbpe.digests(none, PATH).count() == 0
    ids = rankbpe.encoded(odd, PATH)
    back = sorted(((r.doc_id, bytes(r.text)) for r in rankbpe.decoded(ids, PATH).collect()), key=key)
    assert back == sorted(((d, (t or "").encode()) for d, t in odd_texts), key=key)
    assert rankbpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == b""
    assert rankbpe.encoded(none, PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_files(name):
    own = rankbpe.RankEncoder(tokenizer_path(name))
    with open(tokenizer_path(name), "rb") as f:
        assert own.ranks[base64.b64decode(f.readline().split()[0])] == 0
    ids, at = own.ids(pa.array([None, "", "plain words, and more"]))
    assert at.tolist()[:3] == [0, 0, 0] and rankbpe.spelled(ids, own.bytes) == b"plain words, and more"


def test_pieces_encoded_together(monkeypatch):
    """Pieces of up to SHORT bytes do not go through one queue each, and have the ids of merged, whatever the ranks."""
    rng = random.Random(7)
    for _ in range(40):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        words = sorted({bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)}, key=lambda _: rng.random())
        ranks |= {w: 3 + i for i, w in enumerate(words)} | {bytes([c]): 200 + c for c in range(256) if c not in b"abc"}
        top = max(ranks.values()) + 1
        pieces = [p for p in {bytes(rng.choices(b"abcd", weights=(5, 2, 1, 1), k=rng.randint(2, 64))) for _ in range(80)} if p not in ranks]
        end = np.cumsum([len(p) for p in pieces])
        single = np.array([ranks[bytes([b])] for b in range(256)])
        queues = rankbpe.RankQueues(top, len(pieces))
        ids, lengths = rankbpe.merged_each(np.frombuffer(b"".join(pieces), np.uint8), end - [len(p) for p in pieces], end, single, rankbpe.Joins(ranks), queues)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [rescanned(p, ranks) for p in pieces]
        assert not any(words.any() for words in queues.levels)
    own, calls = rankbpe.RankEncoder(PATH), []
    one = rankbpe.merged
    monkeypatch.setattr(rankbpe, "merged", lambda piece, *more: calls.append(piece) or one(piece, *more))
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(3000)) + " " + "xq" * 40
    ids, _ = own.ids(pa.array([text]))
    assert ids.tolist() == library.encode_ordinary(text) and calls == [b" " + b"xq" * 40]

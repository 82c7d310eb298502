from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from seqforge.llm import ranked

ALPHABET = set("0123456789abcdefghijklmnopqrstuvwxyz")


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c in ALPHABET or ord(c) > 127 else " " for c in low).split(" ")


def plain(docs, items, k=10):
    """Every document scored for every item, by the words of the contract."""
    counts = [Counter(t for t in split(text) if t) for _, text in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, size in zip(docs, counts, sizes):
            score = 0
            for t in {t for t in split(text) if t} & c.keys():
                m = 100 - 90 + 90 * size * n // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        out += [(item, r + 1, d if has else None, -s) for r, (s, has, d) in enumerate(sorted(scored)[:k])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Élan", "straße", "漢字", "ABC", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(rng.randrange(500), " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for _ in range(300)]
    docs += [(7, docs[0][1]), (7, docs[0][1]), (None, docs[0][1]), (None, None), (901, ""), (902, " .,; "), (903, "w1 " * 5000), *((1000 + i, "copy of w3 w4") for i in range(40))]
    items = [(str(i), " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)]
    items += [("a", None), ("b", ""), ("c", "nowhere"), ("d", "w3, W4; copy"), ("d", "w3, W4; copy"), (None, "élan Élan STRAßE"), ("e", "w0 " * 50)]
    return docs, items


@pytest.mark.parametrize("shard_bytes,block_bytes", [(1 << 22, 1 << 20), (3000, 1 << 20), (1, 64)])
def test_against_scores_of_all(spark, corpus, shard_bytes, block_bytes):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id int, text string, score string, uid long").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id string, text string, rank int")
    assert rows(ranked.ranked(d, q, shard_bytes=shard_bytes, block_bytes=block_bytes)) == sorted(plain(docs, items), key=repr)


def test_odd_tables(spark, odd, odd_texts, none):
    items = [("1", odd_texts[0][1][:60]), ("2", "one é 漢字 ha")]
    q = spark.createDataFrame(items, "item_id string, text string")
    assert rows(ranked.ranked(odd, q)) == sorted(plain(odd_texts, items), key=repr)
    assert rows(ranked.ranked(none, q)) == [] and rows(ranked.ranked(odd, q.where("false"))) == []
    assert ranked.ranked(none, q).columns == ranked.ranked(odd, q).columns == ["item_id", "rank", "doc_id", "score"]


def test_sql(spark, corpus, tmp_path):
    docs, items = corpus
    docs = [x for x in dict(d for d in docs if d[0] is not None).items()]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("benchmark", q.toPandas())
    assert sorted(con.sql(ranked.OP13_SQL.strip()).fetchall(), key=repr) == rows(ranked.ranked(d, q))


def test_search_expands_few_nodes():
    """Bounds cut the search off: for a rare term, far fewer nodes than documents."""
    rng = np.random.default_rng(1)
    texts = ["common " * int(rng.integers(1, 30)) + ("rare" if i % 400 == 7 else "other") for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    shard = ranked._shard([batch], ranked.SpanHasher(17), 4000, sum(len(t.split()) for t in texts))
    tree = ranked.Tree.of({c: shard[c][0].as_py() if c == "n" else shard[c][0].as_buffer() for c in shard.schema.names})
    keys, _ = ranked.terms(pa.array(["rare common"]), ranked.SpanHasher(17))
    begin, end = tree.lists(keys)
    seen, order = [], tree.order
    tree.order = lambda c: seen.append(c) or order(c)
    found = tree.best(begin, end, np.array([8000, 10]), 10, [])
    assert len(found) == 10 and all(doc % 400 == 7 for _, (_, doc) in found) and len(seen) < 400


def test_large_lengths_do_not_overflow():
    tf, length = np.array([1, 3]), np.array([10**7, 5])
    n, total = 10**11, 10**14
    want = [10**9 * t // (1000 * t + 8 * (10 + 90 * x * n // total)) for t, x in zip(tf.tolist(), length.tolist())]
    assert ranked.impacts(tf, length, n, total).tolist() == want

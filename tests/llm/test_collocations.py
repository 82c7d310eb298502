from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from seqforge.llm import collocations


def plain(docs, least, most=5, top=2000, share=100):
    """Counts all phrases of all pieces, then goes by the words of the contract."""
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = {}
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = lang, w[i : i + m]
                covered[key] = max(covered.get(key, 0), a)
    out = {}
    for (lang, w), a in found.items():
        if 100 * covered.get((lang, w), 0) >= share * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    rows = []
    for lang, own in out.items():
        rows += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])]
    return sorted(rows)


def rows(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [*"abcdefgh", "É", "über", "漢", "\x00", "x-y", "IT", "w\x1fz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    piece = lambda: "".join(x + rng.choice([" ", " ", "\t", "  "]) for x in rng.choices(words, weights, k=rng.randint(0, 12)))
    text = lambda: "".join(piece() + rng.choice([".", ", ", "\n", "?!", "\x0b", " : "]) for _ in range(rng.randint(0, 8)))
    docs = [(rng.choice(["en", "en", "en", "de", None, "und"]), text()) for _ in range(150)]
    docs += [("en", "the same passage of words again and again")] * 30 + [("fr", "ha " * 60), ("fr", "ha Ha. ha"), ("de", None), ("xx", ""), ("xx", ". , "), (None, "one two")]
    return docs


@pytest.mark.parametrize("dealing", [{}, {"block_bytes": 200, "span": 3, "hot": 12}, {"block_bytes": 1, "span": 1 << 16, "hot": 5}], ids=["plain", "spans", "hot"])
@pytest.mark.parametrize("least,most,share", [(8, 5, 100), (3, 3, 60)])
def test_against_counts_of_all(spark, corpus, dealing, least, most, share):
    d = spark.createDataFrame([(k, lang, t, 1, "w") for k, (lang, t) in enumerate(corpus)], "doc_id int, lang string, text string, n int, word string").repartition(3)
    want = plain(corpus, least, most, share=share)
    assert want and rows(collocations.collocations(d, least, most, share=share, **dealing)) == want


def test_top_and_order(spark, corpus):
    d = spark.createDataFrame([(k, *x) for k, x in enumerate(corpus)], "doc_id int, lang string, text string")
    found = rows(collocations.collocations(d, 4, top=3))
    assert found == plain(corpus, 4, top=3) and max(Counter(r[0] for r in found).values()) == 3


def test_odd_tables(spark, odd, odd_texts, none):
    docs = [("en" if i is None or i % 2 else None, t) for i, t in odd_texts]
    assert rows(collocations.collocations(odd, 2)) == plain(docs, 2)
    assert rows(collocations.collocations(none)) == []


def test_words_that_share_a_hash_are_noticed(spark, corpus, monkeypatch):
    """Two words of one 64-bit hash: under such a seed nothing is returned, the next one gives the result."""
    d = spark.createDataFrame([(1, "en", "a b " * 20 + "c d " * 20)], "doc_id int, lang string, text string")
    words = np.zeros(2, collocations._NAMED)
    words["key"], words["n"], words["check"] = 9, (100, 1), (1, 2)
    cells = collocations._table([(0, 0, 1, "en", words.tobytes(), b"")], collocations._SENT)
    assert collocations._settle(100, 10)(cells)["clash"].to_pylist() == [True]
    gathered = collocations._gather(pa.concat_tables([cells, cells]))
    assert collocations._settle(100, 10)(gathered)["clash"].to_pylist() == [True]
    real, seen = collocations._mined, []
    monkeypatch.setattr(collocations, "_mined", lambda docs, seed, *a: seen.append(seed) or (None if seed == 0 else real(docs, seed, *a)))
    assert rows(collocations.collocations(d, 5)) == plain([("en", "a b " * 20 + "c d " * 20)], 5) and seen == [0, 1]
    monkeypatch.setattr(collocations, "_mined", lambda *a: None)
    with pytest.raises(ValueError):
        collocations.collocations(d)


def test_extension_is_depth_first_and_whole():
    rng = random.Random(4)
    seen = Counter(tuple(rng.choices([1, 2, 3], k=2)) + tuple(x if i < 2 else 0 for i, x in enumerate(rng.choices([1, 2], k=3))) for _ in range(400))
    data = np.zeros(len(seen), collocations._followed(5))
    for k, (w, n) in enumerate(sorted(seen.items())):
        data[k] = w, n
    want = Counter()
    for w, n in seen.items():
        for m in range(2, 6):
            if w[m - 1]:
                want[w[:m]] += n
    found = list(collocations.extended(data, 10))
    assert dict(found) == {w: n for w, n in want.items() if n >= 10}
    assert [w for w, _ in found] == sorted(w for w, _ in found)
    parts = Counter()
    for turn in range(3):
        for w, n in collocations.extended(np.array([x for x in data if hash(tuple(x["w"][:4])) % 3 == turn], data.dtype), 10, 4):
            parts[w] += n
    assert {w: n for w, n in parts.items() if n >= 10} == dict(found)


def test_large_products_are_exact(spark, monkeypatch):
    """Counts whose products pass 64 bits."""
    a, n, left, right = 10**10 + 7, 10**13 + 9, 10**10 + 8, 10**10 + 9
    grown = spark.createDataFrame([([1, 2], a, None, None), ([1], None, "en", "x"), ([2], None, "en", "y")], "words array<long>, n long, lang string, word string")
    words = spark.createDataFrame([([1], left), ([2], right)], "words array<long>, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, total long")
    monkeypatch.setattr(collocations, "candidates", lambda *a, **k: (totals, words, grown))
    assert rows(collocations.collocations(None)) == [("en", 1, "x y", a, left, right, n, 1000 * a * n // (left * right))]


def test_sql(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, rng.choice(["en", None]), " ".join(rng.choices(["a", "B", "c,", "É", "d e f"], k=40))) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    assert sorted(con.sql(collocations.OP12_SQL.strip()).fetchall()) == rows(collocations.collocations(d)) != []

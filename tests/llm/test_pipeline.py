from __future__ import annotations

from collections import Counter

import corpus_pipeline


def test_stages_against_plain_versions(spark, odd, odd_texts, none, tmp_path):
    import random

    rng = random.Random(11)
    good = [(100 + i, " ".join("".join(rng.choice("aeioulmn") for _ in range(5)) for _ in range(60))) for i in range(150)]
    bad = [(400 + i, " ".join("".join(rng.choice("AEIOULMN") for _ in range(5)) + "!!" for _ in range(60))) for i in range(150)]
    passage = " ".join(good[3][1].split()[20:34])
    leak = [(700, good[5][1] + " " + passage), (701, "token = hx7Kq92LmPz4 " + good[7][1])]
    secret = " ".join("".join(rng.choice("aeioulmn") for _ in range(5)) for _ in range(60))
    leak.append((702, "password: 'Wq82nfKz71mTc' " + secret))  # like no other document, so that only the secret scan changes it
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [*good, *bad, *leak, good[0]]], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    held = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, d)
        assert held.columns == docs.columns
        held.write.parquet(f"{d}/out/{name}")
        held = spark.read.parquet(f"{d}/out/{name}")
        seen.append(Counter(r.doc_id for r in held.collect()))
    ids = lambda rows: {i for i, _ in rows}
    assert ids(good) | ids(leak) <= set(seen[0]) and len(set(seen[0]) & ids(bad)) < 5 and seen[0][100] == 2
    assert max(seen[1].values()) == 1 and 700 not in seen[1] and ids(good) <= set(seen[1])
    assert set(seen[1]) - set(seen[2]) == {103}
    text = {r.doc_id: (r.text, r.n_chars) for r in held.collect()}
    assert text[702] == ("password: '[REDACTED]' " + secret, len("password: '[REDACTED]' " + secret))
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(seen[3])
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() >= docs.count()

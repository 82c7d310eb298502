from __future__ import annotations

import hashlib
import json
import os
import zipfile

import numpy as np
import pytest

from seqforge.operators import control
from seqforge.sources import files, tables


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_digests_of_files_of_any_size(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    with open(tmp_path / "large", "wb") as f:  # beyond what a row can hold, without its blocks on disk
        f.truncate((2 << 30) + 5)
    want = hashlib.sha256()
    for _ in range(2 << 10):
        want.update(bytes(1 << 20))
    want.update(bytes(5))
    got = {os.path.basename(r.path): (r.sha256, r.length) for r in files.digests(spark, [str(tmp_path / n) for n in ("a", "empty", "large", "absent")]).collect()}
    assert got == {"a": (sha(b"abc"), 3), "empty": (sha(b""), 0), "large": (want.hexdigest(), (2 << 30) + 5), "absent": (None, None)}
    assert files.digests(spark, []).count() == 0
    assert {r.sha256 for r in tables.digests(spark, str(tmp_path / "a")).collect()} == {sha(b"abc")}


def test_sidecars_stand_while_the_file_does(spark, tmp_path):
    (tmp_path / "w").write_bytes(b"one")
    path = str(tmp_path / "w")
    first, again = (files.digests(spark, [path], sidecar=True).first() for _ in range(2))
    assert (first.cached, again.cached) == (False, True) and first.sha256 == again.sha256 == sha(b"one")
    (tmp_path / "w").write_bytes(b"two")
    os.utime(tmp_path / "w", ns=(1, 10**18))
    drifted = files.digests(spark, [path], sidecar=True).first()
    assert (drifted.sha256, drifted.cached) == (sha(b"two"), False)
    (tmp_path / "w.sha256").write_text("{broken")
    assert files.digests(spark, [path], sidecar=True).first().sha256 == sha(b"two")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["w", "w.sha256"] and json.loads((tmp_path / "w.sha256").read_text())["sha256"] == sha(b"two")


def test_checks_against_a_manifest(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    entries = lambda *rows: spark.createDataFrame([(str(tmp_path / n), d) for n, d in rows], "path string, wanted string")
    files.check_files(spark, entries(("a", sha(b"abc"))))
    files.check_files(spark, entries(("a", None)))
    for rows, needed, what in (([("a", sha(b"x"))], False, "has changed"), ([("a", None)], True, "no sha256"), ([("b", None)], False, "is missing")):
        with pytest.raises(files.ContractError, match=what):
            files.check_files(spark, entries(*rows), needed)


def test_digest_of_a_folder_is_that_of_names_and_files(spark, tmp_path):
    (tmp_path / "w" / "in").mkdir(parents=True)
    for name, data in (("b", b"1"), ("in/a", b"2"), ("a.sha256", b"a file of its own")):
        (tmp_path / "w" / name).write_bytes(data)
    plain = control.weights_digest(tmp_path / "w")
    assert plain == control.weights_digest(tmp_path / "w", spark) == control.weights_digest(tmp_path / "w", spark, sidecar=True) == control.weights_digest(tmp_path / "w", spark, sidecar=True)
    assert control.weights_digest(tmp_path / "w" / "b", spark) == sha(b"1")
    (tmp_path / "none").mkdir()
    with pytest.raises(files.ContractError, match="no files"):
        files.tree_digest(spark, str(tmp_path / "none"))
    with pytest.raises(files.ContractError, match="is missing"):
        files.tree_digest(spark, str(tmp_path / "absent"))


def test_members_of_archives_are_read_by_tasks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"Mutant": ["A1C", None], "sequence": ["CC", "GG"], "DMS_score": [0.5, 1.5]}), tmp_path / "t.parquet")
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/x.csv", "﻿mutant,sequence,dms_score,more\nA1C,CC,0.5,z\n\"A1C,T2G\",\"line\nbreak\",,\n")
        z.writestr("in/y.csv", "sequence,mutant,DMS_score\n" + "".join(f"ACGT,A{i + 1}C,{i}\n" for i in range(20_000)))
        z.writestr("notes.txt", "no table")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.write(tmp_path / "t.parquet", "t.parquet")
    paths = [str(tmp_path / n) for n in ("one.zip", "two.zip")]
    assert sorted((os.path.basename(r.archive), r.member) for r in files.members(spark, paths).collect()) == [("one.zip", "in/x.csv"), ("one.zip", "in/y.csv"), ("two.zip", "t.parquet")]
    rows = tables.archived_variants(spark, paths).collect()
    of = lambda name: [(r.row, r.mutant, r.sequence, r.DMS_score) for r in sorted((r for r in rows if r.dms_id == name), key=lambda r: r.row)]
    assert of("x") == [(0, "A1C", "CC", "0.5"), (1, "A1C,T2G", "line\nbreak", None)] and of("t") == [(0, "A1C", "CC", "0.5"), (1, None, "GG", "1.5")]
    assert of("y") == [(i, f"A{i + 1}C", "ACGT", str(i)) for i in range(20_000)]
    assert tables.read_any(spark, paths[1]).columns == ["Mutant", "sequence", "DMS_score"]
    with pytest.raises(tables.ContractError, match="several tables"):
        tables.read_any(spark, paths[0])
    with pytest.raises(Exception, match="no column else"):
        files.archived(spark, paths, ["else"]).collect()
    raw = (tmp_path / "one.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(raw[: len(raw) // 2])
    at = raw.index(b"in/y.csv") + 300
    (tmp_path / "bad.zip").write_bytes(raw[:at] + b"\xff\x00\xff" * 20 + raw[at + 60 :])
    with pytest.raises(Exception, match="is no archive"):
        files.members(spark, [str(tmp_path / "cut.zip")]).collect()
    with pytest.raises(Exception, match="bad.zip, in/y.csv|zlib|invalid"):
        files.archived(spark, [str(tmp_path / "bad.zip")], ["mutant"]).collect()


def test_dense_arrays_by_ranges_of_rows(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(103, 3, 5)).astype(np.float32)
    for name, save in (("stored.npz", np.savez), ("packed.npz", np.savez_compressed)):
        save(tmp_path / name, arrays=x, layer_ids=np.array([0, 4, 9]))
        df = files.read_dense(spark, str(tmp_path / name), rows=10)
        assert df.rdd.getNumPartitions() == 11
        got = {(r.item, r.layer_id): r.vec for r in df.collect()}
        assert len(got) == 309 and all(got[i, k] == x[i, j].astype(float).tolist() for i in range(103) for j, k in enumerate((0, 4, 9)))
    np.savez(tmp_path / "plain.npz", vectors=x[:4])
    assert {r.layer_id for r in files.read_dense(spark, str(tmp_path / "plain.npz")).collect()} == {0, 1, 2}
    np.savez(tmp_path / "none.npz", arrays=x[:0])
    assert files.read_dense(spark, str(tmp_path / "none.npz")).count() == 0
    np.savez(tmp_path / "flat.npz", arrays=x[0])
    np.savez(tmp_path / "other.npz", scores=x)
    for name, what in (("flat.npz", "items x layers x width"), ("other.npz", "no array arrays or vectors"), ("absent.npz", "is missing")):
        with pytest.raises(Exception, match=what):
            files.read_dense(spark, str(tmp_path / name)).collect()


def test_a_partition_reads_its_own_rows_only(tmp_path, monkeypatch):
    x = np.arange(4000 * 2 * 100, dtype=np.float64).reshape(4000, 2, 100)
    np.savez(tmp_path / "x.npz", arrays=x)
    reader = files._ArrayReader({"path": str(tmp_path / "x.npz"), "rows": "100"})
    parts = reader.partitions()
    assert [(p.a, p.b) for p in parts[:2]] == [(0, 100), (100, 200)] and len(parts) == 40
    read = []
    real = zipfile.ZipExtFile.read
    monkeypatch.setattr(zipfile.ZipExtFile, "read", lambda self, n=-1: read.append(len(out := real(self, n))) or out)
    (batch,) = reader.read(parts[37])
    assert batch["item"][0].as_py() == 3700 and batch["vec"][0].as_py() == x[3700, 0].tolist()
    assert sum(read) <= 2 * 100 * 1600 + 4096  # of 6.4 MB


def test_ragged_arrays(spark, tmp_path):
    rng = np.random.default_rng(2)
    own = [rng.normal(size=rng.integers(0, 9)).tolist() for _ in range(57)]
    np.savez(tmp_path / "r.npz", values=np.concatenate(own), offsets=np.cumsum([0, *map(len, own)]))
    np.savez(tmp_path / "l.npz", n=np.int64(57), **{f"arr_{i}": np.array(v) for i, v in enumerate(own)})
    for name, kind in (("r.npz", "ragged"), ("l.npz", "listed")):
        for rows in (0, 10):
            got = {r.item: r["values"] for r in files.read_ragged(spark, str(tmp_path / name), kind, rows).collect()}
            assert [got[i] for i in range(57)] == own
    np.savez(tmp_path / "gap.npz", n=np.int64(2), arr_1=np.zeros(2))
    with pytest.raises(Exception, match="no array arr_0"):
        files.read_ragged(spark, str(tmp_path / "gap.npz"), "listed").collect()
    for bad in ([0, 3, 2, 5], [1, 5], [0, 4], [0, 6]):
        np.savez(tmp_path / "bad.npz", values=np.arange(5.0), offsets=np.array(bad))
        with pytest.raises(Exception, match="offsets do not fit"):
            files.read_ragged(spark, str(tmp_path / "bad.npz")).collect()


def test_sinks_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, k, rng.normal(size=4).tolist()) for i in range(200) for k in (0, 3)]
    df = spark.createDataFrame(rows, "item long, layer_id int, vec array<double>").repartition(5)
    folder = str(tmp_path / "dense")
    for _ in range(2):  # the second write replaces the first
        files.write_dense(df, folder, file_bytes=2000)
        assert "_SUCCESS" in os.listdir(folder) and len(os.listdir(folder)) > 4
        back = files.read_dense(spark, folder)
        assert back.count() == 400 and sorted(tuple(r.vec) for r in back.collect()) == sorted(tuple(v) for *_, v in rows)
    own = [(i, rng.normal(size=i % 4).tolist()) for i in range(90)]
    files.write_ragged(spark.createDataFrame(own, "item long, values array<double>").repartition(3), str(tmp_path / "ragged"))
    assert sorted(tuple(r["values"]) for r in files.read_ragged(spark, str(tmp_path / "ragged")).collect()) == sorted(tuple(v) for _, v in own)
    broken = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [1.0]), (1, 0, [1.0])], "item long, layer_id int, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="all of them"):
        files.write_dense(broken, str(tmp_path / "broken"))
    assert not [n for n in os.listdir(tmp_path / "broken") if n.endswith(".npz") or n == "_SUCCESS"]

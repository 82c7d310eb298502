from __future__ import annotations

import pytest

from seqforge import cli
from seqforge.models import EchoModel, SequenceModel
from seqforge.operators import control


def test_lists(capsys):
    cli.main(["models"])
    cli.main(["tasks"])
    assert "echo" in capsys.readouterr().out


def test_run_and_board(spark, tmp_path, capsys):
    (tmp_path / "m.yaml").write_text("model: kmer\nk: 2\n")
    common = ["--results", str(tmp_path / "r")]
    cli.main(["run", "--model", str(tmp_path / "m.yaml"), "--tasks", "genes,variants", "--tables", "/root/testdata/sf0.001", *common])
    cli.main(["leaderboard", *common, "--output", str(tmp_path / "board")])
    out = capsys.readouterr().out
    assert "variants\tna" in out and "| place |" in out and (tmp_path / "board.csv").exists()
    with pytest.raises(SystemExit):
        cli.main(["query", "nothing", "--tables", "x"])


def test_identity_and_half_built_models():
    class Half(SequenceModel):
        capabilities = frozenset({"embed", "score"})

        def embed(self, seqs, layers="last"):
            return None

    assert control.half_built(Half()) == ["score"] and control.half_built(EchoModel()) == []
    assert len(control.identity_warnings("declared:x", "main")) == 2 and not control.identity_warnings("ab", "0123abc")
    assert control.progress_line(5, 10, 5).endswith("00:00:05 left")

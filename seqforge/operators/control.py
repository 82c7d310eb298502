"""What decides which work is done: capabilities, resume, shared passes, content hashes, records."""

from __future__ import annotations

import hashlib
import json
import os
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reuse import Reuse, pick_layers, plan  # noqa: F401


@dataclass
class TaskResult:
    task: str
    status: str = "ok"  # ok, na or error
    primary_metric: str | None = None
    metrics: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


def choose(required: list[list[str]], declared) -> tuple[list[str] | None, list[list[str]]]:
    """(first alternative whose capabilities are declared, what each alternative lacks)."""
    lacking = [sorted(set(alternative) - set(declared)) for alternative in required]
    return next((alternative for alternative, gap in zip(required, lacking) if not gap), None), lacking


def negotiate(alternatives: DataFrame, declared: DataFrame) -> DataFrame:
    """model, task, chosen (number of the first alternative that is met, null if none), status.

    alternatives: task, alt, required ARRAY; declared: model, capabilities ARRAY."""
    tried = alternatives.crossJoin(F.broadcast(declared)).withColumn("lacks", F.array_except("required", "capabilities"))
    chosen = F.min(F.when(F.size("lacks") == 0, F.col("alt")))
    return tried.groupBy("model", "task").agg(chosen.alias("chosen"), F.when(chosen.isNull(), "na").otherwise("ok").alias("status"), F.min(F.size("lacks")).alias("fewest_lacking"))


def pending(tasks: DataFrame, prior: DataFrame) -> DataFrame:
    """The tasks that have no ok result yet."""
    return tasks.join(prior.where("status = 'ok'").select("model", "task").distinct(), ["model", "task"], "left_anti")


def fusion_plan(tasks: DataFrame) -> DataFrame:
    """For each corpus: how many tasks read it and the widest pass that serves them all.

    tasks: task, corpus, all_layers BOOLEAN, logprob BOOLEAN."""
    return tasks.groupBy("corpus").agg(F.count(F.lit(1)).alias("consumers"), F.max(F.col("all_layers").cast("int")).alias("all_layers"), F.max(F.col("logprob").cast("int")).alias("logprob"), (F.count(F.lit(1)) > 1).alias("shared"))


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def model_hash(weights_digest: str, spec: dict, adapter: str) -> str:
    """The identity of a model: weights, settings and adapter (name@version)."""
    return "run:" + hashlib.sha256("\0".join([weights_digest, canonical(spec), adapter]).encode()).hexdigest()[:24]


def file_digest(path: str | os.PathLike, chunk: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def weights_digest(path: str | os.PathLike, spark=None, sidecar: bool = False) -> str:
    """Of a file its SHA-256; of a folder that of its sorted names and digests. Tasks read the files if there is a
    session, and keep their digests beside them if asked to."""
    if spark is not None:
        from ..sources.files import tree_digest

        return tree_digest(spark, str(path), sidecar)
    path = Path(path)
    if path.is_file():
        return file_digest(path)
    names = sorted(p.relative_to(path).as_posix() for p in path.rglob("*") if p.is_file())
    return hashlib.sha256("".join(f"{n}:{file_digest(path / n)}\n" for n in names).encode()).hexdigest()


def expand_env(value, environ=os.environ):
    """${NAME} and ${NAME:-default} in all strings; every missing name is reported at once."""
    import re

    missing: set[str] = set()

    def one(m):
        found = environ.get(m[1]) or (m[2][2:] if m[2] is not None else None)
        if found is None:
            missing.add(m[1])
        return found or ""

    def walk(x):
        if isinstance(x, str):
            return re.sub(r"\$\{(\w+)(:-[^}]*)?\}", one, x)
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    out = walk(value)
    if missing:
        raise KeyError(f"not set: {', '.join(sorted(missing))}")
    return out


def record_path(folder: str | os.PathLike, record: dict) -> Path:
    """One file for each model hash and benchmark."""
    own = "" if record["benchmark"] == "default" else "-" + record["benchmark"]
    return Path(folder) / f"{record['model_hash'].replace(':', '_')}{own}.json"


def write_record(folder: str | os.PathLike, record: dict) -> Path:
    """The record's file, replaced whole."""
    path = record_path(folder, record)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_text(json.dumps(record, indent=2, sort_keys=True) + "\n")
    part.replace(path)
    return path


def finished(path: Path) -> dict[str, dict]:
    """The ok tasks of a record's file; a broken record counts for nothing."""
    try:
        return {t["task"]: t for t in json.loads(path.read_text())["tasks"] if t["status"] == "ok"}
    except (OSError, ValueError, KeyError, TypeError):
        return {}


def run_tasks(model, tasks: list, spark, folder=None, benchmark: str = "default", spec: dict | None = None, digest: str | None = None, told=None, keep: str | None = None) -> dict:
    """Runs what has no ok result yet and writes the record after each task.

    A task has name, alternatives, prepare(spark) and run(model, chosen, prepared); one with a ``corpus`` is
    given ``reuse`` too, so that tasks that read the same windows share a pass, in the widest form that any
    pending one of the corpus needs (``layers``, ``head``). ``keep`` names a folder in which outputs outlive the
    run. Weights named in the spec are hashed; ``told`` is called with a line after each task."""
    spec = spec or {"name": model.name}
    digest = digest or ("sha256:" + weights_digest(spec["weights"], spark, bool(spec.get("digest_sidecar"))) if spec.get("weights") else "declared")
    record = {"model_hash": model_hash(digest, spec, f"{model.name}@{model.version}"), "model": model.name, "benchmark": benchmark, "spec": spec, "weights_digest": digest}
    record["warnings"] = identity_warnings(digest, spec.get("revision")) + [f"declares {c} without a method" for c in half_built(model)]
    done = finished(record_path(folder, record)) if folder else {}
    pending_tasks = [t for t in tasks if t.name not in done]
    able = {t.name for t in pending_tasks if choose(t.alternatives, model.capabilities)[0] is not None}
    reuse = Reuse(plan([t for t in pending_tasks if t.name in able]), record["model_hash"], keep)
    began = time.time()
    for k, task in enumerate(pending_tasks):
        chosen, lacking = choose(task.alternatives, model.capabilities)
        corpus = getattr(task, "corpus", None)
        if chosen is None:
            result = TaskResult(task.name, "na", metadata={"lacks": lacking})
        else:
            try:
                more = {"reuse": reuse} if corpus is not None else {}
                result = task.run(model, chosen, task.prepare(spark), **more)
                result.metadata["scoring_method"] = "+".join(chosen)
                if getattr(task, "manifest", None):
                    result.metadata["manifest_sha256"] = file_digest(task.manifest)
            except Exception as e:  # a task's failure is its result
                result = TaskResult(task.name, "error", metadata={"error": f"{type(e).__name__}: {e}"[:2000]})
        if corpus is not None and task.name in able:
            reuse.release(corpus)
        done[task.name] = result.__dict__
        record["passes"] = [list(p) for p in reuse.passes]
        record["tasks"] = [done[t.name] for t in tasks if t.name in done]
        if folder:
            write_record(folder, record)
        if told:
            told(f"{task.name}: {result.status}, {progress_line(k + 1, len(pending_tasks), time.time() - began)}")
    return record | {"tasks": [done[t.name] for t in tasks if t.name in done]}


def identity_warnings(digest: str, revision: str | None) -> list[str]:
    """What makes a run's identity weak: weights that are only declared, a revision that can move."""
    out = []
    if digest.startswith("declared"):
        out.append("the weights' digest is declared, not computed")
    if revision is not None and not (len(revision) >= 7 and all(c in "0123456789abcdef" for c in revision)):
        out.append(f"revision {revision!r} can change")
    return out


def half_built(model) -> list[str]:
    """Capabilities that a model declares without its own method."""
    from ..models import SequenceModel

    methods = {"tokenize": "tokenize", "score": "score", "per_token": "per_token", "variant_llr": "site_logits", "embed": "embed"}
    return sorted(c for c in model.capabilities if getattr(type(model), methods[c]) is getattr(SequenceModel, methods[c]))


def progress_line(done: int, total: int, seconds: float) -> str:
    """done/total, rate and time to go."""
    rate = done / seconds if seconds else 0.0
    left = int((total - done) / rate) if rate else 0
    return f"{done}/{total} ({100 * done / max(1, total):.0f}%) {rate:.1f}/s, {left // 3600:02d}:{left // 60 % 60:02d}:{left % 60:02d} left"

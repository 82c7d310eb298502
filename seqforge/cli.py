"""python -m seqforge.cli: models, tasks, run, leaderboard, query."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path


def _models(args) -> None:
    from .models import registry

    print("\n".join(registry.names("model")))


def _tasks(args) -> None:
    print("genes\tembed\ngenes-layer-sweep\tembed\nenzymes\tembed\nenzymes-layer-sweep\tembed\nvariants\tvariant_llr or score")


def _model(spec: dict):
    from .models import registry

    settings = {k: v for k, v in spec.items() if k not in ("model", "adapter_version", "weights", "revision")}
    made = registry.get("model", spec["model"])(**settings)
    wanted = spec.get("adapter_version")
    if wanted is not None and wanted != getattr(made, "version", "1"):
        raise SystemExit(f"the spec is for version {wanted} of {spec['model']}")
    return made


def _run(args) -> None:
    import yaml
    from pyspark.sql import functions as F

    from .operators.control import expand_env, run_tasks
    from .plans import stand_ins
    from .plans.tasks import EnzymeTask, GeneTask, VariantTask
    from .session import session
    from .sources.tables import load_assays, load_enzymes, load_splits

    spec = expand_env(yaml.safe_load(Path(args.model).read_text()))
    spark = session(master=args.master)
    if args.manifest:
        genes = lambda s: load_splits(s, args.manifest).withColumnsRenamed({"id": "doc_id", "sequence": "seq", "genome_name": "genome"})
    else:
        genes = lambda s: stand_ins.labelled(s, args.tables)
    enzymes = (lambda s: load_enzymes(s, args.enzymes).withColumn("row_idx", F.col("id"))) if args.enzymes else (lambda s: stand_ins.enzymes(s, args.tables))
    variants = (lambda s: load_assays(s, args.assays)) if args.assays else (lambda s: stand_ins.numbered_variants(s, args.tables))
    tasks = {"variants": VariantTask("variants", variants, args.assays)}
    for swept in (False, True):
        name = "-layer-sweep" * swept
        tasks["genes" + name] = GeneTask("genes" + name, genes, "genes", swept, manifest=args.manifest)
        tasks["enzymes" + name] = EnzymeTask("enzymes" + name, enzymes, corpus="enzymes", sweep=swept, manifest=args.enzymes)
    began = time.time()
    told = lambda line: print(line, file=sys.stderr)
    record = run_tasks(_model(spec), [tasks[t] for t in args.tasks.split(",")], spark, args.results, args.benchmark, spec, told=told)
    for line in record["warnings"]:
        print(f"warning: {line}", file=sys.stderr)
    for t in record["tasks"]:
        print(f"{t['task']}\t{t['status']}\t{t['metrics'].get(t['primary_metric'] or '', '')}")
    print(f"{time.time() - began:.0f} s", file=sys.stderr)


def _leaderboard(args) -> None:
    from pyspark.sql import functions as F

    from .operators.results import explode_records, overall_board
    from .session import session
    from .sources.tables import read_records, write_board

    spark = session(master=args.master)
    rows = explode_records(read_records(spark, args.results))
    board = overall_board(rows, rows.select("task").distinct()).select("place", "model", F.round("headline", 6).alias("headline"), "n_ok", "n_tasks").orderBy("place")
    write_board(board, args.output)
    print(Path(args.output).with_suffix(".md").read_text())


def _query(args) -> None:
    from .plans import catalogue
    from .session import session

    found = catalogue.queries()
    if args.name not in found:
        raise SystemExit("there are " + " ".join(sorted(found)))
    out = found[args.name](session(master=args.master), args.tables)
    out.write.mode("overwrite").parquet(args.output) if args.output else out.show(args.rows, False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="seqforge")
    p.add_argument("--master")
    sub = p.add_subparsers(required=True)
    for name, f in (("models", _models), ("tasks", _tasks)):
        sub.add_parser(name).set_defaults(f=f)
    run = sub.add_parser("run")
    run.add_argument("--model", required=True, help="a YAML file: model, and its settings")
    run.add_argument("--tasks", default="genes,variants")
    run.add_argument("--manifest", help="of gene splits; else the stand-in tables")
    run.add_argument("--enzymes", help="a manifest of enzyme splits")
    run.add_argument("--assays", help="a manifest of assays")
    run.add_argument("--tables", default="/root/testdata/sf0.01")
    run.add_argument("--benchmark", default="default")
    run.add_argument("--results", default="results")
    run.set_defaults(f=_run)
    board = sub.add_parser("leaderboard")
    board.add_argument("--results", default="results")
    board.add_argument("--output", default="leaderboard")
    board.set_defaults(f=_leaderboard)
    query = sub.add_parser("query")
    query.add_argument("name")
    query.add_argument("--tables", required=True)
    query.add_argument("--output")
    query.add_argument("--rows", type=int, default=20)
    query.set_defaults(f=_query)
    args = p.parse_args(argv)
    args.f(args)


if __name__ == "__main__":
    main()

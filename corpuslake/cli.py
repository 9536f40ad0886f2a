"""Command line: index, query, stats, delete, versions, rollback and eval."""

from __future__ import annotations

import argparse

from corpuslake.engine import Engine
from corpuslake.session import session
from corpuslake.sources import datasets


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuslake")
    p.add_argument("--home", default="corpuslake-data")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("root")
    i.add_argument("--force", action="store_true")
    i.add_argument("--semantic", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("question")
    q.add_argument("--top-k", type=int, default=5)
    q.add_argument("--threshold", type=float)
    q.add_argument("--fusion", choices=["rrf", "linear"], default="rrf")
    sub.add_parser("stats")
    sub.add_parser("delete").add_argument("source")
    sub.add_parser("versions").add_argument("source", nargs="?", help="a path or file name; all files if left out")
    r = sub.add_parser("rollback")
    r.add_argument("source", help="a path or file name")
    r.add_argument("version", type=int)
    kinds = sub.add_parser("eval").add_subparsers(dest="kind", required=True)
    recall = kinds.add_parser("recall")
    recall.add_argument("dataset", nargs="?", help="a JSON file; the built-in questions if left out")
    recall.add_argument("--top-k", type=int, default=5)
    faithful = kinds.add_parser("faithfulness")
    faithful.add_argument("question")
    faithful.add_argument("--top-k", type=int, default=5)
    faithful.add_argument("--threshold", type=float)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    engine = Engine(spark, a.home)
    if a.command == "index":
        engine.index(a.root, a.force, a.semantic).show()
    elif a.command == "query":
        limit = engine.config.similarity_threshold if a.threshold is None else a.threshold
        engine.search([a.question], a.top_k, method=a.fusion, threshold=limit).select("rank", "score", "source", "document").show(truncate=80)
        engine.ask([a.question], a.top_k, a.threshold).select("answer").show(truncate=False)
    elif a.command == "stats":
        engine.stats().show()
    elif a.command == "delete":
        print(engine.delete(a.source))
    elif a.command == "versions":
        (engine.source_versions(a.source) if a.source else engine.versions()).show(truncate=False)
    elif a.command == "rollback":
        return 0 if engine.rollback_source(a.source, a.version) else 1
    elif a.command == "eval" and a.kind == "faithfulness":
        engine.evaluate_faithfulness([a.question], a.top_k, a.threshold).show(truncate=80)
    elif a.command == "eval":
        data = datasets.load_dataset(spark, a.dataset) if a.dataset else datasets.builtin_dataset(spark)
        engine.evaluate_recall(data, a.top_k)[1].show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

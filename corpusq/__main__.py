"""Command line: python -m corpusq CATALOG VERB ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from corpusq.engine import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusq")
    p.add_argument("catalog")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("index")
    v.add_argument("folder")
    v.add_argument("project")
    v = verbs.add_parser("search")
    v.add_argument("query")
    v.add_argument("--keyword")
    v.add_argument("--top-k", type=int)
    v.add_argument("--path", action="append")
    v.add_argument("--profile", default="local", choices=("local", "library", "cloud"))
    v = verbs.add_parser("grep")
    v.add_argument("text")
    v.add_argument("--pattern")
    v = verbs.add_parser("glob")
    v.add_argument("pattern")
    v = verbs.add_parser("read")
    v.add_argument("path")
    v.add_argument("--first", type=int)
    v.add_argument("--last", type=int)
    v = verbs.add_parser("chunk")
    v.add_argument("chunk_id")
    v.add_argument("--around", type=int, default=0)
    v = verbs.add_parser("tree")
    v.add_argument("--depth", type=int, default=2)
    v = verbs.add_parser("purge")
    v.add_argument("paths", nargs="+")
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("corpusq").getOrCreate(), a.catalog)
    run = {
        "index": lambda: engine.index(a.folder, a.project),
        "search": lambda: engine.search(a.query, a.keyword, a.top_k, a.path, a.profile),
        "grep": lambda: engine.grep(a.text, a.pattern, limit=20),
        "glob": lambda: engine.glob(a.pattern),
        "read": lambda: engine.read(a.path, a.first, a.last),
        "chunk": lambda: engine.get_chunk(a.chunk_id, a.around),
        "tree": lambda: engine.tree(a.depth),
        "purge": lambda: engine.purge(a.paths),
    }[a.verb]
    out = run()
    for line in [out] if out is None or isinstance(out, str) else (json.loads(r) for r in out.toJSON().toLocalIterator()):
        print(json.dumps(line, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

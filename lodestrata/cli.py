"""python -m lodestrata.cli search PATTERN FOLDER [-i] [-F] [-w] [-c] [-l] [-C N] [--json] [--top N]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .sources.tables import check_root, walk


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestrata")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("pattern")
    s.add_argument("folder")
    for short, name in (("-i", "--ignore-case"), ("-F", "--fixed"), ("-w", "--word"), ("-c", "--count"), ("-l", "--files"), ("-j", "--json")):
        s.add_argument(short, name, action="store_true")
    s.add_argument("-B", "--before", type=int, default=0)
    s.add_argument("-A", "--after", type=int, default=0)
    s.add_argument("-C", "--context", type=int)
    s.add_argument("-t", "--type")
    s.add_argument("-g", "--glob")
    s.add_argument("--top", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    files = walk(spark, check_root(a.folder))
    corpus = files.select(F.xxhash64("path").alias("doc_id"), "path", "text")
    o = api.SearchOptions(a.pattern, ignore_case=a.ignore_case, fixed=a.fixed, word=a.word, before=a.before, after=a.after, context=a.context, file_type=a.type, glob=a.glob, default_excludes=False, top=a.top)
    mode = "count" if a.count else "files" if a.files else "json" if a.json else "context" if a.before or a.after or a.context else "grouped"
    out = api.search(corpus, o, mode)
    for row in out.toLocalIterator():
        print("\t".join(str(x) for x in row))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

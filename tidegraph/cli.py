"""Commands over files: extract, rank, sort, filter, dumpcategory, print, suggest, compare, page, tables, serve."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from tidegraph import answers
from tidegraph.operators import category, search
from tidegraph.plans.pipelines import parse_pages, rank_pages
from tidegraph.session import local_session
from tidegraph.sources import readers, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidegraph")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {"extract": ("dump", "out"), "rank": ("pages", "out", "edges"), "sort": ("ranked", "out"), "filter": ("ranked", "titles", "out"), "dumpcategory": ("ranked", "edges", "titles", "out"), "print": ("ranked",), "suggest": ("ranked", "prefix"), "compare": ("ranked", "a", "b"), "page": ("ranked", "title"), "tables": ("ranked", "out", "lists"), "serve": ("ranked", "port", "lists")}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a, **({"nargs": "*", "metavar": "NAME=PATH"} if a == "lists" else {}))
        if name == "extract":
            p.add_argument("--legacy", action="store_true", help="keep comments, take coordinates from raw text, the infobox's first")
        if name == "rank":
            p.add_argument("--legacy", action="store_true", help="follow redirect chains, cut sections, count redirect pages' own links")
            p.add_argument("--float", action="store_true", help="single-precision ranks")
        if name == "dumpcategory":
            p.add_argument("--influencers", type=int, default=-1)
            p.add_argument("--items", type=int, default=-1)
            p.add_argument("--no-aliases", action="store_true")
            p.add_argument("--year", action="store_true", help="with the release year")
            p.add_argument("--ignore-case", action="store_true")
            p.add_argument("--compact", action="store_true", help="JSON without indent")
        if name == "tables":
            p.add_argument("--n", type=int, default=1000)
    a = parser.parse_args(argv)
    spark = local_session()
    table = spark.read.parquet
    if a.command == "extract":
        sinks.write_table(parse_pages(readers.read_dump(spark, a.dump), infobox_first=a.legacy, strip_comments=not a.legacy, raw_coordinates=a.legacy), a.out)
    elif a.command == "rank":
        ranked, edges = rank_pages(table(a.pages), a.legacy, a.legacy, a.legacy, a.float)
        sinks.write_table(ranked, a.out)
        sinks.write_table(edges, a.edges)
    elif a.command == "sort":
        sinks.write_table(table(a.ranked).orderBy(F.desc("rank"), "id"), a.out)
    elif a.command == "filter":
        sinks.write_table(category.members(table(a.ranked), readers.read_titles(spark, a.titles), case_sensitive=False), a.out)
    elif a.command == "dumpcategory":
        titles = readers.read_titles(spark, a.titles)
        options = category.CategoryOptions(a.influencers, a.items, not a.no_aliases, a.year, not a.ignore_case, not a.compact)
        sinks.write_document(category.category_table(table(a.ranked), table(a.edges), titles, options), a.out, options.pretty)
        for r in category.unmatched(table(a.ranked), titles, options.case_sensitive).toLocalIterator():
            print(f"not found: {r.title}", file=sys.stderr)
    elif a.command == "print":
        for r in sinks.rank_lines(table(a.ranked).orderBy(F.desc("rank"), F.asc("id"))).toLocalIterator():
            print(r.line)
    elif a.command == "suggest":
        for r in search.suggest(search.title_index(table(a.ranked)), a.prefix).collect():
            print(f"{r.key}\t{r.rank:.6f}")
    elif a.command == "compare":
        for r in search.compare_titles(search.title_index(table(a.ranked)), [a.a, a.b]).collect():
            print(r.sentence)
    elif a.command == "page":
        asked = spark.createDataFrame([(a.title,)], "title string")
        print(sinks.json_document(search.pages_by_title(search.title_index(table(a.ranked)), table(a.ranked), asked)))
    else:
        lists = readers.read_categories(spark, dict(x.split("=", 1) for x in a.lists))
        if a.command == "tables":
            pages = table(a.ranked)
            sinks.write_table(search.category_tables(search.title_index(pages), pages, lists, a.n), a.out)
        else:
            answers.serve(answers.Answers(table(a.ranked), lists), int(a.port))
    return 0


if __name__ == "__main__":
    sys.exit(main())

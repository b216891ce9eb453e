"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidegraph.plans import catalogue
from tidegraph.session import local_session

NAMES = ["pagerank_edges", "pagerank_topk_order", "redirect_transitive", "html_links", "wikilink_extract", "infobox_attrs", "category_influence", "category_conditional", "title_index", "prefix_suggest", "external_sort", "relative_rank", "best_per_year", "log_histogram"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    took = {}
    for name in NAMES:
        began = time.time()
        catalogue.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

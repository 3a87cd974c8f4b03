"""Time the headline queries: python bench.py [name ...] prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from folioflow.plans import all_builders
from folioflow.session import local_session

HEADLINES = [
    "review_sheet", "thread_assembly", "comment_codes", "comment_list_all", "reachable_attachments",
    "attachment_summary", "guarded_update", "cascading_delete", "resolved_mentions", "registry_upsert",
    "order_summary", "first_labels", "collapsed_cells", "merged_versions", "row_states", "sentence_hashes",
    "replaced_sentences", "change_report", "dictionary_merge", "translated_texts", "term_tags", "xrefs_renumbered",
    "tree_from_levels", "subtree_ends", "legal_tree", "diff_states", "page_links", "page_chapters", "folder_paths",
    "presence", "job_runs", "editing_intervals",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores))
    builders = all_builders()
    names = sys.argv[1:] or HEADLINES
    run(builders[names[0]](spark, folder))  # one untimed run, so that no query pays for the JVM's start
    times = {}
    for name in names:
        begun = time.perf_counter()
        run(builders[name](spark, folder))
        times[name] = round(time.perf_counter() - begun, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()

"""Headline queries, timed one after another; prints one JSON line.

``sentences`` builds and caches the sentence relation all others read. Every query is
run over the whole tables and written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from spanloom.catalog import all_queries
from spanloom.session import build_session
from spanloom.sources.corpus import open_corpus

HEADLINE = [
    "o27_word_freq", "o35_modal_tag", "o42_bigrams", "o48_adjacency_entropy", "o51_lattice_match", "o53_occ_hit",
    "o55_reliability", "o59_dict_features", "o62_domain_vectors", "o63_gap_features", "o69_stratified_kfold",
    "o71_oof_dict_features", "o77_bidirectional_match", "o83_viterbi", "o89_category_metrics", "o96_mlm_mixed",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("spanloom-bench", cores)
    corpus, queries, times = open_corpus(spark, path), all_queries(), {}

    def timed(name, run):
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    timed("sentences", corpus.sent.count)
    timed("lexicon", lambda: corpus.lex)
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, path).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(path.rstrip("/"))}))


if __name__ == "__main__":
    main()

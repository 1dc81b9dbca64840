"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from corpusloom.queries.registry import QUERIES
from corpusloom.session import build_session

HEADLINE = [
    "s2_segment_files", "s2_segment_lines", "s3_read_articles", "f9_clean_articles", "f13_sentences",
    "e1_article_table", "t1_tokenize", "t3_remove_stopwords", "t6_lemmatize", "j1_drop_stopwords",
    "j2_map_lemmas", "l6_build_stopwords", "a5_thirty_categories", "a8_term_counts", "a9_term_stats",
    "v1_count_vectors", "v2_vocabulary", "v3_alphabetical_vocabulary", "v4_dictionary",
    "v5_bag_of_words", "v6_tf_idf", "e2_lemma_vocabulary", "m1_spark_topics", "m2_multicore_topics",
    "m4_doc_topics",
]
# A thousand training steps, and what is built on them: only with BENCH_FULL=1.
if os.environ.get("BENCH_FULL"):
    HEADLINE += ["m3_batch_topics", "m5_quality"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    spark = build_session(
        "corpusloom-bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in HEADLINE if not only or n in only.split(",")]
    # Start-up of the JVM and of code generation is not part of any query.
    QUERIES["v2_vocabulary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

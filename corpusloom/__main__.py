"""Launcher: ``python -m corpusloom articles …`` and ``python -m corpusloom topics …``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from corpusloom.config import batch_profile, multicore_profile, spark_profile
from corpusloom.operators.wordlists import base_stopwords
from corpusloom.plans.articles import build_articles
from corpusloom.plans.topic_jobs import train_batch, train_multicore, train_spark
from corpusloom.session import build_session
from corpusloom.sources.articles import read_articles, with_doc_id
from corpusloom.sources.wordlists import read_lemma_dict, read_stopwords

_JOBS = {
    "spark": (train_spark, spark_profile),
    "multicore": (train_multicore, multicore_profile),
    "batch": (train_batch, batch_profile),
}


def main() -> None:
    parser = argparse.ArgumentParser(prog="corpusloom")
    commands = parser.add_subparsers(dest="command", required=True)
    articles = commands.add_parser("articles", help="raw dump to cleaned article table")
    articles.add_argument("dump")
    articles.add_argument("target")
    articles.add_argument("--format", choices=["parquet", "tsv"], default="parquet")
    topics = commands.add_parser("topics", help="article table to topics")
    topics.add_argument("articles", help="tab-separated article files")
    topics.add_argument("target", help="folder for the topic words, as JSON lines")
    topics.add_argument("--job", choices=sorted(_JOBS), default="spark")
    topics.add_argument("--stopwords", help="word file; Spark's English list if not given")
    topics.add_argument("--lemmas", help="dictionary file; tokens stay as they are if not given")
    topics.add_argument("--topics", type=int)
    topics.add_argument("--iter", type=int, help="iterations of the distributed job")
    topics.add_argument("--epochs", type=int, help="passes of the chunked jobs")
    topics.add_argument("--vocabsize", type=int)
    topics.add_argument("--minDF", type=float)
    topics.add_argument("--maxDF", type=float)
    args = parser.parse_args()
    spark = build_session()
    if args.command == "articles":
        build_articles(spark, args.dump, args.target, args.format)
        return
    train, profile = _JOBS[args.job]
    given = {
        "topics": args.topics,
        "max_iter": args.iter,
        "passes": args.epochs,
        "vocab_size": args.vocabsize,
        "max_df_frac": args.maxDF,
        "min_df_count" if args.job == "multicore" else "min_df_frac": args.minDF,
    }
    settings = profile(**{k: v for k, v in given.items() if v is not None})
    words = read_stopwords(spark, args.stopwords) if args.stopwords else base_stopwords(spark)
    if args.lemmas:
        lemmas = read_lemma_dict(spark, args.lemmas)
    else:
        lemmas = spark.createDataFrame([], "form string, lemma string")
    docs = with_doc_id(read_articles(spark, args.articles))
    model, prepared = train(docs, words, lemmas, settings)
    model.quality(prepared).show(truncate=False)
    model.describe().orderBy("topic", F.col("rank")).write.json(args.target)


if __name__ == "__main__":
    main()

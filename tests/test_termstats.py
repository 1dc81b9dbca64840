"""Term statistics that add up, by batches and by streams."""

from collections import Counter

import pytest

from corpusloom.operators import termstats as S
from corpusloom.operators import vocab as V

DOCS = [(i, [f"w{j}" for j in range(i % 7)] + ["all", "all"] + ([None] if i % 5 == 0 else [])) for i in range(60)]
DOCS += [(100, []), (101, None), (None, ["all"]), (3, ["w1"])]


def brute(docs):
    df, cf, tokens = Counter(), Counter(), 0
    for _, words in docs:
        known = [w for w in words or [] if w is not None]
        df.update(set(known))
        cf.update(known)
        tokens += len(known)
    return {w: (df[w], cf[w]) for w in df} | {None: (len(docs), tokens)}


def as_dict(table):
    return {r["term"]: (r["df"], r["cf"]) for r in table.collect()}


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, tokens array<string>")


def test_batches_add_up_in_any_order(spark):
    parts = [S.batch_stats(frame(spark, DOCS[i::3])) for i in range(3)]
    want = brute(DOCS)
    assert as_dict(S.batch_stats(frame(spark, DOCS))) == want
    assert as_dict(S.merge_stats(*parts)) == want
    assert as_dict(S.merge_stats(S.merge_stats(parts[2], parts[0]), parts[1])) == want
    assert as_dict(S.merge_stats(parts[1], S.merge_stats(parts[0], parts[2]))) == want


def test_corpus_and_batch_equal_a_recount(spark, tmp_path):
    path = str(tmp_path / "stats")
    S.write_batch(S.batch_stats(frame(spark, DOCS[:50])), path, "corpus")
    S.write_batch(S.batch_stats(frame(spark, DOCS[50:])), path, "day1")
    S.write_batch(S.batch_stats(frame(spark, DOCS[50:])), path, "day1")  # a repeated batch counts once
    table = S.read_stats(spark, path)
    assert as_dict(table) == brute(DOCS)
    bounds = dict(min_df_frac=0.05, max_df_frac=0.9, size=50)
    vocab = V.vocab_of(S.terms_of(table), S.documents_of(table), **bounds)
    again = V.build_vocab(frame(spark, [(i, [t for t in w or [] if t]) for i, w in DOCS]), **bounds)
    assert sorted(vocab.collect()) == sorted(again.collect()) and vocab.count() > 3


@pytest.mark.parametrize("name", ["", "a/b", "_x", ".x"])
def test_batches_need_plain_names(spark, tmp_path, name):
    with pytest.raises(ValueError):
        S.write_batch(S.batch_stats(frame(spark, DOCS)), str(tmp_path), name)


def test_stream_counts_every_document_once(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("source", "stats", "checkpoint"))
    for part in range(3):
        frame(spark, DOCS[part::3]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, tokens array<string>").parquet(source)
        S.count_stream(stream, path, checkpoint).awaitTermination()
    assert as_dict(S.read_stats(spark, path)) == brute(DOCS)


def test_empty_batch(spark):
    empty = S.batch_stats(frame(spark, DOCS).limit(0))
    assert empty.count() == 0
    assert spark.range(1).select(S.documents_of(empty).alias("n")).first()["n"] == 0


def test_one_shuffle_with_partial_sums(spark, tmp_path):
    frame(spark, DOCS).write.parquet(str(tmp_path / "d"))
    plan = S.batch_stats(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "ReadSchema: struct<tokens:array<string>>" in plan

"""The stages in a row: what goes, what stays, what is carried."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import pieces


def test_stages_on_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "pii", "mix", "sentencepiece"]
    rows, table = docs, pieces.load_pieces()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.write_scratch(stage(spark, rows, sf_dir), name)
        assert rows.columns == docs.columns
        now = [r["doc_id"] for r in rows.select("doc_id").collect()]
        assert set(now) <= ids and (name == "mix" or len(set(now)) == len(now))
        if name != "mix":
            assert len(now) > 0.6 * len(ids)
        ids = set(now)
    last = corpus_pipeline.encode(spark, rows, sf_dir)
    texts = sorted(r["text"] for r in rows.collect())
    assert sorted(table.decode(r["ids"]) for r in last.collect()) == texts
    assert not any("@mail" in t for t in texts) and any("[EMAIL]" in t or "[IP]" in t for t in texts)


def test_awkward_documents(spark, tmp_path):
    toxic = [(i, f"vileword number{chr(97 + i % 26)} of people {i}", "en", "a", 1) for i in range(100, 160)]
    clean = [(i, f"pleasant story{chr(97 + i % 26)} about the garden {i} and its long path", "en", None, 1) for i in range(200, 400)]
    odd = [(1, None, None, None, None), (1, "", "en", "a", 0), (None, "x", "en", "b", 1), (2, "mail a@b.cc", "en", "a", 1), (2, "mail a@b.cc", "en", "a", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(toxic + clean + odd, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1) for i, *_ in toxic] + [(i, 0) for i, *_ in clean]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not {r["doc_id"] for r in out} & {i for i, *_ in toxic}
    table = pieces.load_pieces()
    assert "mail [EMAIL]" in {table.decode(r["ids"]) for r in out if r["doc_id"] == 2}
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert os.path.isdir(tmp_path)


INNER = (
    "size tie part parts sid start taken offset runs key row s turn block first n n_words fp root component node "
    "component_id best base cands seen half added vec toxicity score features text_a __base __id __tie"
).split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_extra_columns_of_any_name_are_carried(spark, tmp_path, name):
    """Columns named like those that a stage works out inside keep their values in every row."""
    texts = [f"vile word number{chr(97 + i % 26)} a story{chr(97 + i % 7)} of {i} mail m{i}@mail.org" for i in range(40)]
    docs = spark.createDataFrame(
        [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    docs = docs.select("*", *((F.col("doc_id") * 100 + k).alias(c) for k, c in enumerate(INNER)))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    left = {"text", "ids", "n_pieces", "decoded"} if name == "sentencepiece" else set()
    assert [c for c in out.columns if c not in left] == [c for c in docs.columns if c not in left]
    rows = out.collect()
    assert rows
    for r in rows:
        assert [r[c] for c in INNER] == [r["doc_id"] * 100 + k for k in range(len(INNER))]


def test_texts_go_to_workers_in_small_batches(spark, sf_dir):
    """A task of 12 MB of texts comes in several batches, short rows still come ten thousand at once; a
    setting of the session's own stays."""
    import pyarrow as pa

    name = corpus_pipeline.BATCH_SETTING

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "n"])

    def seen(rows):
        return rows.coalesce(1).mapInArrow(sizes, "bytes bigint, n bigint").collect()

    docs = spark.createDataFrame([(1, "a text", "en", "a", 6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    try:
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.near_dedup, corpus_pipeline.mix, corpus_pipeline.encode):
            spark.conf.unset(name)
            stage(spark, docs, sf_dir)
            got = seen(spark.range(3000).select(F.repeat(F.lit("x"), 4000).alias("text")))
            assert sum(r["n"] for r in got) == 3000 and max(r["bytes"] for r in got) < 5 << 20
            assert max(r["n"] for r in seen(spark.range(20_000))) == 10_000
        spark.conf.set(name, "2m")
        corpus_pipeline.encode(spark, docs, sf_dir)
        assert spark.conf.get(name) == "2m"
    finally:
        spark.conf.unset(name)

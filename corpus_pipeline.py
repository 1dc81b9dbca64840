"""From raw documents to token ids; each stage is one operator of ``corpusloom.llm``."""

from __future__ import annotations

from corpusloom.llm import mixture, pieces, pii, simhash, toxicity
from corpusloom.session import write_scratch

# How many bytes of texts Spark hands to a Python worker at once. A batch stands in the worker as Arrow, as
# strings and as results, and in buffers beside the executor's heap; batches of 64 MB, which Spark allows by
# itself, hold the texts of a whole task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark):
    """Set ``BATCH_BYTES``, unless the session has a value of its own.

    Spark reads the setting when a stage's rows are written, after the stage has returned them, so it stays.
    """
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def drop_toxic(spark, docs, sf_dir):
    """Documents scored 0.5 or more go, all others stay as they are.

    The classifier learns from the labels of ``sf_dir`` that are not held out.
    """
    small_batches(spark)
    labelled = toxicity.labelled_documents(
        docs.select("doc_id", "text"),
        spark.read.parquet(f"{sf_dir}/labels.parquet"),
        toxicity.train_part(),
        toxicity.ToxicityParams(),
    )
    model = toxicity.fit_toxicity(labelled)
    return toxicity.drop_toxic(docs, model)


def near_dedup(spark, docs, sf_dir):
    """One document of each group stays whose fingerprints, of three-word shingles, differ in three
    bits at most, directly or through others."""
    small_batches(spark)
    return simhash.keep_one(docs)


def redact(spark, docs, sf_dir):
    """Personal data is replaced by its kind in brackets; every document stays."""
    return pii.redact_documents(docs)


def mix(spark, docs, sf_dir):
    """Parts of documents taken so that the sources meet their target weights."""
    small_batches(spark)
    return mixture.mix_documents(docs)


def encode(spark, docs, sf_dir):
    """Piece ids of every part, ``(doc_id, lang, source, n_chars, ids, n_pieces, decoded)``."""
    small_batches(spark)
    return pieces.encode_documents(docs, pieces.load_pieces())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", near_dedup),
    ("pii", redact),
    ("mix", mix),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # hashes, random draws and learned models have no SQL form


def run(spark, sf_dir):
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_scratch(stage(spark, docs, sf_dir), name)
    return docs

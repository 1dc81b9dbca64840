"""What the physical plans must not do: compute a text twice, shuffle it, or leave the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.operators import clean
from corpusloom.operators import lookups as J
from corpusloom.operators import tokens as T
from corpusloom.operators import vocab as V
from corpusloom.operators.segment import segment_lines
from corpusloom.queries.registry import QUERIES
from corpusloom.sources.dump import segment_articles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "WASHINGTON — Some text"), (2, "x")], "doc_id long, content string").write.parquet(path)
    return spark.read.parquet(path)


def test_exploding_tokens_does_not_tokenize_twice(docs):
    text = plan(J.explode_tokens(T.tokenize(docs), "words"))
    assert text.count("regexp_extract_all") == 1


def test_cleaning_is_one_narrow_pass(docs):
    text = plan(clean.clean_articles(docs).select("doc_id", "content_new"))
    assert "Exchange" not in text
    assert text.count("regexp_replace") == 1


def test_preprocessing_is_narrow(spark, docs):
    lemmas = spark.createDataFrame([("texts", "text")], "form string, lemma string")
    text = plan(T.preprocess(docs, ["some"], lemmas))
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


def test_term_stats_shuffle_once_with_partial_sums(docs):
    text = plan(V.term_stats(T.tokenize(docs), "words"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_scans_are_pruned(docs):
    assert "ReadSchema: struct<content:string>" in plan(V.term_stats(T.tokenize(docs), "words"))


# These walk the rows of a scan in their order, which no built-in function does: see sources/positions.py.
WALKS = ("s2_", "s3_read_articles", "s4_read_articles", "e1_")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("m")))
def test_no_pair_joins_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("NestedLoop", "Cartesian", "InPandas"):
        assert operator not in text
    for line in text.splitlines():
        if "PythonEval" in line:
            # Texts stay in the JVM: hashes, offsets and flags go out.
            assert name.startswith(WALKS) and re.search(r"\[(first|count|walk)\(xxhash64\(", line)
            assert not re.search(r"(value|line|content)#", line.split("]")[0])


def test_segmentation_scans_once(spark, tmp_path):
    (tmp_path / "dump.txt").write_text("URL: a\nb\n")
    text = plan(segment_articles(spark, str(tmp_path)))
    assert text.count("FileScan text") == 1 and "Exchange" not in text and "Join" not in text


def test_hot_file_is_segmented_in_blocks(spark):
    line = F.when(F.col("line_no") % 7 == 0, F.concat(F.lit(C.ARTICLE_PREFIX), F.col("line_no").cast("string")))
    lines = spark.range(70_000).select(
        F.lit("hot").alias("file"), F.col("id").alias("line_no")
    ).withColumn("line", F.coalesce(line, F.lit(" text ")))
    out = segment_lines(lines, parts=40)
    wrong = out.filter(
        (F.col("url") != ((F.col("article_no") - 1) * 7).cast("string"))
        | (F.col("content") != "text text text text text text")
    )
    assert out.count() == 10_000 and wrong.count() == 0

import pytest
from pyspark.sql import functions as F

from corpusloom import session as S
from corpusloom.streaming.articles import clean_stream, read_article_stream


def test_scratch_is_in_the_shared_folder(spark):
    path = S.scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert path != S.scratch_path(spark, "x")


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "yarn"
        applicationId = "app"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        S.scratch_path(Session(), "x")


def test_write_scratch_keeps_rows_and_types(spark):
    df = spark.range(10).withColumn("s", F.array(F.lit("a")))
    back = S.write_scratch(df, "t")
    assert back.dtypes == df.dtypes and back.count() == 10


def test_lookup_size_and_limits(spark):
    lookup = spark.createDataFrame([("é", "b"), (None, "c")], "k string, v string")
    assert S.lookup_size(lookup) == (2, 4)
    assert S.fits_broadcast(10, 10) and S.fits_inline(10, 10)
    assert not S.fits_broadcast(S.BROADCAST_ROWS + 1, 10)
    assert not S.fits_broadcast(10, S.BROADCAST_BYTES + 1)
    assert not S.fits_inline(S.INLINE_ROWS + 1, 10)


def test_spread_leaves_wide_scans_alone(spark):
    narrow = spark.range(0, 100, 1, 1).toDF("k")
    assert S.spread(narrow, "k").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 2 * spark.sparkContext.defaultParallelism).toDF("k")
    assert S.spread(wide, "k") is wide


def test_cleaning_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.tsv").write_text('2016-06-30\thead\t"PARIS — Some\nnews_ here"\n2016-06-29\th\t中文\n')
    cleaned = clean_stream(read_article_stream(spark, str(source), multi_line=True))
    assert cleaned.isStreaming
    query = cleaned.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    try:
        query.processAllAvailable()
        rows = spark.sql("select content_new, words from cleaned").collect()
    finally:
        query.stop()
    assert [(r["content_new"], r["words"]) for r in rows] == [("Some\nnews here", ["some", "news", "here"])]


def test_lookup_size_counts_arrays(spark):
    from corpusloom.session import lookup_size

    df = spark.range(1).select("id", F.array_repeat(F.lit("xy"), 100_000).alias("a"))
    rows, size = lookup_size(df)
    assert rows == 1 and size > 200_000

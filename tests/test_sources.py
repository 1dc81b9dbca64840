import datetime
import json
import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import segment
from corpusloom.operators import wordlists as L
from corpusloom.operators.segment import segment_lines
from corpusloom.plans.articles import build_articles
from corpusloom.sources import articles as A
from corpusloom.sources import dump as D
from corpusloom.sources import wordlists as S
from corpusloom.sources.positions import read_positioned, running_count


def expected_articles(lines, keep_last=False):
    """Brute force: cut the list of lines at its openings."""
    starts = [i for i, line in enumerate(lines) if line.startswith("URL: ")]
    found = []
    for start, end in zip(starts, [*starts[1:], len(lines)]):
        body = [line.strip() for line in lines[start + 1 : end]]
        found.append((lines[start].strip().replace("URL: ", ""), " ".join(b for b in body if b)))
    return found if keep_last else found[:-1]


def random_lines(seed, preamble):
    rng = random.Random(seed)
    lines = ["before the first", "", "see URL: inside"] if preamble else []
    for number in range(rng.randint(1, 120)):
        lines.append(f"URL: http://x/2016/01/{number}/URL: y{number}.html  ")
        for _ in range(rng.randint(0, 5)):
            lines.append(rng.choice(["", "   ", " text here", "an URL: inside  ", "\ttab\t", "w" * 200]))
    return lines


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("keep_last", [False, True])
def test_segment_articles_over_many_splits(spark, tmp_path, newline, keep_last):
    expected = []
    for seed in range(6):
        lines = random_lines(seed, preamble=seed % 2 == 0)
        end = newline if seed % 3 else ""
        (tmp_path / f"dump{seed}.txt").write_bytes((newline.join(lines) + end).encode())
        expected += expected_articles(lines, keep_last)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = D.segment_articles(spark, str(tmp_path), keep_last)
        assert out.rdd.getNumPartitions() > 1
        found = [(r["url"], r["content"]) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("text", ["", "no article at all\n", "URL: only-one\nbody\n"])
def test_segment_articles_of_tiny_files(spark, tmp_path, text):
    (tmp_path / "dump.txt").write_text(text)
    assert D.segment_articles(spark, str(tmp_path), keep_last=False).collect() == []
    assert D.segment_articles(spark, str(tmp_path)).count() == ("URL" in text)


@pytest.mark.parametrize("parts", [1, 7, 60, None])
@pytest.mark.parametrize("keep_last", [False, True])
def test_segment_lines(spark, parts, keep_last):
    rows, expected = [], []
    for file in range(4):
        lines = random_lines(file, preamble=file % 2 == 0)
        # Dense numbers, sparse ones, negative ones, and huge ones.
        number_of = [lambda n: n, lambda n: n**3, lambda n: n * 1000 - 50_000, lambda n: (n // 3) * (1 << 40) + n % 3][file]
        rows += [(file, number_of(number), line) for number, line in enumerate(lines)]
        for number, (url, content) in enumerate(expected_articles(lines, keep_last), 1):
            expected.append((file, number, url, content))
    rows += [(None, 1, "URL: http://no/file"), (9, None, "URL: http://no/number"), (1, -1, None)]
    table = spark.createDataFrame(rows, "file long, line_no long, line string").repartition(5)
    found = segment_lines(table, keep_last, parts).collect()
    assert sorted((r["file"], r["article_no"], r["url"], r["content"]) for r in found) == sorted(expected)


def test_a_hot_file_of_sparse_numbers_is_spread(spark, monkeypatch):
    """The summary has a row for each range and file, whatever the numbers; no range is large."""
    kept = {}
    write = segment.write_scratch
    monkeypatch.setattr(segment, "write_scratch", lambda df, name: kept.setdefault(name, write(df, name)))
    line = F.when(F.col("id") % 9 == 0, F.concat(F.lit("URL: u"), "id")).otherwise(F.lit("text"))
    table = spark.range(20_000).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 50).alias("file"), F.shiftleft("id", 32).alias("line_no"), line.alias("line")
    )
    found = segment.segment_lines(table, parts=16)
    assert found.count() == sum(1 for i in range(0, 20_000, 9))
    assert kept["range-counts"].count() <= 16 + 50
    sizes = [r["count"] for r in kept["ranged-lines"].groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 20_000 / 16


def test_running_counts_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(0, 500, numPartitions=3).select("id", (F.col("id") % 10 == 0).alias("flag"), F.expr("id div 60").alias("key"))
        walked = rows.withColumn("n", running_count(F.col("key"), F.col("flag"))).withColumn("part", F.spark_partition_id())
        seen = {}
        for r in walked.orderBy("id").collect():
            seen[r["part"], r["key"]] = seen.get((r["part"], r["key"]), 0) + r["flag"]
            assert r["n"] == seen[r["part"], r["key"]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@contextmanager
def small_splits(spark, size, batch=10_000):
    """Splits of ``size`` bytes, several of them a task, and small batches of rows."""
    conf = {
        "spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch),
    }
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in conf:
            spark.conf.unset(key)


@pytest.mark.parametrize("size", [97, 300, 100_000])
def test_first_records_of_packed_files(spark, tmp_path, size):
    """Many files share a task, and a record may look like an article that opens a file."""
    expected = []
    for number in range(40):
        lines = [[], ["preamble"], ["", "URL: x", "body"]][number % 3] + [f"URL: URL: http://x/{number}", "URL:", " text ", "URL: end"]
        data = "\n".join(lines).encode()
        (tmp_path / f"d{number:02d}.txt").write_bytes(b"\xef\xbb\xbf" * (number % 2) + data)
        expected += expected_articles(lines, keep_last=True)
    with small_splits(spark, size, batch=3):
        found = [(r["url"], r["content"]) for r in D.segment_articles(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(expected)


def test_preview(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f" line {i} \n" for i in range(100)))
    (tmp_path / "b.txt").write_text("last\n")
    lines = D.preview(D.read_dump(spark, str(tmp_path)), 30)
    assert [r["line"] for r in lines.collect()] == [f"line {i}" for i in range(30)]


HARD = [
    (datetime.date(2016, 6, 30), "plain", "text"),
    (datetime.date(2016, 6, 29), 'with "quotes"', 'say "a"\tthen\ttab'),
    (datetime.date(2016, 6, 28), " spaces ", "two\nlines \\ and \r\nthree "),
    (None, None, '"'),
    (datetime.date(2016, 1, 1), "comma, and 'single'", "\\\"both\\\""),
]


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(HARD, A.ARTICLE_SCHEMA)
    path = str(tmp_path / "tsv")
    A.write_articles(df, path, ("date", "headline", "content"), fmt="tsv", rows_per_file=2, multi_line=True)
    back = A.read_articles(spark, path, keep_headline=True, multi_line=True).collect()
    key = str
    assert sorted((tuple(r) for r in back), key=key) == sorted(HARD, key=key)
    assert A.read_articles(spark, path).columns == ["date", "content"]


def test_reads_doubled_quotes_of_other_writers(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('2016-06-30\thead\t"a ""b""\tc\nd"\n2016-06-29\th2\tplain\n')
    rows = A.read_articles(spark, str(tmp_path), keep_headline=True, multi_line=True).orderBy("date").collect()
    assert rows[1]["content"] == 'a "b"\tc\nd' and rows[0]["headline"] == "h2"


FIELDS = ["", "a", "plain words", 'say "so"', '"', '""', "two\nlines", "\n", 'mix "\t\n" of, all', "\r\nx", "é\n\n日本", "tab\there", '"\n"']


@pytest.mark.parametrize("seed, size, batch", [(1, 300, 10_000), (2, 900, 2), (3, 10**6, 10_000)])
def test_quoted_line_breaks_by_many_tasks(spark, tmp_path, seed, size, batch):
    """Equal to the reader that takes a file a task, for random fields, splits and batches."""
    rng = random.Random(seed)
    draw = lambda: rng.choice([None, datetime.date(2016, 1, rng.randint(1, 28))])
    rows = [(draw(), *(rng.choice([None, *FIELDS, "w" * rng.randrange(90), "long\n" * rng.randrange(40)]) for _ in range(2))) for _ in range(120)]
    df = spark.createDataFrame(rows, A.ARTICLE_SCHEMA).coalesce(2)
    path = str(tmp_path / "tsv")
    A.write_articles(df, path, ("date", "headline", "content"), fmt="tsv", multi_line=True)
    whole = spark.read.csv(path, schema=A.ARTICLE_SCHEMA, multiLine=True, dateFormat="yyyy-MM-dd", **A.TSV_OPTIONS).collect()
    with small_splits(spark, size, batch):
        back = A.read_articles(spark, path, keep_headline=True, multi_line=True)
        scans = read_positioned(spark, path, "\n").rdd.getNumPartitions()
        found = back.collect()
    assert scans > 4 or size > 1000
    assert sorted(map(repr, found)) == sorted(map(repr, whole))


def test_bare_quotes_of_other_writers(spark, tmp_path):
    """A quote inside an unquoted field opens nothing; CRLF ends records; blank lines are none."""
    text = '2016-06-30\t5" disk\tx "y" z\r\n\r\n2016-06-29\t"a ""b""\r\nc"\t"q"\r\n2016-06-28\t\t"\n"\r\n'
    (tmp_path / "x.tsv").write_bytes(text.encode())
    for size in (7, 1000):
        with small_splits(spark, size):
            rows = A.read_articles(spark, str(tmp_path), keep_headline=True, multi_line=True).collect()
        found = {str(r["date"]): (r["headline"], r["content"]) for r in rows}
        assert len(rows) == 3
        assert found["2016-06-30"] == ('5" disk', 'x "y" z')
        assert found["2016-06-29"][0].replace("\r", "") == 'a "b"\nc' and found["2016-06-29"][1] == "q"
        assert found["2016-06-28"] == (None, "\n")


def test_changed_splits_raise(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("2016-06-30\ta\tb\n" * 50)
    with small_splits(spark, 100):
        rows = A.read_articles(spark, str(tmp_path), multi_line=True)
    with small_splits(spark, 130):
        with pytest.raises(Exception, match="splits"):
            rows = A.read_articles(spark, str(tmp_path), multi_line=True)
            (tmp_path / "x.tsv").write_text("2016-06-30\ta\tb\n" * 500)
            spark.catalog.refreshByPath(str(tmp_path))
            rows.select("content").count()


def test_lines_are_split_over_tasks(spark, tmp_path):
    df = spark.createDataFrame(HARD, A.ARTICLE_SCHEMA)
    path = str(tmp_path / "tsv")
    A.write_articles(df.unionByName(df), path, ("date", "headline", "content"), fmt="tsv")
    flat = lambda v: re.sub(r"\r\n|\r|\n", " ", v) if isinstance(v, str) else v
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        back = A.read_articles(spark, path, keep_headline=True)
        assert back.rdd.getNumPartitions() > 2
        assert sorted(map(str, map(tuple, back.collect()))) == sorted(2 * [str(tuple(map(flat, r))) for r in HARD])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        A.write_articles(spark.createDataFrame(HARD, A.ARTICLE_SCHEMA), str(tmp_path / "x"), fmt="orc",
                         columns=("date",))


def test_doc_ids_are_unique(spark):
    ids = A.with_doc_id(spark.range(1000).repartition(7).toDF("n")).agg(F.count_distinct("doc_id")).first()[0]
    assert ids == 1000


def test_stopword_files(spark, tmp_path):
    path = str(tmp_path / "words")
    words = spark.createDataFrame([(w,) for w in ["b", "a", "Z", "é", "'s", "a", "000"]], "word string")
    S.write_stopwords(words, path)
    lines = [r["value"] for r in D.read_dump(spark, path).orderBy("file", "position").collect()]
    assert lines == sorted({"b", "a", "Z", "é", "'s", "000"})
    assert sorted(r["word"] for r in S.read_stopwords(spark, path).collect()) == lines


LOOKUP = {"Tasks": "task", "tasked": "task", "task's": "task", "Taught": "teach", "x9": "x", "o'er": "o-v"}


def test_lemma_files_end_to_end(spark, tmp_path):
    (tmp_path / "lemmas.json").write_text(json.dumps(LOOKUP, indent=1))
    lookup = S.read_lemma_json(spark, str(tmp_path / "lemmas.json"))
    assert {r["form"]: r["lemma"] for r in lookup.collect()} == LOOKUP
    inverted = L.alphabetic_lemmas(L.invert_lemmas(lookup))
    path = str(tmp_path / "dict")
    S.write_lemma_dict(inverted, path)
    lines = [r["value"] for r in D.read_dump(spark, path).orderBy("file", "position").collect()]
    assert lines == ["task -> task tasks tasked", "teach -> teach taught", "x -> x "]
    back = {r["form"]: r["lemma"] for r in S.read_lemma_dict(spark, path).collect()}
    assert back == {"task": "task", "tasks": "task", "tasked": "task", "teach": "teach", "taught": "teach", "x": "x"}
    assert {r["form"]: r["lemma"] for r in L.flatten_lemmas(inverted).collect()} == back


def test_worked_example_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_text("taste -> taste tasted tastes tasting\nteach -> teach taught teaches teaching\n")
    found = {r["form"]: r["lemma"] for r in S.read_lemma_dict(spark, str(tmp_path)).collect()}
    assert found["taught"] == "teach" and found["tasted"] == "taste" and len(found) == 8


def test_last_line_naming_a_form_wins(spark, tmp_path):
    (tmp_path / "d.txt").write_text("zeta -> zeta same\nalpha -> alpha same\n\n")
    found = {r["form"]: r["lemma"] for r in S.read_lemma_dict(spark, str(tmp_path)).collect()}
    assert found == {"zeta": "zeta", "alpha": "alpha", "same": "alpha"}


def test_last_entry_of_json_lines_wins(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": "x", "b": "y"}\n{"a": "z"}\n')
    found = S.read_lemma_json(spark, str(tmp_path), json_lines=True)
    assert {r["form"]: r["lemma"] for r in found.collect()} == {"a": "z", "b": "y"}


def test_dump_to_table(spark, tmp_path):
    lines = [
        "URL: http://x/2016/06/30/world/asia/some-news.html", "PARIS — Some_ text.", "",
        "URL: http://x/2016/06/29/a/b.html", "中文",
        "URL: http://x/2016/06/28/c/d.html", "last, kept",
    ]
    (tmp_path / "dump.txt").write_text("\n".join(lines))
    target = str(tmp_path / "out")
    build_articles(spark, str(tmp_path / "dump.txt"), target)
    rows = [tuple(r) for r in spark.read.parquet(target).collect()]
    assert sorted(rows) == [
        (datetime.date(2016, 6, 28), "d", "last, kept"), (datetime.date(2016, 6, 30), "some news", "Some text.")
    ]


def test_lemma_objects_are_bounded(spark, tmp_path):
    lookup = spark.range(500).selectExpr("concat('f', id) AS form", "concat('l', id % 7) AS lemma")
    path = str(tmp_path / "objects")
    S.write_lemma_objects(lookup, path, size=20)
    sizes = [len(json.loads(r["value"])) for r in spark.read.text(path).collect()]
    assert sum(sizes) == 500 and len(sizes) > 15 and max(sizes) < 60
    got = S.read_lemma_json(spark, path, json_lines=True)
    assert sorted(map(tuple, got.select("form", "lemma").collect())) == sorted(map(tuple, lookup.collect()))


@pytest.mark.parametrize("indent", [None, 1])
def test_one_lemma_object_by_many_tasks(spark, tmp_path, indent):
    rng = random.Random(indent or 0)
    part = lambda: "".join(rng.choice(['a', 'b', '"', ",", "\\", "}", "{", " ", "é", "\n", ":"]) for _ in range(rng.randrange(6)))
    entries = {f"{part()}{i}": f"{part()}l{i % 9}" for i in range(700)}
    text = json.dumps(entries, indent=indent, ensure_ascii=False)
    # The last entry of a form wins, also where another task reads it.
    text = text[:-1].rstrip() + ', "same": "first", ' + ", ".join(f'"pad{i}": "x"' for i in range(50)) + ', "same": "last"}\n'
    (tmp_path / "one.json").write_text(text)
    want = json.loads(text)
    for size, batch in ((150, 3), (4000, 10_000), (10**7, 10_000)):
        with small_splits(spark, size, batch):
            got = S.read_lemma_json(spark, str(tmp_path)).collect()
        assert {r["form"]: r["lemma"] for r in got} == want
    ordered = [r["form"] for r in sorted(got, key=lambda r: r["position"]) if r["form"] != "same"]
    assert ordered == [f for f in want if f != "same"]


@pytest.mark.parametrize("text", ["{}", " { } \n", ""])
def test_empty_lemma_objects(spark, tmp_path, text):
    (tmp_path / "one.json").write_text(text)
    assert S.read_lemma_json(spark, str(tmp_path)).count() == 0


def test_one_lemma_object(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"went": "go",\n "mice": "mouse"}')
    got = S.read_lemma_json(spark, str(tmp_path / "one.json")).select("form", "lemma")
    assert sorted(map(tuple, got.collect())) == [("mice", "mouse"), ("went", "go")]

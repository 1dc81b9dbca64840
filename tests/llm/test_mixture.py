"""The mix of sources: sizes, targets, caps and whole blocks."""

import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.llm import mixture, queries

PARAMS = mixture.MixParams(block=8, shard=16)


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_targets():
    assert mixture.water_fill([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, 500 / 3, 250 / 3]
    assert mixture.water_fill([10, 0], [5, 2], 15, 2) == [15.0, 0.0]
    assert mixture.water_fill([], [], 0, 2) == []


def test_whole_query(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op2_source_mix(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(docs))
    totals, taken, targets = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == size(docs[r["doc_id"]]["text"]) and r["taken"] <= 2 * r["size"]
        source = docs[r["doc_id"]]["source"]
        totals[source] += r["size"]
        taken[source] += r["taken"]
        targets[source] = r["target"]
    names = sorted(totals)
    expected = mixture.water_fill([totals[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(totals.values()), 2)
    assert all(abs(targets[s] - e) < 1e-6 for s, e in zip(names, expected))
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in names)
    again = queries.op2_source_mix(spark, sf_dir).collect()
    assert sorted(got) == sorted(again)


AWKWARD = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, " d\te ", None), (None, "f", "y"),
           (5, "g " * 5000, "x"), (6, " h i j", "y")]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, 0, "z") for r in AWKWARD], "doc_id bigint, text string, source string, size int, sid string")
    got = mixture.mix_counts(docs, PARAMS).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter(
        (i, size(t), s) for i, t, s in AWKWARD
    )
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixture.mix_counts(docs.limit(0), PARAMS).count() == 0


def test_blocks_and_documents_hold_the_counted_words(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{i}.{j}" for j in range(i % 40)), f"s{i % 4}", "en") for i in range(200)],
        "doc_id bigint, text string, source string, lang string",
    )
    counts = {r["doc_id"]: r["taken"] for r in mixture.mix_counts(docs, PARAMS).collect()}
    blocks = mixture.mix_blocks(docs, PARAMS).collect()
    slots = Counter((r["shard"], r["position"]) for r in blocks)
    assert max(slots.values()) == 1 and sum(slots.values()) == len(blocks)
    assert Counter(len(r["words"]) == 8 for r in blocks)[False] <= 8
    in_blocks = Counter(int(w[1:].split(".")[0]) for r in blocks for w in r["words"])
    parts = mixture.mix_documents(docs, PARAMS)
    assert parts.columns == docs.columns
    in_parts = Counter()
    for r in parts.collect():
        in_parts[r["doc_id"]] += len(r["text"].split())
        assert {w.split(".")[0] for w in r["text"].split()} == {f"w{r['doc_id']}"}
    want = Counter({k: v for k, v in counts.items() if v})
    assert in_blocks == want and in_parts == want


def test_small_sources_meet_their_targets(spark):
    params = mixture.MixParams(block=128, shard=64)
    rows = [(i, " ".join(f"w{i}.{j}" for j in range(25)), f"s{i // 2:03d}") for i in range(1200)]
    rows += [(2000 + i, "z " * (1 + 37 * i), "t") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixture.mix_counts(docs, params).collect()
    taken, targets = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert len(targets) == 601 and all(abs(taken[s] - t) <= 0.5 for s, t in targets.items())
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_taken_by_brute_force(spark):
    """What every document gives, worked out from the order of the documents and the slots alone."""
    docs = spark.createDataFrame(
        [(i, "w " * (i * 7 % 45), f"s{i % 5}") for i in range(150)], "doc_id bigint, text string, source string"
    )
    sized = docs.select("doc_id", "source", mixture.n_words(docs["text"]).alias("size"), F.xxhash64("text").alias("tie"))
    plan = mixture.source_plan(sized, PARAMS)
    placed = mixture.place_documents(sized, plan).collect()
    owner = {}
    for r in placed:
        for j in range(r["size"]):
            assert owner.setdefault((r["sid"], r["start"] + j), r["doc_id"]) == r["doc_id"]
    slots = mixture.draw_slots(plan, PARAMS).collect()
    assert max(Counter((r["sid"], r["turn"], r["block"]) for r in slots).values()) == 1
    want = Counter()
    for r in slots:
        for j in range(r["most"]):
            if (r["sid"], r["block"] * 8 + j) in owner:
                want[owner[r["sid"], r["block"] * 8 + j]] += 1
    got = {r["doc_id"]: r["taken"] for r in mixture.mix_counts(docs, PARAMS).collect()}
    assert {i: n for i, n in got.items() if n} == dict(want)

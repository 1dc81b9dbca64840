"""SimHash components against all pairs on small tables."""

import re

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import queries, simhash
from corpusloom.llm.components import connected_components


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = {i: brute_print(t) for i, t in rows}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return prints, least


def test_whole_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints, least = brute_components(rows)
    got = queries.op4_simhash_dedup(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == least[r["doc_id"]]


def test_awkward_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (7, "one"), (8, "ONE"), (None, "one"), (8, "ONE"),
            (11, "a b c d"), (12, "É é " * 70_000), (None, "alone here and now")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, fp int, tie int")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert got[(5, 0)] == got[(3, 0)] == got[(9, 0)] == 3
    signed = lambda t: brute_print(t) - (1 << 64 if brute_print(t) >> 63 else 0)
    assert got[(8, signed("one"))] == got[(None, signed("one"))] == 7
    assert got[(None, signed("alone here and now"))] is None
    assert (12, signed("É é " * 70_000)) in got
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 7, 11, 12]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 16)
    base = [i * 0x9E3779B97F4A7C15 % 2**64 for i in range(1, 4)]
    prints = sorted({b ^ (1 << i) ^ (1 << j) for b in base for i in range(20) for j in range(25, 40)})
    signed = [p - (1 << 64 if p >> 63 else 0) for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    nodes = connected_components(simhash.near_links(df)).collect()
    assert len(nodes) == len(prints) and len({r["component"] for r in nodes}) == 3


def test_groups_share_a_key_for_any_size():
    for n in (10, 10**6, 10**9, 10**11):
        groups = simhash.bit_groups(n, 3)
        assert sorted(b for g in groups for b in g) == list(range(64)) and len(groups) >= 4


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(edges).filter("component <> 0").count() == 0
    assert connected_components(edges.limit(0)).count() == 0


def test_stage_keeps_one_of_each_component(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, least = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_links_of_a_group_of_near_copies_grow_with_its_size(spark):
    """A group of 400 near copies gives a forest of links, not all of its 79,800 pairs."""
    prints = {0x5555555555555555 ^ (1 << i) ^ (1 << j) for i in range(28) for j in range(32, 48)}
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    keys = len(simhash.bit_groups(len(prints), 3))
    assert links.count() <= keys * len(prints)
    assert connected_components(links).select("component").distinct().count() == 1

"""Piece chains against a plain dynamic program over the whole text, and exact round trips."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from corpusloom.llm import pieces, queries


@pytest.fixture(scope="module")
def table():
    return pieces.load_pieces()


def brute(table, text):
    """Best chain over the whole text by position, from the definition."""
    if not text:
        return []
    s = pieces.written(text)
    best = [(0, [])]
    for end in range(1, len(s) + 1):
        options = []
        for begin in range(max(0, end - table.longest), end):
            known = table.pieces.get(s[begin:end])
            if known is not None:
                options.append((best[begin][0] + table.scores[known], begin - end))
            elif end == begin + 1:
                options.append((best[begin][0] + table.unknown, -1))
        score, length = max(options, key=lambda o: (o[0], -o[1]))
        best.append((score, best[end + length][1] + [(end + length, end)]))
    return [i for b, e in best[-1][1] for i in table.ids(s[b:e])]


SAMPLES = ["", " ", "a", "  two  spaces ", "Der Fluss über\nzwei Zeilen\t", "▁ sign ▁▁", "日本語 text \U0001f600!",
           "thtion" * 30, "x" * 70, "\x00\x01", "a▁b c", "end space "]


def test_whole_texts(table):
    for text in SAMPLES:
        ids = table.encode(text).tolist()
        assert ids == brute(table, text), text
        assert table.decode(ids) == text


def test_chunks_give_the_ids_of_the_whole(spark, table):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["th", "tion", " ", "er", "é", "\n", "▁", "日", "in", "the ", "  "]) for _ in range(n)) for n in (40, 90, 300)]
    texts += ["the" * 200, "e" * 333, "日本語" * 60, " " * 200, "a" * 34]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (3, ""), (1, texts[1]), (1, texts[1])]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id bigint, text string, ids string, chunk int")
    got = pieces.encode_documents(docs, table, chunk=33).collect()
    assert len(got) == len(rows)
    texts = sorted((brute(table, t) for _, t in rows), key=str)
    assert sorted((r["ids"] for r in got), key=str) == texts
    for r in got:
        assert r["decoded"] and r["n_pieces"] == len(r["ids"]) and r["chunk"] == 5
    assert pieces.encode_documents(docs.limit(0), table).count() == 0


def test_matrices_combine_associatively(table):
    text = pieces.written("the tionality of thing over and over again")
    parts = [pieces.transfer(table, text[i : i + 16 + table.longest], min(16, len(text) - i)) for i in range(0, len(text), 16)]
    left, right = parts[0], parts[-1]
    for m in parts[1:]:
        left = pieces.combine(left, m)
    for m in parts[-2::-1]:
        right = pieces.combine(m, right)
    assert np.array_equal(left, right)
    assert left[0, 0] == table.forward(text, [(0, 0)], len(text))[0][len(text)]


def test_whole_query(spark, sf_dir, table):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op3_sentencepiece(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and all(r["decoded"] for r in got)
    for r in got[:40]:
        if len(texts[r["doc_id"]]) < 3000:
            assert r["ids"] == brute(table, texts[r["doc_id"]])


def test_stored_ids_decode_to_the_texts(spark, sf_dir, table, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-i - 1, t, None) for i, t in enumerate(SAMPLES)] + [(None, "日本語" * 40, "ja"), (-1, "", None), (-1, "", None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    pieces.encode_documents(docs, table).drop("decoded").write.parquet(f"{tmp_path}/ids")
    stored = spark.read.parquet(f"{tmp_path}/ids")
    back = pieces.decode_documents(stored, table, chunk=5)
    assert back.columns == ["doc_id", "lang", "n_pieces", "text"]
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"])
    got = sorted((key(r) for r in back.collect()), key=str)
    assert got == sorted((key(r) for r in docs.collect()), key=str)
    assert pieces.decode_documents(stored.limit(0), table).count() == 0


def test_ids_that_no_text_has(spark, table):
    byte = table.byte_ids
    rows = [(1, [10**6]), (2, [-1]), (3, [None]), (4, [table.pieces["▁the"], byte[0xFF]]), (5, None), (6, []),
            (7, [table.pieces["▁the"], byte[0xC3], byte[0xA9]])]
    encoded = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded, table, chunk=2).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: "", 6: "", 7: "theé"}


def test_executors_need_not_have_the_package(sf_dir, tmp_path):
    """In a process of its own, started elsewhere, only the driver's ``sys.path`` knows the package."""
    root = str(Path(__file__).resolve().parents[2])
    job = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {root + "/__spark_entry__.py"!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
rows = entry.queries()["op3_sentencepiece"](spark, {sf_dir!r}).collect()
assert rows and all(r["decoded"] for r in rows)
"""
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env | _java(), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]


def _java() -> dict[str, str]:
    import os

    return {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "SPARK_LOCAL_IP")}


def test_kept_words_are_bounded_and_recent_ones_stay(monkeypatch):
    """Whatever is read, no more than twice the words of a dict are held, and results do not change."""
    monkeypatch.setattr(pieces, "CACHED_WORDS", 50)
    monkeypatch.setattr(pieces, "CACHED_PARTS", 20, raising=False)
    table, fresh = pieces.load_pieces(), pieces.load_pieces()
    rng = random.Random(5)
    for i in range(60):
        text = "again " + " ".join("".join(rng.choices("abcé1中", k=rng.randint(1, 9))) for _ in range(10))
        text += rng.choice(["", "  ", " ▁ x"])
        fresh = pieces.PieceTable(**{f: getattr(fresh, f) for f in list(fresh.__dataclass_fields__)[:8]})
        assert table.encode(text).tolist() == fresh.encode(text).tolist()
        assert table.decode(table.encode(text).tolist()) == text
        assert "again" in table.seen or "again" in table.seen_before
        assert len(table.seen) + len(table.seen_before) <= 2 * 65
        assert len(table.known) + len(table.known_before) <= 2 * 20


def test_words_read_together_share_their_beginnings(table):
    """What words have in common at their begin is walked once; the ids are those of words read alone."""

    class Counted(dict):
        walked = 0

        def get(self, key, default=None):
            self.walked += 1
            return super().get(key, default)

    rng = random.Random(11)
    texts = [" ".join("interrelationship" + "".join(rng.choices("aeé▁日th", k=rng.randint(0, 2))) for _ in range(20)) for _ in range(9)]
    texts += ["", None, "x" * 200 + " " + "inter" * 30, "  inter  interr", texts[0]]
    own = pieces.PieceTable(**{f: getattr(table, f) for f in list(table.__dataclass_fields__)[:8]})
    own.tails = Counted(own.backwards())
    got = [ids.tolist() for ids in own.encode_all(texts)]
    assert got == [brute(table, t) for t in texts]
    short = {w for t in texts for w in pieces.words_of(t) if len(w) <= pieces.LONG_WORD}
    beginnings = {(pieces.SPACE + w)[:n] for w in short for n in range(1, len(w) + 2)}
    assert own.tails.walked == len(beginnings) < sum(map(len, short)) / 4

"""Sentence ends with learned abbreviations."""

from corpusloom.operators import clean
from corpusloom.operators.sentences import abbreviations, split_sentences, stop_statistics

TEXTS = [
    "The U.S. said no. It cost 3.5 dollars. J. Doe and A. B. Roe left.",
    "Mr. Smith met the U.S. envoy on Jan. 5 at noon. The end came.",
    "At 3.5 percent, the U.S. economy grew. Mr. Lee said so (cf. below).",
    "Mr. Poe and Mrs. Poe saw Mr. Ray. See cf. page 2, and cf. page 3. The end.",
    "In Jan. and in Jan. 2016 the U.S. won. Is it noon? The end! He left. He left. He left.",
    "They left early. Mr. Kay left at noon. On Jan. 7, as of Jan. 8, cf. above, cf. this.",
]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")


def test_statistics(spark):
    found = {r["word"]: tuple(r)[1:] for r in stop_statistics(docs(spark, TEXTS)).collect()}
    assert found["u.s"] == (4, 0, 4)
    assert found["mr"] == (5, 0, 0)
    assert found["jan"] == (5, 0, 5)
    assert found["left"] == (2, 2, 0)
    assert found["cf"] == (5, 0, 5) and found["3.5"] == (0, 2, 0)


def test_abbreviations_are_learned(spark):
    known = abbreviations(stop_statistics(docs(spark, TEXTS)), least=4)
    assert sorted(known) == ["cf", "jan", "mr", "u.s"]


def test_only_sentence_ends_split(spark):
    known = abbreviations(stop_statistics(docs(spark, TEXTS)), least=4)
    rows = split_sentences(docs(spark, TEXTS), known).orderBy("doc_id", "pos").collect()
    found = [[r["sentence"] for r in rows if r["doc_id"] == i] for i in range(len(TEXTS))]
    assert found[0] == ["The U.S. said no.", "It cost 3.5 dollars.", "J. Doe and A. B. Roe left."]
    assert found[1] == ["Mr. Smith met the U.S. envoy on Jan. 5 at noon.", "The end came."]
    assert found[4] == ["In Jan. and in Jan. 2016 the U.S. won.", "Is it noon?", "The end!", "He left.", "He left.", "He left."]
    assert [r["pos"] for r in rows if r["doc_id"] == 0] == [0, 1, 2]


def test_without_abbreviations_the_plain_rule_holds(spark):
    texts = ["One here. Two there!  Three?\nFour", "", "no end", "Dots... and more. So", " . . ", "x." * 3000, "word here. " * 3000]
    plain = clean.explode_sentences(docs(spark, texts)).collect()
    learned = split_sentences(docs(spark, texts), []).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, learned))
    assert split_sentences(docs(spark, texts).limit(0), ["mr"]).count() == 0
    assert split_sentences(spark.createDataFrame([(1, None)], "doc_id long, content string"), ["mr"]).count() == 0


def test_words_at_sentence_ends_only_are_no_abbreviations(spark):
    texts = ["We reached the summit. Then we left."] * 20
    assert abbreviations(stop_statistics(docs(spark, texts))) == []

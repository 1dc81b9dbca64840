"""Queries over tokens, stopwords, lemmas and word joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import tokens as K
from corpusloom.operators import lookups as J
from corpusloom.operators import tokens as T
from corpusloom.operators import wordlists as L
from corpusloom.operators.vocab import bag_of_words, build_vocab, term_counts
from corpusloom.queries import inputs as I
from corpusloom.queries.inputs import ALL, LEMMAS, STATS_CTE, TOK_CTE, WORDS, with_
from corpusloom.session import scratch_path, write_scratch
from corpusloom.sources import wordlists as S
from corpusloom.sources.positions import read_positioned

# --- SQL pieces ---

# Tokens left after the stopwords, and their lemmas.
_KEPT_CTE = "kept AS (SELECT doc_id, pos, token FROM tok WHERE token NOT IN (SELECT lower(word) FROM stop))"
_LEMMA_CTE = (
    "lem AS (SELECT doc_id, pos, token, coalesce(lemma, token) AS lemma "
    "FROM kept LEFT JOIN lemmas ON form = token)"
)
_INVERTED_CTE = "inverted AS (SELECT lemma, string_agg(form, ' ' ORDER BY form) AS forms FROM lemmas GROUP BY lemma)"
_ROOTS_CTE = (
    "verbs(word) AS (VALUES " + I.words_values(C.LIGHT_VERB_ROOTS) + "), "
    "roots AS (SELECT word FROM verbs UNION SELECT word FROM frequent), "
    "expanded AS (SELECT form AS word FROM lemmas JOIN roots ON lemma = word "
    "UNION ALL SELECT word FROM roots)"
)


def _per_doc(tokens: str, column: str, out: str) -> str:
    """Tokens joined per document; documents without tokens get an empty text."""
    return (
        f"SELECT doc_id, coalesce(string_agg({column}, ' ' ORDER BY pos), '') AS {out} "
        f"FROM documents LEFT JOIN {tokens} USING (doc_id) GROUP BY doc_id"
    )


def _words(spark, sf_dir):
    return I.documents(spark, sf_dir).transform(T.tokenize, text="text")


def _filtered(spark, sf_dir):
    return _words(spark, sf_dir).transform(T.remove_stopwords, words=I.stopwords(spark, sf_dir))


def _joined(docs, tokens, out):
    return docs.select("doc_id", F.array_join(tokens, " ").alias(out))


def _roots(spark, sf_dir):
    frequent = I.frequent_words(spark, sf_dir)
    return write_scratch(L.combine_words(L.light_verb_roots(spark), frequent).distinct(), "roots")


def _exploded(spark, sf_dir):
    return J.explode_tokens(I.tokens(spark, sf_dir))


def _numbered(lines):
    """Lines with their place in the files; only for word lists, which are bounded."""
    number = F.row_number().over(W.orderBy("file", "position")).cast("bigint")
    return lines.select(number.alias("n"), F.col("value").alias("line"))


def s6_read_stopwords(spark, sf_dir):
    path = scratch_path(spark, "stopword-file")
    S.write_stopwords(I.stopwords(spark, sf_dir), path)
    return S.read_stopwords(spark, path)


def s7_write_stopwords(spark, sf_dir):
    path = scratch_path(spark, "stopword-file")
    S.write_stopwords(I.stopwords(spark, sf_dir), path)
    return _numbered(read_positioned(spark, path))


def s8_read_lemma_json(spark, sf_dir):
    path = scratch_path(spark, "lemma-json")
    I.lemma_lookup(spark, sf_dir).select(F.to_json(F.create_map("form", "lemma"))).write.text(path)
    return S.read_lemma_json(spark, path, json_lines=True).select("form", "lemma")


def s8_read_lemma_object(spark, sf_dir):
    """The dictionary as JSON objects of a bounded size, one per line."""
    path = scratch_path(spark, "lemma-object")
    S.write_lemma_objects(I.lemma_lookup(spark, sf_dir), path)
    return S.read_lemma_json(spark, path, json_lines=True).select("form", "lemma")


def s9_write_lemma_dict(spark, sf_dir):
    path = scratch_path(spark, "lemma-dict")
    inverted = L.alphabetic_lemmas(L.invert_lemmas(I.lemma_lookup(spark, sf_dir)))
    S.write_lemma_dict(inverted, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def s10_read_lemma_dict(spark, sf_dir):
    path = scratch_path(spark, "lemma-dict")
    inverted = L.alphabetic_lemmas(L.invert_lemmas(I.lemma_lookup(spark, sf_dir)))
    S.write_lemma_dict(inverted, path)
    return S.read_lemma_dict(spark, path)


def p6_alphabetic_tokens(spark, sf_dir):
    docs = _words(spark, sf_dir).withColumn("words", K.alphabetic_only("words"))
    return _joined(docs, "words", "words")


def p7_not_a_stopword(spark, sf_dir):
    words = J.explode_tokens(_filtered(spark, sf_dir), "words_filtered")
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def p8_lemma_is_root(spark, sf_dir):
    roots = I.frequent_words(spark, sf_dir).withColumnRenamed("word", "lemma")
    lookup = I.lemma_lookup(spark, sf_dir)
    return lookup.join(write_scratch(roots, "roots"), "lemma", "left_semi").select("form", "lemma")


def t1_tokenize(spark, sf_dir):
    return _joined(_words(spark, sf_dir), "words", "words")


def t2_clean_text(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    docs = docs.transform(T.clean_text, text="text")
    docs = docs.transform(T.clean_text, text="text", out="cased", lowercase=False)
    return docs.select("doc_id", "clean", "cased")


def t3_remove_stopwords(spark, sf_dir):
    return _joined(_filtered(spark, sf_dir), "words_filtered", "words_filtered")


def t3_stopwords_by_join(spark, sf_dir):
    """The join that larger word tables take."""
    docs = _words(spark, sf_dir).transform(T.remove_stopwords, words=I.stopwords(spark, sf_dir), strategy="join")
    return _joined(docs, "words_filtered", "words_filtered")


def t4_join_tokens(spark, sf_dir):
    return _filtered(spark, sf_dir).transform(T.join_tokens).select("doc_id", "words_joined")


def t5_split_words(spark, sf_dir):
    docs = _filtered(spark, sf_dir).transform(T.join_tokens).transform(T.split_words)
    return docs.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


def t6_lemmatize(spark, sf_dir):
    docs = _filtered(spark, sf_dir).transform(T.lemmatize, lemmas=I.lemma_lookup(spark, sf_dir))
    return _joined(docs, "tokens", "lemmas")


def t6_lemmas_by_join(spark, sf_dir):
    """The join that larger dictionaries take."""
    docs = _filtered(spark, sf_dir)
    docs = docs.transform(T.lemmatize, lemmas=I.lemma_lookup(spark, sf_dir), strategy="join")
    return _joined(docs, "tokens", "lemmas")


def t8_alphabetic_lemmas(spark, sf_dir):
    docs = T.preprocess(
        I.documents(spark, sf_dir),
        I.stopwords(spark, sf_dir),
        I.lemma_lookup(spark, sf_dir),
        text="text",
        alpha_only=True,
        break_hyphens=True,
        lowercase_lemmas=True,
    )
    return _joined(docs, "tokens", "lemmas")


def t9_remove_words(spark, sf_dir):
    docs = _filtered(spark, sf_dir).transform(T.lemmatize, lemmas=I.lemma_lookup(spark, sf_dir))
    return _joined(docs.transform(T.remove_words), "tokens", "lemmas")


def l1_invert_lemmas(spark, sf_dir):
    inverted = L.invert_lemmas(I.lemma_lookup(spark, sf_dir))
    return inverted.select("lemma", F.array_join("forms", " ").alias("forms"))


def l2_alphabetic_lemmas(spark, sf_dir):
    inverted = L.alphabetic_lemmas(L.invert_lemmas(I.lemma_lookup(spark, sf_dir)))
    return inverted.select("lemma", F.array_join("forms", " ").alias("forms"))


def l3_expand_roots(spark, sf_dir):
    expanded = L.expand_roots(_roots(spark, sf_dir), I.lemma_lookup(spark, sf_dir))
    return expanded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def l4_combine_words(spark, sf_dir):
    expanded = L.expand_roots(_roots(spark, sf_dir), I.lemma_lookup(spark, sf_dir))
    combined = L.combine_words(L.word_classes(spark), expanded)
    return combined.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def l5_distinct_words(spark, sf_dir):
    return L.combine_words(L.word_classes(spark), _exploded_words(spark, sf_dir)).distinct()


def _exploded_words(spark, sf_dir):
    return _exploded(spark, sf_dir).select(F.col("token").alias("word"))


def l6_build_stopwords(spark, sf_dir):
    base = I.frequent_words(spark, sf_dir)
    verbs = L.expand_roots(_roots(spark, sf_dir), I.lemma_lookup(spark, sf_dir))
    return L.build_stopwords(base, L.word_classes(spark), verbs)


def l7_sorted_words(spark, sf_dir):
    path = scratch_path(spark, "sorted-words")
    S.write_stopwords(l6_build_stopwords(spark, sf_dir), path)
    return _numbered(read_positioned(spark, path)).withColumnRenamed("line", "word")


def l8_word_class_counts(spark, sf_dir):
    # Only words of a class are counted, once; a word may be in several classes.
    classes = L.word_classes(spark)
    listed = F.broadcast(classes.select("word").distinct())
    counts = _exploded_words(spark, sf_dir).join(listed, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("cf"))
    found = classes.join(counts, "word", "left")
    return found.groupBy("class").agg(
        F.count(F.lit(1)).alias("words"),
        F.count("cf").alias("words_found"),
        F.coalesce(F.sum("cf"), F.lit(0)).alias("occurrences"),
    )


def j1_drop_stopwords(spark, sf_dir):
    kept = J.drop_words(_exploded(spark, sf_dir), I.stopwords(spark, sf_dir))
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("pos").cast("bigint") + 1).alias("pos_sum")
    )


def j2_map_lemmas(spark, sf_dir):
    mapped = J.map_lemmas(_exploded(spark, sf_dir), I.lemma_lookup(spark, sf_dir))
    return mapped.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def j3_name_terms(spark, sf_dir):
    docs = I.tokens(spark, sf_dir)
    vocab = write_scratch(build_vocab(docs, min_df_frac=0.02, max_df_frac=0.8, size=10_000), "vocab")
    named = J.name_terms(bag_of_words(docs, vocab), vocab)
    return named.select("doc_id", F.col("term_id").cast("bigint"), "term", "tf")


def j4_forms_of_roots(spark, sf_dir):
    return J.forms_of(_roots(spark, sf_dir), I.lemma_lookup(spark, sf_dir))


def j5_known_terms(spark, sf_dir):
    docs = I.tokens(spark, sf_dir)
    vocab = write_scratch(build_vocab(docs, min_df_frac=0.02, max_df_frac=0.5), "vocab")
    return J.known_terms(term_counts(docs), vocab).select("doc_id", "term", "tf")


QUERIES = {
    q.__name__: q
    for q in (
        s6_read_stopwords, s7_write_stopwords, s8_read_lemma_json, s8_read_lemma_object, s9_write_lemma_dict,
        s10_read_lemma_dict, p6_alphabetic_tokens, p7_not_a_stopword, p8_lemma_is_root, t1_tokenize,
        t2_clean_text, t3_remove_stopwords, t3_stopwords_by_join, t4_join_tokens, t5_split_words, t6_lemmatize,
        t6_lemmas_by_join,
        t8_alphabetic_lemmas, t9_remove_words, l1_invert_lemmas, l2_alphabetic_lemmas,
        l3_expand_roots, l4_combine_words, l5_distinct_words, l6_build_stopwords, l7_sorted_words,
        l8_word_class_counts, j1_drop_stopwords, j2_map_lemmas, j3_name_terms, j4_forms_of_roots,
        j5_known_terms,
    )
}

_ALPHA = r"'^\p{L}+$'"
_ALPHA_INVERTED = (
    "alpha AS (SELECT lemma, coalesce(string_agg(form, ' ' ORDER BY form) "
    f"FILTER (WHERE regexp_matches(form, {_ALPHA})), '') AS forms FROM lemmas "
    f"WHERE regexp_matches(lemma, {_ALPHA}) GROUP BY lemma)"
)
_STOP_BUILT = "built AS (SELECT word FROM frequent UNION SELECT word FROM classes UNION SELECT word FROM expanded)"
_N_DOCS = "(SELECT count(*) FROM documents)"

ORACLES = {
    "s6_read_stopwords": with_(*WORDS) + "SELECT word FROM stop",
    "s7_write_stopwords": with_(*WORDS)
    + "SELECT row_number() OVER (ORDER BY word) AS n, word AS line FROM stop",
    "s8_read_lemma_json": with_(*LEMMAS) + "SELECT form, lemma FROM lemmas",
    "s8_read_lemma_object": with_(*LEMMAS) + "SELECT form, lemma FROM lemmas",
    "s9_write_lemma_dict": with_(*LEMMAS, _ALPHA_INVERTED)
    + "SELECT lemma || ' -> ' || lemma || ' ' || forms AS line FROM alpha",
    "s10_read_lemma_dict": with_(*LEMMAS)[:-1]
    + ", entries AS (SELECT form, lemma FROM lemmas "
    f"WHERE regexp_matches(lemma, {_ALPHA}) AND regexp_matches(form, {_ALPHA}) "
    f"UNION SELECT lemma, lemma FROM lemmas WHERE regexp_matches(lemma, {_ALPHA})) "
    "SELECT form, max(lemma) AS lemma FROM entries GROUP BY form",
    "p6_alphabetic_tokens": with_(
        TOK_CTE, f"alpha AS (SELECT * FROM tok WHERE regexp_matches(token, {_ALPHA}))"
    ) + _per_doc("alpha", "token", "words"),
    "p7_not_a_stopword": with_(*WORDS, _KEPT_CTE) + "SELECT token, count(*) AS n FROM kept GROUP BY token",
    "p8_lemma_is_root": with_(*ALL)
    + "SELECT form, lemma FROM lemmas WHERE lemma IN (SELECT word FROM frequent)",
    "t1_tokenize": with_(TOK_CTE) + _per_doc("tok", "token", "words"),
    "t2_clean_text": "SELECT doc_id, lower(array_to_string(l, ' ')) AS clean, array_to_string(l, ' ') AS cased "
    r"FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9\-]{3,50}') AS l FROM documents)",
    "t3_remove_stopwords": with_(*WORDS, _KEPT_CTE) + _per_doc("kept", "token", "words_filtered"),
    "t3_stopwords_by_join": with_(*WORDS, _KEPT_CTE) + _per_doc("kept", "token", "words_filtered"),
    "t4_join_tokens": with_(*WORDS, _KEPT_CTE) + _per_doc("kept", "token", "words_joined"),
    "t5_split_words": with_(*WORDS, _KEPT_CTE)
    + "SELECT doc_id, count(token) AS n_tokens FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id",
    "t6_lemmatize": with_(*ALL, _KEPT_CTE, _LEMMA_CTE) + _per_doc("lem", "lemma", "lemmas"),
    "t6_lemmas_by_join": with_(*ALL, _KEPT_CTE, _LEMMA_CTE) + _per_doc("lem", "lemma", "lemmas"),
    "t8_alphabetic_lemmas": with_(
        *ALL,
        "pieces AS (SELECT doc_id, pos, string_split(token, '-') AS l FROM tok)",
        "parts AS (SELECT doc_id, pos, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM pieces)",
        f"letters AS (SELECT * FROM parts WHERE regexp_matches(token, {_ALPHA}) "
        "AND token NOT IN (SELECT word FROM stop))",
        "lem AS (SELECT doc_id, pos, i, lower(coalesce(lemma, token)) AS lemma "
        "FROM letters LEFT JOIN lemmas ON form = token)",
    )
    + "SELECT doc_id, coalesce(string_agg(lemma, ' ' ORDER BY pos, i), '') AS lemmas "
    "FROM documents LEFT JOIN lem USING (doc_id) GROUP BY doc_id",
    "t9_remove_words": with_(
        *ALL,
        _KEPT_CTE,
        _LEMMA_CTE,
        "gone(word) AS (VALUES " + I.words_values([*C.PUNCTUATION, *C.EXTRA_WORDS]) + ")",
        "rest AS (SELECT * FROM lem WHERE lemma NOT IN (SELECT word FROM gone))",
    )
    + _per_doc("rest", "lemma", "lemmas"),
    "l1_invert_lemmas": with_(*LEMMAS, _INVERTED_CTE) + "SELECT lemma, forms FROM inverted",
    "l2_alphabetic_lemmas": with_(*LEMMAS, _ALPHA_INVERTED) + "SELECT lemma, forms FROM alpha",
    "l3_expand_roots": with_(*ALL, _ROOTS_CTE)
    + "SELECT word, count(*) AS n FROM expanded GROUP BY word",
    "l4_combine_words": with_(*ALL, _ROOTS_CTE)
    + "SELECT word, count(*) AS n FROM (SELECT word FROM classes UNION ALL SELECT word FROM expanded) GROUP BY word",
    "l5_distinct_words": with_(*WORDS) + "SELECT word FROM classes UNION SELECT token FROM tok",
    "l6_build_stopwords": with_(*ALL, _ROOTS_CTE, _STOP_BUILT) + "SELECT word FROM built",
    "l7_sorted_words": with_(*ALL, _ROOTS_CTE, _STOP_BUILT)
    + "SELECT row_number() OVER (ORDER BY word) AS n, word FROM built",
    "l8_word_class_counts": with_(*WORDS)
    + "SELECT class, count(*) AS words, count(cf) AS words_found, "
    "CAST(coalesce(sum(cf), 0) AS BIGINT) AS occurrences "
    "FROM classes LEFT JOIN stats ON term = word GROUP BY class",
    "j1_drop_stopwords": with_(*WORDS, _KEPT_CTE)
    + "SELECT doc_id, count(*) AS n_tokens, CAST(sum(pos) AS BIGINT) AS pos_sum FROM kept GROUP BY doc_id",
    "j2_map_lemmas": with_(*LEMMAS)
    + "SELECT coalesce(lemma, token) AS token, count(*) AS n FROM tok LEFT JOIN lemmas ON form = token GROUP BY 1",
    "j3_name_terms": with_(TOK_CTE, STATS_CTE)[:-1]
    + f", vocab AS (SELECT row_number() OVER (ORDER BY cf DESC, term) - 1 AS term_id, term FROM stats "
    f"WHERE df >= CAST(0.02 AS DOUBLE) * {_N_DOCS} AND df <= CAST(0.8 AS DOUBLE) * {_N_DOCS} "
    "ORDER BY term_id LIMIT 10000) "
    "SELECT doc_id, term_id, term, count(*) AS tf FROM tok JOIN vocab ON term = token GROUP BY ALL",
    "j4_forms_of_roots": with_(*ALL, _ROOTS_CTE)
    + "SELECT word AS root, form FROM roots JOIN lemmas ON lemma = word",
    "j5_known_terms": with_(TOK_CTE, STATS_CTE)
    + "SELECT doc_id, token AS term, count(*) AS tf FROM tok WHERE token IN (SELECT term FROM stats "
    f"WHERE df >= CAST(0.02 AS DOUBLE) * {_N_DOCS} AND df <= CAST(0.5 AS DOUBLE) * {_N_DOCS}) GROUP BY ALL",
}

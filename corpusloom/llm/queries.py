"""The registered queries of this folder: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import (
    collocations, covertree, decontaminate, langspans, licenses, mixture, pieces, pii, ranking, simhash, toxicity,
    urlrules, vafile,
)
from corpusloom.llm.common import fold, table

SITE_RULES = [
    urlrules.site_rule("com", "/", "allow"),
    urlrules.site_rule("example.com", "/en/", "block"),
    urlrules.site_rule("www.example.com", "/en/", "allow"),
    urlrules.site_rule("net", "/es/", "block"),
    urlrules.site_rule("net", "/fr/", "block"),
]
BAD_WORDS = ["casino", "gambling", "porn", "xxx", "phishing", "malware", "warez", "torrent"]


def op1_exact_search(spark, sf_dir):
    """The five best inner products of every fiftieth vector."""
    return vafile.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op2_source_mix(spark, sf_dir):
    """Words of each document that a mix of 150 % of all words takes."""
    mixed = mixture.mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_sentencepiece(spark, sf_dir):
    """Piece ids of each document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode_documents(docs, pieces.load_pieces())
    return encoded.select("doc_id", "n_pieces", "decoded", "ids")


def op4_simhash_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of each document."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op5_toxicity(spark, sf_dir):
    """Toxicity of each document, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = toxicity.labelled_documents(
        docs, table(spark, sf_dir, "labels"), toxicity.train_part(), toxicity.ToxicityParams()
    )
    model = toxicity.fit_toxicity(labelled)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op6_licenses(spark, sf_dir):
    """Licence notices of each document: the confirmed families, and every notice found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.find_licenses(docs, licenses.fit_licenses(docs))
    sure = F.filter("licenses", lambda n: n["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda n: n["family"]))), ",")
    return found.select(
        "doc_id", families.alias("families"), F.size(sure).cast("bigint").alias("n_notices"), "licenses"
    )


def op7_pii(spark, sf_dir):
    """Personal data in each document: counts and digest of the exact patterns, and all spans."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *(of(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)),
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.concat("base", "added")).alias("spans"),
    )


def op8_vector_dedup(spark, sf_dir):
    """Links and components of the vectors of each label at a cosine of 0.98."""
    return covertree.similar_vectors(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark, sf_dir):
    """Verdict of the site rules on each page's URL, else that of the word rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = SITE_RULES + [urlrules.word_rule(w) for w in BAD_WORDS]
    judged = urlrules.judge_urls(pages, urlrules.rule_table(spark, rules))
    word = F.col("rule").startswith("word:")
    return judged.select(
        "page_id", "host", "path",
        F.when(~word, F.col("rule")).alias("rule"),
        "verdict",
        F.when(word, F.col("rule")).alias("word_rule"),
    )


def op10_language(spark, sf_dir):
    """Language of each document, learned from two thirds of them, and its spans' number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langspans.fit_languages(docs, langspans.train_part())
    labelled = langspans.label_languages(docs.select("doc_id", "text"), model)
    return labelled.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_spans").alias("spans"),
    )


def op11_decontaminate(spark, sf_dir):
    """Words of each document inside ten-word windows of the benchmark items, and the items hit."""
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.hit_words(F.col("spans"))
    return leaks.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.array_join("items", ",").alias("items"),
    )


def op12_ranked_search(spark, sf_dir):
    """The ten documents that rank highest for each benchmark item."""
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark, sf_dir):
    """The 2,000 best phrases of two and three words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (
    op1_exact_search, op2_source_mix, op3_sentencepiece, op4_simhash_dedup, op5_toxicity, op6_licenses,
    op7_pii, op8_vector_dedup, op9_url_filter, op10_language, op11_decontaminate, op12_ranked_search, op13_collocations,
)}

_SITE = {r.rule: r for r in SITE_RULES}
_FITS = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{h}{p}'"
    for h, p in sorted(((r.split("/", 1)[0], "/" + r.split("/", 1)[1]) for r in _SITE), key=lambda x: -len("".join(x)))
)
_BLOCKED = ", ".join(f"'{r.rule}'" for r in SITE_RULES if r.verdict == "block")
_WORDS = "|".join(BAD_WORDS)

ORACLES = {
    "op1_exact_search": """
WITH v AS (
  SELECT DISTINCT vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id AS query_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM v WHERE vec_id % 50 = 0),
p AS (SELECT vec_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM v),
s AS (
  SELECT query_id, vec_id, CAST(sum(q.x * p.x) AS BIGINT) AS score
  FROM q JOIN p ON q.i = p.i AND query_id <> vec_id GROUP BY query_id, vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op8_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT vec_id, label, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM v),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY vec_id),
d AS (
  SELECT a.vec_id AS a, b.vec_id AS b, sum(a.x * b.x) AS dot
  FROM e a JOIN e b ON a.label = b.label AND a.i = b.i AND a.vec_id <> b.vec_id
  GROUP BY a.vec_id, b.vec_id),
link AS (
  SELECT a, b FROM d JOIN n na ON na.vec_id = a JOIN n nb ON nb.vec_id = b
  WHERE dot / (na.norm * nb.norm) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT m.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, comp.component_id,
  comp.component_id = m.vec_id AS kept
FROM embeddings m JOIN comp ON comp.a = m.vec_id LEFT JOIN deg ON deg.a = m.vec_id""",
    "op9_url_filter": f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {_FITS} END AS rule FROM parts),
worded AS (
  SELECT *, CASE WHEN rule IS NULL THEN nullif(lower(
    regexp_extract(host || path, '(?i)(?:^|[^A-Za-z0-9])({_WORDS})(?:[^A-Za-z0-9]|$)', 1)), '') END AS word
  FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({_BLOCKED}) OR word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  'word:' || word AS word_rule
FROM worded""",
    "op11_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
s AS (
  SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
  FROM i WHERE item_id IS NOT NULL AND len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM s),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM windows)),
grams AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS g FROM places),
found AS (SELECT doc_id, item_id, m, p FROM grams JOIN windows USING (m, g)),
hit AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM found) GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n_items, list_sort(list(item)) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  coalesce(array_to_string(items, ','), '') AS items
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN held ON held.doc_id = d.doc_id""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
m AS (SELECT doc_id, 25 + (75 * CAST(n AS BIGINT) * docs) // words AS m FROM n, c),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, c GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_collocations": r"""
WITH t AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
  FROM w, range(1, 4) AS s(m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase),
words AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
inner_ AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM c WHERE m = 3),
dropped AS (SELECT lang, phrase, max(longer) AS longer FROM inner_ GROUP BY lang, phrase),
kept AS (
  SELECT c.* FROM c LEFT JOIN dropped ON c.m = 2 AND dropped.lang = c.lang AND dropped.phrase = c.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM kept, range(1, 3) AS s(k) WHERE k < m),
scored AS (
  SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, k,
    CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.first
  JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest),
weakest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS weak FROM scored) WHERE weak = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN words USING (lang) WHERE rank <= 2000""",
}

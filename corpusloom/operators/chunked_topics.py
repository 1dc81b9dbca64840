"""Online variational topics in passes that meet every document once.

Spark's own online optimizer draws every step's documents with replacement. Here documents are dealt into
chunks by a hash of their key; a pass takes each chunk once. A step infers the topics of its chunk's
documents in their own tasks; only sums of topics by terms are shuffled, by blocks of terms, and the
driver holds one such matrix, as Spark's optimizer does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import ceil, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import TopicParams
from corpusloom.operators import vocab as V
from corpusloom.operators.lookups import name_terms
from corpusloom.operators.topics import fit_tasks
from corpusloom.session import write_scratch

BLOCK = 4096  # terms whose sums travel together
CELLS = 1 << 19  # topics by terms of the documents that are inferred together
ROUNDS, CLOSE = 100, 1e-3  # of a document's inference: rounds at most, mean change at which it ends


def _together():
    """``(digamma, infer_all, blocks)``, nested so that tasks get their code and need not have this package."""
    rounds, close, cells_at_once = ROUNDS, CLOSE, CELLS

    def digamma(x):
        """By the recurrence up to 6, then by the asymptotic series."""
        x = np.array(x, dtype=float)
        out = np.zeros_like(x)
        while (x < 6).any():
            out -= np.where(x < 6, 1 / x, 0)
            x = np.where(x < 6, x + 1, x)
        y = 1 / (x * x)
        return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))

    def infer_all(beta, alpha, ids, counts, lengths):
        """Topic weights of some documents, and their terms' shares of them: ``(gamma, theta, norm)``.

        The terms of the documents, ``lengths`` of each and none of 0, stand one after another. A
        document ends by itself, so its result does not depend on those beside it.
        """
        k, n = len(beta), len(lengths)
        out, out_theta, out_norm = np.empty((k, n)), np.empty((k, n)), np.empty(len(ids))
        docs, cells, open_ = np.arange(n), np.arange(len(ids)), np.ones(n, dtype=bool)
        own, doc = beta[:, ids], np.repeat(docs, lengths)
        gamma = np.ones((k, n))
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=0)))
        norm = (theta[:, doc] * own).sum(axis=0) + 1e-100
        for round_ in range(rounds):
            before, starts = gamma, np.cumsum(lengths) - lengths
            gamma = alpha + theta * np.add.reduceat(own * (counts / norm), starts, axis=1)
            theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=0)))
            norm = (theta[:, doc] * own).sum(axis=0) + 1e-100
            ends = open_ & ((np.abs(gamma - before).mean(axis=0) < close) | (round_ == rounds - 1))
            if ends.any():
                out[:, docs[ends]], out_theta[:, docs[ends]] = gamma[:, ends], theta[:, ends]
                out_norm[cells[ends[doc]]] = norm[ends[doc]]
                open_ = open_ & ~ends
                if not open_.any():
                    break
                if 4 * open_.sum() <= 3 * len(open_):
                    left = open_[doc]
                    own, counts, norm, cells = own[:, left], counts[left], norm[left], cells[left]
                    gamma, theta, docs, lengths = gamma[:, open_], theta[:, open_], docs[open_], lengths[open_]
                    doc, open_ = np.repeat(np.arange(len(docs)), lengths), np.ones(len(docs), dtype=bool)
        return out, out_theta, out_norm

    def blocks(frame, k):
        """``(rows, ids, counts, lengths)`` of the documents with terms, some cells at a time."""
        sizes = np.array([len(i) for i in frame["ids"]], dtype=np.int64)
        rows = np.flatnonzero(sizes)
        parts = np.cumsum(sizes[rows]) * k // cells_at_once
        for own in np.split(rows, np.flatnonzero(np.diff(parts)) + 1) if len(rows) else ():
            lists = [np.concatenate([np.asarray(frame[c].iloc[r]) for r in own]) for c in ("ids", "counts")]
            yield own, lists[0], lists[1].astype(float), sizes[own]

    return digamma, infer_all, blocks


def _inference():
    """``(digamma, infer)`` for one document."""
    digamma, infer_all, _ = _together()

    def infer(beta, alpha, ids, counts):
        """A document's topic weights, and its terms' shares of them: ``(gamma, theta, counts / norm)``."""
        gamma, theta, norm = infer_all(beta, alpha, ids, counts, np.array([len(ids)]))
        return gamma[:, 0], theta[:, 0], counts / norm

    return digamma, infer


@dataclass
class ChunkedModel:
    """Topics as a matrix of weights, with the same reports as ``TopicModel``."""

    weights: np.ndarray
    vocab: DataFrame
    settings: TopicParams
    passes: int
    chunks: DataFrame

    @cached_property
    def _beta(self) -> np.ndarray:
        digamma, _ = _inference()
        return np.exp(digamma(self.weights) - digamma(self.weights.sum(axis=1, keepdims=True)))

    def _inferred(self, docs: DataFrame, key: str, with_bound: bool) -> DataFrame:
        shared, alpha = docs.sparkSession.sparkContext.broadcast(self._beta), 1.0 / self.settings.topics
        digamma, infer_all, blocks = _together()
        log_gamma = lgamma

        def run(frames):
            beta = shared.value
            k = len(beta)
            for frame in frames:
                shares, bounds, mass = np.zeros((len(frame), k)), np.zeros(len(frame)), np.zeros(len(frame))
                for rows, ids, counts, lengths in blocks(frame, k):
                    gamma, _, norm = infer_all(beta, alpha, ids, counts, lengths)
                    total, starts = gamma.sum(axis=0), np.cumsum(lengths) - lengths
                    shares[rows], mass[rows] = (gamma / total).T, np.add.reduceat(counts, starts)
                    if with_bound:
                        log_theta = digamma(gamma) - digamma(total)
                        fit = np.add.reduceat(counts * np.log(norm), starts) + ((alpha - gamma) * log_theta).sum(axis=0)
                        prior = [sum(map(log_gamma, g)) - log_gamma(t) for g, t in zip(gamma.T, total)]
                        bounds[rows] = fit + prior + (log_gamma(k * alpha) - k * log_gamma(alpha))
                yield pd.DataFrame({key: frame[key], "topicDistribution": list(shares), "bound": bounds, "mass": mass})

        kind = docs.schema[key].dataType.simpleString()
        out = term_lists(docs.select(key, "tokens"), self.vocab, key).mapInPandas(
            run, f"`{key}` {kind}, topicDistribution array<double>, bound double, mass double"
        )
        return out if with_bound else out.drop("bound", "mass")

    def mixtures(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """``(key, topicDistribution, dominant_topic)``; shares of 0 without a known term."""
        shares = self._inferred(docs, key, False)
        best = F.array_max("topicDistribution")
        return shares.withColumn(
            "dominant_topic", F.when(best > 0, F.array_position("topicDistribution", best).cast("int") - 1)
        )

    def quality(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """One row: a lower bound of the log likelihood, log perplexity and perplexity."""
        digamma, _ = _inference()
        eta, (k, size) = 1.0 / self.settings.topics, self.weights.shape
        log_beta = np.log(self._beta)
        lg = np.vectorize(lgamma)
        topics = float(((eta - self.weights) * log_beta).sum() + (lg(self.weights) - lgamma(eta)).sum())
        topics += float((lgamma(size * eta) - lg(self.weights.sum(axis=1))).sum())
        sums = self._inferred(docs, key, True).agg(F.sum("bound").alias("bound"), F.sum("mass").alias("mass")).first()
        likelihood = sums["bound"] + topics if sums["mass"] else None
        per_token = -likelihood / sums["mass"] if sums["mass"] else None
        return docs.sparkSession.range(1).select(
            F.lit(likelihood).cast("double").alias("log_likelihood"),
            F.lit(per_token).cast("double").alias("log_perplexity"),
            F.exp(F.lit(per_token).cast("double")).alias("perplexity"),
        )

    def describe(self, n: int | None = None) -> DataFrame:
        """``(topic, rank, term, weight)``: the ``n`` heaviest terms of each topic."""
        shares = self.weights / self.weights.sum(axis=1, keepdims=True)
        rows = []
        for topic, own in enumerate(shares):
            for rank, term in enumerate(np.argsort(-own, kind="stable")[: n or self.settings.top_words]):
                rows.append((topic, rank + 1, int(term), float(own[term])))
        top = self.vocab.sparkSession.createDataFrame(rows, "topic int, rank int, term_id int, weight double")
        return name_terms(top, self.vocab).select("topic", "rank", "term", "weight")


def term_lists(docs: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """``(key, ids, counts)`` of the vocabulary's terms, one row for every row of ``docs(key, tokens)``."""
    v = F.unwrap_udt("features")
    return V.vectorize(docs, vocab, "tokens", "features", key).select(
        key, F.coalesce(v["indices"], F.array().cast("array<int>")).alias("ids"),
        F.coalesce(v["values"], F.array().cast("array<double>")).alias("counts"),
    )


def fit_by_chunks(
    docs: DataFrame, settings: TopicParams, key: str = "doc_id", passes: int | None = None, vocab: DataFrame | None = None
) -> ChunkedModel:
    """Train on ``(key, tokens)``: ``passes`` passes of ``steps_per_pass`` chunks.

    Each document is in one chunk, and each pass takes every chunk once, in ascending order. Priors are
    symmetric, 1 / topics. The vectors are written once, in a folder for each chunk, and their
    number of tasks follows from the number of documents, so a fit is the same on every cluster. Rows of
    equal key are documents of their own; without a known term a document says nothing.
    """
    spark = docs.sparkSession
    steps = settings.steps_per_pass or 1
    passes = passes or settings.passes or 1
    n_docs = docs.count()
    if vocab is None:
        vocab = V.build_vocab(
            docs.select(key, "tokens"), settings.min_df_frac, settings.max_df_frac, settings.min_df_count,
            size=settings.vocab_size, order=settings.vocab_order, n_docs=n_docs,
        )
    vocab = write_scratch(vocab, "vocabulary")
    size, k = vocab.count(), settings.topics
    tasks = fit_tasks(ceil(n_docs / steps))
    lists = term_lists(docs.select(key, "tokens"), vocab, key)
    chunk = F.pmod(F.xxhash64(key, F.lit(settings.seed)), F.lit(steps)).cast("int")
    dealt = lists.withColumns({"chunk": chunk, "part": F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int")})
    dealt = write_scratch(dealt, "chunks")
    rng = np.random.default_rng(settings.seed)
    weights = rng.gamma(100.0, 0.01, (k, size))
    counts = {r["chunk"]: r["n"] for r in dealt.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    digamma, _ = _inference()
    eta = 1.0 / k
    for step in range(passes * steps):
        own = step % steps
        if not counts.get(own) or not size:
            continue
        beta = np.exp(digamma(weights) - digamma(weights.sum(axis=1, keepdims=True)))
        rows = dealt.filter(F.col("chunk") == own).repartition(tasks, "part").sortWithinPartitions("part", key)
        sums = _summed(rows, spark.sparkContext.broadcast(beta), k, size, settings)
        rho = (settings.learning_offset + step + 1) ** -settings.learning_decay
        weights = (1 - rho) * weights + rho * (eta + n_docs / counts[own] * sums * beta)
    return ChunkedModel(weights, vocab, settings, passes, dealt.select(key, "chunk"))


def _summed(rows: DataFrame, shared, k: int, size: int, settings: TopicParams) -> np.ndarray:
    """The sums over a chunk's documents of their topics' shares in each term."""
    alpha, block = 1.0 / settings.topics, BLOCK
    _, infer_all, blocks = _together()

    def run(frames):
        beta = shared.value
        sums, seen, first = np.zeros((k, size)), False, 0
        for frame in frames:
            first = int(frame["part"].iloc[0]) if not seen and len(frame) else first
            for _, ids, counts, lengths in blocks(frame, k):
                _, theta, norm = infer_all(beta, alpha, ids, counts, lengths)
                terms, at = np.unique(ids, return_inverse=True)
                ratio, doc = counts / norm, np.repeat(np.arange(len(lengths)), lengths)
                for topic in range(k):
                    sums[topic, terms] += np.bincount(at, weights=theta[topic, doc] * ratio, minlength=len(terms))
                seen = True
        for b in range(0, size if seen else 0, block):
            yield pd.DataFrame({"block": [b], "part": [first], "sums": [sums[:, b : b + block].tobytes()]})

    def add(frame):
        # In the order of the parts, so that a sum of floats is the same in every run.
        held = [np.frombuffer(s) for s in frame.sort_values("part")["sums"]]
        return pd.DataFrame({"block": frame["block"].iloc[:1], "sums": [sum(held[1:], held[0].copy()).tobytes()]})

    parts = rows.mapInPandas(run, "block int, part int, sums binary")
    out = np.zeros((k, size))
    for r in parts.groupBy("block").applyInPandas(add, "block int, sums binary").collect():
        out[:, r["block"] : r["block"] + block] = np.frombuffer(r["sums"]).reshape(k, -1)
    return out

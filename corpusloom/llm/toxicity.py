"""Toxicity scores by a logistic model that is trained to ignore which group a text mentions."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, hash_share, letter_runs
from corpusloom.session import write_scratch

# --- Fixed values: groups of words that name people; within a group one may stand for another. ---
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("black", "white", "asian", "latino"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("american", "mexican", "chinese", "german", "french", "african"),
    ("immigrants", "natives", "refugees"),
)
# --- End of fixed values. ---


@dataclass(frozen=True)
class ToxicityParams:
    """``sample`` bounds the labelled documents of a fit, which are chosen by a hash of their id;
    ``features`` the words of the model, each of which must differ between the labels by ``clear``
    (a chi-squared statistic, so that words seen by chance stay out). ``fairness`` weighs the change of a score when identity
    terms are swapped, ``ridge`` the size of the weights, whatever the number of documents."""

    sample: int = 20_000
    features: int = 2_048
    min_docs: int = 5
    clear: float = 25.0
    fairness: float = 4.0
    ridge: float = 0.02
    steps: int = 300
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the words and beginnings a text holds, however often, and the weight of none."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        return score_words(self.weights, self.bias, text)


PREFIXES = (4, 5, 6)


def text_features(text: str | None) -> set[str]:
    """The words of a text, and the beginnings of longer ones with a star: inflected words share
    them."""
    held: set[str] = set()
    for words in letter_runs(text or ""):
        held.update(words)
    return word_features(held)


def word_features(words: set[str]) -> set[str]:
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in PREFIXES))


def swapped_features(features: list[str], swap: dict[str, str]) -> set[str]:
    """The features of the same text with each identity term replaced."""
    return word_features({swap.get(f, f) for f in features if not f.endswith("*")})


def score_words(weights: dict[str, float], bias: float, text: str | None) -> float:
    held = weights.keys() & text_features(text)
    z = bias + sum(weights[w] for w in sorted(held))
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    """Each identity term with the next one of its group."""
    return {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}


def labelled_documents(docs: DataFrame, labels: DataFrame, train: Column, params: ToxicityParams) -> DataFrame:
    """``(text, toxic)`` of at most about ``params.sample`` labelled documents where ``train`` holds.

    Rows without a label or id are left out; of several labels of a document the highest counts.
    The chosen ids are bounded by the sample, so they can be sent to the documents, and no text is
    shuffled to find its label. Of documents with equal text and label one is taken.
    """
    known = (
        labels.filter("toxic is not null and doc_id is not null")
        .filter(train)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("__toxic"))
    )
    share = min(1.0, params.sample / max(1, known.count()))
    chosen = known.filter(hash_share(F.col("doc_id"), share))
    found = docs.join(F.broadcast(chosen), "doc_id").select("text", F.col("__toxic").alias("toxic"))
    return found.dropDuplicates(["text", "toxic"])


def _word_sets(batches):
    for batch in batches:
        rows = [sorted(text_features(text.as_py())) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), batch.column(1)], ["words", "toxic"])


def fit_toxicity(labelled: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on ``(text, toxic)``.

    The words and beginnings with the clearest link to either label become features (ties to the
    smaller one).
    The loss is the log loss of each document plus ``fairness`` times the squared change of its
    score when its identity terms are swapped. Without labelled rows of both kinds the model gives
    the observed share of toxic rows, 0.5 without any row, to every text.
    """
    rows = write_scratch(
        labelled.select("text", "toxic").mapInArrow(_word_sets, "words array<string>, toxic int"), "labelled"
    )
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = float((positive + 1) / (n + 2))
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < positive < n:
        return ToxicityModel({}, bias)
    swap = swaps(params.groups)
    counts = (
        rows.select(F.explode("words").alias("word"), "toxic")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("pos"))
        .filter(F.col("df") >= params.min_docs)
    )
    share = positive / n
    gap = F.col("pos") - F.col("df") * share
    clear = counts.withColumn("chi", gap * gap / (F.col("df") * share * (1 - share))).filter(F.col("chi") >= params.clear)
    names = [r["word"] for r in clear.orderBy(F.desc("chi"), "word").limit(params.features).collect()]
    names = sorted({*names, *word_features(set(swap))})
    index = {w: i for i, w in enumerate(names)}

    def ids(frames):
        for frame in frames:
            own = [[index[w] for w in words if w in index] for words in frame["words"]]
            named = [not swap.keys().isdisjoint(words) for words in frame["words"]]
            other = [
                sorted(index[w] for w in swapped_features(words, swap) if w in index) if some else held
                for words, held, some in zip(frame["words"], own, named)
            ]
            lists = {"own": pd.Series(own, dtype=object), "other": pd.Series(other, dtype=object)}
            yield pd.DataFrame({"toxic": frame["toxic"].to_numpy(), **lists})

    kept = rows.mapInPandas(ids, "toxic int, own array<int>, other array<int>").toPandas()
    own, other = _sparse(kept["own"]), _sparse(kept["other"])
    y = kept["toxic"].to_numpy(dtype=float)
    return ToxicityModel(*_descend(own, other, y, names, bias, params))


def _sparse(lists) -> tuple[np.ndarray, np.ndarray]:
    lengths = [len(x) for x in lists]
    columns = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if lists.size else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(lengths)), lengths), columns


def _descend(own, other, y, names, bias, params) -> tuple[dict[str, float], float]:
    n, k = len(y), len(names)
    w, b = np.zeros(k), bias

    def apply(matrix, weights):
        return np.bincount(matrix[0], weights[matrix[1]], minlength=n)

    def back(matrix, residual):
        return np.bincount(matrix[1], residual[matrix[0]], minlength=k) / n

    def loss(weights, at) -> float:
        z = apply(own, weights) + at
        change = z - at - apply(other, weights)
        fit = np.logaddexp(0, z) - y * z
        return float(fit.mean() + params.fairness * (change**2).mean() + ridge / 2 * (weights**2).sum())

    # Steps along a coordinate are scaled by its curvature: how often its word occurs or is swapped.
    df, ridge = np.bincount(own[1], minlength=k) / n, params.ridge / n
    moved = np.abs(np.bincount(own[1], minlength=k) - np.bincount(other[1], minlength=k)) / n
    scale = 1 / (df / 4 + ridge + 2 * params.fairness * np.maximum(moved, df * (moved > 0)))
    rate = 1 / max(1.0, float(np.bincount(own[0], minlength=n).mean()))
    w_seen, b_seen, t_seen, least = w, b, 1.0, loss(w, b)
    w_now, b_now = w, b
    for _ in range(params.steps):
        z = apply(own, w_now)
        change = z - apply(other, w_now)
        residual = 1 / (1 + np.exp(-np.clip(z + b_now, -500, 500))) - y
        fair = 2 * params.fairness * change
        grad = back(own, residual + fair) - back(other, fair) + ridge * w_now
        w, b = w_now - rate * scale * grad, b_now - rate * 4 * residual.mean()
        now = loss(w, b)
        if not now <= least + 1e-12:
            # Too far: go on from the best point with shorter steps and without momentum.
            rate, t_seen = rate * 0.7, 1.0
            w, b = w_now, b_now = w_seen, b_seen
            continue
        t = (1 + (1 + 4 * t_seen * t_seen) ** 0.5) / 2
        push = (t_seen - 1) / t
        w_now, b_now = w + push * (w - w_seen), b + push * (b - b_seen)
        w_seen, b_seen, t_seen, least = w, b, t, now
    w, b = w_seen, b_seen
    return {name: float(x) for name, x in zip(names, w) if x}, float(b)


def toxicity_of(text: Column, model: ToxicityModel) -> Column:
    """The score of a text, a double from 0 to 1; a null text counts as empty."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: score_words(weights, bias, text)).astype(float)

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity``, a double from 0 to 1, for every row.

    Whole texts are read; null and empty texts get the score of a text without known words. Equal
    texts have equal scores. A column ``toxicity`` of ``docs`` is replaced.
    """
    return docs.withColumn("toxicity", toxicity_of(F.col("text"), model))


def drop_toxic(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all their columns, whatever their names."""
    return docs.filter(toxicity_of(F.col("text"), model) < least)


def train_part() -> Column:
    """The rows labels may be learned from."""
    return fold("doc_id", 5) != 0

"""Language of words, spans and documents: script ranges, word scores, Viterbi with a switch cost."""


from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, hash_share, letter_runs
from corpusloom.session import write_scratch

# --- Fixed values: first code points of script ranges; letters before the first are Latin. ---
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
# --- End of fixed values. ---

_STARTS = [s for s, _ in SCRIPT_STARTS]
WORDS_AT_ONCE = 300_000
CACHED_WORDS = 200_000


def script(letter: str) -> str:
    return SCRIPT_STARTS[bisect_right(_STARTS, ord(letter)) - 1][1]


@dataclass(frozen=True)
class LanguageParams:
    """About ``sample`` different texts of each language are learned from, chosen by a hash of the
    text; copies count once. The ``langs`` languages with most texts are learned, ties to the smaller name.
    Of each the ``grams`` most frequent letter n-grams are kept, fewer where all languages together
    would need more than ``cells`` scores."""

    sample: int = 1_500
    langs: int = 200
    grams: int = 20_000
    cells: int = 20_000_000
    order: int = 3
    switch: float = 8.0
    min_script_share: float = 0.01


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of letter n-grams by language, and the scripts each language is written in."""

    langs: tuple[str, ...]
    grams: dict[str, int]
    scores: np.ndarray  # one row per n-gram, the last one for n-grams not learned
    scripts: dict[str, np.ndarray]  # script: which languages use it
    order: int
    switch: float


def word_grams(word: str, order: int) -> list[str]:
    """The n-grams of a word between spaces, one ending at each letter and one at its end."""
    padded = " " + word + " "
    return [padded[max(0, i - order) : i] for i in range(2, len(padded) + 1)]


def fit_languages(docs: DataFrame, train: Column, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learn from ``docs(text, lang)`` where ``train`` holds and ``lang`` is not null.

    Grams, scripts and letters are counted over the whole texts of the sample by Spark, and the most
    frequent grams of all languages are found in one job. The tables that reach the driver are
    bounded by ``params.langs``, ``params.grams`` and ``params.cells``, however many values ``lang`` has.
    """
    known = docs.filter(train).filter("lang is not null and text is not null").select("lang", "text")
    texts = known.select("lang", F.xxhash64("text").alias("__text")).distinct()
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.orderBy(F.desc("__n"), "lang").limit(params.langs)
    shares = sizes.select("lang", F.least(F.lit(1.0), params.sample / F.col("__n")).alias("__share"))
    chosen = known.join(F.broadcast(shares), "lang").filter(hash_share(F.col("text"), F.col("__share")))
    chosen = chosen.select("lang", "text").distinct()
    order = params.order

    def count(batches):
        for batch in batches:
            tally: Counter = Counter()
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                for words in letter_runs(text.as_py()):
                    for word, n in Counter(words).items():
                        for gram in word_grams(word, order):
                            tally[lang, "g", gram] += n
                        for name in {script(c) for c in word}:
                            tally[lang, "s", name] += n * len(word)
            rows = list(tally.items())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k, _ in rows], pa.string()),
                    pa.array([k[1] for k, _ in rows], pa.string()),
                    pa.array([k[2] for k, _ in rows], pa.string()),
                    pa.array([n for _, n in rows], pa.int64()),
                ],
                ["lang", "kind", "item", "n"],
            )

    counted = (
        chosen.mapInArrow(count, "lang string, kind string, item string, n bigint")
        .groupBy("lang", "kind", "item")
        .agg(F.sum("n").alias("n"))
    )
    counted = write_scratch(counted, "grams")
    sums = counted.filter("kind = 'g'").groupBy("lang").agg(F.sum("n").alias("n")).collect()
    total = {r["lang"]: r["n"] for r in sums}
    langs = tuple(sorted(total))
    scripts = counted.filter("kind = 's'").collect()
    most: Counter = Counter()
    for r in scripts:
        most[r["lang"]] = max(most[r["lang"]], r["n"])
    used: dict[str, np.ndarray] = {}
    for r in scripts:
        if r["n"] >= params.min_script_share * most[r["lang"]]:
            used.setdefault(r["item"], np.zeros(len(langs), bool))[langs.index(r["lang"])] = True
    each = min(params.grams, params.cells // max(1, len(langs)) ** 2)
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    top = counted.filter("kind = 'g'").withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= each)
    rows: dict[str, list[tuple[str, int]]] = {lang: [] for lang in langs}
    for r in top.select("lang", "item", "n").collect():
        rows[r["lang"]].append((r["item"], r["n"]))
    grams = {g: i for i, g in enumerate(sorted({g for top in rows.values() for g, _ in top}))}
    counts = np.zeros((len(grams) + 1, len(langs)))
    for j, lang in enumerate(langs):
        for g, n in rows[lang]:
            counts[grams[g], j] = n
    size = np.array([total[lang] for lang in langs], dtype=float)
    scores = np.log((counts + 0.5) / (size + 0.5 * (len(grams) + 1)))
    return LanguageModel(langs, grams, scores, used, order, params.switch)


class _Scorer:
    """Scores of words by language, kept for words seen before."""

    def __init__(self, model: LanguageModel):
        self.model, self.rows = model, {}
        self.table = np.zeros((0, len(model.langs)))

    def __call__(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.rows})
        if new:
            if len(self.rows) + len(new) > CACHED_WORDS:
                self.rows, self.table = {}, self.table[:0]
                new = list(set(words))
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.table = np.concatenate([self.table, self._score(new)])
        return self.table[[self.rows[w] for w in words]]

    def _score(self, words: list[str]) -> np.ndarray:
        model = self.model
        lists = [word_grams(w, model.order) for w in words]
        get, unknown = model.grams.get, len(model.grams)
        ids = np.array([get(g, unknown) for grams in lists for g in grams])
        ends = np.cumsum([len(grams) for grams in lists])
        scores = np.add.reduceat(model.scores[ids], np.concatenate([[0], ends[:-1]]), axis=0)
        # Languages not written in the word's script stand far behind those that are.
        for i, word in enumerate(words):
            name = "latin" if word.isascii() else Counter(map(script, word)).most_common(1)[0][0]
            fits = model.scripts.get(name)
            if fits is not None and not fits.all():
                scores[i, ~fits] = scores[i].min() - 50.0
        return scores


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word of many texts; text i has rows ``starts[i]:starts[i + 1]``.

    All texts take a step at a time, longest first, so that a step is one array operation. Ties
    stay in the language, then go to the first one.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = starts[:-1][order], lengths[order]
    n_texts, longest = int((lengths > 0).sum()), int(lengths.max(initial=0))
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    switched = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)
    value = scores[begin[:n_texts]].copy()
    best[begin[:n_texts]] = value.argmax(axis=1)
    for t in range(1, longest):
        here = begin[: active[t]] + t
        value = value[: active[t]]
        top = value.max(axis=1, keepdims=True) - switch
        move = top > value
        switched[here] = move
        value = np.where(move, top, value) + scores[here]
        best[here] = value.argmax(axis=1)
    path = np.zeros(len(scores), np.int16)
    state = best[begin + np.maximum(lengths - 1, 0)] if len(scores) else best
    # Backwards: a text joins when the step reaches its last word.
    current = np.zeros(len(lengths), np.int16)
    for t in range(longest - 1, -1, -1):
        here = begin[: active[t]] + t
        ending = lengths[: active[t]] == t + 1
        current[: active[t]][ending] = state[: active[t]][ending]
        now = current[: active[t]]
        path[here] = now
        if t:
            moved = switched[here, now]
            now[moved] = best[here[moved] - 1]
    return path


def _label(model: LanguageModel, scorer: _Scorer, texts: list[str | None]):
    """Words, starts and the language of every word of some texts."""
    words: list[str] = []
    starts = [0]
    for text in texts:
        for run in letter_runs(text or ""):
            words += run
        starts.append(len(words))
    starts = np.array(starts)
    if not words:
        return starts, np.zeros(0, int), np.zeros(0, np.int16)
    letters = np.fromiter(map(len, words), np.int64, len(words))
    return starts, letters, viterbi(scorer(words), starts, model.switch)


def _groups(texts: list[str | None]):
    """Runs of texts with a bounded number of characters; a long text is one alone."""
    run, size = [], 0
    for text in texts:
        n = len(text or "")
        if run and size + n > 6 * WORDS_AT_ONCE:
            yield run
            run, size = [], 0
        run.append(text)
        size += n
    if run:
        yield run


def label_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_spans``.

    ``lang_spans`` are ``(lang, first, words)`` over the text's words, its runs of letters, in
    order. ``lang_pred`` is the language of most letters (ties to the smaller name), ``lang_score``
    their share. A null text and one without a letter are ``und`` with score 0 and no spans, as is
    every text if nothing was learned. Whole texts are labelled; equal texts alike. Columns of these
    three names in ``docs`` are replaced, all others stay.
    """
    langs = np.array(model.langs, dtype=object)

    def run(series_iter: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(model)
        for texts in series_iter:
            preds, scores, spans = [], [], []
            for group in _groups(list(texts)):
                starts, letters, path = _label(model, scorer, group) if len(langs) else ([0] * (len(group) + 1), None, None)
                for a, b in zip(starts[:-1], starts[1:]):
                    if a == b:
                        preds.append("und")
                        scores.append(0.0)
                        spans.append([])
                        continue
                    part = path[a:b]
                    weight = np.bincount(part, letters[a:b], minlength=len(langs))
                    preds.append(langs[weight.argmax()])
                    scores.append(float(weight.max() / weight.sum()))
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [b - a]])
                    spans.append([(langs[part[i]], int(i), int(j - i)) for i, j in zip(cuts[:-1], cuts[1:])])
            yield pd.DataFrame({"lang_pred": preds, "lang_score": scores, "lang_spans": spans})

    schema = "lang_pred string, lang_score double, lang_spans array<struct<lang string, first int, words int>>"
    label = F.pandas_udf(run, schema)
    new = ("lang_pred", "lang_score", "lang_spans")
    own = [c for c in docs.columns if c.lower() not in new]
    held = "__label" + "_" * max(map(len, own))  # longer than any other name
    labelled = docs.select(*own, label(F.col("text")).alias(held))
    return labelled.select(*own, *(F.col(held).getField(c).alias(c) for c in new))


def train_part() -> Column:
    """The rows languages may be learned from."""
    return fold("doc_id", 3) != 1

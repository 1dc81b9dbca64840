"""Spark ML's online LDA with the documents of a step inferred many at once.

Spark's optimizer infers one document after another. Here the steps, the documents that each draws and the
random starts are the same, and so are the topics but for rounding; only the inference within the tasks
is done by numpy over blocks of documents. A document ends by itself, so its result does not depend on
those beside it.
"""

from __future__ import annotations

import json
from math import ceil

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.linalg import DenseMatrix, MatrixUDT, Vectors, VectorUDT
from pyspark.serializers import NoOpSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import scratch_path

GAMMA_SHAPE = 100.0  # of the random starts
DRAWN_PER_TASK, LEAST_PER_TASK = 5_000, 250  # documents of a step that are best inferred together
DIRECT_BYTES = 1 << 25  # sums of all tasks that the driver adds up by itself
BLOCK = 4096  # terms whose sums travel together, beyond that


def _numerics():
    """``(psi, draws, infer)``, nested so that tasks get their code and need not have this package."""
    shape, cells_at_once, chunk = GAMMA_SHAPE, 1 << 14, 1 << 20

    def shifted(x):
        """``(w, c)`` with digamma(x) = log(w) + c: the recurrence up to w = x + 8, then the asymptotic series.

        Spark's digamma goes on to 49 and has one term of the other sign there. That error, 3e-9 at most, is
        added, as it decides now and then whether a document takes one more round.
        """
        z = x * (x + 7)
        q = z + 28
        for more in (252, 720):
            q *= z
            q += more
        c = 4 * z
        for more in (84, 504):
            c += more
            c *= z
        c += 720
        c *= 2 * x + 7
        q *= z
        c /= q  # the sum of 1 / x up to 1 / (x + 7)
        w = x + 8
        y = 1 / w
        c += 0.5 * y
        y *= y
        series = y * (691 / 32760)
        for less in (1 / 132, 1 / 240, 1 / 252, 1 / 120, 1 / 12):
            series -= less
            series *= -y
        c += series
        y = np.ceil(49 - x)
        np.maximum(y, 0, out=y)
        y += x
        y *= y
        np.reciprocal(y, out=y)
        c += y * y * (1 / 60 - y * (1 / 126))
        return w, np.negative(c, out=c)

    def psi(x):
        w, c = shifted(np.atleast_1d(x))
        return np.log(w) + c

    def draws(seed, n):
        """``n`` gamma variates of mean 1 by Marsaglia and Tsang, as Spark draws them from this seed."""
        twister = np.random.RandomState(np.array([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF], dtype=np.uint32))

        def more(size):
            raw = np.frombuffer(twister.bytes(8 * size), dtype="<u4").astype(np.int64) >> 6
            return ((raw[::2] << 26) | raw[1::2]) * 2.0**-52

        d = shape - 1 / 3
        c = 1 / np.sqrt(9 * d)

        def tried(x, u):
            v = (1 + c * x) ** 3
            with np.errstate(invalid="ignore", divide="ignore"):
                taken = (u < 1 - 0.0331 * x**4) | (np.log(u) < 0.5 * x * x + d * (1 - v + np.log(v)))
            return taken & (v > 0), d * v / shape

        def pair(x, y):
            r = np.sqrt(-2 * np.log(y))
            return r * np.cos(2 * np.pi * x), r * np.sin(2 * np.pi * x)

        out, left, have, at = [], n, more(2 * n + 64), 0
        while left > 0:
            rows = min(4096, (left + 1) // 2)
            if len(have) - at < 4 * rows + 64:
                have, at = np.concatenate([have[at:], more(4 * rows + 64)]), 0
            x, y, u1, u2 = have[at : at + 4 * rows].reshape(rows, 4).T
            first, second = pair(x, y)
            (ok1, g1), (ok2, g2) = tried(first, u1), tried(second, u2)
            good = ok1 & ok2
            n_good = rows if good.all() else int(good.argmin())
            out.append(np.stack([g1[:n_good], g2[:n_good]], axis=1).ravel())
            left, at = left - 2 * n_good, at + 4 * n_good
            if n_good < rows:  # a variate is refused: go on one at a time up to the end of a pair of normals
                spare = []
                while True:
                    if not spare:
                        spare, at = list(pair(have[at], have[at + 1]))[::-1], at + 2
                    normal = spare.pop()
                    if 1 + c * normal <= 0:
                        continue
                    ok, g = tried(normal, have[at])
                    at += 1
                    if ok:
                        out.append(np.array([g]))
                        left -= 1
                        if not spare:
                            break
                    if len(have) - at < 8:
                        have, at = np.concatenate([have[at:], more(64)]), 0
        return np.concatenate(out)[:n] if out else np.empty(0)

    def exp_log(gamma):
        """The exponentials of the expected logarithms of shares, a column for each document."""
        w, c = shifted(np.concatenate([gamma, gamma.sum(axis=0, keepdims=True)]))
        c -= c[-1] + np.log(w[-1])
        return np.exp(c[:-1]) * w[:-1]

    def infer(beta, alpha, ids, counts, lengths, starts):
        """``(gamma, theta, ratio)``: topic weights of documents, the exponentials of their expected logarithms, both
        with a column for each document, and a cell's count over its norm.

        The cells of the documents, none of 0, stand one after another. Documents of like length make a block.
        Those that end leave it; when few are left, these wait for those of the other blocks.
        """
        n, total, k = len(lengths), len(ids), beta.shape[1]
        ids, counts = np.append(ids, 0), np.append(counts, 0.0)  # what shorter rows of a block are filled up with
        first = np.cumsum(lengths) - lengths
        all_gamma, ratio = np.array(starts), np.empty(total + 1)
        all_theta, pool = exp_log(all_gamma), np.arange(n)
        while len(pool):
            pool = pool[np.argsort(lengths[pool], kind="stable")]
            parts = np.cumsum(lengths[pool]) // cells_at_once
            blocks, waiting = np.split(pool, np.flatnonzero(np.diff(parts)) + 1), [pool[:0]]
            for rows in blocks:
                at = np.arange(lengths[rows].max())
                at = np.where(at < lengths[rows][:, None], first[rows][:, None] + at, total)
                own, cts = np.ascontiguousarray(beta[ids[at]].transpose(0, 2, 1)), counts[at]
                gamma, theta = all_gamma[:, rows], all_theta[:, rows]
                norm = np.matmul(np.ascontiguousarray(theta.T)[:, None, :], own)[:, 0, :] + 1e-100
                open_, enough = np.ones(len(rows), dtype=bool), len(rows) // 4 if len(blocks) > 1 else 0
                while True:
                    before = gamma
                    gamma = theta * np.matmul(own, (cts / norm)[:, :, None])[:, :, 0].T + alpha[:, None]
                    theta = exp_log(gamma)
                    norm = np.matmul(np.ascontiguousarray(theta.T)[:, None, :], own)[:, 0, :] + 1e-100
                    ends = open_ & ~(np.abs(gamma - before).sum(axis=0) / k > 1e-3)
                    if not ends.any():
                        continue
                    all_gamma[:, rows[ends]], all_theta[:, rows[ends]] = gamma[:, ends], theta[:, ends]
                    ratio[at[ends]] = cts[ends] / norm[ends]
                    open_ &= ~ends
                    left = int(open_.sum())
                    if left <= enough:
                        all_gamma[:, rows[open_]], all_theta[:, rows[open_]] = gamma[:, open_], theta[:, open_]
                        waiting.append(rows[open_])
                        break
                    if 10 * left <= 7 * len(rows):
                        own, cts, norm, at, rows = own[open_], cts[open_], norm[open_], at[open_], rows[open_]
                        gamma, theta, open_ = gamma[:, open_], theta[:, open_], open_[open_]
            pool = np.concatenate(waiting)
        return all_gamma, all_theta, ratio[:total]

    def summed(rows, beta, alpha, seed):
        """``(sums, logs, drawn, used)`` of drawn documents: topics by terms, logarithms of shares, and numbers of
        documents with and without terms. ``rows`` are the bytes of ``pack``; copies follow one another."""
        cell, (size, k) = np.dtype([("id", "<i4"), ("n", "<f8")]), beta.shape
        sums, logs, drawn, used, starts = np.zeros((size, k)), np.zeros(k), 0, 0, {}

        def add(held, times):
            nonlocal used, logs
            lengths = np.array([len(h) for h in held]) // cell.itemsize
            cells = np.frombuffer(b"".join(held), dtype=cell)
            heads = np.cumsum(lengths) - lengths
            parts, inner = cells["id"][heads], np.ones(len(cells), dtype=bool)
            inner[heads] = False
            nonzero = np.add.reduceat((cells["n"] != 0) & inner, heads, dtype=np.int64) > 0
            inner &= np.repeat(nonzero, lengths)
            if not nonzero.any():
                return
            ids, counts = cells["id"][inner].astype(np.int64), cells["n"][inner]
            lengths, parts, times = lengths[nonzero] - 1, parts[nonzero], np.array(times)[nonzero]
            for p in set(parts.tolist()) - starts.keys():
                starts[p] = draws((seed + p) & 0xFFFFFFFFFFFFFFFF, k)
            gamma, theta, ratio = infer(beta, alpha, ids, counts, lengths, np.stack([starts[p] for p in parts.tolist()], axis=1))
            used += int(times.sum())
            logs = logs + (times * (psi(gamma) - psi(gamma.sum(axis=0)))).sum(axis=1)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            ratio = ratio * times[doc]
            for topic in range(k):
                sums[:, topic] += np.bincount(ids, weights=theta[topic, doc] * ratio, minlength=size)

        held, times, room = [], [], chunk * cell.itemsize
        for row in rows:
            drawn += 1
            if held and held[-1] == row:
                times[-1] += 1
                continue
            if room <= 0:
                add(held, times)
                held, times, room = [], [], chunk * cell.itemsize
            held.append(row)
            times.append(1)
            room -= len(row)
        if held:
            add(held, times)
        return sums, logs, drawn, used

    return psi, draws, summed


def _packed():
    """The function that packs documents, nested for the same reason."""
    import pyarrow as pa

    def pack(batches):
        """A document as bytes: its partition and its vector's size, then its cells of term and count."""
        for batch in batches:
            part, size, ids, counts = (batch.column(i) for i in range(4))
            ends = ids.offsets.to_numpy().astype(np.int64)
            n = len(batch)
            cells = np.zeros(int(ends[-1] - ends[0]) + n, dtype=[("id", "<i4"), ("n", "<f8")])
            heads = ends - ends[0] + np.arange(n + 1)
            inner = np.ones(len(cells), dtype=bool)
            inner[heads[:-1]] = False
            cells["id"][heads[:-1]], cells["n"][heads[:-1]] = part.to_numpy(), size.to_numpy()
            cells["id"][inner], cells["n"][inner] = ids.flatten().to_numpy(), counts.flatten().to_numpy()
            offsets = pa.py_buffer((heads * cells.itemsize).astype(np.int64).tobytes())
            docs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, offsets, pa.py_buffer(cells.tobytes())])
            yield pa.RecordBatch.from_arrays([docs.cast(pa.binary())], ["doc"])

    return pack


def _size(row: bytes) -> int:
    return int(np.frombuffer(row, dtype=[("id", "<i4"), ("n", "<f8")])["n"][0])


class BatchedLDA(LDA):
    """``LDA`` with the online optimizer, whose fit differs from Spark's in rounding alone."""

    def _fit(self, dataset: DataFrame) -> LDAModel:
        if self.getOptimizer() != "online":
            return super()._fit(dataset)
        vector = F.unwrap_udt(self.getFeaturesCol())
        ids, size = vector["indices"], F.coalesce(vector["size"], F.size(vector["values"]))
        every = F.transform(vector["values"], lambda _, i: i)  # of a dense vector
        part = F.spark_partition_id()
        docs = dataset.select(part.alias("part"), size.alias("size"), F.coalesce(ids, every).alias("ids"), vector["values"].alias("counts"))
        rows = docs.mapInArrow(_packed(), "doc binary").rdd.map(lambda row: bytes(row[0]))
        rows = rows._reserialize(NoOpSerializer()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n_docs = rows._jrdd.count()
            size = _size(rows.first()) if n_docs else 0
            if not size:
                return super()._fit(dataset)
            weights, alpha, eta = self._trained(rows, n_docs, size)
        finally:
            rows.unpersist()
        return self._model(dataset, weights, alpha, eta)

    def _trained(self, rows: RDD, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Topics by terms and the two priors."""
        sc, k, fraction = rows.context, self.getK(), self.getSubsamplingRate()
        prior = self.getDocConcentration() if self.isSet(self.docConcentration) else []
        alpha = np.array(prior if len(prior) == k > 1 else [prior[0] if prior else 1 / k] * k)
        eta = self.getTopicConcentration() if self.isSet(self.topicConcentration) else 1 / k
        # Spark's own sampler, as its optimizer calls it; that of PySpark draws other rows.
        stored = rows._jrdd
        n_parts = stored.getNumPartitions()
        expected, cores = n_docs * fraction, sc.defaultParallelism
        tasks = max(ceil(expected / DRAWN_PER_TASK), min(cores, ceil(expected / LEAST_PER_TASK)))
        tasks = max(1, min(n_parts, tasks))
        seeds = _java_longs(self.getSeed())
        psi, draws, summed = _numerics()
        weights = draws(next(seeds) & 0xFFFFFFFFFFFFFFFF, k * size).reshape(k, size)
        iteration, draw, tau, kappa = 0, next(seeds), self.getLearningOffset(), self.getLearningDecay()
        for _ in range(self.getMaxIter()):
            seed = next(seeds)
            beta = np.empty((size, k))
            for own, topic in zip(weights, range(k)):
                beta[:, topic] = np.exp(psi(own) - psi(own.sum()))
            drawn = stored.sample(True, fraction, draw)
            drawn = RDD(drawn.coalesce(tasks) if tasks < n_parts else drawn, sc, NoOpSerializer())
            sums, logs, n_drawn, used = _step(drawn, sc.broadcast(beta), alpha, seed, tasks, summed)
            if not n_drawn:  # Spark draws the documents anew and takes no step
                draw = seed
                continue
            draw, iteration = next(seeds), iteration + 1
            if not used:
                continue
            rho = (tau + iteration) ** -kappa
            weights = (1 - rho) * weights + rho * ((sums * beta).T * (n_docs / ceil(fraction * n_docs)) + eta)
            if self.getOptimizeDocConcentration():
                alpha = _next_alpha(alpha, logs / used, used, rho, psi)
        return weights, alpha, eta

    def _model(self, dataset: DataFrame, weights: np.ndarray, alpha: np.ndarray, eta: float) -> LDAModel:
        """The Spark ML model of these figures, in the form in which Spark ML stores models."""
        spark, path = dataset.sparkSession, scratch_path(dataset.sparkSession, "topics")
        self.write().save(f"{path}/estimator")
        about = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
        about["class"] = "org.apache.spark.ml.clustering.LocalLDAModel"
        about["paramMap"]["featuresCol"] = self.getFeaturesCol()
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
        kinds = T.StructType(
            [
                T.StructField("vocabSize", T.IntegerType()), T.StructField("topicsMatrix", MatrixUDT()),
                T.StructField("docConcentration", VectorUDT()), T.StructField("topicConcentration", T.DoubleType()),
                T.StructField("gammaShape", T.DoubleType()),
            ]
        )
        k, size = weights.shape
        row = (size, DenseMatrix(size, k, weights.ravel()), Vectors.dense(alpha), float(eta), GAMMA_SHAPE)
        spark.createDataFrame([row], kinds).coalesce(1).write.parquet(f"{path}/model/data")
        return LocalLDAModel.load(f"{path}/model")


def _step(drawn: RDD, shared, alpha: np.ndarray, seed: int, tasks: int, summed):
    """``(sums, logs, drawn, used)`` over all tasks.

    The sums of small vocabularies go to the driver as they are. Those of large ones are shuffled by blocks of
    terms first, so that the driver gets one matrix.
    """
    (size, k), block, direct = shared.value.shape, BLOCK, tasks * shared.value.nbytes <= DIRECT_BYTES

    def run(index, rows):
        sums, logs, n_drawn, used = summed(rows, shared.value, alpha, seed)
        yield -1, (index, logs.tobytes(), n_drawn, used)
        for b in range(0, size if used else 0, size if direct else block):
            own = sums[b : b + (size if direct else block)]
            known = np.flatnonzero(own.any(axis=1))
            yield b // block, (index, known.astype(np.int32).tobytes(), own[known].tobytes())

    def add(pairs):
        held = {}
        for b, (index, *values) in pairs:
            if b < 0:
                yield b, (index, *values)
            else:
                held.setdefault(b, []).append((index, values))
        for b, own in held.items():  # in the order of the tasks, so that sums of floats are the same in every run
            out = np.zeros((size if direct else min(block, size - b * block), k))
            for _, (known, values) in sorted(own):
                out[np.frombuffer(known, dtype=np.int32)] += np.frombuffer(values).reshape(-1, k)
            yield b, out

    pairs = drawn.mapPartitionsWithIndex(run)
    if not direct:
        pairs = pairs.partitionBy(ceil(size / block), lambda b: max(b, 0)).mapPartitions(add)
    found = pairs.collect()
    shared.destroy()
    sums, logs, n_drawn, used = np.zeros((size, k)), np.zeros(k), 0, 0
    for b, value in sorted(add(found) if direct else found, key=lambda pair: (pair[0], pair[0] < 0 and pair[1][0])):
        if b < 0:
            logs, n_drawn, used = logs + np.frombuffer(value[1]), n_drawn + value[2], used + value[3]
        else:
            sums[b * block : b * block + len(value)] = value
    return sums, logs, n_drawn, used


def _next_alpha(alpha: np.ndarray, logs: np.ndarray, n: int, rho: float, psi) -> np.ndarray:
    """A Newton step of the documents' prior, left out if a share of it would not be positive."""
    gradient = n * (psi(alpha.sum()) - psi(alpha) + logs)
    c, q = n * _trigamma(alpha.sum()), -n * _trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    stepped = alpha - rho * (gradient - b) / q
    return stepped if (stepped > 0).all() else alpha


def _trigamma(x):
    out, x = np.zeros_like(x), np.array(x, dtype=float)
    while (x < 49).any():
        out, x = out + np.where(x < 49, 1 / (x * x), 0), x + (x < 49)
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 + y / 42))


def _java_longs(seed: int):
    """The longs of ``java.util.Random``, which Spark takes its seeds from."""
    state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
    while True:
        value = 0
        for _ in range(2):
            state = (state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
            half = state >> 16
            value = (value << 32) + (half - (1 << 32) if half >> 31 else half)
        yield (value + (1 << 63)) % (1 << 64) - (1 << 63)

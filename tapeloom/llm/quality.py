"""Quality classifier: random Fourier features of text statistics, ridge, isotonic scores.

Each text gives ``len(NAMES)`` statistics. Standardised, they enter ``FEATURES`` random
Fourier features that approximate a Gaussian kernel. Normal equations are summed by
partition, then in ``SLOTS`` groups, so the driver adds a fixed number of matrices
whatever the input; it solves for ridge weights. Raw scores of the training rows are
counted in ``BINS`` bins, and an isotonic fit over them turns a raw score into the
share of label 1. All labelled training rows count; nothing is sampled.

Null text counts as empty and has a score like any other. Rows with a null label are
not learnt from; repeated rows count each time. Without training rows every score is
0.5. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.text import U, blocks, byte_sums, mix

NAMES = (
    "bytes", "words", "word length", "word length spread", "upper", "lower", "digits", "marks",
    "symbols", "bars", "exclamations", "beyond ascii", "blanks", "lines", "line length",
    "distinct words", "repeated lines", "words without letters", "commonest word",
)
FEATURES = 256
RIDGE = 1e-3
SLOTS = 32
BINS = 4096
SEED = 11


def _classes() -> np.ndarray:
    """For each byte value, which of the counted kinds it belongs to."""
    kinds = np.zeros((9, 256), bool)
    kinds[0, 65:91] = kinds[1, 97:123] = kinds[2, 48:58] = True
    kinds[3, [ord(c) for c in ".,;:'\"-()?"]] = True
    kinds[4, [ord(c) for c in "#$%&*@^~<>{}[]=+_\\/"]] = True
    kinds[5, ord("|")] = kinds[6, ord("!")] = True
    kinds[7, 128:] = True
    kinds[8, [9, 10, 11, 12, 13, 32]] = True
    return kinds


_KINDS = _classes()


def statistics(block) -> np.ndarray:
    """One row of statistics for each text of a block."""
    n = block.rows.num_rows
    size = np.diff(block.offsets)
    some = np.maximum(size, 1)

    def per_row(flags):
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[block.offsets])

    kinds = [per_row(k[block.data]) / some for k in _KINDS]
    words = block.words()
    length = words.end - words.start
    count = np.maximum(words.count, 1)
    mean = np.bincount(words.row, length, n) / count
    spread = np.sqrt(np.maximum(np.bincount(words.row, length.astype(float) ** 2, n) / count - mean**2, 0))
    letters = np.concatenate(([0], np.cumsum((_KINDS[0] | _KINDS[1] | _KINDS[7])[block.data])))
    bare = np.bincount(words.row, letters[words.end] == letters[words.start], n) / count
    salt = mix(np.arange(n, dtype=U) + U(1))
    _, first, times = np.unique(words.hash ^ salt[words.row], return_index=True, return_counts=True)
    distinct = np.bincount(words.row[first], minlength=n) / count
    top = np.zeros(n)
    np.maximum.at(top, words.row[first], times)

    # lines of each text, without the text's end
    newline = np.flatnonzero(block.data == 10)
    edge = np.union1d(newline + 1, block.offsets[:-1][size > 0])
    edge = edge[edge < len(block.data)]
    stop = np.minimum(np.append(edge[1:], len(block.data)), len(block.data))
    row = np.searchsorted(block.offsets[1:], edge, side="right")
    total, inverse = byte_sums(block.data)
    value = mix((total[stop] - total[edge]) * inverse[edge]) ^ salt[row]
    lines = np.bincount(row, minlength=n)
    _, first = np.unique(value, return_index=True)
    unique = np.bincount(row[first], minlength=n)
    return np.stack([
        np.log1p(size), np.log1p(words.count), mean, spread, *kinds,
        np.log1p(lines), np.log1p(size / np.maximum(lines, 1)),
        distinct, 1 - unique / np.maximum(lines, 1), bare, top / count,
    ], 1)


def text_statistics(docs: DataFrame) -> DataFrame:
    """The other columns of docs with a binary column stats (doubles, in the order of NAMES)."""
    others = [c for c in docs.columns if c.lower() not in ("text", "stats")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = np.ascontiguousarray(statistics(block))
            stats = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(c) for c in others] + [stats], names=[*others, "stats"])

    schema = docs.select(*others).schema.add("stats", "binary")
    return docs.select(*others, "text").mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("stats").to_pylist())).reshape(-1, len(NAMES))


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of a vector of fixed length: by task, by slot, on the driver."""
    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = part(batch)
                total = value if total is None else total + value
        if total is not None:
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_pydict({"slot": [slot], "v": pa.array([total.tobytes()], pa.binary())})

    def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v").to_pylist():
                value = np.frombuffer(v)
                total = value if total is None else total + value
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    slots = rows.mapInArrow(by_task, "slot long, v binary").repartition(SLOTS, "slot")
    found = [np.frombuffer(r.v) for r in slots.mapInArrow(by_slot, "v binary").collect()]
    return sum(found) if found else None


class Model:
    """Scaling, random features, ridge weights and isotonic steps."""

    def __init__(self, mean, scale, labels: float):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale, self.labels = mean, scale, labels
        self.w = rng.normal(0, 1 / np.sqrt(len(NAMES)), (len(NAMES), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.steps = np.array([0.0, 1.0]), np.array([labels, labels])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.append(np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1)), 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.steps)


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Nondecreasing shares of ones over ordered bins (pool adjacent violators)."""
    pools: list[list[float]] = []
    for n, y in zip(counts.tolist(), ones.tolist(), strict=True):
        pools.append([n, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, y2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + y2, pools[-1][2] + k2]
    return np.repeat([y / n for n, y, _ in pools], [k for _, _, k in pools])


def fit(training: DataFrame) -> Model:
    """Learn from rows of stats and label (0 or 1, no nulls)."""
    d = len(NAMES)
    moments = summed(training.select("stats", "label"), lambda b: np.concatenate((
        [b.num_rows, np.sum(b.column("label").to_numpy())],
        _matrix(b).sum(0), (_matrix(b) ** 2).sum(0))))
    if moments is None:
        return Model(np.zeros(d), np.ones(d), 0.5)
    n, positive, mean = moments[0], moments[1], moments[2 : 2 + d] / moments[0]
    scale = np.sqrt(np.maximum(moments[2 + d :] / n - mean**2, 1e-8))
    model = Model(mean, scale, positive / n)

    def normal(batch):
        x, y = model.features(_matrix(batch)), batch.column("label").to_numpy().astype(float)
        return np.concatenate(((x.T @ x).ravel(), x.T @ y))

    size = FEATURES + 1
    sums = summed(training.select("stats", "label"), normal)
    gram, right = sums[: size * size].reshape(size, size), sums[size * size :]
    model.beta = np.linalg.solve(gram + RIDGE * n / size * np.eye(size), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"bin": at, "label": batch.column("label").to_numpy().astype(np.int64)})

    rows = training.select("stats", "label").mapInArrow(binned, "bin long, label long").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).orderBy("bin").collect()
    share = isotonic(np.array([r.n for r in rows], float), np.array([r.y for r in rows], float))
    model.steps = (np.array([r.bin for r in rows]) + 0.5) / BINS * 2 - 0.5, share
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """The rows of text_statistics with score instead of stats."""
    others = [c for c in stats.columns if c.lower() not in ("stats", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in others] + [pa.array(model.score(_matrix(batch)))],
                names=[*others, "score"])

    return stats.mapInArrow(run, stats.select(*others).schema.add("score", "double"))

"""LM scoring: a log-bilinear model trained by noise-contrastive estimation.

Tokens are words with A-Z lower-cased, then one end. The symbols are all tokens that training
texts hold ``LEAST`` times or more (the ``WORDS`` commonest of them at most) and ``CLASSES``
classes of all other words, by their last two bytes; so the vocabulary grows with the texts.
Symbols fall into ``GROUPS`` groups of similar neighbours. The chance of a token is that of its
symbol's group after the symbol before it, times that of the symbol within its group after the
group of the symbol before. Both parts are log-bilinear: a context vector, taken through a
matrix in the first part, meets a target vector, with a bias for each target, and a
softmax normalises over the groups or over the group's symbols. Within a class a word has its
add-one share of the class's count, one more place standing for a word that was not seen.

Everything counted comes from all training texts and is summed in Spark: words, sketches of
each symbol's neighbours (random signs of ``SYMBOLS`` landmark symbols) that form the groups, and
how often each group follows each symbol and each symbol each group: at most ``GROUPS`` numbers of
each kind for a symbol. The model is trained in numpy on these: each step takes the
contrastive objective's expectation over data and noise in batched matrix products, so no
noise is drawn. The driver trains with the ``HEAD`` commonest words and the classes. What
all symbols share then stands, so the vectors of each other word follow from its own counts
alone: tasks find them, some words each. A symbol seen n times has n / (n + ``PRIOR``) of its own
counts, and its group's for the rest.

Scoring looks counts up in the task for the ``KNOWN`` commonest words at most (the size
bound of what is broadcast); other words are joined with the table of counts.

Null text: no words, so the end alone. A null doc_id counts as empty text in the fold.
Repeated rows each count and return. Words are told apart by 64-bit hashes. Without
training texts the groups are equally likely. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.text import U, blocks, mix, signed, staged

COMMON = 768
CLASSES = 256
#: Landmarks: the commonest words and all classes.
SYMBOLS = COMMON + CLASSES
#: Words with vectors of their own: how often they are seen at least, and how many at most.
LEAST, WORDS = 10, 1 << 17
#: Words whose counts the driver trains with.
HEAD = 1 << 13
GROUPS = 128
SKETCH = 16
KNOWN = 1 << 19
WIDTH = 32
NOISE = 10
STEPS, ROUNDS, BATCH = 300, 6, 1024
#: Steps that find the vectors of one more word.
MORE = 40
PRIOR = 20
#: Different pairs that a task holds before it passes them on.
PAIRS = 1 << 22
#: The hash that stands for the end of a text, and its class (it is common unless nothing is).
END, END_CLASS = U(0x5EED), 0


def _tokens(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and class of each token of a block, ends included, in order."""
    data = block.lower()
    words = block.words(data)
    n = block.rows.num_rows
    last = data[words.end - 1].astype(U)
    before = np.where(words.end - words.start > 1, data[np.maximum(words.end - 2, 0)], 0).astype(U)
    kind = (mix(last << U(8) | before) % U(CLASSES)).astype(np.int16)
    at = words.first + words.count + np.arange(n)  # places of the ends
    row = np.repeat(np.arange(n), words.count + 1)
    value = np.full(len(row), END, U)
    classes = np.full(len(row), END_CLASS, np.int16)
    word = np.ones(len(row), bool)
    word[at] = False
    value[word], classes[word] = words.hash, kind
    return row, value, classes


def count_words(docs: DataFrame) -> DataFrame:
    """h, n and class of each different token of the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            _, value, classes = _tokens(block)
            h, first, n = np.unique(value, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": signed(h), "n": n.astype(np.int64), "class": classes[first]})

    rows = docs.select("text").mapInArrow(run, "h long, n long, class short")
    return rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("class").alias("class"))


@dataclass
class Counts:
    """Sums of all counts, the known words' counts and symbols, and shares within classes."""

    tokens: int
    distinct: int
    h: np.ndarray
    n: np.ndarray
    symbol: np.ndarray
    size: np.ndarray  # log10 of what divides an add-one count in each class
    words: int  # words with a symbol of their own, commonest first; the classes' symbols follow

    @property
    def symbols(self) -> int:
        return self.words + CLASSES

    def look_up(self, value: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, count, symbol) of tokens."""
        rest = self.words + classes.astype(np.int64)
        if not len(self.h):
            return np.zeros(len(value), bool), np.zeros(len(value), np.int64), rest
        at = np.minimum(np.searchsorted(self.h, value), len(self.h) - 1)
        found = self.h[at] == value
        symbol = np.where(found & (self.symbol[at] >= 0), self.symbol[at], rest)
        return found, np.where(found, self.n[at], 0), symbol


def gather(counts: DataFrame) -> Counts:
    """What the tasks need of the table of counts."""
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # the least count that leaves no more than KNOWN words, on a scale of eighths of powers of two
    scale = F.floor(F.log2("n") * 8)
    least, words = None, 0
    for step, n in sorted(map(tuple, counts.groupBy(scale.alias("s")).agg(F.count(F.lit(1))).collect()), reverse=True):
        if words + n > KNOWN:
            break
        least, words = step, words + n
    known = counts.filter(scale >= least) if least is not None else counts.limit(0)
    table = known.select("h", "n", "class").toArrow()
    h, n, kind = (table.column(i).to_numpy() for i in range(3))
    h = np.ascontiguousarray(h).view(U)
    order = np.lexsort((h, -n))
    words = min(WORDS, int((n >= LEAST).sum()))
    symbol = np.full(len(h), -1, np.int64)
    symbol[order[:words]] = np.arange(words)
    sums = np.zeros((CLASSES, 2))
    for c, a, b in counts.groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():
        sums[c] = a, b
    own = order[:words]
    np.subtract.at(sums, kind[own].astype(np.int64), np.stack([n[own], np.ones(words)], 1))
    by = np.argsort(h)
    return Counts(total[0] or 0, total[1], h[by], n[by], symbol[by], np.log10(sums.sum(1) + 1), words)


def _contexts(row: np.ndarray, symbol: np.ndarray, end: int) -> np.ndarray:
    """The symbol before each token; the end's stands before a text's first."""
    context = np.concatenate(([end], symbol[:-1]))
    context[np.diff(row, prepend=-1) != 0] = end
    return context


def _end_symbol(counts: Counts) -> int:
    return int(counts.look_up(np.array([END]), np.array([END_CLASS]))[2][0])


def _symbols(docs: DataFrame, counts: Counts, schema: str, each) -> DataFrame:
    """Rows that ``each`` makes of the (context, symbol) pairs of a task's blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        end = _end_symbol(own)

        def pairs():
            for block in blocks(batches):
                row, value, classes = _tokens(block)
                symbol = own.look_up(value, classes)[2]
                yield _contexts(row, symbol, end), symbol

        yield from each(pairs())

    return docs.select("text").mapInArrow(run, schema)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values[:0]


def sketches(docs: DataFrame, counts: Counts) -> np.ndarray:
    """For each symbol the sum, over all the texts, of its neighbours' random signs."""
    symbols, words = counts.symbols, counts.words
    marks = np.r_[: min(COMMON, words), words:symbols]
    place = np.full(symbols, -1)
    place[marks] = np.arange(len(marks))
    signs = np.random.default_rng(3).choice(np.array([-1, 1], np.int32), (2, len(marks), SKETCH))

    def each(pairs) -> Iterator[pa.RecordBatch]:
        total = np.zeros((symbols, SKETCH), np.int64)
        for context, symbol in pairs:
            for i, (of, by) in enumerate(((symbol, context), (context, symbol))):
                near = place[by]
                marked = near >= 0
                at, sums = _summed(of[marked], signs[i][near[marked]])
                total[at] += sums
        at = np.flatnonzero(total.any(1))
        for i in range(0, len(at), 1 << 14):
            part = at[i : i + (1 << 14)]
            yield pa.RecordBatch.from_pydict({
                "symbol": part.astype(np.int32), **{f"s{j}": total[part, j] for j in range(SKETCH)}})

    names = [f"s{j}" for j in range(SKETCH)]
    rows = _symbols(docs, counts, "symbol int, " + ", ".join(f"{c} long" for c in names), each)
    table = rows.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((symbols, SKETCH))
    out[table.column("symbol").to_numpy()] = np.stack([table.column(c).to_numpy() for c in names], 1)
    return out


def groups(sketch: np.ndarray) -> np.ndarray:
    """The group of each symbol: those of like direction together, by k-means on the sphere."""
    rng = np.random.default_rng(4)
    size = np.linalg.norm(sketch, axis=1, keepdims=True)
    x = sketch / np.maximum(size, 1e-9)
    x = x - (x * np.sqrt(size)).sum(0) / max(np.sqrt(size).sum(), 1e-9)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weight = np.sqrt(size[:, 0]) + 1e-9
    centre = x[rng.choice(len(x), GROUPS, replace=len(x) < GROUPS, p=weight / weight.sum())]
    for _ in range(12):
        near = np.concatenate([(x[i : i + 8192] @ centre.T).argmax(1) for i in range(0, len(x), 8192)])
        sums = np.stack([np.bincount(near, x[:, j] * weight, GROUPS) for j in range(SKETCH)], 1)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centre)
    return near


class Sparse:
    """Counts by row and group, from sums by row * GROUPS + group; rows are given out dense."""

    def __init__(self, key: np.ndarray, n: np.ndarray, rows: int):
        order = np.argsort(key)
        self.key, self.n, self.shape = key[order], n[order].astype(np.float64), (rows, GROUPS)
        self.first = np.searchsorted(self.key, np.arange(rows + 1) * GROUPS)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        size = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out = np.zeros((len(rows), GROUPS))
        out[np.repeat(np.arange(len(rows)), size), self.key[at] % GROUPS] = self.n[at]
        return out

    def sum(self, axis: int) -> np.ndarray:
        by = self.key // GROUPS if axis else self.key % GROUPS
        return np.bincount(by, self.n, self.shape[1 - axis])


def count_neighbours(docs: DataFrame, counts: Counts, group: np.ndarray) -> DataFrame:
    """row, group, n: how often each group follows and precedes each symbol, over all the texts.

    Row 2 s is for what follows symbol s and row 2 s + 1 for what precedes it; row -1 - g
    is for what precedes group g.
    """
    def each(pairs) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting, count = [], 0

        def merged():
            return _summed(np.concatenate([keys, *waiting]), np.concatenate([n, np.ones(count, np.int64)]))

        def out():
            for i in range(0, len(keys), 1 << 16):
                row, other = np.divmod(keys[i : i + (1 << 16)], GROUPS)
                yield pa.RecordBatch.from_pydict({
                    "row": (row - GROUPS).astype(np.int32), "group": other.astype(np.int16), "n": n[i : i + (1 << 16)]})

        for context, symbol in pairs:
            before, own = group[context], group[symbol]
            waiting += [(GROUPS + 2 * context) * GROUPS + own, (GROUPS + 2 * symbol + 1) * GROUPS + before,
                        (GROUPS - 1 - own) * GROUPS + before]
            count += 3 * len(symbol)
            if count > PAIRS:
                keys, n = merged()
                waiting, count = [], 0
                if len(keys) > PAIRS:
                    yield from out()
                    keys, n = keys[:0], n[:0]
        keys, n = merged()
        yield from out()

    rows = _symbols(docs, counts, "row int, group short, n long", each)
    return rows.groupBy("row", "group").agg(F.sum("n").alias("n"))


def collected(rows: DataFrame, place: np.ndarray) -> tuple[Sparse, Sparse, np.ndarray]:
    """Counts of what follows and what precedes the symbols of rows, by their places, and of groups before groups."""
    table = rows.toArrow()
    row, group, n = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "group", "n"))
    size = int(place.max(initial=-1)) + 1
    out = []
    for side in (0, 1):
        own = (row >= 0) & (row % 2 == side)
        out.append(Sparse(place[row[own] // 2] * GROUPS + group[own], n[own], size))
    of_groups = np.zeros((GROUPS, GROUPS))
    of_groups[-1 - row[row < 0], group[row < 0]] = n[row < 0]
    return out[0], out[1], of_groups


class Adam:
    """Steps along the gradients of some rows of an array, with a pace for each number."""

    def __init__(self, values: np.ndarray):
        self.values, self.mean, self.square = values, np.zeros_like(values), np.zeros_like(values)
        self.steps = np.zeros(len(values), values.dtype)

    def step(self, grad: np.ndarray, rate: float, rows=slice(None)) -> None:
        self.steps[rows] += 1
        t = self.steps[rows].reshape(-1, *[1] * (self.values.ndim - 1))
        m = self.mean[rows] + 0.1 * (grad - self.mean[rows])
        v = self.square[rows] + 0.01 * (grad * grad - self.square[rows])
        self.mean[rows], self.square[rows] = m, v
        self.values[rows] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)


def _slope(logit: np.ndarray, shift, data: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Slope of the expected contrastive loss by the scores; data and noise are weights of the pairs."""
    true = 1 / (1 + np.exp(-np.clip(logit - shift, -40, 40)))
    return noise * true - data * (1 - true)


def _log_softmax(logit: np.ndarray) -> np.ndarray:
    top = logit.max(1, keepdims=True)
    return logit - top - np.log(np.exp(logit - top).sum(1, keepdims=True))


def _shrunk(n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Rows of counts with the chances of a prior mixed in; the sums stay."""
    total = n.sum(1, keepdims=True)
    return (n + PRIOR * prior) * total / (total + PRIOR)


def bilinear(neighbours, prior=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query vectors of the contexts (rows), vectors and biases of the targets (columns).

    prior gives each context's chances that its counts are mixed with.
    """
    rng = np.random.default_rng(5)
    rows, columns = neighbours.shape
    followed = neighbours.sum(0)
    noise = (followed + 1) / (followed.sum() + columns)
    context, matrix = Adam(rng.normal(0, 0.1, (rows, WIDTH))), Adam(np.eye(WIDTH))
    target, bias = Adam(rng.normal(0, 0.1, (columns, WIDTH))), Adam(np.log(noise))
    parts = -(-rows // BATCH)
    steps = max(STEPS, ROUNDS * parts)
    for step in range(steps):
        if step % parts == 0:
            order = rng.permutation(rows)
        own = order[step % parts :: parts]
        weight = neighbours[own]
        if prior is not None:
            weight = _shrunk(weight, prior(own))
        weight = weight / max(weight.sum(), 1.0)
        vectors = context.values[own]
        query = vectors @ matrix.values
        slope = _slope(query @ target.values.T + bias.values, np.log(NOISE * noise), weight,
                       NOISE * weight.sum(1, keepdims=True) * noise)
        through = slope @ target.values
        grads = through @ matrix.values.T, vectors.T @ through, slope.T @ query, slope.sum(0)
        rate = 0.05 * (1 - step / steps) + 0.002
        context.step(grads[0], rate, own)
        matrix.step(grads[1], rate)
        target.step(grads[2], rate)
        bias.step(grads[3], rate)
    return context.values @ matrix.values, target.values, bias.values


def train(neighbours: np.ndarray) -> np.ndarray:
    """log10 probability of each target after each context, from contrastive estimation."""
    query, target, bias = bilinear(neighbours)
    return _log_softmax(query @ target.T + bias) / np.log(10)


def within(before: Sparse, group: np.ndarray, noise: np.ndarray, of_groups: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the groups before, vectors and biases of the symbols at hand.

    before tells how often each of these symbols follows each group, noise its share of its
    group, of_groups how often each group follows each, be the symbols at hand or not.
    """
    rng = np.random.default_rng(6)
    members = [own for g in range(GROUPS) if len(own := np.flatnonzero(group == g))]
    context = Adam(rng.normal(0, 0.1, (GROUPS, WIDTH)))
    target, bias = Adam(rng.normal(0, 0.1, (len(group), WIDTH))), Adam(np.log(noise))
    rounds = 2 * ROUNDS
    for turn in range(rounds):
        rate = 0.05 * (1 - turn / rounds) + 0.002
        for g in rng.permutation(len(members)):
            own = members[g]
            chance = _chances(of_groups[group[own[0]]])
            total = max(of_groups[group[own[0]]].sum(), 1.0)
            vectors = target.values[own]
            slope = _slope(context.values @ vectors.T + bias.values[own], np.log(NOISE * noise[own]),
                           _shrunk(before[own], chance).T / total, NOISE * chance[:, None] * noise[own])
            grads = slope @ vectors, slope.T @ context.values, slope.sum(0)
            context.step(grads[0], rate)
            target.step(grads[1], rate, own)
            bias.step(grads[2], rate, own)
    return context.values, target.values, bias.values


def _chances(n: np.ndarray) -> np.ndarray:
    return n / max(n.sum(), 1.0)


def solve(start: np.ndarray, fixed: np.ndarray, offset, data: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Vectors (rows) whose scores with the fixed vectors lessen the contrastive loss, each for itself."""
    own = Adam(start.copy())
    for step in range(MORE):
        own.step(_slope(own.values @ fixed.T + offset, 0, data, noise) @ fixed, 0.1 * (1 - step / MORE) + 0.005)
    return own.values


def more_vectors(rows: DataFrame, parts, group: np.ndarray, noise: np.ndarray, of_groups: np.ndarray,
                 chances: np.ndarray, followed: np.ndarray) -> DataFrame:
    """symbol, query, vector: found from each symbol's rows of count_neighbours, 512 symbols at a time.

    parts are the start of each group's queries, the groups' vectors and biases, the start of
    each group's symbol vectors, and the vectors of the groups before.
    """
    shared = rows.sparkSession.sparkContext.broadcast(
        (*[x.astype(np.float32) for x in (*parts, noise, of_groups, chances, followed)], group))

    def run(table: pa.Table) -> pa.Table:
        query, target, bias, inner, left, noise, of_groups, chances, followed, group = shared.value
        row, other, n = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "group", "n"))
        symbol = np.unique(row // 2)
        dense = np.zeros((2, len(symbol), GROUPS), np.float32)
        dense[row % 2, np.searchsorted(symbol, row // 2), other] = n
        own = group[symbol]
        after = _shrunk(dense[0], chances[own])
        after /= np.maximum(after.sum(1, keepdims=True), 1)
        queries = solve(query[own], target, bias - np.log(NOISE * followed), after, NOISE * followed)
        usual = of_groups[own] / np.maximum(of_groups[own].sum(1, keepdims=True), 1)
        before = _shrunk(dense[1], usual)
        before /= np.maximum(before.sum(1, keepdims=True), 1)
        # the last number of a vector is its bias, less the logarithm of its share
        vectors = solve(inner[own], np.c_[left, np.ones(GROUPS, np.float32)], -np.log(np.float32(NOISE)), before, NOISE * usual)
        vectors[:, -1] += np.log(noise[symbol])
        return pa.table({
            "symbol": pa.array(symbol, pa.int32()),
            "query": pa.array([x.tobytes() for x in queries.astype("<f4")], pa.binary()),
            "vector": pa.array([x.tobytes() for x in vectors.astype("<f4")], pa.binary())})

    return rows.groupBy(F.shiftright("row", 10)).applyInArrow(run, "symbol int, query binary, vector binary")


@dataclass
class Model:
    """Natural logarithms throughout; vectors of a context are through the matrix."""

    group: np.ndarray
    after: tuple[np.ndarray, np.ndarray, np.ndarray]
    inside: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    def log10(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Normalised log10 chance of each symbol after its context."""
        seen = np.zeros(len(self.group), bool)
        seen[context] = True
        place = np.cumsum(seen) - 1
        query, target, bias = self.after
        chance = np.concatenate([
            _log_softmax(query[i] @ target.T + bias)
            for i in np.array_split(np.flatnonzero(seen), 1 + seen.sum() // 8192)])
        before, own = self.group[context], self.group[symbol]
        out = chance[place[context], own].astype(np.float64)
        left, right, bias, sums = self.inside
        for i in range(0, len(symbol), 1 << 16):
            part = slice(i, i + (1 << 16))
            out[part] += np.einsum("ij,ij->i", left[before[part]], right[symbol[part]])
        return (out + bias[symbol] - sums[own, before]) / np.log(10)


def _group_means(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    sums = np.zeros((GROUPS, values.shape[1]))
    np.add.at(sums, group, values)
    return sums / np.maximum(np.bincount(group, minlength=GROUPS), 1)[:, None]


def fit(docs: DataFrame, counts: Counts) -> Model:
    """The model of the texts, whose words gather has counted."""
    group = groups(sketches(docs, counts))
    rows = staged(count_neighbours(docs, counts, group), "neighbours")
    first = min(HEAD, counts.words)
    head = np.r_[:first, counts.words : counts.symbols]
    place = np.full(counts.symbols, -1)
    place[head] = np.arange(len(head))
    tail = (F.col("row") >= 2 * first) & (F.col("row") < 2 * counts.words)
    after, before, of_groups = collected(rows.filter(~tail), place)

    own = counts.symbol >= 0
    seen = np.ones(counts.symbols)
    seen[counts.symbol[own]] += counts.n[own]
    seen[counts.words :] += before.sum(1)[first:]
    noise = seen / np.bincount(group, seen, GROUPS)[group]
    chances = 10 ** train(of_groups.T)
    query, target, bias = bilinear(after, lambda some: chances[group[head[some]]])
    left, vector, inner = within(before, group[head], noise[head], of_groups)
    followed = of_groups.sum(1) + 1
    followed /= followed.sum()

    out = np.zeros((counts.symbols, WIDTH), np.float32), np.zeros((counts.symbols, WIDTH + 1), np.float32)
    out[0][head], out[1][head] = query, np.c_[vector, inner]
    start = np.c_[vector, inner - np.log(noise[head])]
    found = more_vectors(
        rows.filter(tail), (_group_means(query, group[head]), target, bias, _group_means(start, group[head]), left),
        group, noise, of_groups, chances, followed).toArrow()
    symbol = found.column("symbol").to_numpy()
    for values, name in zip(out, ("query", "vector"), strict=True):
        values[symbol] = np.frombuffer(b"".join(found.column(name).to_pylist()), "<f4").reshape(len(symbol), values.shape[1])

    sums = np.zeros((GROUPS, GROUPS), np.float32)
    for g in range(GROUPS):
        members = out[1][group == g]
        if len(members):
            logit = left @ members[:, :-1].T + members[:, -1]
            sums[g] = (logit - _log_softmax(logit))[:, 0]
    return Model(group, (out[0], target.astype(np.float32), bias.astype(np.float32)),
                 (left.astype(np.float32), out[1][:, :-1].copy(), out[1][:, -1].copy(), sums))


def scores(docs: DataFrame, held_out, table: DataFrame, counts: Counts, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    table is what count_words gives; held_out a boolean column over docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts, model))
    divisor = float(np.log10(counts.tokens + counts.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, model = shared.value
        end = _end_symbol(own)
        number = TaskContext.get().partitionId() << 40
        for block in blocks(batches):
            n = block.rows.num_rows
            row, value, classes = _tokens(block)
            found, count, symbol = own.look_up(value, classes)
            share = np.log10(count + 1)
            base = np.where(found, share - divisor, 0)
            score = model.log10(_contexts(row, symbol, end), symbol)
            score += np.where(found & (symbol >= own.words), share - own.size[classes], 0)
            salt = mix(np.arange(n, dtype=U) + U(1))
            rest = np.flatnonzero(~found)
            _, first, times = np.unique(
                value[rest] ^ salt[row[rest]], return_index=True, return_counts=True)
            first = rest[first]
            none = pa.nulls(len(first), pa.float64())
            yield pa.RecordBatch.from_pydict({
                "rid": np.arange(number, number + n),
                "doc_id": block.rows.column("doc_id"), "held_out": block.rows.column("held_out"),
                "n_tokens": np.bincount(row, minlength=n), "n_known": np.bincount(row, found, n).astype(np.int64),
                "base": np.bincount(row, base, n), "score": np.bincount(row, score, n),
                "h": pa.nulls(n, pa.int64()), "class": pa.nulls(n, pa.int32()), "times": pa.nulls(n, pa.int64()),
            })
            yield pa.RecordBatch.from_pydict({
                "rid": number + row[first],
                "doc_id": none.cast(pa.int64()), "held_out": none.cast(pa.bool_()),
                "n_tokens": none.cast(pa.int64()), "n_known": none.cast(pa.int64()),
                "base": none, "score": none,
                "h": signed(value[first]), "class": classes[first].astype(np.int32), "times": times.astype(np.int64),
            })
            number += n

    rows = staged(docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(
        run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double,"
             " score double, h long, class int, times long"), "scores")
    sizes = F.array(*[F.lit(float(x)) for x in counts.size])
    rare = rows.filter("times is not null").select("rid", "h", "class", "times").join(
        table.select("h", "n"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.log10(F.col("n") + 1)
    rare = rare.select(
        "rid", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * (share - divisor)).alias("base2"),
        (F.col("times") * (share - F.element_at(sizes, F.col("class") + 1))).alias("score2"),
    ).groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("known", "base2", "score2")])
    return rows.filter("times is null").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"),
    )


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """Learn from the rows of docs that are not held out, and score all."""
    training = docs.filter(~held_out)
    table = staged(count_words(training), "counts")
    counts = gather(table)
    return scores(docs, held_out, table, counts, fit(training, counts))

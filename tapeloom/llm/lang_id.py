"""Language ID by error-correcting output codes over byte n-grams.

Each language has a codeword of bits. One binary n-gram classifier for each bit tells
the languages with that bit set from the others: naive Bayes log-odds of hashed byte
trigrams, every language weighing the same. A text's codeword of margins is compared
with each language's by a logistic loss, each bit weighted by how well its classifier
separates that language (loss-weighted decoding). Texts whose two nearest languages
are close are flagged as ambiguous.

Training sums cover all training rows. They are map-side sums of (language, n-gram), packed to
one row for each language. The driver reads these rows one after another, twice, and adds
them to the bits they belong to: it holds the bits' n-grams and each language's codeword, never all
languages' n-grams, so there may be any number of languages.

Null texts and texts without a letter are ``und`` with score 0. If there is nothing to
learn from, every text is ``und``. Rows with a null lang are not learnt from. Repeated
rows count each time. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.text import U, blocks, mix, staged

GRAMS = 1 << 14
#: Languages up to which all different splits into two sets are used as bits.
EXHAUSTIVE = 6
#: How much farther the second language must be, as a share of all bits' weight.
MARGIN = 0.05
UNKNOWN = "und"


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def grams(block) -> np.ndarray:
    """The hashed trigram at each byte; GRAMS where the text ends or blanks meet."""
    data = _FOLD[block.data].astype(U)
    out = np.full(len(data), GRAMS, np.int64)
    if len(data) > 2:
        value = data[:-2] << U(16) | data[1:-1] << U(8) | data[2:]
        out[:-2] = (mix(value) % U(GRAMS)).astype(np.int64)
        blank = (data[:-2] == 32) & (data[1:-1] == 32) | (data[1:-1] == 32) & (data[2:] == 32)
        out[:-2][blank] = GRAMS
    for back in (1, 2):
        ends = block.offsets[1:] - back
        out[ends[ends >= 0]] = GRAMS
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram and n over all rows of (text, lang)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for block in blocks(batches):
            gram, langs = grams(block), block.rows.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                own = sums.setdefault(lang, np.zeros(GRAMS + 1, np.int64))
                part = gram[block.offsets[i] : block.offsets[i + 1]]
                if len(part) < 512:
                    np.add.at(own, part, 1)
                else:
                    own += np.bincount(part, minlength=GRAMS + 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own[:GRAMS])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(at), pa.string()), "gram": at.astype(np.int32), "n": own[at]})

    counts = docs.select("text", "lang").mapInArrow(run, "lang string, gram int, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def codebook(k: int) -> np.ndarray:
    """k codewords of +1 and -1: all splits of few languages, else spread random words."""
    if k < 2:
        return np.ones((k, 1))
    if k <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(columns, float).T
    rng = np.random.default_rng(k)
    size, best, least = 15 * int(np.ceil(np.log2(k))), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, size))
        code[:, np.abs(code.sum(0)) == k] = np.where(np.arange(k) % 2, 1.0, -1.0)[:, None]
        near = np.abs(code @ code.T - size * np.eye(k)).max()
        if size - near > least:
            best, least = code, size - near
    return best


class Model:
    """Codewords, n-gram weights of each bit, and weights of each language's bits.

    langs in order; shares() gives (number, share of each n-gram) of one language after another.
    """

    def __init__(self, langs: list[str], shares):
        self.langs = langs
        self.code = codebook(len(langs))
        on, off = np.zeros((2, self.code.shape[1], GRAMS))
        for i, share in shares():
            on[self.code[i] > 0] += share
            off[self.code[i] < 0] += share
        ons, offs = ((self.code * sign > 0).sum(0)[:, None] for sign in (1, -1))
        with np.errstate(invalid="ignore", divide="ignore"):
            weights = np.where((ons > 0) & (offs > 0), np.log((on / ons) / (off / offs)), 0)
        self.weight = np.append(weights, np.zeros((len(weights), 1)), 1).astype(np.float32)
        # mean margin of each bit over a language's own n-grams, in the right direction
        margin = np.zeros(self.code.shape)
        for i, share in shares():
            margin[i] = np.maximum(self.weight[:, :GRAMS] @ share * self.code[i], 1e-6)
        self.scale = 4 / margin.mean() if margin.size else 1.0
        self.trust = margin / margin.sum(1, keepdims=True) if margin.size else margin

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, score and whether another is close, for rows of margins."""
        set_, unset = (np.logaddexp(0, -sign * margins * self.scale) for sign in (1, -1))
        loss = set_ @ np.where(self.code > 0, self.trust, 0).T + unset @ np.where(self.code < 0, self.trust, 0).T
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        if len(self.langs) < 2:
            return best, np.ones(len(best)), np.zeros(len(best), bool)
        soft = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        rows = np.arange(len(best))
        gap = loss[rows, order[:, 1]] - loss[rows, best]
        return best, soft[rows, best] / soft.sum(1), gap < MARGIN


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language of rows in the order of lang: its n-grams and their numbers."""
    def row(lang, kept):
        gram, n = (np.concatenate(x) for x in zip(*kept, strict=True))
        return pa.RecordBatch.from_pydict({
            "lang": [lang], "gram": [gram.astype("<i4").tobytes()], "n": [n.astype("<i8").tobytes()]})

    lang, kept = None, []
    for batch in batches:
        runs = pc.run_end_encode(batch.column("lang"))
        at = 0
        for name, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if kept and name != lang:
                yield row(lang, kept)
                kept = []
            lang, part = name, batch.slice(at, stop - at)
            kept.append((part.column("gram").to_numpy(), part.column("n").to_numpy()))
            at = stop
    if kept:
        yield row(lang, kept)


def fit(docs: DataFrame) -> Model:
    """Learn from all rows of (text, lang) that have both."""
    rows = count_grams(docs.select("text", "lang").filter("lang is not null and text is not null"))
    packed = staged(rows.repartition("lang").sortWithinPartitions("lang", "gram").mapInArrow(
        _packed, "lang string, gram binary, n binary"), "grams").sort("lang")
    langs = [r.lang for r in packed.select("lang").toLocalIterator()]

    def shares():
        for i, (_, gram, n) in enumerate(packed.toLocalIterator()):
            count = np.zeros(GRAMS)
            count[np.frombuffer(gram, "<i4")] = np.frombuffer(n, "<i8")
            yield i, (count + 0.5) / (count.sum() + 0.5 * GRAMS)

    return Model(langs, shares)


def predict(block, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, of each text of a block."""
    gram = grams(block)
    known = np.concatenate(([0], np.cumsum(gram < GRAMS)))
    n = np.maximum(np.diff(known[block.offsets]), 1)
    margins = []
    for weight in model.weight:
        total = np.concatenate(([0.0], np.cumsum(weight[gram], dtype=np.float64)))
        margins.append(np.diff(total[block.offsets]) / n)
    letter = np.concatenate(([0], np.cumsum((_FOLD[block.data] != 32) & (block.data < 128))))
    letters = np.diff(letter[block.offsets]) > 0
    for i in np.flatnonzero(~letters):
        letters[i] = any(c.isalpha() for c in block.text(i).decode("utf-8", "replace"))
    if not model.langs:
        return [UNKNOWN] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
    best, score, close = model.decode(np.array(margins).T)
    pred = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters, strict=True)]
    return pred, np.where(letters, score, 0.0), close | ~letters


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous; columns of these names are replaced."""
    names = ["lang_pred", "score", "ambiguous"]
    others = [c for c in docs.columns if c.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            pred, score, close = predict(block, model)
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(c) for c in others] + [pa.array(pred, pa.string()), pa.array(score), pa.array(close)],
                names=others + names)

    schema = docs.select(*others).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")):
        schema = schema.add(name, kind)
    return docs.select(*others).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is known and not ambiguous, as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield block.rows.filter(pa.array(~predict(block, model)[2]))

    return docs.mapInArrow(run, docs.schema)

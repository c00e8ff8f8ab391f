"""Benchmark decontamination: item-sized windows of documents against benchmark items.

Words are taken with A-Z lower-cased; shingles have five words (all words of a shorter
item). A window has as many words as the item (all words of a shorter document). A
window without any shingle of an item has similarity zero to it, so windows are formed
only around shingles that some item holds. Their SimHash over 64 bits is compared with
the fingerprints of the items of that size: ``BLOCKS`` blocks of bits, of which at least
one has no more than ``RADIUS // BLOCKS`` differing bits if all have no more than
``RADIUS``; then all bits. Windows that pass are verified exactly: the weighted Jaccard
similarity of their shingles, repeats counted, must reach ``SIMILARITY``.

Items go to the tasks in groups of at most ``ITEM_WORDS`` words (the size bound of what
is broadcast); each group is one pass over the documents. There is no shuffle.

Null or empty text holds nothing; null or wordless items match nothing. Items with
equal texts each match. Repeated rows each return. Extra columns are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.text import U, Words, blocks

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BLOCKS = 8
ITEM_WORDS = 1_000_000
SCHEMA = "doc_id long, item_id long, similarity double, start long, n_words long"


def _words(text: str) -> Words:
    data = np.frombuffer(text.encode().lower(), np.uint8)
    return Words(data, np.array([0, len(data)]))


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Votes of each bit: +1 or -1."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), bitorder="little")
    return bits.reshape(-1, 64).astype(np.int32) * 2 - 1


class Items:
    """A group of items: shingles, sizes and fingerprints."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.size, self.shingle, self.hashes, self.fp = [], [], [], [], []
        for item_id, text in rows:
            words = _words(text)
            if not len(words):
                continue
            k = min(SHINGLE, len(words))
            hashes = words.shingles(k)[1]
            self.ids.append(item_id)
            self.size.append(len(words))
            self.shingle.append(k)
            self.hashes.append(hashes)
            self.fp.append(np.packbits(_bits(hashes).sum(0) > 0, bitorder="little").view(U)[0])
        #: for each shingle size, the hashes in order and the items of each
        self.index = {}
        for k in set(self.shingle):
            own = [i for i, x in enumerate(self.shingle) if x == k]
            pairs = np.unique(np.concatenate([
                np.stack([self.hashes[i], np.full(len(self.hashes[i]), i, U)], 1) for i in own]), axis=0)
            value, first = np.unique(pairs[:, 0], return_index=True)
            self.index[k] = value, np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)


def within_radius(windows: np.ndarray, item: np.uint64) -> np.ndarray:
    """Which windows' fingerprints are within the radius of the item's: blocks, then all bits."""
    differ = windows ^ item
    by_block = np.bitwise_count(differ[:, None].view(np.uint8))
    some = np.flatnonzero((by_block <= RADIUS // BLOCKS).any(1))
    return some[np.bitwise_count(differ[some]) <= RADIUS]


def similarity(window: np.ndarray, item: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    values, place = np.unique(np.concatenate([window, item]), return_inverse=True)
    a = np.bincount(place[: len(window)], minlength=len(values))
    b = np.bincount(place[len(window) :], minlength=len(values))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


def _search(words: Words, items: Items) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, start, words) of the best window of each matching pair."""
    for k, (values, first, owners) in items.index.items():
        start, hashes = words.shingles(k)
        at = np.minimum(np.searchsorted(values, hashes), len(values) - 1)
        hit = np.flatnonzero(values[at] == hashes)
        near = defaultdict(list)
        for place, v in zip(start[hit].tolist(), at[hit].tolist(), strict=True):
            row = int(words.row[place])
            for item in owners[first[v] : first[v + 1]].tolist():
                near[row, item].append(place)
        # shingles of one row are consecutive, so a window's shingles are a slice
        for (row, item), places in near.items():
            low, count = int(words.first[row]), int(words.count[row])
            size = min(items.size[item], count)
            last = low + count - size  # last start of a window
            need = SIMILARITY * len(items.hashes[item])
            base = int(np.searchsorted(start, low))
            for a, b in _regions(places, size - k, low, last):
                own = hashes[base + a - low : base + b - low + size - k + 1]
                total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(own), 0)])
                votes = total[size - k + 1 :] - total[: len(total) - (size - k + 1)]
                prints = np.packbits(votes > 0, axis=1, bitorder="little").view(U).ravel()
                best = (0.0, 0)
                for w in within_radius(prints, items.fp[item]).tolist():
                    window = own[w : w + size - k + 1]
                    if len(window) >= need:
                        best = max(best, (similarity(window, items.hashes[item]), -(a + w - low)))
                if best[0] >= SIMILARITY:
                    yield row, item, best[0], -best[1], size


def _regions(places: list[int], reach: int, low: int, last: int) -> Iterator[tuple[int, int]]:
    """First and last window start of each stretch of windows that hold one of the places."""
    a = b = None
    for place in places:
        x, y = max(place - reach, low), min(place, last)
        if x > y:
            continue
        if b is not None and x <= b + 1:
            b = max(b, y)
        else:
            if b is not None:
                yield a, b
            a, b = x, y
    if b is not None:
        yield a, b


def _found(block, items: Items) -> dict[tuple[int, int], tuple]:
    """(similarity, start, words) of the best window of each (row, item) of a block."""
    found: dict[tuple[int, int], tuple] = {}
    for row, item, value, start, size in _search(block.words(block.lower()), items):
        if value > found.get((row, item), (0.0,))[0]:
            found[row, item] = value, start, size
    return found


def _groups(benchmark: DataFrame) -> Iterator[Items]:
    rows, size = [], 0
    query = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null")
    for item_id, text in query.toLocalIterator():
        rows.append((item_id, text))
        size += len(text.split())
        if size >= ITEM_WORDS:
            yield Items(rows)
            rows, size = [], 0
    yield Items(rows)


def _leaks(docs: DataFrame, items: Items) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = _found(block, items)
            best = list(found.values())
            yield pa.RecordBatch.from_pydict({
                "doc_id": block.rows.column("doc_id").take(pa.array([r for r, _ in found], pa.int64())),
                "item_id": pa.array([items.ids[i] for _, i in found], pa.int64()),
                "similarity": pa.array([b[0] for b in best], pa.float64()),
                "start": pa.array([b[1] for b in best], pa.int64()),
                "n_words": pa.array([b[2] for b in best], pa.int64()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, and start and length in words of the best window."""
    return reduce(DataFrame.union, [_leaks(docs, g) for g in _groups(benchmark)])


def _without(docs: DataFrame, items: Items) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keep = np.ones(block.rows.num_rows, bool)
            keep[[r for r, _ in _found(block, items)]] = False
            yield block.rows.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, as they are."""
    return reduce(_without, _groups(benchmark), docs)

"""Substring dedup: word windows that occur more than once, found by difference-cover anchors.

A window is ``window`` consecutive words. Positions are sampled by a difference
cover modulo ``PERIOD``: for any two positions i and j there is a shift below the
period that takes both to cover positions. So two equal windows share an anchor
(a shorter window at a cover position) inside both, and only a quarter of all
positions are hashed and shuffled.

1. Anchor hashes are shuffled; those met more than once are sent back to the texts.
2. Extension: a text forms the whole windows around its repeated anchors. Windows
   with the same smallest 12-word hash travel together, so a window costs about
   ten bytes; windows met more than once are sent back.
3. Each text drops the words that repeated windows cover.

All three steps read one shuffle of the distinct texts. Nothing is staged; a lost
executor costs the usual retry of a stage.

Null text: no words. Fewer words than the window: nothing is removed. Repeated
rows: each row is a document, so a text of at least one window that several rows
hold goes as a whole. A null doc_id changes nothing. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.repeats import Known
from tapeloom.llm.text import (
    U, blocks, distinct_texts, flat, lists, longs, mix, rolling, signed,
)

WINDOW = 35
PERIOD = 21
#: Every difference modulo 21 is a difference of two of these.
COVER = [0, 1, 4, 14, 16]
#: Words of the hash by which whole windows travel.
CARRIER = 12


def _anchors(words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes and hashes at cover positions; anchors fit in every shift of a window."""
    start, value = words.shingles(window - PERIOD + 1)
    keep = np.isin(words.number[start] % PERIOD, COVER)
    return start[keep], value[keep]


def _per_row(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values grouped by row: the rows that have any, values in row order, their counts."""
    order = np.argsort(rows, kind="stable")
    counts = np.bincount(rows, minlength=n)
    has = np.flatnonzero(counts)
    return has, values[order], counts[has]


def send_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for block in blocks(batches):
            words = block.words()
            at, value = _anchors(words, window)
            if not len(at):
                continue
            repeated, send, marked = known.split(value)
            t1, t2 = longs(block.rows, "t1"), longs(block.rows, "t2")
            row = words.row[at]
            yield pa.RecordBatch.from_pydict({
                "h": signed(value[send]), "t1": t1[row[send]], "t2": t2[row[send]],
                "known": marked[send], "found": pa.nulls(int(send.sum()), pa.list_(pa.int64())),
            })
            has, values, counts = _per_row(row[repeated], signed(value[repeated]), len(t1))
            yield pa.RecordBatch.from_pydict({
                "h": t1[has], "t1": t1[has], "t2": t2[has], "known": np.ones(len(has), bool),
                "found": lists(values, counts, pa.int64()),
            })
    return run


def _runs(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of consecutive starts within a row."""
    fresh = np.flatnonzero(np.diff(starts, prepend=-2) != 1) if len(starts) else np.empty(0, int)
    if len(starts):
        fresh = np.union1d(fresh, np.flatnonzero(np.diff(rows, prepend=-1) != 0))
    return fresh, np.diff(np.append(fresh, len(starts)))


def send_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for block in blocks(batches):
            words = block.words()
            t1, t2 = longs(block.rows, "t1"), longs(block.rows, "t2")
            at, value = _anchors(words, window)
            found, owner = flat(block.rows.column("found"))
            salt = mix(np.arange(len(t1), dtype=U) + U(1))
            hit = at[np.isin(value ^ salt[words.row[at]], found.view(U) ^ salt[owner])]
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(hit - PERIOD + 1, 0), 1)
            np.add.at(near, hit + 1, -1)
            start, value = words.shingles(window)
            keep = np.cumsum(near)[start] > 0
            start, value = start[keep], value[keep]
            if not len(start):
                continue
            row = words.row[start]
            repeated, send, marked = known.split(value, longs(block.rows, "copies")[row] > 1)

            # the smallest short hash in each window, the leftmost of equal ones
            short = rolling(words.hash, CARRIER)
            bits = U(int(len(short)).bit_length())
            best = (short >> bits << bits) | np.arange(len(short), dtype=U)
            width, span = 1, window - CARRIER + 1
            while width * 2 <= span:
                best, width = np.minimum(best[:-width], best[width:]), width * 2
            best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
            place = (best[start[send]] & ((U(1) << bits) - U(1))).astype(np.int64)

            number = words.number[start].astype(np.int32)
            fresh = np.flatnonzero(np.diff(place, prepend=-1) != 0)
            sizes = np.diff(np.append(fresh, len(place)))
            mine = row[send][fresh]
            yield pa.RecordBatch.from_pydict({
                "g": signed(short[place[fresh]]), "t1": t1[mine], "t2": t2[mine],
                "pos": lists(np.where(marked, -1, number)[send], sizes, pa.int32()),
                "h": lists(signed(value[send]), sizes, pa.int64()),
                "runs": pa.nulls(len(fresh), pa.list_(pa.int32())),
            })
            fresh, sizes = _runs(start[repeated], row[repeated])
            pairs = np.stack([number[repeated][fresh], sizes], 1).astype(np.int32)
            has, pairs, counts = _per_row(row[repeated][fresh], pairs, len(t1))
            none = np.zeros(len(has), np.int64)
            yield pa.RecordBatch.from_pydict({
                "g": t1[has], "t1": t1[has], "t2": t2[has],
                "pos": lists(np.empty(0), none, pa.int32()),
                "h": lists(np.empty(0), none, pa.int64()),
                "runs": lists(pairs.ravel(), counts * 2, pa.int32()),
            })
    return run


def drop_words(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = block.words()
            pairs, owner = flat(block.rows.column("runs"))
            first, size = words.first[owner[::2]] + pairs[::2], pairs[1::2]
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + size + window - 1, -1)
            gone = np.cumsum(cover)[:-1] > 0
            whole = (longs(block.rows, "copies") > 1) & (words.count >= window)
            gone |= whole[words.row]
            removed = np.bincount(words.row[gone], minlength=len(words.count))
            kept = []
            for i, n in enumerate(removed):
                parts = block.text(i).split()
                if n:
                    a = words.first[i]
                    parts = [w for w, x in zip(parts, gone[a : a + len(parts)], strict=True) if not x]
                kept.append(b" ".join(parts))
            yield pa.RecordBatch.from_pydict({
                "t1": block.rows.column("t1"), "t2": block.rows.column("t2"),
                "n_words": words.count.astype(np.int64), "n_removed": removed.astype(np.int64),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            })
    return run


def kept_by_text(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """t1, t2, n_words, n_removed and kept_text for each distinct text.

    kept_text holds the kept words joined by one space.
    """
    if window < PERIOD + CARRIER:
        raise ValueError(f"window must be at least {PERIOD + CARRIER} words")
    texts = distinct_texts(docs)
    key = ["t1", "t2"]
    anchors = texts.mapInArrow(
        send_anchors(window), "h long, t1 long, t2 long, known boolean, found array<long>")
    seen = F.count(F.when(F.col("found").isNull(), 1)).over(Window.partitionBy("h"))
    found = (
        anchors.withColumn("n", seen)
        .filter("found is not null or (not known and n > 1)")
        .select(*key, F.coalesce("found", F.array("h")).alias("found"))
        .groupBy(*key).agg(F.flatten(F.collect_list("found")).alias("found"))
    )
    windows = texts.join(found, key).mapInArrow(
        send_windows(window),
        "g long, t1 long, t2 long, pos array<int>, h array<long>, runs array<int>")
    one = (
        windows.repartition("g")
        .select("g", *key, "runs", F.explode_outer(F.arrays_zip("pos", "h")).alias("w"))
        .select("g", *key, "runs", "w.pos", "w.h")
    )
    runs = (
        one.withColumn("n", F.count("h").over(Window.partitionBy("g", "h")))
        .filter("runs is not null or (pos >= 0 and n > 1)")
        .select(*key, F.coalesce("runs", F.array("pos", F.lit(1))).alias("runs"))
        .groupBy(*key).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    )
    return texts.join(runs, key, "left").mapInArrow(
        drop_words(window), "t1 long, t2 long, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with text replaced by its kept words.

    A text without a repeated window, and a null one, stays as it was, blanks included.
    """
    changed = kept_by_text(docs, window).filter("n_removed > 0").select("t1", "t2", "kept_text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = F.col(f"c{docs.columns.index('text')}")
    text = F.coalesce(own, F.lit(""))
    rows = plain.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)})
    joined = rows.join(changed, ["t1", "t2"], "left")
    columns = [F.coalesce("kept_text", own) if c == "text" else F.col(f"c{i}")
               for i, c in enumerate(docs.columns)]
    return joined.select(*columns).toDF(*docs.columns)

"""Suffix-array dedup: byte strings that occur more than once, from a common-prefix interval tree.

``length`` bytes make a window. The suffix array of a whole corpus does not fit a
task, so it is built in parts that hold all occurrences of what they hold:

1. Each window has a minimizer, the smallest hash of ``GRAM`` bytes in it. Equal
   windows have equal minimizers, so minimizers met once rule out their windows.
2. Runs of windows with one repeated minimizer travel to it as one segment of at
   most ``2 * length - GRAM`` bytes. Equal segments are collapsed: all but the
   first are answered whole.
3. Over the different segments of a minimizer a suffix array with common-prefix
   lengths is sorted. A stack scan closes its intervals; those of at least
   ``length`` common bytes whose left extensions differ are the maximal repeats.
   Every occurrence but the first of each is removed. The start of a segment
   counts as different on its left, since what precedes lies in another part.
4. Each text drops the removed bytes.

A minimizer with more than ``GROUP`` different segments is not gathered: its
segments go on as single windows, which a window function ranks.

Null text: empty. Texts shorter than a window keep everything. Order is doc_id (null
first), then the text's key, then the start. Rows with the same doc_id and text are one
document met twice and have the same result; another row with the same text is a
later copy. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.repeats import Known
from tapeloom.llm.text import (
    U, blocks, byte_sums, distinct_texts, flat, lists, longs, mix, signed,
)

LENGTH = 100
GRAM = 50
#: Different segments of one minimizer that a task holds at once.
GROUP = 20_000
#: Segments whose suffixes are sorted together.
TOGETHER = 8_192
#: Bytes of one long text handled at a time.
PART = 1 << 20


class Runs:
    """Runs of windows with one minimizer: row, first window, windows, hash, and place in the bytes."""

    def __init__(self, block, length: int):
        found = [self._part(block.data, block.offsets, at, length)
                 for at in range(0, max(1, len(block.data)), 2 * PART)]
        self.row, self.start, self.count, self.hash, self.at = (
            np.concatenate([p[i] for p in found]) for i in range(5))

    @staticmethod
    def _part(data, offsets, at, length):
        """Windows that start in [at, at + 2 * PART)."""
        none = np.empty(0, np.int64)
        piece = data[at : at + 2 * PART + length - 1]
        if len(piece) < length:
            return none, none, none, np.empty(0, U), none
        total, inverse = byte_sums(piece)
        gram = mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(piece) - GRAM + 1])
        bits = U(int(len(gram)).bit_length())
        best = (gram >> bits << bits) | np.arange(len(gram), dtype=U)
        width, span = 1, length - GRAM + 1
        while width * 2 <= span:
            best, width = np.minimum(best[:-width], best[width:]), width * 2
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
        place = (best & ((U(1) << bits) - U(1))).astype(np.int64)
        stops = offsets[1:-1] - at
        cross = np.zeros(len(place) + 1, np.int64)  # windows over the end of a text
        np.add.at(cross, np.clip(stops - length + 1, 0, len(place)), 1)
        np.add.at(cross, np.clip(stops, 0, len(place)), -1)
        inside = np.cumsum(cross)[:-1] == 0
        place = np.where(inside, place, -1)
        fresh = np.flatnonzero(np.diff(place, prepend=-2) != 0)
        sizes = np.diff(np.append(fresh, len(place)))
        good = place[fresh] >= 0
        fresh, sizes = fresh[good], sizes[good]
        row = np.searchsorted(offsets[1:], fresh + at, side="right")
        return row, fresh + at - offsets[row], sizes, gram[place[fresh]], fresh + at


def send_minimizers(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for block in blocks(batches):
            runs = Runs(block, length)
            if not len(runs.row):
                continue
            repeated, send, marked = known.split(runs.hash)
            t1, t2, row = longs(block.rows, "t1"), longs(block.rows, "t2"), runs.row
            yield pa.RecordBatch.from_pydict({
                "h": signed(runs.hash[send]), "t1": t1[row[send]], "t2": t2[row[send]],
                "known": marked[send], "found": pa.nulls(int(send.sum()), pa.list_(pa.int64())),
            })
            counts = np.bincount(row[repeated], minlength=len(t1))
            has = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "h": t1[has], "t1": t1[has], "t2": t2[has], "known": np.ones(len(has), bool),
                "found": lists(signed(runs.hash[repeated]), counts[has], pa.int64()),
            })
    return run


def send_segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            runs = Runs(block, length)
            names = ("t1", "t2", "first_id")
            t1, t2, first_id = (longs(block.rows, x) for x in names)
            found, owner = flat(block.rows.column("found"))
            salt = mix(np.arange(len(t1), dtype=U) + U(1))
            keep = np.flatnonzero(np.isin(runs.hash ^ salt[runs.row], found.view(U) ^ salt[owner]))
            if not len(keep):
                continue
            order = np.lexsort((t2, t1, first_id))
            rank = np.empty(len(t1), np.int64)
            rank[order] = np.arange(len(t1))
            keep = keep[np.lexsort((runs.start[keep], rank[runs.row[keep]]))]
            row, start, size = runs.row[keep], runs.start[keep], runs.count[keep] + length - 1
            at = runs.at[keep]
            texts = [block.data[a : a + n].tobytes() for a, n in zip(at, size, strict=True)]
            seen: dict[bytes, None] = {}
            first = np.zeros(len(texts), bool)
            for i, x in enumerate(texts):
                if x not in seen:
                    seen[x] = None
                    first[i] = True
            sent = np.flatnonzero(first)
            mine = row[sent]
            yield pa.RecordBatch.from_pydict({
                "g": signed(runs.hash[keep][sent]),
                "segment": pa.array([texts[i] for i in sent], pa.binary()),
                "first_id": first_id[mine], "t1": t1[mine], "t2": t2[mine],
                "start": start[sent], "gone": pa.nulls(len(sent), pa.list_(pa.int64())),
            })
            rest = np.flatnonzero(~first)
            counts = np.bincount(row[rest], minlength=len(t1))
            rest = rest[np.argsort(row[rest], kind="stable")]
            has = np.flatnonzero(counts)
            spans = np.stack([start[rest], start[rest] + size[rest]], 1)
            yield pa.RecordBatch.from_pydict({
                "g": t1[has], "segment": pa.nulls(len(has), pa.binary()),
                "first_id": first_id[has], "t1": t1[has], "t2": t2[has],
                "start": np.zeros(len(has), np.int64),
                "gone": lists(spans.ravel(), counts[has] * 2, pa.int64()),
            })
    return run


def maximal_repeats(segments: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes, segments, starts) of each maximal repeat of at least length bytes.

    The suffixes that are windows of a segment are sorted with their common-prefix
    lengths; a stack scan closes the intervals from the deepest outwards.
    """
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(segments)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    width = int(sizes.max())
    data = np.full((len(segments), 2 * width + 1), 0xFF, np.uint8)
    for i, x in enumerate(segments):
        data[i, : len(x)] = np.frombuffer(x, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(data, width + 1, axis=1)
    suffix = np.ascontiguousarray(view[owner, start])  # ends in 0xFF, which UTF-8 never holds
    order = np.argsort(suffix.view(f"S{width + 1}").ravel(), kind="stable")
    suffix, owner, start = suffix[order], owner[order], start[order]
    left = sizes[owner] - start
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.minimum(common, np.minimum(left[1:], left[:-1]))
    before = np.where(start == 0, -1, data[owner, start - 1].astype(np.int64))

    deep = common >= length
    keep = np.flatnonzero(np.append(deep, False) | np.insert(deep, 0, False))
    if not len(keep):
        return
    lcp = np.where(np.isin(keep + 1, keep), np.append(common, 0)[keep], 0)
    lcp = np.where(lcp >= length, lcp, 0).tolist()
    owner, start, before = owner[keep], start[keep], before[keep].tolist()
    # stack of [common bytes, first leaf, symbol on the left or -1 where they differ]
    stack: list[list[int]] = []
    for i, depth in enumerate(lcp):  # depth: common bytes of leaf i and leaf i + 1
        symbol, first = before[i], i
        while stack and stack[-1][0] > depth:
            size, first, own = stack.pop()
            symbol = own if own == symbol else -1
            if symbol == -1:
                yield size, owner[first : i + 1], start[first : i + 1]
        if depth:
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != symbol:
                    stack[-1][2] = -1
            else:
                stack.append([depth, first, symbol])


def _later(rows: list[tuple], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(t1, t2, from, to) of all but the first occurrence of each maximal repeat."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][1:])
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    spans: dict[int, list[tuple[int, int]]] = {}
    for size, owner, start in maximal_repeats([r[0] for r in rows], length):
        # segments of one text may overlap, so the order is that of the texts, then of the bytes
        keys = [(rows[o][1:4], rows[o][4] + s) for o, s in zip(owner.tolist(), start.tolist(), strict=True)]
        least = min(keys)
        for o, s, key in zip(owner.tolist(), start.tolist(), keys, strict=True):
            if key != least:
                spans.setdefault(o, []).append((s, s + size))
    for o, found in spans.items():
        found.sort()
        _, _, t1, t2, at = rows[o]
        a, b = found[0]
        for x, y in found[1:]:
            if x > b:
                yield t1, t2, at + a, at + b
                a, b = x, y
            b = max(b, y)
        yield t1, t2, at + a, at + b


def scan_intervals(length: int):
    """Rows sorted by (g, segment, rank); one answer row for each removed span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], [], []]  # t1, t2, from, to, first_id, segment

        def answer(t1, t2, a, b, first_id=None, segment=None):
            for column, value in zip(out, (t1, t2, a, b, first_id, segment), strict=True):
                column.append(value)

        def flush():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(out[5], pa.binary())],
                names=["t1", "t2", "from", "to", "first_id", "segment"])
            for column in out:
                column.clear()
            return batch

        ready: list[tuple] = []  # whole groups
        group: list[tuple] = []
        now, over = None, False

        def close():
            if len(group) > 1:
                ready.extend(group)
            group.clear()

        def pass_on(rows):
            for segment, first_id, t1, t2, start in rows:
                answer(t1, t2, start, start + len(segment), first_id, segment)

        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in
                       ("g", "segment", "first_id", "t1", "t2", "start", "gone", "rank"))
            for g, segment, first_id, t1, t2, start, gone, rank in zip(*columns, strict=True):
                if gone is not None:
                    for a, b in zip(gone[::2], gone[1::2], strict=True):
                        answer(t1, t2, a, b)
                    continue
                if g != now:
                    close()
                    now, over = g, False
                    if len(ready) >= TOGETHER:
                        for x in _later(ready, length):
                            answer(*x)
                        ready = []
                if rank > 1:
                    answer(t1, t2, start, start + len(segment))
                elif over:
                    pass_on([(segment, first_id, t1, t2, start)])
                else:
                    group.append((segment, first_id, t1, t2, start))
                    if len(group) > GROUP:
                        pass_on(group)
                        group.clear()
                        over = True
            if len(out[0]) >= 8192:
                yield flush()
        close()
        for x in _later(ready, length) if ready else ():
            answer(*x)
        yield flush()
    return run


def drop_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            values, owner = flat(block.rows.column("gone"))
            base = block.offsets[:-1]
            cover = np.zeros(len(block.data) + 1, np.int64)
            np.add.at(cover, base[owner[::2]] + values[::2], 1)
            np.add.at(cover, base[owner[::2]] + values[1::2], -1)
            gone = np.cumsum(cover)[:-1] > 0
            fresh = np.zeros(len(gone) + 1, bool)
            fresh[base] = True
            starts = np.flatnonzero(gone & (fresh[:-1] | ~np.concatenate(([False], gone[:-1]))))
            row = np.searchsorted(block.offsets[1:], starts, side="right")
            n = len(base)
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[block.offsets[1:]] - total[block.offsets[:-1]]
            kept = []
            for i, some in enumerate(removed):
                part = slice(block.offsets[i], block.offsets[i + 1])
                kept.append((block.data[part][~gone[part]] if some else block.data[part]).tobytes())
            yield pa.RecordBatch.from_pydict({
                "t1": block.rows.column("t1"), "t2": block.rows.column("t2"),
                "first_id": block.rows.column("first_id"),
                "n_bytes": np.diff(block.offsets), "n_removed": removed.astype(np.int64),
                "n_spans": np.bincount(row, minlength=n).astype(np.int64),
                "kept": pa.array(kept, pa.binary()),
            })
    return run


def kept_by_text(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """t1, t2, first_id, n_bytes, n_removed, n_spans and kept bytes for each distinct text.

    These hold for the row that comes first (first_id); later rows with the same text
    lose all of it if it has a window.
    """
    if not GRAM < length <= 2 * GRAM:
        raise ValueError(f"length must be over {GRAM} and at most {2 * GRAM} bytes")
    texts = distinct_texts(docs)
    key = ["t1", "t2"]
    sent = texts.mapInArrow(
        send_minimizers(length), "h long, t1 long, t2 long, known boolean, found array<long>")
    seen = F.count(F.when(F.col("found").isNull(), 1)).over(Window.partitionBy("h"))
    found = (
        sent.withColumn("n", seen)
        .filter("found is not null or (not known and n > 1)")
        .select(*key, F.coalesce("found", F.array("h")).alias("found"))
        .groupBy(*key).agg(F.flatten(F.collect_list("found")).alias("found"))
    )
    segments = texts.join(found, key).mapInArrow(
        send_segments(length),
        "g long, segment binary, first_id long, t1 long, t2 long, start long, gone array<long>")
    by = Window.partitionBy("g", "segment").orderBy("first_id", "t1", "t2", "start")
    spans = (
        segments.repartition("g").withColumn("rank", F.row_number().over(by))
        .mapInArrow(scan_intervals(length),
                    "t1 long, t2 long, `from` long, `to` long, first_id long, segment binary")
    )
    # single windows of the segments that were passed on, and spans that are settled
    inner = F.when(F.col("segment").isNotNull(), F.expr(f"sequence(0, length(segment) - {length})"))
    single = spans.select(*key, "from", "to", "first_id", "segment", F.explode_outer(inner).alias("i"))
    window = F.when(F.col("i").isNotNull(), F.expr(f"substring(segment, i + 1, {length})"))
    single = single.select(
        *key, "first_id", "i",
        (F.col("from") + F.coalesce("i", F.lit(0))).alias("from"),
        F.when(F.col("i").isNull(), F.col("to")).otherwise(F.col("from") + F.col("i") + length).alias("to"),
        F.coalesce(window, F.unhex(F.hex("t1"))).alias("window"),
    )
    rank = F.row_number().over(
        Window.partitionBy("window").orderBy("first_id", *key, "from"))
    gone = (
        single.withColumn("rank", rank).filter("i is null or rank > 1")
        .groupBy(*key).agg(F.flatten(F.collect_list(F.array("from", "to"))).alias("gone"))
    )
    return texts.join(gone, key, "left").mapInArrow(
        drop_bytes(length),
        "t1 long, t2 long, first_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def later_copy(order_id: str, length: int = LENGTH):
    """Whether a row joined with kept_by_text repeats an earlier row's whole text."""
    return (F.col(order_id) != F.col("first_id")) & (F.col("n_bytes") >= length)

"""Phrases that occur often, mined by sampling with a negative border, and their scores.

A text is cut into pieces at ``.,;:!?`` and the bytes 0x0A to 0x0D, pieces into words at
blanks and tabs, after lower-casing A-Z. Everything is counted per language. A phrase is
frequent at ``LEAST`` occurrences or more, and then so is every run of words within it.

1. A sample of the documents (one of ``SAMPLE`` by the hash of doc_id) proposes phrases at
   a lowered limit.
2. One pass over all documents counts exactly every word, every proposed phrase and the
   negative border: a phrase whose first part and last part (one word shorter) are both
   proposed.
3. Frequent phrases of the border that were not proposed are failures. They join the proposal,
   and a further pass counts what they bring within the border, with all longer phrases of it.
   That closes the set: what is still uncounted has a part known to be too rare.

So the sample decides whether there is a further pass and never the result. Tasks know the
proposal as a bit set of at most ``MOST_BITS``; a bit set by chance only makes a pass count
a phrase more. A hash only ever rules out phrases that are too rare: counts are by text, each task
sends one row for a phrase and language, and a phrase's parts are looked up by joins. Nothing
else is broadcast or collected.

Null text: empty. Null lang: ``und``, together with rows that say so. Null doc_ids are one
sample unit; repeated rows count each. Long texts are read in parts that overlap by four
words. Extra columns are left alone. No documents, or no frequent phrases: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.text import Block, U, blocks, byte_sums, mix, signed, staged

LEAST = 100
LONGEST = 5
#: One of so many documents is in the sample, and the share of the expected count that proposes.
SAMPLE, LOWERED = 8, 0.4
#: Bits for each proposed phrase, and of the whole set at most (32 MB).
EACH, MOST_BITS = 24, 1 << 28
#: Bytes of texts whose phrases are counted together, and of one part of a long text.
TOGETHER = 1 << 21
#: Shares of a language whose best phrases meet in its last ranking.
FEW = 16
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2


def parts(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets of rows, bytes that are the part's own) of a block.

    Only a long text has several parts. A part ends before a word and is followed by enough
    bytes for the phrases that start in it.
    """
    if len(block.data) <= 2 * TOGETHER:
        yield block.data, block.offsets, len(block.data)
        return
    at, data = 0, block.data
    while at < len(data):
        stop = _before_word(data, at + TOGETHER)
        reach = stop
        for _ in range(LONGEST - 1):
            reach = _before_word(data, reach + 1)
        yield data[at:reach], np.clip(block.offsets - at, 0, reach - at), stop - at
        at = stop


def _before_word(data: np.ndarray, at: int) -> int:
    """The first place from at on where a word starts after a gap, or the end."""
    while at < len(data):
        inside = _KIND[data[at - 1 : at + 4096]] == 0
        first = np.flatnonzero(inside[1:] & ~inside[:-1])
        if len(first):
            return at + int(first[0])
        at += max(1, len(inside) - 1)
    return len(data)


class Words:
    """Words of a part: row, hash, whether the next is in the same piece, and their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, own: int):
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        kind = _KIND[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1]))
        end = np.flatnonzero(inside & ~(np.concatenate((inside[1:], [False])) & ~edge[1:])) + 1
        self.row = np.repeat(
            np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
        self.own = int(np.searchsorted(start, own))
        breaks = np.flatnonzero((kind == 2) | edge[:-1])  # a piece ends before, or a row starts here
        piece = np.searchsorted(breaks, start, side="right")
        self.linked = piece[1:] == piece[:-1]
        total, inverse = byte_sums(data)
        self.hash = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))
        self._bytes, self._size = data[inside], end - start

    def __len__(self) -> int:
        return len(self.row)

    def coded(self) -> tuple[np.ndarray, Callable[[np.ndarray, int], pa.StringArray]]:
        """A number for each different word, and the text of k words from each of some places."""
        size, count = self._size, len(self)
        end = np.cumsum(size)
        words = pa.BinaryArray.from_buffers(pa.binary(), count, [
            None, pa.py_buffer(np.concatenate(([0], end)).astype(np.int32)), pa.py_buffer(self._bytes)])
        spaced = np.full(len(self._bytes) + count, 32, np.uint8)  # words joined by one space
        spaced[np.arange(len(self._bytes)) + np.repeat(np.arange(count), size)] = self._bytes

        def text(first: np.ndarray, k: int) -> pa.StringArray:
            a = end[first] - size[first] + first
            long = end[first + k - 1] + first + k - 1 - a
            ends = np.cumsum(long)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - long), long)
            return pa.StringArray.from_buffers(
                len(first), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(spaced[take]))

        return words.dictionary_encode().indices.to_numpy(), text


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & U(size - 1)).astype(np.int64), (hashes >> U(32) & U(size - 1)).astype(np.int64)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits in a packed bit set of a power of two."""
    out = np.ones(len(hashes), bool)
    for place in _bits(hashes, 8 * len(bits)):
        out &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return out


def occurrences(docs: DataFrame, levels: range, proposed=None, counted=None, chosen=None) -> DataFrame:
    """Phrases of so many words and how often each block of texts holds them.

    proposed, counted, chosen: bit sets (broadcasts). A phrase of several words counts if its first
    and its last part are proposed. With counted, only what has newly come within the border
    counts, and it takes all longer phrases of it along, since no pass before has looked at them.
    Without chosen: h (a phrase's hash, with its language) and n. With chosen (a bit set, or True
    for all): lang, k, phrase, n, h of phrases whose hash is in it; and rows with k = 0 that have
    a language's number of words.
    """
    by_text = chosen is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = (x.value if x is not None else None for x in (proposed, counted))
        only = chosen.value if by_text and chosen is not True else None
        for block in blocks(batches, limit=TOGETHER):
            langs = block.rows.column("lang").dictionary_encode()
            names, lang = langs.dictionary, langs.indices.to_numpy()
            for data, offsets, own in parts(block):
                words = Words(data, offsets, own)
                if not len(words):
                    continue
                spoken = lang[words.row]
                if by_text and 1 in levels:
                    total = np.bincount(spoken[: words.own], minlength=len(names))
                    yield pa.RecordBatch.from_pydict({
                        "lang": names, "k": np.zeros(len(names), np.int32), "phrase": [""] * len(names),
                        "n": total, "h": np.zeros(len(names), np.int64)})
                codes = text = None
                for k, place, hashes in levels_of(words, _name_hashes(names)[spoken], levels, new, old):
                    mine = place < words.own
                    if only is not None:
                        mine &= holds(only, hashes)
                    place, hashes = place[mine], hashes[mine]
                    if not by_text:
                        found, times = np.unique(hashes, return_counts=True)
                        yield pa.RecordBatch.from_pydict({"h": signed(found), "n": times})
                        continue
                    if not len(place):
                        continue
                    if codes is None:
                        codes, text = words.coded()
                    at, times = _alike(place, hashes, [spoken, *[codes[j:] for j in range(k)]])
                    yield pa.RecordBatch.from_pydict({
                        "lang": names.take(pa.array(spoken[place[at]])), "k": np.full(len(at), k, np.int32),
                        "phrase": text(place[at], k), "n": times, "h": signed(hashes[at])})

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(
        run, "lang string, k int, phrase string, n long, h long" if by_text else "h long, n long")


def levels_of(words: Words, seed: np.ndarray, levels: range, new, old):
    """(k, places of first words, hashes) of the phrases of k words that count, level by level."""
    single = mix(words.hash + seed)
    place, hashes = np.arange(len(words)), single
    if 1 in levels:
        yield 1, place, hashes
    if new is None:
        return
    linked, before = words.linked, None
    for k in range(1, levels.stop):
        if k > 1:
            # phrases of k - 1 words at one word and at the next, both proposed
            place = np.flatnonzero(inside[:-1] & inside[1:] & linked)
            hashes = mix(hashes_at[place] * U(0x9E3779B97F4A7C15) + single[place + k - 1])
            linked = True
        fresh = None
        if old is not None:
            known = holds(old, hashes)
            if k > 1:
                fresh = ~(before[place] & before[place + 1])
                known &= ~fresh
        if k > 1 and k in levels:
            yield (k, place, hashes) if fresh is None else (k, place[fresh], hashes[fresh])
        inside, hashes_at = np.zeros(len(words), bool), np.zeros(len(words), U)
        inside[place] = holds(new, hashes) if fresh is None else holds(new, hashes) | fresh
        hashes_at[place] = hashes
        if old is not None:
            before = np.zeros(len(words), bool)
            before[place] = known


def _alike(place: np.ndarray, hashes: np.ndarray, parts_of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A first index and the number of equal phrases; parts_of say whether equal hashes are equal phrases."""
    _, at, group, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if any((x[place] != x[place[at]][group]).any() for x in parts_of):
        _, at, times = np.unique(
            np.stack([x[place] for x in parts_of], 1), axis=0, return_index=True, return_counts=True)
    return at, times


def _name_hashes(names: pa.Array) -> np.ndarray:
    sums = [byte_sums(np.frombuffer(name.encode(), np.uint8))[0][-1] for name in names.to_pylist()]
    return mix(np.array(sums, U))


def bit_set(proposal: DataFrame, size: int) -> np.ndarray:
    """The proposal's hashes as a packed bit set of size bits, put together in Spark."""
    where = [F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseAND(size - 1)]
    places = proposal.select(F.explode(F.array(*where)).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 31 AS int))")).alias("b"))
    table = words.toArrow()
    out = np.zeros(size // 32, "<u4")
    out[table.column("w").to_numpy()] = table.column("b").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _size(proposed: int) -> int:
    return min(MOST_BITS, 1 << max(16, (EACH * proposed).bit_length()))


def often(found: DataFrame, least: int) -> DataFrame:
    """Hashes whose phrases together occur that often."""
    return found.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h")


def propose(docs: DataFrame, least: int) -> DataFrame:
    """Hashes of phrases that are frequent in the sample at the lowered limit, level by level."""
    context = docs.sparkSession.sparkContext
    sample = staged(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("lang", "text"), "sample")
    limit = max(1, int(least * LOWERED / SAMPLE))
    proposal, bits = None, None
    for k in range(1, LONGEST + 1):
        level = staged(often(occurrences(sample, range(k, k + 1), bits), limit), "proposal")
        proposal = level if proposal is None else proposal.union(level)
        if level.isEmpty():
            break
        bits = context.broadcast(bit_set(proposal, _size(proposal.count())))
    return proposal


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, k, phrase, n of every phrase that occurs at least that often (k = 0: all words).

    The first pass reads the texts twice: sums by hash, which are at least a phrase's own,
    then exact counts by text of phrases whose hash came that far. So the many rare
    phrases of the border travel as hashes only. If there are failures, a further pass
    counts by text what they bring within the border, and its extensions to the greatest
    length: a phrase that is still not counted then has a part that is counted and too rare.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "lang", "text")
    proposal = propose(docs, least)
    size = _size(2 * proposal.count())
    bits = context.broadcast(bit_set(proposal, size))
    levels = range(1, LONGEST + 1)
    hashes = staged(often(occurrences(docs, levels, bits), least), "hashes")
    chosen = context.broadcast(bit_set(hashes, _size(hashes.count())))
    found = staged(_counted(occurrences(docs, levels, bits, None, chosen), least), "frequent")
    failures = staged(found.filter("k > 0").select("h").join(proposal, "h", "left_anti"), "failures")
    if not failures.isEmpty():
        wider = context.broadcast(bit_set(proposal.union(failures), size))
        more = occurrences(docs, range(2, LONGEST + 1), wider, bits, True)
        found = found.union(staged(_counted(more, least), "frequent"))
    return found.drop("h")


def _counted(found: DataFrame, least: int) -> DataFrame:
    sums = found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"), F.max("h").alias("h"))
    return sums.filter((F.col("n") >= least) | (F.col("k") == 0))


def scored(frequent: DataFrame) -> DataFrame:
    """lang, share, phrase, a, l, r, n, score of phrases of several words that no longer one stands for.

    share: one of as many numbers as shuffles have partitions; a language may hold most phrases.
    """
    shares = int(frequent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
    total = frequent.filter("k = 0").select(
        "lang", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    known = frequent.filter("k > 0").select("lang", "k", "phrase", F.col("n").alias("f"))
    phrases = known.filter("k > 1").withColumn("words", F.split("phrase", " "))

    def piece(start, size):
        return F.array_join(F.slice("words", start, size), " ")

    inside = phrases.filter("k > 2").select(
        "lang", F.explode(F.array(piece(F.lit(1), F.col("k") - 1), piece(F.lit(2), F.col("k") - 1))).alias("phrase"),
        F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    # f never grows with length, so a longer phrase that is as frequent has one of one word more between
    left = phrases.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("f")))
    cuts = left.select("lang", "phrase", "words", "k", F.col("f").alias("a"),
                       F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", piece(F.lit(1), F.col("cut")).alias("head"),
                       piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    cuts = cuts.withColumn("share", share).join(total, ["lang", "share"]).withColumn(
        "score", _floor_ratio(F.lit(1000).cast("decimal(4,0)") * whole["a"] * whole["n"], whole["l"] * whole["r"]))
    best = cuts.groupBy("lang", "share", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "share", "phrase", *[F.col(f"best.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def _floor_ratio(product, divisor):
    """Whole quotient of two exact products of up to 38 digits."""
    return F.call_function("div", product, divisor)


def collocations(docs: DataFrame, least: int = LEAST, first: int = 2000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = scored(frequent_phrases(docs, least))
    # ranks within a language's shares, then within a few of them, bound the last group
    for group in (["lang", "share"], ["lang", F.col("share") % FEW], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        rows = rows.filter(F.col("rank") <= first)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

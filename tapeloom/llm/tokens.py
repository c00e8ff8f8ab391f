"""Token ids of a byte-level BPE vocabulary, and packing into sequences.

``pack_powers`` cuts each document into pieces of binary lengths, so that pieces fill
sequences of equal lengths without padding and no sequence holds two documents.
``pack_best_fit`` packs whole documents by best fit decreasing.

Both work in one pass over the documents without a shuffle. The vocabulary is a file
of ranks that gives the same ids as the ``tokenizers`` file of that name.

Null text: empty, so a document is its end id alone. Long texts are encoded whole; a run of
white space of ``RUN`` characters or more is encoded apart, at places where the ids stay the same. Null
ids and repeated rows are packed like any others. Pieces of equal size keep the documents' order.
Extra columns are left alone.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.text import blocks

VOCABULARY = "byte_bpe_50k.tiktoken"
LENGTH = 2048
#: Text bytes whose documents are packed together by best fit.
TOGETHER = 1 << 22
#: White space of so many characters is not given to the vocabulary's pattern, which would backtrack over it.
RUN = 10_000
_SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % RUN)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, path: str) -> list[int]:
    """Ids of a text; strings of special tokens are ordinary text.

    In a run of white space the pattern takes all but the last character, which may
    go with what follows, or all at the end of the text. So a long run is one piece, and
    the texts before and after it can be encoded on their own.
    """
    own = encoder(path)
    if len(text) < RUN:
        return own.encode_ordinary(text)
    out, at = [], 0
    for run in _SPACES.finditer(text):
        stop = run.end() - (run.end() < len(text))
        out += own.encode_ordinary(text[at : run.start()])
        out += encoder(path, "(?s).+").encode_ordinary(text[run.start() : stop])
        at = stop
    return out + own.encode_ordinary(text[at:])


def encode(block, path: str, end: int) -> list[np.ndarray]:
    """Ids of each text with the end id."""
    return [np.array([*token_ids(block.text(i).decode("utf-8", "replace"), path), end], "<u4")
            for i in range(block.rows.num_rows)]


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def binary_lengths(n: int, length: int) -> list[int]:
    """Whole sequences, then the powers of two that sum to the rest, greatest first."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack_powers(docs: DataFrame, length: int = LENGTH, end: int = 1, path: str | None = None,
                ids: bool = False) -> DataFrame:
    """One row for each piece, which is one sequence.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id (the task's number and a
    count), offset; with ids also the ids (little-endian unsigned 32 bits). Sequences
    of one length are a bucket, see ``write_buckets``.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for block in blocks(batches):
            row, start, size, crc, total, data = [], [], [], [], [], []
            for i, tokens in enumerate(encode(block, path, end)):
                at = 0
                for n in binary_lengths(len(tokens), length):
                    piece = tokens[at : at + n].tobytes()
                    row.append(i)
                    start.append(at)
                    size.append(n)
                    crc.append(zlib.crc32(piece))
                    total.append(len(tokens))
                    if ids:
                        data.append(piece)
                    at += n
            columns = {
                "doc_id": block.rows.column("doc_id").take(pa.array(row, pa.int64())),
                "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()),
                "sequence_id": np.arange(number, number + len(row)),
                "offset": np.zeros(len(row), np.int64),
            }
            number += len(row)
            if ids:
                columns["ids"] = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
              " sequence_id long, offset long" + ", ids binary" * ids)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces (with ids) as Parquet, a folder for each length.

    All sequences of a folder are equally long, so a batch of them is a matrix without
    padding. The rebalance lets a common length fill many files.
    """
    (
        pieces.hint("rebalance", "length").write.partitionBy("length")
        .option("compression", "zstd").parquet(path)
    )


class Capacities:
    """Open sequences by free places, in a segment tree that finds the tightest fit."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, free: int, sequence: int) -> None:
        self.open[free].append(sequence)
        self._add(free, 1)

    def _add(self, free: int, change: int) -> None:
        node = free + self.size
        while node:
            self.count[node] += change
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least free places that are enough, and how many."""
        node = need + self.size
        while not self.count[node]:
            while node & 1:  # a right child: no greater capacities below its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node + (not self.count[2 * node])
        free = node - self.size
        self._add(free, -1)
        return self.open[free].pop(), free


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Sequences of item numbers by best fit decreasing; every size is at most length."""
    free, sequences = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if (found := free.take(sizes[i])) is None:
            found = len(sequences), length
            sequences.append([])
        sequence, left = found
        sequences[sequence].append(i)
        free.put(left - sizes[i], sequence)
    return sequences


def pack_best_fit(docs: DataFrame, length: int = LENGTH, end: int = 50256, path: str | None = None
                  ) -> DataFrame:
    """One row for each packed sequence of length places.

    sequence_id (the task's number and a count), n_tokens, doc_ids, starts and lengths of
    the pieces in order, cu_seqlens (cumulative lengths from 0), ids (length unsigned
    32-bit ids, padded with the end id) and position_ids (from 0 in each piece and in the
    padding). A document of more than length ids is cut into whole sequences and a rest.
    Documents of ``TOGETHER`` bytes of text are packed together, which leaves under one
    sequence in a hundred part empty and bounds memory.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for block in blocks(batches, limit=TOGETHER):
            pieces = []  # row, start, ids
            for i, tokens in enumerate(encode(block, path, end)):
                pieces += [(i, a, tokens[a : a + length]) for a in range(0, len(tokens), length)]
            packed = best_fit([len(p[2]) for p in pieces], length)
            out: dict[str, list] = {x: [] for x in (
                "n_tokens", "starts", "lengths", "cu_seqlens", "ids", "position_ids")}
            rows, counts = [], []
            for members in packed:
                own = [pieces[m] for m in members]
                sizes = [len(p[2]) for p in own]
                ids = np.full(length, end, "<u4")
                ids[: sum(sizes)] = np.concatenate([p[2] for p in own])
                ends = np.cumsum([0, *sizes])
                resets = np.repeat([*ends], np.diff([*ends, length]))
                rows += [p[0] for p in own]
                counts.append(len(own))
                for name, value in (
                    ("n_tokens", sum(sizes)), ("starts", [p[1] for p in own]), ("lengths", sizes),
                    ("cu_seqlens", ends.tolist()), ("ids", ids.tobytes()),
                    ("position_ids", (np.arange(length) - resets).astype("<u4").tobytes()),
                ):
                    out[name].append(value)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            taken = block.rows.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + len(packed))),
                pa.array(out["n_tokens"], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), taken),
                pa.array(out["starts"], pa.list_(pa.int64())),
                pa.array(out["lengths"], pa.list_(pa.int32())),
                pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
                pa.array(out["ids"], pa.binary()), pa.array(out["position_ids"], pa.binary()),
            ], names=["sequence_id", "n_tokens", "doc_ids", "starts", "lengths", "cu_seqlens",
                      "ids", "position_ids"])
            number += len(packed)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>,"
             " lengths array<int>, cu_seqlens array<int>, ids binary, position_ids binary")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet: one row of the id matrix in each row."""
    packed.write.option("compression", "zstd").parquet(path)

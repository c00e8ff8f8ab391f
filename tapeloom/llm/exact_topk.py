"""Exact inner-product search: columnar branch and bound over scaled integer vectors.

Vectors are scaled and floored to integers. Candidates are dealt evenly to buckets of
bounded size, each query is sent to each bucket once, and a task holds its bucket in
vertical layout: blocks of vectors, dimension by dimension. A query adds up its product
one group of dimensions after another, the groups with most of its own mass first. What
the open groups can still add is at most the sum of the products of both sides' norms in
them; candidates that cannot reach the k-th best score so far are dropped and the rest
compacted. Each bucket gives k rows a query, and a rank joins them.

Nothing goes through the driver but three totals, and nothing is broadcast. The vectors are
written once with row numbers, so a lost task deals the same rows again.

Null vectors and vectors with a null or non-finite component (scaled, in doubles) take no
part. Vectors of different lengths meet in their common components; an empty one scores 0.
Equal scores go to the smaller id, a null id last. A row with a null id is a candidate
but no query. Rows that share a query's id are its own and no candidates; repeated rows are
candidates, and queries, each. Scores that pass 64 bits count as the nearest long. Extra columns are left
alone. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.text import staged

#: Components that one bucket holds; more vectors make more buckets.
BUCKET = 1 << 24
#: Components that one vertical block holds.
PLANE = 1 << 22
#: Dimensions that are added at a time.
GROUP = 8
LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and the vector's integers (as doubles), without vectors that take no part."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    rows = vectors.select(F.col("vec_id").cast("long"), whole.alias("v"))
    infinite = F.lit(float("inf"))
    return rows.filter(F.forall("v", lambda x: F.abs(x) < infinite)).withColumn(
        "v", F.transform("v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))


class Plane:
    """Some vectors in vertical layout with the norm of each group of dimensions."""

    def __init__(self, ids: np.ndarray, absent: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        self.ids, self.absent = ids, absent
        self.width = -(-max(int(sizes.max()), 1) // GROUP) * GROUP
        self.largest = float(np.abs(values).max(initial=0))
        kind = np.float32 if self.largest < 2**24 else np.float64
        self.rows = np.zeros((self.width, len(ids)), kind)
        at = 0
        edges = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):  # vectors of one length
            n = int(sizes[a])
            self.rows[:n, a:b] = values[at : at + n * (b - a)].reshape(b - a, n).T
            at += n * (b - a)
        squares = self.rows.reshape(-1, GROUP, len(ids)).astype(np.float64) ** 2
        self.norms = np.sqrt(squares.sum(1)).astype(np.float32) * np.float32(1.00001)

    def search(self, query: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (places, exact scores) of which any may be among the k best.

        least: a score that k candidates elsewhere are known to reach.
        """
        q = np.zeros(self.width)
        q[: min(len(query), self.width)] = query[: self.width]
        reach = self.largest * float(np.abs(q).sum())
        other = self.absent | (self.ids != own)
        if reach >= 2.0**53:
            places = np.flatnonzero(other)
            return places, self._whole(q, places)
        kind = np.float32 if reach < 2**24 and self.rows.dtype == np.float32 else np.float64
        q = q.astype(kind)
        mass = np.sqrt((q.reshape(-1, GROUP).astype(np.float64) ** 2).sum(1)).astype(np.float32)
        order = np.argsort(-mass, kind="stable")
        order = order[mass[order] > 0]
        bound = mass[order] @ self.norms[order]
        places = np.flatnonzero(other & (bound * 1.0001 + 1 >= least))
        if len(places) > 4 * k:  # exact scores of the most promising set a first limit
            first = places[np.argpartition(-bound[places], 2 * k)[: 2 * k]]
            score = q @ self.rows[:, first].astype(kind, copy=False)
            least = max(least, float(np.partition(score, -k)[-k]))
            places = places[bound[places] * 1.0001 + 1 >= least]
        total = np.zeros(len(places), kind)
        every = len(places) == len(self.ids)
        for i, g in enumerate(order):
            band = self.rows[g * GROUP : (g + 1) * GROUP]
            band = (band if every else band[:, places]).astype(kind, copy=False)
            total += q[g * GROUP : (g + 1) * GROUP] @ band
            rest = order[i + 1 :]
            if len(rest):
                left = mass[rest] @ (self.norms[rest] if every else self.norms[rest][:, places])
                keep = total + left * 1.0001 + 1 >= least
                if np.count_nonzero(keep) < 0.8 * len(keep):
                    places, total, every = places[keep], total[keep], False
        return places, total

    def _whole(self, q: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores in whole numbers of any size, then brought into 64 bits."""
        used = np.flatnonzero(q)
        factors = [int(x) for x in q[used]]
        score = [sum(f * int(x) for f, x in zip(factors, self.rows[used, p], strict=True)) for p in places]
        return np.array([max(-LONG - 1, min(LONG, s)) for s in score], object)


def _planes(held: list[tuple[np.ndarray, ...]]) -> list[Plane]:
    if not held:
        return []
    ids, absent, sizes, values = (np.concatenate(x) for x in zip(*held, strict=True))
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(ids):  # sizes ascend
        stop = at + 1
        while stop < len(ids):
            step = min(len(ids), stop + max(1, (PLANE // max(int(sizes[stop]), 1) - (stop - at)) // 2))
            if max(int(sizes[step - 1]), 1) * (step - at) > PLANE:
                break
            stop = step
        first = ends[at - 1] if at else 0
        out.append(Plane(ids[at:stop], absent[at:stop], sizes[at:stop], values[first : ends[stop - 1]]))
        at = stop
    return out


def _best(ids, absent, score, k):
    keep = np.lexsort((ids, absent, -score))[:k]
    return ids[keep], absent[keep], score[keep]


def search_bucket(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, planes = [], None
        for batch in batches:
            role = batch.column("role").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(role, 1))
            for part, query in ((batch.slice(0, cut), False), (batch.slice(cut), True)):
                if not part.num_rows:
                    continue
                ids = part.column("vec_id")
                absent = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                sizes = part.column("v").value_lengths().to_numpy()
                values = part.column("v").flatten().to_numpy()
                if not query:
                    held.append((ids, absent, sizes, values))
                    continue
                if planes is None:
                    planes = _planes(held)
                    held = []
                ends = np.cumsum(sizes)
                counts, found = [], []
                for i, own in enumerate(ids):
                    q, best = values[ends[i] - sizes[i] : ends[i]], None
                    for plane in planes:
                        least = float(best[2][-1]) if best and len(best[2]) == k else -np.inf
                        places, score = plane.search(q, int(own), k, least)
                        if score.dtype != object:
                            score = score.astype(np.int64)
                        new = plane.ids[places], plane.absent[places], score
                        if best:
                            new = tuple(np.concatenate(x) for x in zip(best, new, strict=True))
                        best = _best(*new, k)
                    counts.append(len(best[0]) if best else 0)
                    found += [best] if best else []
                got = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0)] * 3
                numbers = part.column("no").to_numpy()
                yield pa.RecordBatch.from_pydict({
                    "no": np.repeat(numbers, counts), "query_id": np.repeat(ids, counts),
                    "vec_id": pa.array(got[0], pa.int64(), mask=got[1].astype(bool)),
                    "score": pa.array(got[2].tolist(), pa.int64()),
                })
    return run


def search(vectors: DataFrame, every: int, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of each vector whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = staged(scaled(vectors, scale).withColumn("no", F.monotonically_increasing_id()), "vectors")
    components = rows.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-components // BUCKET))
    candidates = rows.select(
        F.pmod("no", F.lit(buckets)).cast("int").alias("bucket"), F.lit(0).alias("role"), "no", "vec_id", "v")
    queries = rows.filter(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(1).alias("role"),
        "no", "vec_id", "v")
    dealt = candidates.union(queries).repartitionById(buckets, F.col("bucket")).sortWithinPartitions(
        "role", F.size("v"), "no")
    found = dealt.drop("bucket").mapInArrow(
        search_bucket(k), "no long, query_id long, vec_id long, score long")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

"""SimHash near-dedup through an inverted index of byte positions.

A fingerprint has eight positional bytes. Fingerprints within ``RADIUS`` bits differ
in at most that many bytes, so they share at least ``8 - RADIUS`` positional bytes.
A list for each single byte would hold a 256th of all fingerprints, and pairs would
grow with the square of the corpus. The index therefore has one list for each way to
reach the guaranteed count: six positions with their bytes. A pair that shares six or
more bytes meets in such a list and in no other way; there its shared bytes are
tallied, pairs that reach the count are verified by their differing bits, and only the
links of a spanning forest leave. The two open bytes bound a list to 65,536 fingerprints.

Equal fingerprints are collapsed before the index, so copies cost nothing there.

``unique_documents`` serves the pipeline. Its groups come first from the fingerprints of
whole texts and their index as above, over different texts. There texts also count as near
duplicates from a Jaccard similarity of 0.8 over five-word shingles. At that similarity
fingerprints of 64 bits differ in about ten bits, beyond what shared bytes can
guarantee. For those pairs each positional byte is the SimHash byte of a sample of the shingles,
the one that is least under the position's own order; two texts agree in a position with
their Jaccard similarity as probability. The same index finds texts that share
``BAND`` consecutive positions, pairs with at least ``TALLY`` shared positional bytes
are kept, and the similarity of the whole shingle sets verifies them.

Null text: no words, like an empty one; their fingerprint is zero and links like any
other. A null doc_id keeps its fingerprint and takes the component's smallest id (null
if there is none). Repeated rows each return. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.graph import components
from tapeloom.llm.text import U, blocks, mix, rolling, scratch, staged, staging_dir
from tapeloom.session import settings

SHINGLE = 3
RADIUS = 2
BYTES = 8
SEED = 42

#: Positional bytes of samples, how many make a list, and how many a pair must share.
POSITIONS, BAND, TALLY = 64, 4, 36
#: Texts of a list that are all compared; how often a longer one draws a head.
SMALL, ROUNDS = 64, 4
#: Texts of a block of a longer list; two blocks are compared in one task.
CELL = 512
SIMILARITY = 0.8
WORDS = 5
#: Text that a Python worker is given at a time.
BATCH = "8m"


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of size words, A-Z lower-cased; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, U)
    joined = b" ".join(words)
    size = min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(lengths)
    start = (end - lengths)[: len(words) - size + 1].tolist()
    stop = (end[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, stop, strict=True)),
                       U, len(start))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += part.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            n = block.rows.num_rows
            fps = np.fromiter((fingerprint(shingle_hashes(block.text(i), size)) for i in range(n)), U, n)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": block.rows.column("doc_id"), "fp": fps.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _forest(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links within the radius among the distinct fingerprints of a list, as a spanning forest."""
    root = np.arange(len(values))
    if len(values) <= 64:
        differ = values[:, None] ^ values[None, :]
        shared = (differ[:, :, None].view(np.uint8) == 0).sum(2)
        i, j = np.nonzero((shared >= BYTES - radius) & (np.bitwise_count(differ) <= radius))
        near = [(i, j)]
    else:  # look up each flip of up to radius bits among the sorted values
        order = np.argsort(values)
        values = values[order]
        open_bits = [b for b in range(64) if len(np.unique(values >> U(b) & U(1))) > 1]
        flips = [sum(1 << b for b in c) for n in range(1, radius + 1) for c in combinations(open_bits, n)]
        near = []
        for flip in flips:
            at = np.minimum(np.searchsorted(values, values ^ U(flip)), len(values) - 1)
            i = np.flatnonzero(values[at] == values ^ U(flip))
            near.append((order[i], order[at[i]]))
    while True:
        before = root.copy()
        for i, j in near:
            np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            break
    return ((i, int(r)) for i, r in enumerate(root) if i != r)


def links(fps: DataFrame, radius: int = RADIUS, key: str = "fp") -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough to connect all within the radius.

    They are named by the column key, a long that all rows of a fingerprint share.
    """
    if not 0 < radius <= 2:
        raise ValueError("radius must be 1 or 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps, keys in zip(batch.column("fp"), batch.column(key), strict=True):
                values, names = (np.asarray(x.values, np.int64) for x in (fps, keys))
                for i, j in _forest(values.view(U), radius):
                    a.append(names[i])
                    b.append(names[j])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = (1 << 64) - 1
    masks = [full ^ sum(0xFF << 8 * i for i in c) for c in combinations(range(BYTES), radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = F.explode(F.array(*[
        F.struct(F.lit(i).alias("positions"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes"))
        for i, m in enumerate(masks)])).alias("list")
    columns = dict.fromkeys(["fp", key])
    # each row becomes 28: as many tasks as a shuffle has, not the few that small input is merged to
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        fps.select(*columns).distinct().repartition(tasks).select(*columns, lists)
        .groupBy("list.positions", "list.bytes").agg(*[F.collect_list(x).alias(x) for x in columns])
        .filter("size(fp) > 1").select(*columns).mapInArrow(run, "a long, b long")
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    rows = staged(fingerprints(docs, size), "fingerprints")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(rows, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    reps = reps.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = reps.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = reps.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _samples(hashes: np.ndarray) -> bytes:
    """One byte for each position: of the hash that is least in the position's order."""
    if not len(hashes):
        return bytes(POSITIONS)
    least = hashes[[(hashes * salt).argmin() for salt in _SALTS]]
    return mix(least ^ _SALTS).astype(np.uint8).tobytes()


_SALTS = mix(np.arange(1, POSITIONS + 1, dtype=U)) | U(1)


def _shingle_set(words, i: int) -> np.ndarray:
    """Distinct hashes of a row's shingles of WORDS words (of all words if there are fewer)."""
    own = words.hash[words.first[i] : words.first[i] + words.count[i]]
    size = min(WORDS, len(own))
    return np.unique(rolling(own, size)) if size else own


def _text_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        n = block.rows.num_rows
        fps = np.fromiter((fingerprint(shingle_hashes(block.text(i), SHINGLE)) for i in range(n)), U, n)
        words = block.words(block.lower())
        sample = [_samples(_shingle_set(words, i)) for i in range(n)]
        yield pa.RecordBatch.from_pydict({
            **{x: block.rows.column(x) for x in ("t1", "t2")},
            "fp": fps.view(np.int64), "sample": pa.array(sample, pa.binary())})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        sides = ([], [])
        for name, side in zip(("text", "other"), sides, strict=True):
            for block in blocks(iter([batch]), text=name):
                words = block.words(block.lower())
                side.extend(_shingle_set(words, i) for i in range(block.rows.num_rows))
        for a, b in zip(*sides, strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tallied(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """The pairs (a, b) of texts that share at least TALLY positional bytes."""
    one = samples.select(F.col("t1").alias("a"), F.col("sample").alias("x"))
    two = samples.select(F.col("t1").alias("b"), F.col("sample").alias("y"))
    shared = F.expr(
        f"size(filter(sequence(1, {POSITIONS}), i -> substring(x, i, 1) = substring(y, i, 1)))")
    return pairs.join(one, "a").join(two, "b").filter(shared >= TALLY).select("a", "b")


def _verified(pairs: DataFrame, samples: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole shingle sets are similar. Only texts of the pairs are shuffled:
    the table of all texts is bucketed by key, and the pairs' keys go to its buckets."""
    ids = pairs.select(F.col("a").alias("t1")).union(pairs.select("b")).distinct()
    ids = samples.select("t1", "t2").join(ids, "t1", "left_semi")
    texts = staged(texts.join(ids.hint("shuffle_hash"), ["t1", "t2"], "left_semi").select("t1", "text"), "texts")
    with_text = pairs.join(texts.withColumnRenamed("t1", "a"), "a")
    both = with_text.join(texts.select(F.col("t1").alias("b"), F.col("text").alias("other")), "b")
    return both.select("a", "b", "text", "other").mapInArrow(_verify, "a long, b long")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a list's texts in different components that share at least TALLY bytes."""
    for batch in batches:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for t1, root, sample in zip(*(batch.column(x) for x in ("t1", "root", "sample")), strict=True):
            t1, root = np.asarray(t1.values), np.asarray(root.values)
            own = np.frombuffer(b"".join(sample.as_py()), np.uint8).reshape(-1, POSITIONS)
            shared = (own[:, None] == own[None]).sum(2)
            i, j = np.nonzero((shared >= TALLY) & (root[:, None] != root[None]) & (t1[:, None] < t1[None]))
            a.append(t1[i])
            b.append(t1[j])
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell (list, i, j), which come together, as one batch."""
    kept, cell = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(x)) for x in ("list", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            if kept and (keys[:, a] != cell).any():
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept = []
            cell = keys[:, a]
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _candidates(cell: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the cell's two blocks in different components that share at least TALLY bytes.

    A pair that also shares an earlier band is left to that band's list.
    """
    t1, root, block = (np.asarray(cell.column(x)) for x in ("t1", "root", "block"))
    i, j, start = (cell.column(x)[0].as_py() for x in ("i", "j", "start"))
    own = np.frombuffer(b"".join(cell.column("sample").to_pylist()), np.uint8).reshape(-1, POSITIONS)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        same = own[some][:, None] == own[right][None]
        near = np.bitwise_count(same.view(U)).sum(2) >= TALLY
        near &= root[some][:, None] != root[right]
        near &= ~same[:, :, : start * BAND].reshape(len(some), len(right), start, BAND).all(3).any(2)
        if i == j:
            near &= t1[some][:, None] < t1[right]
        a, b = np.nonzero(near)
        yield some[a], right[b]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that are in a pair of its candidates."""
    for cell in _cells(batches):
        rows = np.unique(np.concatenate([x for pair in _candidates(cell) for x in pair] or [np.empty(0, np.int64)]))
        if len(rows):
            yield cell.take(pa.array(rows))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        words = block.words(block.lower())
        yield pa.RecordBatch.from_pydict({
            "t1": block.rows.column("t1"),
            "shingles": pa.array([_shingle_set(words, i).tobytes() for i in range(block.rows.num_rows)], pa.binary())})


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similar pairs of each cell's candidates, as many as connect all that they connect."""
    for cell in _cells(batches):
        t1, root = np.asarray(cell.column("t1")), cell.column("root").to_pylist()
        sets = [np.frombuffer(x, U) for x in cell.column("shingles").to_pylist()]
        of = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ids = np.split(of, np.cumsum([len(x) for x in sets])[:-1])
        held = np.zeros(len(of), bool)
        up: dict[int, int] = {}

        def top(x: int, up=up) -> int:
            while x in up:
                x = up[x]
            return x

        a, b = [], []
        for some, others in _candidates(cell):
            marked = None
            for x, y in zip(some.tolist(), others.tolist(), strict=True):
                one, two = top(root[x]), top(root[y])
                if one == two:
                    continue
                if x != marked:
                    held[:] = False
                    held[ids[x]] = True
                    marked = x
                both = np.count_nonzero(held[ids[y]])
                if both >= SIMILARITY * (len(ids[x]) + len(ids[y]) - both):
                    up[max(one, two)] = min(one, two)
                    a.append(t1[x])
                    b.append(t1[y])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _settled(lists: DataFrame, linked: DataFrame, samples: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the components of each list of over SMALL texts, from all their pairs.

    Each list is dealt to blocks of about CELL texts, and each two blocks are a cell. Cells
    first meet with samples alone; only texts of candidate pairs then come with their shingles.
    """
    members = lists.filter(F.col("n") > SMALL).join(linked.withColumnRenamed("u", "t1"), "t1", "left").select(
        "list", "start", "n", "t1", F.coalesce("v", "t1").alias("root"))
    mixed = members.groupBy("list").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter(
        "least < most").select("list")
    parts = F.ceil(F.col("n") / CELL)
    dealt = members.join(mixed, "list").join(samples.select("t1", "t2", "sample"), "t1").withColumns({
        "block": F.pmod(F.xxhash64(F.lit("block"), "list", "t1"), parts),
        "other": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)),
    }).select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
              "block", "start", "t1", "t2", "root", "sample")
    cell = ["list", "i", "j"]
    schema = "list long, i long, j long, block long, start int, t1 long, t2 long, root long, sample binary"
    met = staged(dealt.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_open, schema), "open")
    ids = met.select("t1", "t2").distinct()
    sets = staged(texts.join(ids.hint("shuffle_hash"), ["t1", "t2"], "left_semi").select("t1", "text").mapInArrow(
        _shingle_sets, "t1 long, shingles binary"), "shingles")
    whole = met.join(sets, "t1").repartition(*cell).sortWithinPartitions(*cell)
    return staged(whole.mapInArrow(_settle, "a long, b long"), "settled")


def _bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write to the shared folder in buckets of the keys: joins on them do not shuffle it again."""
    spark = df.sparkSession
    path = staging_dir(spark, name)
    table = f"{name}_{uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's own limit
    df.write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, like those of any staged table
    return found


def _firsts(docs: DataFrame) -> DataFrame:
    """Each different text once: its key (t1, t2) and row, the columns of a row that has its
    smallest doc_id, a null last."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"c{docs.columns.index('text')}"), F.lit(""))
    doc_id = F.col(f"c{docs.columns.index('doc_id')}")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"))
    return plain.groupBy(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")).agg(
        F.min_by(F.struct(*plain.columns), order).alias("row"))


def _first_texts(docs: DataFrame) -> DataFrame:
    """Each different text once, in buckets of its key: t1, t2, text and first, its smallest
    doc_id (a null last)."""
    inner = [F.col(f"row.c{docs.columns.index(x)}") for x in ("text", "doc_id")]
    return _bucketed(_firsts(docs).select(
        "t1", "t2", F.coalesce(inner[0], F.lit("")).alias("text"),
        F.struct(inner[1].isNull().alias("none"), inner[1].alias("doc_id")).alias("first")),
        "first_texts", ["t1", "t2"])


def _near_texts(samples: DataFrame) -> DataFrame:
    """Links (a, b) between the keys t1 of texts whose fingerprints are within ``RADIUS`` bits,
    enough to connect all of them: texts of one fingerprint with the least key among them, and
    those of near fingerprints with one another."""
    rows = samples.select("t1", "fp")
    heads = rows.groupBy("fp").agg(F.min("t1").alias("head"))
    same = rows.join(heads, "fp").filter("t1 != head").select(F.col("t1").alias("a"), F.col("head").alias("b"))
    return same.union(links(heads, key="head"))


def similar_texts(texts: DataFrame) -> DataFrame:
    """(u, v) of ``components`` over the keys t1 of ``_first_texts``.

    Texts of near fingerprints are linked first, see ``_near_texts``; what follows adds the
    pairs that are similar by their shingle sets.

    Each list links its members to one of them, chosen by a hash of its own for each list,
    so a list of any size gives one candidate for each member; that joins large groups.
    Then the members of a list of up to ``SMALL`` texts are all compared by their shared
    bytes, and a longer list that still holds several components draws further heads, each
    linked to the members of the other components. Last, all pairs of a longer list that
    are still in different components are compared in blocks, see ``_settled``. Where no
    list is longer, there is nothing left to draw or to compare.
    """
    samples = staged(texts.select("t1", "t2", "text").mapInArrow(
        _text_samples, "t1 long, t2 long, fp long, sample binary"), "samples")
    lists = samples.select("t1", F.posexplode(F.array(*[
        F.xxhash64(F.lit(i), F.substring("sample", i * BAND + 1, BAND)) for i in range(POSITIONS // BAND)
    ])).alias("start", "list"))
    heads = lists.groupBy("list").agg(
        F.min_by("t1", F.xxhash64("list", "t1")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = staged(lists.join(heads, "list"), "lists")
    tested = staged(_tallied(lists.filter("t1 != head").select(*_pair("t1", "head")).distinct(), samples), "pairs")
    linked = components(_near_texts(samples).union(_verified(tested, samples, texts)))
    long = not lists.filter(F.col("n") > SMALL).isEmpty()
    for draw in range(ROUNDS if long else 1):
        members = lists.join(linked.withColumnRenamed("u", "t1"), "t1", "left").select(
            "list", "n", "t1", F.coalesce("v", "t1").alias("root"))
        mixed = [F.min("root").alias("least"), F.max("root").alias("most")]
        if draw == 0:
            of_list = F.collect_list(F.struct("t1", "root", "sample")).alias("m")
            met = members.filter(F.col("n").between(3, SMALL)).join(samples.select("t1", "sample"), "t1").groupBy(
                "list").agg(of_list, *mixed).filter("least < most").select("m.t1", "m.root", "m.sample").mapInArrow(
                _across, "a long, b long").distinct()
        else:
            members = members.filter(F.col("n") > SMALL)
            heads = members.groupBy("list").agg(
                F.min_by(F.struct("t1", "root"), F.xxhash64("list", F.lit(draw), "t1")).alias("head"),
                *mixed).filter("least < most")
            met = members.join(heads, "list").filter("root != head.root").select(*_pair("t1", "head.t1")).distinct()
        pairs = staged(_tallied(met.join(tested, ["a", "b"], "left_anti"), samples), "pairs")
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs)
        new = staged(_verified(pairs, samples, texts), "similar")
        if not new.isEmpty():
            linked = components(linked.select(F.col("u").alias("a"), F.col("v").alias("b")).union(new))
    if not long:
        return linked
    new = _settled(lists, linked, samples, texts)
    if not new.isEmpty():
        linked = components(linked.select(F.col("u").alias("a"), F.col("v").alias("b")).union(new))
    return linked


def unique_documents(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each group the row with the smallest doc_id stays.

    Groups are connected by pairs of texts whose fingerprints differ in at most ``RADIUS``
    bits, and by pairs with a Jaccard similarity of at least ``SIMILARITY`` over the sets of
    their shingles, see ``similar_texts``. A null doc_id comes last.
    """
    spark = docs.sparkSession
    with scratch(spark), settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=BATCH):
        texts = _first_texts(docs)
        linked = similar_texts(texts)

        # a group's winner is its text with the smallest doc_id; the others' texts go
        nodes = linked.select(F.col("u").alias("t1"), F.col("v").alias("root")).union(
            linked.select(F.col("v").alias("t1"), F.col("v").alias("root")).distinct())
        known = nodes.join(texts.select("t1", "t2", "first"), "t1")
        best = known.groupBy("root").agg(F.min(F.struct("first", "t1")).alias("best"))
        losers = known.join(best, "root").filter(F.col("t1") != F.col("best.t1")).select("t1", "t2")
        losers = staged(losers, "losers", lasting=True)
    kept = _firsts(docs).join(losers.hint("shuffle_hash"), ["t1", "t2"], "left_anti")
    return kept.select("row.*").toDF(*docs.columns)

"""Merkle manifest of documents: checkpointed hash trees, and proofs from recomputed nodes.

Leaves are numbered within their source by one range sort that splits a large source, and
runs of ``FAN`` nodes become their parent. Only every ``STEP``-th level is kept: an
aligned subtree of ``FAN ** STEP`` nodes is hashed up to its head, and the levels between
are forgotten. The heads of all sources form a tree in the same way.

Proofs go down again. A subtree meets its head's path, hashes its missing levels once
more, gives each of its nodes the siblings up to the head followed by the head's path,
and drops the levels. A subtree is at most 256 rows, so no source is ever in one task.

``H`` is SHA-256 in lowercase hex over inputs joined without a separator. A leaf is H of its
fields, each ``-`` if null, else its UTF-8 bytes, ``:`` and its value.

Order within a source: doc_id, null first; rows of equal doc_id by leaf. Rows repeated in
full are leaves each. Null and empty texts have different leaves. Long texts are hashed whole. A null doc_id
is never tampered with. Extra columns are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.text import staged

FAN = 16
#: Levels from one kept level to the next.
STEP = 2
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    def coded(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[coded(f) for f in fields]).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, source, leaf, and the leaf of a tampered row's lower-cased text, else null."""
    text = F.translate("text", UPPER, LOWER)
    changed = tampered & (text != F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_of(fields).alias("leaf"),
        F.when(changed, leaf_of([*fields[:-1], text])).alias("changed"),
    )


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with tree (a number for each group, in the order of groups), idx and m.

    idx counts a group's rows from 0 in the given order, null first, and m is how many
    they are. One range sort, then offsets of a group's parts: one row for each part that has it.
    """
    keys = [F.asc_nulls_first(c) for c in [*group, *order]]
    whole = rows.withColumn("no", F.monotonically_increasing_id())
    ordered = staged(
        whole.repartitionByRange(*keys, "no").sortWithinPartitions(*keys, "no").drop("no")
        .withColumn("pos", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("pos", 33))
    own = Window.partitionBy(*group, F.lit(0))
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(*group, "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = parts.select(
        *[F.col(c).alias(f"{c}_") for c in group], F.col("part").alias("part_"),
        F.min("first").over(own).alias("tree"), F.sum("n").over(own).alias("m"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    same = F.col("part") == F.col("part_")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    return ordered.join(parts, same).select(
        *rows.columns, "tree", "m", (F.col("pos") + F.col("shift")).alias("idx"))


def _above(m: Column) -> Column:
    return F.ceil(m / FAN).cast("long")


def climbed(nodes: DataFrame) -> DataFrame:
    """The next kept level: tree, m, idx, hash of aligned subtrees' heads; a lone node stays itself."""
    head = F.expr(f"idx div {FAN**STEP}")
    level = nodes.select("tree", "m", head.alias("head"), "idx", "hash").repartition("tree", "head")
    for _ in range(STEP):
        level = level.groupBy("tree", "head", "m", F.expr(f"idx div {FAN}").alias("parent")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("run"))
        joined = F.array_join(F.transform("run", lambda x: x["hash"]), "")
        level = level.select(
            "tree", "head", F.col("parent").alias("idx"),
            F.when(F.col("m") > 1, F.sha2(joined.cast("binary"), 256))
            .otherwise(F.col("run")[0]["hash"]).alias("hash"),
            _above(F.col("m")).alias("m"))
    return level.select("tree", "m", "idx", "hash")


def kept_levels(nodes: DataFrame) -> list[DataFrame]:
    """The given level and every STEP-th above it, up to one node in each tree."""
    levels = [nodes]
    most = nodes.agg(F.max("m")).first()[0] or 1
    while most > 1 or len(levels) < 2:
        levels.append(staged(climbed(levels[-1]), "level"))
        most = -(-most // FAN**STEP)
    return levels


def _subtrees(nodes: DataFrame, paths: DataFrame, payload: list[str]) -> DataFrame:
    """One row for each aligned subtree: its nodes in order, and its head's path."""
    grouped = nodes.groupBy("tree", "m", F.expr(f"idx div {FAN**STEP}").alias("head")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "hash", *payload))).alias("nodes"))
    heads = paths.withColumnRenamed("idx", "head")
    return grouped.join(heads, ["tree", "head"])


def siblings(hashes: list[str], m: int) -> list[list[tuple[str, str]]]:
    """What stands before and after each node of a subtree, level by level below its head.

    m: nodes of the whole tree on the subtree's lowest level; at one node there is nothing above.
    """
    out: list[list[tuple[str, str]]] = [[] for _ in hashes]
    under = [[i] for i in range(len(hashes))]  # lowest nodes below each node of the level
    for _ in range(STEP):
        if m <= 1:
            break
        above, over = [], []
        for a in range(0, len(hashes), FAN):
            run = hashes[a : a + FAN]
            for i in range(len(run)):
                beside = "".join(run[:i]), "".join(run[i + 1 :])
                for leaf in under[a + i]:
                    out[leaf].append(beside)
            above.append(h("".join(run)))
            over.append([leaf for own in under[a : a + FAN] for leaf in own])
        hashes, under, m = above, over, -(-m // FAN)
    return out


def paths_below(nodes: DataFrame, paths: DataFrame, payload: str | None = None) -> DataFrame:
    """Path of each node of a kept level from the paths of the next kept level above it.

    tree, idx, subroot, root, path. With payload a column of the nodes is the new tree, their
    own hash the subroot: paths of heads of whole trees.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                upper = [(x["before"], x["after"]) for x in row["path"]]
                own = row["nodes"]
                found = siblings([x["hash"] for x in own], row["m"])
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([x[payload] if payload else row["tree"] for x in own], pa.int64()),
                    "idx": pa.array([0 if payload else x["idx"] for x in own], pa.int64()),
                    "subroot": pa.array([x["hash"] if payload else row["subroot"] for x in own], pa.string()),
                    "root": pa.array([row["root"]] * len(own), pa.string()),
                    "path": pa.array(
                        [[{"before": b, "after": a} for b, a in steps + upper] for steps in found],
                        pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                })

    return _subtrees(nodes, paths, [payload] if payload else []).mapInArrow(
        run, f"tree long, idx long, subroot string, root string, path {PATH}")


def proofs(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            for row in batch.to_pylist():
                upper = [(x["before"], x["after"]) for x in row["path"]]
                upper_proof = "".join(b + a for b, a in upper)
                out = []
                for x, steps in zip(
                        row["nodes"], siblings([x["hash"] for x in row["nodes"]], row["m"]), strict=True):
                    node = x["changed"] or x["hash"]
                    for before, after in steps + upper:
                        node = h(before + node + after)
                    proof = h("".join(b + a for b, a in steps) + upper_proof)
                    out.append((x["doc_id"], x["hash"], row["subroot"], row["root"], proof, node,
                                node == row["root"]))
                kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return _subtrees(nodes, paths, ["doc_id", "changed"]).mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string,"
             " folded_root string, verified boolean")


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """A proof for each row of docs, folded from the tampered text where that column is true."""
    rows = staged(leaves(docs, F.coalesce(tampered, F.lit(False))), "leaves")
    nodes = numbered(rows, ["source"], ["doc_id", "leaf"]).withColumnRenamed("leaf", "hash")
    levels = kept_levels(nodes)
    heads = levels[-1].select(F.col("tree").alias("own"), "hash")
    top = kept_levels(numbered(heads, [], ["own"]))
    nothing = F.array().cast(PATH)
    paths = top[-1].select(
        "tree", "idx", F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"),
        nothing.alias("path"))
    for level in reversed(top[1:-1]):
        paths = paths_below(level, paths)
    paths = paths_below(top[0], paths, "own")
    for level in reversed(levels[1:-1]):
        paths = paths_below(level, paths)
    return proofs(nodes, paths)

"""Document fingerprints: I-Match over several randomised lexicons, in DataFrame functions only.

The lexicon holds the terms (words, lower-cased) that a share of all documents between
``LEAST`` and ``MOST`` hold: a band of inverse document frequency. Since every document
adds its distinct terms to the sum of frequencies, there are at most (mean distinct
terms) / LEAST of them, however many documents there are; the lexicon is broadcast if it
has no more than ``BROADCAST`` terms and joined by a shuffle otherwise.

Of ``SUBSETS`` subsets of the lexicon, random ones keep a quarter, an eighth, ... of its
terms, several of each, and the last holds the whole lexicon, so that every lexicon term
is in one. A text's distinct lexicon terms, sorted, are hashed once for each subset. The
likeness of two fingerprints is the share of subsets with equal hashes among those in
which either text has a term: large subsets tell near copies apart, small ones still
agree when much has changed. A text without lexicon terms is hashed whole.

Null text: empty. Equal texts have equal fingerprints. Repeated rows each count. Extra
columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.text import staged

LEAST, MOST = 0.0005, 0.02
BROADCAST = 1_000_000
LEVELS, EACH = 8, 4
SUBSETS = LEVELS * EACH + 1


def _terms(text: Column) -> Column:
    """Distinct lower-cased words; a leading empty string is dropped later."""
    return F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))


def _exploded(texts: DataFrame) -> DataFrame:
    return texts.select("t1", "t2", F.explode(_terms(F.col("text"))).alias("term")).filter(
        "term != ''").select("t1", "t2", F.xxhash64("term").alias("h"))


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
        F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def lexicon(docs: DataFrame) -> DataFrame:
    """h and term (a 32-bit id) of the terms within the band, over all documents."""
    n = docs.count()
    terms = docs.select(F.explode(_terms(F.coalesce(F.col("text"), F.lit("")))).alias("term"))
    counts = terms.filter("term != ''").groupBy(F.xxhash64("term").alias("h")).agg(F.count(F.lit(1)).alias("df"))
    low, high = max(LEAST * n, 2), max(MOST * n, 2)
    return staged(
        counts.filter(F.col("df").between(low, high)).select("h", F.col("h").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("term")), "lexicon")


def _member(term: Column, subset: int) -> Column:
    """Whether a term is in a subset: all of its first bits of a hash of its own are set. The last holds all."""
    if subset == SUBSETS - 1:
        return F.lit(True)
    bits = (1 << (2 + subset // EACH)) - 1
    return F.xxhash64(F.lit(subset), term).bitwiseAND(F.lit(bits)) == bits


def fingerprints(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """t1, t2 and prints (one hash for each subset, null where it holds no term) of (t1, t2, text).

    Rows with one key hold one text. Texts without lexicon terms do not return.
    """
    if lexicon.count() <= BROADCAST:
        lexicon = F.broadcast(lexicon)
    kept = _exploded(texts).join(lexicon, "h").groupBy("t1", "t2").agg(
        F.array_sort(F.collect_set("term")).alias("terms"))

    def one(j: int) -> Column:
        own = F.filter("terms", lambda x: _member(x, j))
        return F.when(F.size(own) > 0, F.xxhash64(own))

    return kept.select("t1", "t2", F.array(*[one(j) for j in range(SUBSETS)]).alias("prints"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either has one."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    equal = F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    return F.when(either > 0, equal / either).otherwise(F.lit(1.0))


def _text_of(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8)))), "", "-" * 8)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, t1, t2) with text and key of the next row by descending doc_id.

    After the last row comes the first; nulls are last, rows with one id are in the order
    of their keys. Rows are dealt to ranges of ids, so that no task sorts all.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = [i / parts for i in range(parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", quantiles, 10 * parts)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    rows = docs.withColumn("part", part)
    order = F.struct("doc_id", "t1", "t2")
    row = F.struct(F.col("text").alias("text"), F.col("t1").alias("t1"), F.col("t2").alias("t2"))
    first = rows.groupBy("part").agg(F.max_by(row, order).alias("first"))
    after = first.select("part").withColumns({
        "follows": F.lead("part").over(Window.orderBy(F.desc("part"))),
        "top": F.max("part").over(Window.orderBy(F.lit(1)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)),
    }).select(F.col("part").alias("of"), F.coalesce("follows", "top").alias("part"))
    borders = after.join(first, "part").select(F.col("of").alias("part"), "first")
    by = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("t1"), F.desc("t2"))
    return rows.withColumn("next", F.lead(row).over(by)).join(borders, "part").withColumn(
        "next", F.coalesce("next", "first")).drop("first", "part")


def edited_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints of text and edited text, and likenesses."""
    rows = with_key(docs)
    words = lexicon(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = with_next(rows).select(
        "doc_id", "t1", "t2", n.cast("long").alias("n_chars"),
        F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"),
                 F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"),
        F.col("next.t1").alias("n1"), F.col("next.t2").alias("n2"),
    ).withColumns({"e1": F.xxhash64("edited"), "e2": F.xxhash64(F.lit(1), "edited")})
    texts = rows.select("t1", "t2", "text").union(edited.select("e1", "e2", "edited"))
    prints = staged(fingerprints(texts, words), "prints")
    slim = staged(edited.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "t1", "t2", "e1", "e2", "n1", "n2"), "edits")
    for name, a, b in (("own", "t1", "t2"), ("new", "e1", "e2"), ("near", "n1", "n2")):
        whole = F.array(*[F.xxhash64(F.lit(j), a, b) for j in range(SUBSETS)])
        side = prints.select(F.col("t1").alias(a), F.col("t2").alias(b), F.col("prints").alias(name))
        slim = slim.join(side, [a, b], "left").withColumn(name, F.coalesce(name, whole))
    return slim.select(
        "doc_id", "n_chars", "edited_sha256", _text_of(F.col("own")).alias("fingerprint"),
        _text_of(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("near")).alias("near_next"))

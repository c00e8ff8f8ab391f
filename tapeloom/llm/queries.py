"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.llm import (
    collocations, decontaminate, exact_topk, imatch, lang_id, language_model, merkle, quality, simhash,
    substring_dedup, suffix_dedup, tokens,
)
from tapeloom.llm.oracles import ORACLES
from tapeloom.llm.text import documents, keyed, staged

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontamination(spark, sf_dir):
    """Benchmark items that documents hold, with the window most like each."""
    return decontaminate.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query
def op2_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and near-duplicate component of each document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op3_best_fit_packing(spark, sf_dir):
    """Packed sequences: pieces, cumulative lengths, and checksums of ids and positions."""
    packed = tokens.pack_best_fit(documents(spark, sf_dir))
    return packed.withColumns({
        "ids_crc32": F.crc32("ids"), "positions_crc32": F.crc32("position_ids"),
    }).drop("ids", "position_ids")


@query
def op4_substring_dedup(spark, sf_dir):
    """Words of each document that 35-word windows met elsewhere cover."""
    docs = documents(spark, sf_dir)
    kept = substring_dedup.kept_by_text(docs).withColumn(
        "kept_sha256", F.sha2(F.col("kept_text").cast("binary"), 256))
    keys = keyed(docs).select("doc_id", "t1", "t2")
    return keys.join(kept, ["t1", "t2"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_suffix_dedup(spark, sf_dir):
    """Bytes of each document that 100-byte strings met earlier cover."""
    docs = documents(spark, sf_dir)
    kept = suffix_dedup.kept_by_text(docs).withColumn("kept_sha256", F.sha2("kept", 256))
    rows = keyed(docs).select("doc_id", "t1", "t2", "order_id").join(kept.drop("kept"), ["t1", "t2"])
    copy = suffix_dedup.later_copy("order_id")
    return rows.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256"))
        .alias("kept_sha256"),
    )


@query
def op6_quality(spark, sf_dir):
    """Quality score of each document, learnt from labelled rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = lang_id.fold("doc_id", 5) == 0
    stats = staged(quality.text_statistics(docs.select("doc_id", held_out.alias("held_out"), "text")), "stats")
    labels = documents(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    training = stats.filter("not held_out").join(labels.filter("label is not null"), "doc_id")
    scored = quality.scored(stats, quality.fit(training))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query
def op7_imatch_fingerprints(spark, sf_dir):
    """Fingerprints of each document and of its edited text, with likenesses."""
    return imatch.edited_documents(documents(spark, sf_dir))


@query
def op8_language_model(spark, sf_dir):
    """Unigram and log-bilinear scores of each document."""
    return language_model.score_documents(documents(spark, sf_dir), lang_id.fold("doc_id", 7) == 2)


@query
def op9_language_id(spark, sf_dir):
    """Language of each document, learnt from the rows that are not held out."""
    held_out = lang_id.fold("doc_id", 5) == 0
    docs = documents(spark, sf_dir)
    model = lang_id.fit(docs.filter(~held_out))
    return lang_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@query
def op10_power_of_two_packing(spark, sf_dir):
    """Pieces of binary lengths, each a sequence of its own."""
    return tokens.pack_powers(documents(spark, sf_dir))


@query
def op11_exact_topk(spark, sf_dir):
    """The five vectors with the greatest integer inner product for each fiftieth id."""
    return exact_topk.search(documents(spark, sf_dir, "embeddings"), every=50)


@query
def op12_collocations(spark, sf_dir):
    """Each language's phrases of words that occur together more often than apart."""
    return collocations.collocations(documents(spark, sf_dir))


@query
def op13_merkle_manifest(spark, sf_dir):
    """Leaf, roots and proof of each document; a fifth are folded from tampered texts."""
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)

"""Inputs beyond sizes that once were limits, and what jobs leave behind."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from tapeloom.llm import imatch, lang_id, queries, simhash, text, tokens
from tests.llm import brute


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


def ids_of(tokenizer, x):
    return tokenizer.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("gap", [" ", "\n", "\t \u3000", "\u00a0\r\n"])
@pytest.mark.parametrize("after", ["", "word more", "\u1c80\U0001f600 x", "\x1c\x1f.", "'s"])
def test_long_white_space_has_the_vocabularys_ids(tokenizer, gap, after):
    for n in (tokens.RUN // len(gap) - 1, tokens.RUN, tokens.RUN + 1):
        x = "It is" + gap * n + after + " " * 3 + "end" + gap * n
        assert tokens.token_ids(x, tokens.default_path()) == ids_of(tokenizer, x)


@pytest.mark.parametrize("gap", [" ", "\n"])
def test_megabytes_of_white_space_are_packed(spark, tokenizer, gap):
    x = "a b" + gap * 2_000_000 + "c d" + gap * 1_200_000
    docs = spark.createDataFrame([(1, x), (2, "short")], "doc_id long, text string")
    want = len(ids_of(tokenizer, x)) + 1
    pieces = tokens.pack_powers(docs).filter("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert tuple(pieces) == (want, want)
    packed = tokens.pack_best_fit(docs)
    assert packed.agg(F.sum("n_tokens")).first()[0] == want + len(ids_of(tokenizer, "short")) + 1



def test_seven_hundred_languages(spark, tmp_path):
    rows = []
    for i in range(700):
        rng = np.random.default_rng(i)
        words = ["".join(map(chr, w)) for w in rng.integers(97, 123, (8, 5))]
        rows += [(4 * i + j, " ".join(rng.choice(words, 40)), f"l{i:03}") for j in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op9_language_id"](spark, str(tmp_path)).toPandas()
    lang = dict((d, x) for d, _, x in rows)
    known = {lang[d] for d, held in zip(got.doc_id, got.held_out, strict=True) if not held}
    assert len(got) == 2800 and got.score.between(0, 1).all()
    test = got[got.held_out & got.doc_id.map(lang).isin(known)]
    assert len(test) > 400 and (test.lang_pred == test.doc_id.map(lang)).mean() > 0.95


def test_languages_equal_a_plain_decoding(spark, monkeypatch):
    texts = {"aa": ["the cat and the dog", "the end of the day"], "bb": ["le chat et le chien", "la fin du jour"],
             "cc": ["der Hund und die Katze", "das Ende des Tages"]}
    training = [(t, lang) for lang, own in texts.items() for t in own]
    asked = ["the night of the cat", "le jour", "die Nacht und der Tag", "Le chat and the Hund"]

    def hashed(x):
        block = next(text.blocks(iter([pa.RecordBatch.from_pydict({"text": [x]})])))
        return [g for g in lang_id.grams(block).tolist() if g < lang_id.GRAMS]

    model = lang_id.fit(spark.createDataFrame(training, "text string, lang string"))
    got = lang_id.identify(spark.createDataFrame([(x,) for x in asked], "text string"), model).collect()
    want = brute.language_scores(training, asked, lang_id.codebook, hashed, lang_id.GRAMS)
    assert [r.lang_pred for r in got] == [x for x, _ in want]
    assert [r.score for r in got] == pytest.approx([x for _, x in want], rel=1e-5)


def test_near_dedup_leaves_only_its_small_table(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{(i // 3) * 50 + j}" for j in range(40)) + " x" * (i % 3), "e") for i in range(60)],
        "doc_id long, text string, row string")
    assert simhash.unique_documents(docs).count() == 20
    left = set(os.listdir(shared)) - before
    assert len(left) == 1 and left.pop().startswith("losers")


def test_buckets_hold_sequences_of_one_length(spark, tokenizer, tmp_path):
    rows = [(i, " ".join(f"word{j % (i + 2)}" for j in range(i * 37 % 900))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens.write_buckets(tokens.pack_powers(docs, length=256, ids=True), str(tmp_path / "b"))
    folders = {int(f.split("=")[1]) for f in os.listdir(tmp_path / "b") if f.startswith("length=")}
    assert folders <= {1 << b for b in range(9)} and 256 in folders and 1 in folders
    back = spark.read.parquet(str(tmp_path / "b")).toPandas()
    assert (back.ids.map(len) == back.length * 4).all()
    assert back.groupby("sequence_id").doc_id.nunique().max() == 1  # no sequence crosses documents
    for doc_id, own in back.sort_values("start").groupby("doc_id"):
        ids = np.frombuffer(b"".join(own.ids), "<u4").tolist()
        assert ids == [*ids_of(tokenizer, dict(rows)[doc_id] or ""), 1]


def test_packed_sequences_are_written_whole(spark, tokenizer, tmp_path):
    rows = [(i, "a b c " * (i * 13 % 70)) for i in range(40)]
    packed = tokens.pack_best_fit(spark.createDataFrame(rows, "doc_id long, text string"), length=64)
    tokens.write_packed(packed, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.schema == packed.schema and back.count() == packed.count()
    pieces = {}
    for r in back.collect():
        ids, resets = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(resets) == 64 and r.cu_seqlens[-1] == r.n_tokens
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            pieces[d, start] = ids[a:b].tolist()
            assert resets[a:b].tolist() == list(range(b - a))
    for d, x in rows:
        own = [i for (doc, _), part in sorted(pieces.items()) if doc == d for i in part]
        assert own[:-1] == ids_of(tokenizer, x)


def test_lexicon_joins_give_the_same_fingerprints(spark, tmp_path, monkeypatch):
    rows = brute.random_rows(11)
    spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    ask = queries.QUERIES["op7_imatch_fingerprints"]
    broadcast = sorted(map(tuple, ask(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(imatch, "BROADCAST", -1)  # a lexicon of any size is then shuffled
    assert sorted(map(tuple, ask(spark, str(tmp_path)).collect())) == broadcast


def test_imatch_and_language_of_megabytes(spark, tmp_path):
    long = "ab " * 400_000 + "é" * 1_000_000
    spark.createDataFrame([(1, long, "en"), (2, "short one", "en"), (5, long, None)],
                          "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op7_imatch_fingerprints"](spark, str(tmp_path)).collect()}
    assert got[1].fingerprint == got[5].fingerprint and got[1].n_chars == len(long)
    langs = {r.doc_id: r.lang_pred for r in queries.QUERIES["op9_language_id"](spark, str(tmp_path)).collect()}
    assert set(langs) == {1, 2, 5} and set(langs.values()) <= {"en", "und"}

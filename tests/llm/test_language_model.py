"""The log-bilinear model against plain counts and sums."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import language_model, queries
from tapeloom.llm.text import staged


def texts(seed, n=240):
    """Sentences in two made-up languages, whose words follow one another in turns."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = "xy"[i % 2]
        words = [f"{lang}{'ab'[j % 2]}{rng.integers(0, 12)}" for j in range(rng.integers(0, 60))]
        rows.append((i, " ".join(words) + f" once{i}"))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "XA1 xa1\n xb2")]


def fitted(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = staged(language_model.count_words(docs), "counts")
    counts = language_model.gather(table)
    return docs, table, counts, language_model.fit(docs, counts)


def test_vocabulary_follows_the_counts(spark):
    rows = texts(1)
    counts = fitted(spark, rows)[2]
    plain = Counter(w for _, t in rows for w in (t or "").lower().split())
    plain["END"] = len(rows)
    assert counts.words == sum(n >= language_model.LEAST for n in plain.values())
    assert counts.tokens == sum(plain.values()) and counts.distinct == len(plain)
    own = counts.symbol >= 0
    assert sorted(counts.n[own].tolist()) == sorted(n for n in plain.values() if n >= language_model.LEAST)


def test_neighbour_counts_equal_plain_ones_however_often_tasks_pass_them_on(spark, monkeypatch):
    rows = texts(2, 60)
    docs, _, counts, model = fitted(spark, rows)
    everything = np.arange(counts.symbols)

    def ask():
        return language_model.collected(language_model.count_neighbours(docs, counts, model.group), everything)

    after, before, of_groups = ask()
    dense = after[everything], before[everything]
    total = sum(len((t or "").split()) + 1 for _, t in rows)
    assert dense[0].sum() == dense[1].sum() == total == after.sum(0).sum() == before.sum(1).sum()
    assert np.array_equal(dense[0].sum(0), after.sum(0)) and np.array_equal(dense[1].sum(1), before.sum(1))
    # both tables hold the same steps from group to group
    groups = [np.zeros((language_model.GROUPS,) * 2) for _ in range(2)]
    np.add.at(groups[0], model.group, dense[0])
    np.add.at(groups[1], model.group, dense[1])
    assert np.array_equal(groups[0], groups[1].T) and np.array_equal(groups[1], of_groups)
    monkeypatch.setattr(language_model, "PAIRS", 5)
    for a, b in zip((after, before), ask()[:2], strict=True):
        assert np.array_equal(a.key, b.key) and np.array_equal(a.n, b.n)


@pytest.mark.parametrize("head", [1 << 13, 20])
def test_chances_sum_to_one_and_scores_equal_plain_sums(spark, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    rows = texts(3)
    docs, table, counts, model = fitted(spark, rows)
    every = np.arange(counts.symbols)
    for context in (0, 1, counts.words - 1, counts.words + 7):
        chance = 10.0 ** model.log10(np.full(len(every), context), every)
        assert chance.sum() == pytest.approx(1, abs=1e-4)

    words = Counter(w for _, t in rows for w in (t or "").lower().split())
    words[""] = len(rows)  # the end
    kinds = {}
    for w in words:
        data, last = w.encode(), 0
        if data:
            last = language_model.mix(np.array([data[-1] << 8 | (data[-2] if len(data) > 1 else 0)], np.uint64))[0]
        kinds[w] = int(last % np.uint64(language_model.CLASSES)) if data else language_model.END_CLASS
    rare = [w for w in words if words[w] < language_model.LEAST]
    own = sorted((w for w in words if w not in rare), key=lambda w: -words[w])
    symbols = {}  # the library orders equal counts by hash: take its number of each word
    for w in own:
        block_hash = language_model.END
        if w:
            batch = spark.createDataFrame([(w,)], "text string").toArrow().to_batches()
            block_hash = next(iter(language_model.blocks(iter(batch)))).words().hash[0]
        symbols[w] = int(counts.symbol[np.searchsorted(counts.h, block_hash)])
    query, target, bias = model.after
    left, right, inner, _ = model.inside

    def plain(text):
        score, before = 0.0, symbols[""]
        for w in [*(text or "").lower().split(), ""]:
            s = symbols.get(w, counts.words + kinds[w])
            logits = query[before] @ target.T + bias
            score += logits[model.group[s]] - np.log(np.exp(logits).sum())
            members = np.flatnonzero(model.group == model.group[s])
            logits = right[members] @ left[model.group[before]] + inner[members]
            score += logits[list(members).index(s)] - np.log(np.exp(logits).sum())
            if w in rare:
                mates = [x for x in rare if kinds[x] == kinds[w]]
                score += math.log((words[w] + 1) / (sum(words[x] + 1 for x in mates) + 1))
            before = s
        return score / math.log(10)

    got = {r.doc_id: r for r in language_model.scores(docs, F.lit(False), table, counts, model).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert got[doc_id].score == pytest.approx(plain(text), abs=1e-2)


@pytest.mark.parametrize("head", [1 << 13, 10])
def test_model_beats_counts_where_words_follow_one_another(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    spark.createDataFrame(texts(4, 900), "doc_id long, text string").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["op8_language_model"](spark, str(tmp_path)).filter("held_out").agg(
        F.sum("n_tokens").alias("n"), F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert (rows.score - rows.base) / rows.n > 0.3


def test_more_words_than_vectors(spark, tmp_path, monkeypatch):
    spark.createDataFrame(texts(5), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ask = queries.QUERIES["op8_language_model"]
    whole = sorted(map(tuple, ask(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(language_model, "WORDS", 3)
    few = sorted(map(tuple, ask(spark, str(tmp_path)).collect()))
    assert [r[:6] for r in few] == [pytest.approx(r[:6]) for r in whole]
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in few)

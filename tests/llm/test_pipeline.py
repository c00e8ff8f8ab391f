"""The pipeline's stages on planted cases."""

import numpy as np
import pytest

import corpus_pipeline


def test_stages_catch_what_is_planted_and_leave_the_rest(spark, tmp_path):
    rng = np.random.default_rng(1)

    def prose(n):
        return [f"{a}{b}" for a, b in zip(rng.choice(["the", "in", "ter", "so"], n), rng.integers(0, 4000, n).tolist(),
                                          strict=True)]

    clean = {i: " ".join(prose(120)) for i in range(30)}
    near = clean[4].split()
    near[50] = "other"
    passage, item = prose(60), " ".join(prose(20))
    planted = {
        100: clean[3], 101: " ".join(near), 102: "12345 !!", 103: None, 104: " ".join(prose(90) + passage),
        105: " ".join(passage + prose(90)), 106: " ".join(prose(70)) + " " + item, 107: " ".join(passage),
    }
    rows = [(d, t, "en", "s", len(t or "")) for d, t in {**clean, **planted}.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    everything = {**clean, **planted}
    assert set(everything) - set(left["language_id"]) == {102, 103}
    assert set(left["language_id"]) - set(left["near_dedup"]) == {100, 101}
    assert set(left["near_dedup"]) - set(left["substring_dedup"]) == {107}
    assert all(len(left["substring_dedup"][d].split()) == 90 for d in (104, 105))
    assert set(left["substring_dedup"]) - set(left["decontamination"]) == {106}
    assert {d: t for d, t in left["decontamination"].items() if d < 100} == clean
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(left["decontamination"])


@pytest.mark.parametrize("rows", [[], [(1, None), (None, None), (2, "")]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    columns = "doc_id long, text string, lang string, t1 int, T2 string, row int, first int, ambiguous int"
    spark.createDataFrame([(d, t, None, 1, "x", 2, 3, 4) for d, t in rows], columns).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

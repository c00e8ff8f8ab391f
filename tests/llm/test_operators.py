"""Operators against plain versions on small inputs, and their defined edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import (
    decontaminate, imatch, lang_id, language_model, quality, queries, simhash, substring_dedup,
    suffix_dedup, text, tokens,
)
from tapeloom.llm.text import staged
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"t{i * 7919 % 60013}" for i in range(700_000))  # about 4.6 MB


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)


@pytest.fixture
def tables(spark, tmp_path):
    """Write documents (and others) to a folder that queries read."""
    def write(rows, **others):
        docs_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
        for name, df in others.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_and_fingerprints_equal_plain_versions(spark, tables, seed):
    rows = brute.random_rows(seed)
    folder = tables(rows)
    for name, plain in (
        ("op4_substring_dedup", brute.kept_words), ("op5_suffix_dedup", brute.kept_bytes),
        ("op2_simhash_near_dedup", brute.simhash_components),
    ):
        assert rows_of(queries.QUERIES[name](spark, folder)) == sorted(plain(rows)), name


def test_near_fingerprints_link_in_small_and_large_lists(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ int(a) for a in rng.integers(0, 1 << 9, 300)}  # one list of hundreds
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    fps |= {x ^ (1 << 63 | 1) for x in list(fps)[:20]}
    fps = sorted(fps)
    root = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    place = {x: i for i, x in enumerate(signed)}
    linked = {(place[r.a], place[r.b]) for r in pairs}
    assert brute.components(list(range(len(fps))), lambda a, b: (a, b) in linked or (b, a) in linked) == root


def test_components_of_a_long_chain_and_a_hub(spark):
    from tapeloom.llm.graph import components
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1200)] + [(7, 7)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 5 for i in range(1000, 1200)}}


@pytest.mark.parametrize(("edges", "rounds"), [
    ([(5, i) for i in range(1000, 1200)] + [(7, 7), (9, 8), (8, 9)], 0), ([], 0),
    ([(1, 2), (2, 3)], 1), ([(1, 3), (2, 3)], 1), ([(2, 3), (1, 3), (3, 4), (6, 5)], 1)])
def test_links_that_are_stars_take_no_further_round(spark, monkeypatch, edges, rounds):
    from tapeloom.llm import graph
    written = []
    monkeypatch.setattr(graph, "staged", lambda df, name: (written.append(name), staged(df, name))[1])
    got = {(r.u, r.v) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    root = brute.components(nodes, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == {(nodes[i], nodes[r]) for i, r in enumerate(root) if i != r}
    assert written == ["links"] + ["stars"] * rounds


def test_links_between_fingerprints_bear_the_names_given(spark):
    rows = [(0, 70), (3, 71), (1 << 62, 72), (7, 73), ((1 << 62) + 1, 74), (-1, 75)]
    pairs = simhash.links(spark.createDataFrame(rows, "fp long, head long"), key="head").collect()
    near = {frozenset((p, q)) for (a, p), (b, q) in combinations(rows, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    linked = {frozenset(r) for r in pairs}
    names = [n for _, n in rows]
    same = [brute.components(names, lambda a, b, x=x: frozenset((a, b)) in x) for x in (near, linked)]
    assert same[0] == same[1]


def test_edge_rows_of_the_repeat_operators(spark, tables):
    long = " ".join(f"u{i}" for i in range(50))
    rows = [(None, None), (None, long), (1, long), (1, long), (2, LONG), (3, "short"), (4, LONG)]
    folder = tables(rows)
    words = rows_of(queries.QUERIES["op4_substring_dedup"](spark, folder))
    assert [r[:3] for r in words] == [
        (None, 0, 0), (None, 50, 50), (1, 50, 50), (1, 50, 50), (2, 700_000, 700_000), (3, 1, 0),
        (4, 700_000, 700_000)]
    size, n = len(long), len(LONG)
    got = rows_of(queries.QUERIES["op5_suffix_dedup"](spark, folder))
    # the null id comes first, so its copy stays; rows with one id are one document
    assert [r[:4] for r in got if r[0] != 2] == [
        (None, 0, 0, 0), (None, size, 0, 0), (1, size, size, 1), (1, size, size, 1), (3, 5, 0, 0), (4, n, n, 1)]
    assert [r[1] for r in got if r[0] == 2] == [n]
    near = rows_of(queries.QUERIES["op2_simhash_near_dedup"](spark, folder))
    assert {r[2] for r in near if r[1] == near[-1][1]} == {2}
    assert (None, "0" * 16, None) in near


def test_overfull_minimizer_groups_go_on_as_windows(spark, tables, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    rng = np.random.default_rng(4)
    core = "".join(chr(97 + c) for c in rng.integers(0, 26, 130))
    rows = [(i, "".join(chr(97 + c) for c in rng.integers(0, 26, 30)) + core
             + "".join(chr(97 + c) for c in rng.integers(0, 26, 30))) for i in range(30)]
    got = rows_of(queries.QUERIES["op5_suffix_dedup"](spark, tables(rows)))
    assert got == sorted(brute.kept_bytes(rows))


def test_maximal_repeats_have_all_occurrences():
    core = b"".join(bytes([97 + i % 25]) for i in range(120))
    segments = [b"A" + core, b"B" + core + b"x", core[:110] + b"yy"]
    found = {(size, tuple(sorted(zip(o.tolist(), s.tolist(), strict=True))))
             for size, o, s in suffix_dedup.maximal_repeats(segments, 100)}
    assert (120, ((0, 1), (1, 1))) in found
    assert (110, ((0, 1), (1, 1), (2, 0))) in found


def test_decontamination_equals_windows_by_hand(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(500)]

    def some(n):
        return [vocabulary[i] for i in rng.integers(0, 500, n)]

    items = [(i, " ".join(some(n))) for i, n in enumerate((3, 15, 18, 30, 45, 59))] + [(90, None), (91, " ")]
    docs = []
    for i in range(60):
        item = items[i % 6][1].split()
        edits = rng.integers(0, len(item), i // 12)
        item = [w if j not in edits else "edit" for j, w in enumerate(item)]
        docs.append((i, " ".join([*some(80), *item, *some(40)]).upper() if i % 2 else "  ".join([*some(9), *item])))
    docs += [(100, None), (101, ""), (102, " ".join(items[3][1].split()[:28])), (103, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs_of(spark, docs)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(frame, bench).collect()}
    want = brute.leaks(docs, items)
    assert got == pytest.approx(want)
    assert 10 < len(want)
    kept = decontaminate.decontaminated(frame, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert kept.columns == frame.columns


def test_items_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 8)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(5)]
    docs = docs_of(spark, [(i, f"x {t} y") for i, t in items] + [(9, "x y")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(i, i) for i in range(5)}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [9]


ODD = ["", "a", "Hello  world's\n\n 12 — ñandú <|endoftext|> x", "\x00\x01", "日本語 text", " " * 300, "é" * 5000]


def test_powers_round_trip(spark):
    own = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = [*enumerate(ODD), (None, None), (50, "word " * 5000), (50, "word " * 5000)]
    found = defaultdict(list)
    for r in tokens.pack_powers(docs_of(spark, rows), ids=True).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert (len(ids), zlib.crc32(r.ids), r.offset) == (r.length, r.ids_crc32, 0)
        assert r.length <= 2048 and r.length & (r.length - 1) == 0
        found[r.doc_id].append((r.start, r.sequence_id, ids))
    assert len({s for x in found.values() for _, s, _ in x}) == sum(map(len, found.values()))
    for doc_id, value in dict(rows).items():
        want = own.encode(value or "", add_special_tokens=False).ids + [1]
        pieces = sorted(found[doc_id], key=lambda x: x[:2])[:: 2 if doc_id == 50 else 1]
        assert np.concatenate([p[2] for p in pieces]).tolist() == want


def test_best_fit_round_trip_and_tightness(spark):
    rows = [(i, ODD[i % len(ODD)] * (i % 9)) for i in range(60)] + [(None, None), (61, "word " * 5000)]
    found = defaultdict(dict)
    for r in tokens.pack_best_fit(docs_of(spark, rows), length=256).collect():
        ids, at = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(at) == 256 and (ids[r.n_tokens :] == 50256).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found[d][s] = ids[a:b].tolist()
            assert at[a:b].tolist() == list(range(b - a))
    own = tokens.encoder(tokens.default_path())
    for d, t in rows:
        assert sum((found[d][s] for s in sorted(found[d])), []) == [*own.encode_ordinary(t or ""), 50256]
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 257, 400).tolist()
    packed = tokens.best_fit(sizes, 256)
    assert sorted(i for p in packed for i in p) == list(range(400))
    open_, plain = [], 0  # the same rule by looking at all open sequences
    for n in sorted(sizes, reverse=True):
        fit = [i for i, x in enumerate(open_) if x >= n]
        if fit:
            open_[min(fit, key=lambda i: open_[i])] -= n
        else:
            open_.append(256 - n)
            plain += 1
    assert len(packed) == plain and all(sum(sizes[i] for i in p) <= 256 for p in packed)


def test_quality_separates_and_scores_everything(spark, tables):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 900, 80)) + ".\nMore text here.") for i in range(200)]
    rows = [(i, t.upper().replace(" ", "!! ") if i % 4 == 0 else t) for i, t in rows] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows[:200]] + [(1, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = queries.QUERIES["op6_quality"](spark, tables(rows, labels=labels)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in got if r.doc_id < 500)
    assert quality.isotonic(np.array([1, 1, 2, 1.0]), np.array([1, 0, 1, 1.0])).tolist() == [0.5] * 3 + [1.0]


def test_quality_without_labels(spark, tables):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = queries.QUERIES["op6_quality"](spark, tables([(1, "a"), (2, None)], labels=labels)).collect()
    assert [r.score for r in got] == [0.5, 0.5]


def test_imatch_edits_and_likeness(spark, tables):
    rows = brute.random_rows(8) + [(3, "a twin id"), (None, "no id"), (200, "x"), (201, "é" * 9)]
    got = queries.QUERIES["op7_imatch_fingerprints"](spark, tables(rows)).collect()
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    ids = [r[0] for r in sorted((r for r in rows if r[0] is not None), reverse=True, key=lambda r: r[0])]
    lookup = {d: t or "" for d, t in rows}
    for r in got:
        if r.doc_id in (None, 3, 4, 0):  # neighbours of the doubled and of the null id
            continue
        own, follower = lookup[r.doc_id], lookup[ids[ids.index(r.doc_id) + 1]]
        half = len(own) // 2
        edited = own[: len(own) - half] + follower[:half]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        by_text[own].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (own == edited)
    assert all(len(x) == 1 for x in by_text.values())
    plan = imatch.fingerprints(
        imatch.with_key(docs_of(spark, rows)), imatch.lexicon(docs_of(spark, rows)))._jdf.queryExecution()
    assert "Python" not in plan.toString() and "Arrow" not in plan.toString()


def test_imatch_texts_with_one_lexicon_term_differ(spark, tables):
    rows = [(i, f"own{i} term{i // 2}") for i in range(400)]  # each term in two texts, the other words in one
    got = queries.QUERIES["op7_imatch_fingerprints"](spark, tables(rows)).collect()
    prints = defaultdict(set)
    for r in got:
        prints[r.fingerprint].add(r.doc_id // 2)
        assert set(r.fingerprint) != {"-"}
        if r.doc_id and r.doc_id % 2 == 0:  # the next row holds another term
            assert r.near_next < 1
    assert len(prints) == 200 and all(len(x) == 1 for x in prints.values())


def test_language_model_base_and_normalisation(spark, tables):
    rows = brute.random_rows(9) + [(300, LONG), (301, "The END the")]
    got = queries.QUERIES["op8_language_model"](spark, tables(rows)).collect()
    want = brute.base_scores(rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    chances = language_model.train(np.ones((language_model.SYMBOLS,) * 2))
    assert np.allclose((10**chances).sum(1), 1)


def test_words_beyond_the_known_are_joined(spark, tables, monkeypatch):
    rows = brute.random_rows(10)
    folder = tables(rows)
    whole = rows_of(queries.QUERIES["op8_language_model"](spark, folder))
    monkeypatch.setattr(language_model, "COMMON", 0)
    monkeypatch.setattr(language_model, "KNOWN", 0)
    got = rows_of(queries.QUERIES["op8_language_model"](spark, folder))
    assert [r[:5] for r in got] == [r[:5] for r in whole]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in whole])


def test_language_id_held_out_and_rejects(spark, tables):
    rng = np.random.default_rng(11)
    parts = {"en": ["the", "ing", "tion", "her"], "de": ["sch", "ung", "der", "ich"], "fr": ["eau", "ment", "les", "oui"],
             "es": ["ción", "los", "que", "ñas"], "it": ["gli", "zione", "che", "sono"]}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 5]
        rows.append((i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(25)), lang, "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "12 34 !!", None, "s", 0), (902, "", "de", "s", 0), (903, "ééé", None, "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    folder = tables([])
    frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, folder).collect()}
    assert len(got) == len(rows)
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:300])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred in parts and all(0 <= r.score <= 1 for r in got.values())
    kept = lang_id.accepted(frame, lang_id.fit(frame))
    assert kept.columns == frame.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())


@pytest.mark.parametrize("k", [2, 3, 6, 9, 40])
def test_codewords_differ(k):
    code = lang_id.codebook(k)
    distance = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert min(distance) >= (1 if k == 2 else 2)


def test_near_documents_equal_plain_groups(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(40):
        own = [f"z{x}" for x in rng.integers(0, 3000, int(rng.integers(60, 400)))]
        rows.append(own)
        for _ in range(i % 4):
            copy = list(own)
            for at in rng.integers(0, len(copy), len(copy) // 100 + 1):
                copy[at] = "changed"
            rows.append(copy)
    rows = [(i * 3 % 997, " ".join(w)) for i, w in enumerate(rows)]
    rows += [(2000, rows[0][1]), (2001, None), (2002, ""), (None, rows[1][1])]
    ids = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    sets = [brute.shingles(t) for _, t in ids]
    root = brute.components(sets, lambda a, b: brute.jaccard(a, b) >= 0.8)
    want = {ids[i][0] for i, r in enumerate(root) if i == r}
    frame = docs_of(spark, rows).withColumnRenamed("source", "t1").withColumnRenamed("lang", "c0")
    got = simhash.unique_documents(frame)
    assert got.columns == frame.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(want)


def test_near_documents_around_one_text_in_long_lists(spark, monkeypatch):
    rng = np.random.default_rng(13)
    base = [f"z{x}" for x in range(500)]
    rows = [(5000, " ".join(base))]
    for i in range(600):  # each about 0.85 like the base and 0.72 like one another
        copy = list(base)
        for at in rng.choice(62, 8, replace=False) * 8 + 3:
            copy[at] = f"c{i}"
        rows.append((i, " ".join(copy)))
    rows += [(6000 + i, " ".join(base[:260] + [f"o{i}x{x}" for x in range(300)])) for i in range(40)]
    sets = [brute.shingles(t) for _, t in rows]
    near = [brute.jaccard(sets[0], s) >= 0.8 for s in sets]
    assert all(near[:601]) and not any(near[601:]) and brute.jaccard(sets[1], sets[2]) < 0.8
    want = [0, *range(6000, 6040)]
    monkeypatch.setattr(simhash, "CELL", 100, raising=False)  # blocks of a list meet in several cells
    got = simhash.unique_documents(docs_of(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == want


def test_substring_dedup_keeps_other_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    frame = docs_of(spark, [(1, f"one  two {passage}"), (2, f"{passage} three"), (3, "as  it\nwas"), (4, None)])
    frame = frame.withColumnRenamed("source", "t1").withColumnRenamed("lang", "kept_text")
    got = substring_dedup.substring_dedup(frame)
    assert got.columns == frame.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "one two", 2: "three", 3: "as  it\nwas", 4: None}


def test_empty_tables(spark, tables):
    folder = tables([], labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                    benchmark=spark.createDataFrame([], "item_id long, text string"),
                    embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))
    for name, f in queries.QUERIES.items():
        assert f(spark, folder).collect() == [], name


def test_blocks_of_one_long_text_hash_like_short_ones():
    data = np.frombuffer(LONG.encode(), np.uint8)
    whole = text.Words(data, np.array([0, len(data)]))
    few = text.Words(data[:1000], np.array([0, 1000]))
    assert len(whole) == 700_000
    assert (whole.hash[: len(few) - 1] == few.hash[:-1]).all()


def test_folds_are_those_of_the_id_as_text(spark):
    frame = spark.createDataFrame([(5,), (123456,), (None,)], "doc_id long")
    got = [r.f for r in frame.select(lang_id.fold("doc_id", 5).alias("f")).collect()]
    assert got == [zlib.crc32(b"5") % 5, zlib.crc32(b"123456") % 5, 0]
    assert frame.select(F.count("*")).first()[0] == 3


def test_near_duplicates_are_found_among_similar_but_different_texts(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(230)]

    def edited(n):
        words = list(base)
        for i in rng.choice(len(words), n, replace=False):
            words[i] = f"x{rng.integers(1 << 30)}"
        return words

    texts = [edited(int(n)) for n in rng.integers(2, 8, 60)]
    shingles = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                old, new = sorted((root[i], root[j]), reverse=True)
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert len(set(root)) < len(texts)
    assert {r.doc_id for r in simhash.unique_documents(docs).collect()} == set(root)


def test_unique_documents_join_all_near_fingerprints(spark):
    """Fingerprints count repeats: texts of one repeated line are near whatever their short ends."""
    line = " ".join(f"w{i}" for i in range(7))
    rows = [(i, " ".join([line] * 200 + [f"e{i}x{x}" for x in range(12)])) for i in (3, 1, 2)]
    rows += [(10 + i, " ".join(f"o{i}x{x}" for x in range(60))) for i in range(3)]
    assert all(brute.jaccard(brute.shingles(a), brute.shingles(b)) < 0.8 for a, b in combinations([t for _, t in rows], 2))
    docs = docs_of(spark, rows)
    of = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert of == {1, 10, 11, 12}
    assert {r.doc_id for r in simhash.unique_documents(docs).collect()} == of


def test_unique_documents_take_no_steps_for_lists_that_are_not_there(spark, monkeypatch):
    """Texts are read once for samples and fingerprints; without a long list nothing is drawn or settled."""
    written = []
    monkeypatch.setattr(simhash, "staged", lambda df, name, *a, **k: (written.append(name), staged(df, name, *a, **k))[1])
    base = [[f"b{i}x{x}" for x in range(200)] for i in range(5)]
    rows = [(10 * i + n, " ".join([*b[:100], *["other"] * bool(n), *b[100:]])) for i, b in enumerate(base) for n in range(2)]
    spark.sparkContext.setJobGroup("short lists", "short lists")
    try:
        kept = simhash.unique_documents(docs_of(spark, rows)).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("short lists")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.doc_id for r in kept} == {0, 10, 20, 30, 40}
    assert written.count("pairs") == 2 and not {"fingerprints", "open", "shingles", "settled"} & set(written)
    assert len(jobs) < 60

"""Operators 11 to 13 against plain versions."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linklens.llm import collocations, context_mixing, importance, word_slices
from tests.llm import brute
from tests.llm.conftest import EDGE, SF

DISTINCT = [r for i, r in enumerate(EDGE) if r[0] not in [d for d, *_ in EDGE[:i]]]


# -- 11 ------------------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def small_scores(small):
    return {r.doc_id: r for r in context_mixing.scores(small).collect()}


def test_token_counts_and_base_score_equal_the_plain_version(small_scores, small_rows):
    want = brute.unigram(small_rows)
    assert set(small_scores) == set(want)
    for doc, r in small_scores.items():
        held, n, known, total, base = want[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_the_model_beats_the_base_on_training_texts_and_bytes_on_held_out_ones(small_scores):
    rows = small_scores.values()
    assert sum(r.score for r in rows if not r.held_out) > sum(r.base_score for r in rows if not r.held_out)
    held = [r for r in rows if r.held_out]
    assert held and all(r.score < 0 for r in rows)
    assert np.mean([r.bits_per_byte for r in held]) < 3.5  # far below the 4.4 bits of single bytes


def test_scores_of_edge_rows(edge, empty):
    rows = context_mixing.scores(edge).collect()
    assert len(rows) == len(EDGE)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_tokens == by[2][0].n_tokens == by[3][0].n_tokens == 1
    assert by[5][0].score == pytest.approx(by[5][1].score, abs=1e-9) and all(math.isfinite(r.score) for r in rows)
    assert [r.n_tokens for r in by[8]] == [3001] and not by[None][0].held_out
    assert context_mixing.scores(empty).count() == 0


def test_without_training_documents(edge):
    held = edge.where(context_mixing.held(F.col("doc_id")))
    rows = context_mixing.scores(held).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in rows)


def model(words, counts):
    tree = context_mixing.code_tree(np.bincount(np.frombuffer(b"".join(w + b" " for w in words), np.uint8), minlength=256))
    tables = []
    bits = context_mixing.bits_of([w + b" " for w in words], 0, tree)
    weight = np.repeat(counts, bits.number)
    for size, slot in zip(context_mixing.SLOT_BITS, bits.slots):
        table = np.zeros(2 << size)
        np.add.at(table, 2 * slot + bits.bit, weight)
        levels = context_mixing.quantised(table)
        tables.append(levels[0::2] | levels[1::2] << 8)
    return context_mixing.Mixer(0, tree, tables)


def test_the_bits_after_a_head_are_a_distribution():
    """The probabilities of all bytes that may follow the same two add up to one, whatever was learned."""
    mixer = model([b"thanea", b"the", b"they", b"than", b"oriner"], np.array([3, 50, 4, 9, 1]))
    scores = mixer.scores([b"th" + bytes([c]) for c in range(256)])
    assert np.exp(scores).sum() == pytest.approx(1.0, abs=1e-9)
    assert np.exp(scores[ord("e")]) > 0.4


def test_refinement_is_a_distribution_over_the_next_word():
    """Over all words of a closed vocabulary the refined probabilities of the last token add up to one."""
    words = [b"", b"a", b"b", b"c"]
    plain = np.log(np.array([0.1, 0.4, 0.3, 0.2]))
    total = 0.0
    for last in range(4):
        ids = np.array([1, 2, 3, 1, 2, last])
        one = context_mixing.Slice(words, ids, np.array([6]))
        whole = context_mixing.refined(one, np.zeros(6), plain[ids], np.exp(plain)[ids], np.full(context_mixing.REPEATS, 0.6))
        before = context_mixing.Slice(words, ids[:5], np.array([5]))
        whole -= context_mixing.refined(before, np.zeros(5), plain[ids[:5]], np.exp(plain)[ids[:5]], np.full(context_mixing.REPEATS, 0.6))
        total += math.exp(whole[0])
    assert total == pytest.approx(1.0, abs=1e-9)


def test_guesses_come_from_the_last_place_of_the_same_two_words():
    one = context_mixing.Slice([b"", b"a", b"b", b"c"], np.array([1, 2, 3, 1, 2, 3, 1, 0, 1, 2, 0]), np.array([8, 11]))
    guess, run = one.repeats()
    assert guess.tolist() == [-1, -1, -1, -1, -1, 3, 1, 2, -1, -1, -1]
    assert run.tolist()[5:8] == [0, 1, 2] and run[8] == 0
    assert one.said().tolist() == [0, 0, 0, 1, 1, 1, 2, 0, 0, 0, 0]


def test_quantised_counts_are_exact_where_small_and_close_where_large():
    counts = np.array([0, 1, 31, 32, 1000, 10**6, 10**12])
    back = context_mixing._LEVELS[context_mixing.quantised(counts)]
    assert back[:3].tolist() == [0, 1, 31] and np.all(np.abs(back - counts) <= 0.08 * counts)


def test_slices_keep_tokens_and_words(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0, None, f"w{i} w{i % 3} " * 5) for i in range(50)], "doc_id long, mark boolean, part string, text string")
    many = word_slices.encoded(rows, context_mixing.split, most=100).collect()
    assert len(many) > 5
    for r in many:
        words = word_slices.unpacked(r["words"], r.n_words)
        ids = word_slices.opened_ids(r["ids"], r.ends[-1])
        texts = [[words[i] for i in ids[a:b]] for a, b in zip([0, *r.ends], r.ends)]
        assert texts == [context_mixing.split(f"w{d} w{d % 3} ".encode() * 5) for d in r.doc_ids]
    wide = np.concatenate([np.arange(70_000), [5]])
    packed = word_slices.short(wide + 1)
    assert (word_slices.opened_ids(packed, len(wide)) == wide).all()


# -- 12 ------------------------------------------------------------------------------------------------------------------------------

def as_dict(frame):
    return {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in frame.collect()}


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_draw_equals_the_plain_version(spark, small, small_rows, longest):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = as_dict(importance.draw(small, target, buckets=997, longest=longest, percent=15))
    assert got == brute.drawn(small_rows, [r.text for r in target.collect()], 997, longest, 20, 15)


def test_draw_of_edge_rows(spark, edge, empty):
    target = spark.createDataFrame([(1, "alpha beta"), (2, None)], "item_id long, text string")
    rows = importance.draw(edge, target, least_words=2, percent=50).collect()
    want = brute.drawn(DISTINCT, ["alpha beta"], 10_000, 1, 2, 50)
    assert len(rows) == len(EDGE)
    assert {r.doc_id: r.n_features for r in rows if r.doc_id is not None} == {d: w[0] for d, w in want.items() if d is not None}
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, len([r for r in rows if r.n_features >= 2]) // 2 + 1))
    assert importance.draw(empty, target).count() == 0
    assert importance.draw(edge, target.where("false")).count() == len(EDGE)
    assert importance.resampled(edge, target, least_words=2, percent=50).columns == edge.columns


def test_any_dictionary_gives_the_same_words(small_rows):
    texts = [(t or "").encode() for _, t in small_rows]
    none, large = importance.Dictionary(most=0), importance.Dictionary()
    importance.features(large, texts)
    assert large.words and not none.words
    for a, b in zip(importance.features(none, texts, 2), importance.features(large, texts, 2)):
        assert (a == b).all()


def test_checksums_of_joined_texts():
    parts = [(b"", b"x"), (b"abc", b""), (b"one", b" two"), ("日本".encode(), b"z" * 300)]
    got = importance.joined(*(np.array(v, np.uint32) for v in ([zlib.crc32(a) for a, _ in parts], [zlib.crc32(b) for _, b in parts])), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


# -- 13 ------------------------------------------------------------------------------------------------------------------------------

def found(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


@pytest.mark.parametrize("least, piece", [(5, 1_000_000), (12, 7)])
def test_phrases_equal_the_plain_version(small, least, piece):
    rows = [(r.text, r.lang) for r in small.select("text", "lang").collect()]
    want = brute.phrases(rows, least, 80, 60)
    assert want and found(collocations.collocations(small, least=least, first=60, piece=piece)) == want


def test_phrases_of_odd_rows(spark):
    line = "Alpha beta gamma, alpha beta. a a a a a\tb"
    rows = [(line, None), (line, "und"), (None, "en"), ("", "en"), ("x|y z", "en"), ("one two\x0bthree", "en")] * 4
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit("x") for c in ("slice", "bin", "part", "word", "id", "doc_id")})
    got = found(collocations.collocations(docs, least=4))
    assert got == brute.phrases(rows, 4, 80, 2000)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs, least=1000).count() == 0


def test_a_phrase_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(word_slices, "SLICE_BYTES", 200)
    rows = [(f"red green blue {i % 7} red green", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert found(collocations.collocations(docs)) == brute.phrases(rows, 30, 80, 2000)

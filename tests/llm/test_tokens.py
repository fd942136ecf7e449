"""Operators 1, 4 and 7 against the tokenizer libraries on whole texts."""

import json
import random
import zlib

import numpy as np
import pytest

from linklens.llm import sentence_pieces as SP
from linklens.llm import token_counts as TC
from linklens.llm import token_files as TF
from linklens.llm.words import WordCache, file_bytes, load_tokenizer, tokenizer_path
from tests.llm import brute
from tests.llm.conftest import EDGE

WORD, BYTE, PIECE = (tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  a", "a  b\n\nc", "don't we'll 'store 'rex ''s x'r 'l 'v", "  x\n", "a<|endoftext|>b <|endoftext|>", "x\U0010ffff y\U0010ffff",
       "é́ 日本語テキスト １２", "I'm you're they've!!'s", "\n\n\n x", "a \n", "\t\tb", "'", "'r", "'ll", "12'34's", "a\x1cb \x85c d　", "J̌ ẖ H̱ ΣΑΣ ΑΣ",
       "▁▁ ▁a ▁", "a" * 3000, "<|startoftext|>", "x" + " " * 700 + "y"]


def words(seed):
    rng = random.Random(seed)
    signs = "abestdmrvl'' \n\t.,!?0123ÉßñΣ日\U0001f600́"
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 300))) for _ in range(150)]


# --- codes ------------------------------------------------------------------

@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2 ** 32 - 1], list(range(5000)), [7] * 3000, [300] * 4096])
def test_any_token_is_reached_alone(ids):
    codes = TF.Codes(TF.encode_levels(np.array(ids, np.uint32)))
    assert [codes[i] for i in range(len(codes))] == ids
    rng = random.Random(1)
    for _ in range(50):
        a, b = sorted(rng.randrange(len(ids) + 1) for _ in range(2))
        assert codes.span(a, b).tolist() == ids[a:b]


def test_segments_round_trip():
    ids = np.random.default_rng(2).integers(0, 49_408, 10_000).astype(np.uint32)
    found, counts, codes = TF.open_segment(TF.pack_segment([None, 5, 9], [4000, 0, 6000], ids))
    assert (found, counts.tolist(), codes.span(0, 10_000).tolist()) == ([None, 5, 9], [4000, 0, 6000], ids.tolist())
    with pytest.raises(ValueError):
        TF.open_segment(b"something else")


def test_words_encode_as_whole_texts():
    spec = file_bytes(WORD).decode()
    texts = ODD + words(3)
    got = [np.frombuffer(c, "<u4").tolist() for c in TF.encode_texts(spec, [t.encode() for t in texts])]
    assert got == [e.ids for e in load_tokenizer(spec).encode_batch(texts, add_special_tokens=False)]


def test_words_that_hold_the_separator_encode_alone():
    spec = file_bytes(WORD).decode()
    tokenizer = load_tokenizer(spec)
    sign, number = TF.separator(tokenizer)
    assert tokenizer.encode(f"a {sign} b", add_special_tokens=False).ids.count(number) == 1
    words = [w.encode() for w in ["plain", sign, f"{sign}-{sign}", "<|endoftext|>", "end", f"x.{sign}", sign.upper(), "日本", "last"]]
    for run in (1, 2, 100):
        got = [np.frombuffer(v, "<u4").tolist() for v in TF._word_values(spec, run)(words)]
        assert got == [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]


def test_case_and_punctuation_make_no_new_word(monkeypatch):
    """The tokenizer sees each lower-case piece once; what can't be cut here it sees as whole words."""
    monkeypatch.setattr(TF, "_CACHES", {})
    spec = file_bytes(WORD).decode()
    texts = ["Word word, WORD! (word) \"Word's\" ÜBER über. x7", "word WORD?! <|endoftext|>. 日本 word... Über,", "  ", ""]
    got = [np.frombuffer(c, "<u4").tolist() for c in TF.encode_texts(spec, [t.encode() for t in texts])]
    assert got == [e.ids for e in load_tokenizer(spec).encode_batch(texts, add_special_tokens=False)]
    assert set(TF._CACHES[spec].cache.known) == {"", "word", ",", "!", "(", ")", '"', "'s", "über", ".", "x", "7", "?!", "...",
                                                 b"<|endoftext|>.", "日本".encode()}


def test_plain_words_are_cut_as_the_library_cuts_them():
    spec = file_bytes(WORD).decode()
    rng = random.Random(11)
    signs = ["abestdmrvlSTREVMLD''''.,!-<>|/w\"0123 \nÉßñÜÿÀÞå", "aeE'sS. ̸̱́ŉĲİſ×÷²½ªµ\x7f\x00\x1c\x85\xa0Σj<h", [chr(c) for c in range(0x250)]]
    odd = ["<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "'S", "'Re", "'lL", "''"]
    texts = ["".join(rng.choice(odd if rng.random() < 0.05 else signs[i % 3]) for _ in range(rng.randrange(200))) for i in range(600)]
    texts += ["a" * 50_000, "." * 50_000, "1" * 9_000, "'" * 500 + "s"]
    got = [np.frombuffer(c, "<u4").tolist() for c in TF.encode_texts(spec, [t.encode() for t in texts])]
    assert got == [e.ids for e in load_tokenizer(spec).encode_batch(texts, add_special_tokens=False)]


def test_other_rules_and_vocabularies_encode_as_whole_texts():
    """A rule that isn't known cuts no words; a vocabulary without all signs leaves pieces without an end."""
    rules = json.loads(file_bytes(WORD))
    rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    few = json.loads(file_bytes(WORD))
    few["model"] |= {"vocab": {"a": 0, "b": 1, "a</w>": 2, "ba</w>": 3}, "merges": [["b", "a</w>"]]}
    few["added_tokens"] = []
    texts = ["ab a b ba Ab's 12ab", "b", "don't ABBA aba? a1b2", ""]
    for spec, known in ((json.dumps(rules), False), (json.dumps(few), True)):
        assert (TF.added_contents(spec) is not None) == known
        got = [np.frombuffer(c, "<u4").tolist() for c in TF.encode_texts(spec, [t.encode() for t in texts])]
        assert got == [e.ids for e in load_tokenizer(spec).encode_batch(texts, add_special_tokens=False)]


def test_files_hold_every_document_in_order(spark, small, small_rows, tmp_path):
    want = brute.codes(small_rows, load_tokenizer(file_bytes(WORD).decode()), 2)
    path = TF.write_codes(small.repartition(7), str(tmp_path / "codes"), WORD, 2, segment_ids=5000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in TF.document_digest(spark, path).collect()}
    assert got == want and spark.read.parquet(path).count() > 5


def test_code_edge_cases(edge, empty):
    rows = sorted(TF.encoded_documents(edge, WORD, 2).collect(), key=lambda r: r.start)
    assert len(rows) == len(EDGE) and [r.doc_id for r in rows[:2]] == [None, None]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert TF.encoded_documents(empty, WORD, 2).count() == 0


# --- counts -----------------------------------------------------------------

def test_counts_equal_the_library(small, small_rows):
    tokenizer = load_tokenizer(file_bytes(BYTE).decode())
    want = {d: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in small_rows}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in TC.token_counts(small, BYTE).collect()} == want


def test_odd_texts_are_counted_exactly():
    spec = file_bytes(BYTE).decode()
    texts = ODD + words(4)
    want = [len(e.ids) for e in load_tokenizer(spec).encode_batch(texts, add_special_tokens=False)]
    assert TC.counter(spec).counts(texts) == want
    assert [TC.counter(spec).counts([t])[0] for t in texts] == want  # chunk borders lie elsewhere


def test_transducer_agrees_with_the_merges_and_may_begin_anew():
    machine = TC.Transducer(file_bytes(BYTE).decode())
    rng = random.Random(5)
    for i in range(400):
        word = bytes(rng.choice(b"etaoin shrdlu\xc3\xa9'Z") for _ in range(rng.randrange(1, 25)))
        if i == 200:
            machine.reset()
        assert machine.count(word) == len(machine.encode(word))


def test_chunk_maps_compose_to_the_sequential_run():
    rng = np.random.default_rng(6)
    classes = rng.integers(0, TC.CLASSES, 20_000).astype(np.uint8)
    columns = classes.reshape(-1, 16).T
    state, want = TC.S_START, []
    for i, c in enumerate(classes):
        if i % 16 == 0:
            want.append(state)
        state = TC._step(state, int(c))[0]
    assert TC.entry_states(columns).tolist() == want


def test_count_edge_cases(edge, empty):
    rows = TC.token_counts(edge, BYTE).collect()
    assert len(rows) == len(EDGE) and {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    assert {r.doc_id for r in rows if r.over_limit} == {8, 9}
    assert TC.token_counts(empty, BYTE).count() == 0


def test_a_full_word_cache_still_answers():
    cache = WordCache(lambda ws: (len(w) for w in ws), limit=2)
    assert [cache.lookup([b"a", b"bb"])(w) for w in (b"a", b"bb")] == [1, 2]
    get = cache.lookup([b"a", b"ccc", b"dddd"])
    assert [get(w) for w in (b"a", b"ccc", b"dddd")] == [1, 3, 4] and len(cache.known) == 2


# --- sentence pieces ----------------------------------------------------------

def test_pieces_equal_the_reference_library():
    import sentencepiece
    data = file_bytes(PIECE)
    plain = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ODD + words(7)
    codes, marks = SP.encode_texts(data, texts)
    ids = [np.frombuffer(c, "<u4").tolist() for c in codes]
    assert ids == plain.encode(texts)
    assert all(m & SP.PARITY for m in marks)
    back = SP.decode_ids(data, ids)
    assert back == [plain.decode(i) if i else "" for i in ids]
    # the model's white-space marker is the one character that can't come back
    assert [b == t for b, t in zip(back, texts)] == [SP.MARK not in t for t in texts] == [bool(m & SP.ROUND_TRIP) for m in marks]
    assert [len(i) for i in ids].count(0) == texts.count("")


def test_runs_of_blanks_equal_the_reference_library():
    """All splits of a piece of blanks share one score: the leftmost joins first, at any length and before any word."""
    import sentencepiece
    data = file_bytes(PIECE)
    plain = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(5)
    texts = [" " * n + tail for n in (*range(1, 80), 700, 50_000) for tail in ("", "y", "▁x", "\n")]
    texts += ["".join(rng.choice(["  ", " " * rng.randrange(1, 60), "▁", "a", "the", "\n", "é", "日", "\U0001f600", "\t"]) for _ in range(40)) for _ in range(300)]
    codes, marks = SP.encode_texts(data, texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == plain.encode(texts) and all(m & SP.PARITY for m in marks)


def test_ids_come_from_the_rebuilt_tokenizer(monkeypatch):
    """Without its merges the rebuilt tokenizer gives other ids, and parity says so."""
    import sentencepiece
    data = file_bytes(PIECE)
    monkeypatch.setattr(SP.Model, "merges", lambda self: [])
    for cache in (SP.load_model, SP._segment_cache):
        cache.cache_clear()
    try:
        (codes,), (mark,) = SP.encode_texts(data, ["the library decides nothing"])
    finally:
        for cache in (SP.load_model, SP._segment_cache):
            cache.cache_clear()
    assert len(codes) // 4 > len(sentencepiece.SentencePieceProcessor(model_proto=data).encode("the library decides nothing"))
    assert mark == SP.ROUND_TRIP


def message(number, value):
    """A protobuf field."""
    def varint(n):
        out = b""
        while n > 0x7F:
            out += bytes([n & 0x7F | 0x80])
            n >>= 7
        return out + bytes([n])
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def test_a_unigram_model_is_rebuilt():
    """A small hand-made unigram model with byte fallback, against the sentencepiece library."""
    import struct

    import sentencepiece
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁", -2.0, 1), ("▁ab", -3.0, 1),
              ("ab", -3.5, 1), ("a", -5.0, 1), ("b", -5.0, 1), ("c", -4.0, 1), ("▁c", -4.5, 1), ("bc", -4.1, 1)]
    data = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + message(3, k)) for p, s, k in pieces)
    data += message(2, message(3, 1) + message(35, 1)) + message(3, message(3, 1) + message(4, 1) + message(5, 1))
    plain = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["abc abc", "c ab  bc", " aab cb ", "xé a", ""]
    codes, _ = SP.encode_texts(data, texts)
    assert SP.load_model(data).cuts is None
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == plain.encode(texts)


def test_piece_rows(edge, empty, small, small_rows):
    rows = SP.encode_rows(edge, PIECE).collect()
    assert len(rows) == len(EDGE) and all(r.round_trip and r.parity and r.n_tokens == len(r.token_ids) for r in rows)
    assert SP.encode_rows(edge, PIECE).columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert SP.encode_rows(empty, PIECE).count() == 0 == SP.digest(empty, PIECE).count()
    import sentencepiece
    plain = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = {d: zlib.crc32(np.array(plain.encode(t or ""), "<u4").tobytes()) for d, t in small_rows}
    got = SP.digest(small, PIECE).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want and all(r.round_trip and r.parity for r in got)

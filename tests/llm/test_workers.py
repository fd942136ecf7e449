"""What Python workers keep between the steps of a job."""

import pyarrow as pa
import pytest

from linklens.llm import near_dedup, quality, words
from linklens.llm import sentence_pieces as SP
from tests.llm.conftest import docs_frame

BATCH = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text_key": [1, 2], "text": ["one two three four five six", None]})
FIRST = {"quality": quality.measured, "near_duplicates": lambda docs: near_dedup.profiles(docs, near_dedup.Likeness())}


def cached():
    return [f.cache_info().currsize for f in (SP.load_model, SP._segment_cache)]


@pytest.mark.parametrize("step", FIRST)
def test_a_step_drops_what_the_encoder_cached(spark, monkeypatch, step):
    docs = docs_frame(spark, [(1, "one two three four five six"), (2, None)])
    given, kind = [], type(docs)

    def noted(self, run, *args, plain=kind.mapInArrow, **more):
        given.append(run)
        return plain(self, run, *args, **more)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    FIRST[step](docs)
    words.forget()  # what other tests cached in this process
    SP.encode_texts(words.file_bytes(words.tokenizer_path("piece_bpe_32k.model")), ["some words to keep"])
    assert cached() == [1, 1]
    found = list(given[0](iter([BATCH])))
    assert sum(b.num_rows for b in found) == 2
    assert cached() == [0, 0]


def test_freed_memory_is_given_back_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(words, "give_back", lambda: calls.append(1))
    task = words.frugal(lambda batches: (b.slice(0, 1) for b in batches))
    assert [b.num_rows for b in task(iter([BATCH, BATCH]))] == [1, 1] and calls == [1]
    broken_off = task(iter([BATCH, BATCH]))
    next(broken_off)
    broken_off.close()
    assert calls == [1, 1]


def test_encoding_in_small_slices_gives_the_same_ids():
    data = words.file_bytes(words.tokenizer_path("piece_bpe_32k.model"))
    batch = pa.RecordBatch.from_pydict({"text": ["a text  of words", None, "", "x" * 50 + " y", "a text  of words"] * 20})
    ids = lambda most: [c for b in words.slices([batch], most=most) for c in SP.encode_texts(data, SP._texts(b, "text"))[0]]
    assert ids(SP.SLICE_BYTES) == ids(16) and len(ids(16)) == 100

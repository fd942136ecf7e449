"""Slices of documents as numbers of their own distinct words, and the way of corpus-wide values to those numbers.

A slice holds whole documents of about ``SLICE_BYTES`` of text. Each distinct word of a slice moves once, however often it occurs there, so
counts are summed before they move, and what comes back to a slice is one value per distinct word: no dictionary of the corpus is ever
sent to a task. Words travel packed, a piece for each slice and bin of the hashed words; there are as many bins as the slices' words ask for.
A longer text is a slice of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.words import raw_texts, slices
from linklens.session import stage

SLICE_BYTES = 3 << 18  # rows of about half a megabyte travel well
BIN_WORDS = 300_000
SCHEMA = "slice long, part string, doc_ids array<long>, marks array<boolean>, ends array<long>, words binary, counts binary, ids binary, n_words long"
PIECES = "bin int, slice long, part string, words binary, counts binary, n_words long"
MERGED = "bin int, parts array<string>, part_of binary, words binary, counts binary, n_words long, slices array<long>, sizes array<int>, index binary"
VALUES = "of_slice long, bin int, values binary"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Numbers(dict):
    """Numbers words in order of appearance, beside some with fixed numbers."""

    def __init__(self, fixed: dict[bytes, int]):
        super().__init__(fixed)
        self.before = len(fixed)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - self.before
        return number


class _Open:
    def __init__(self, fixed: dict[bytes, int]):
        self.numbers, self.docs, self.marks, self.ids, self.size = _Numbers(fixed), [], [], [], 0


def table(schema: str, columns: list) -> pa.Table:
    """Columns under the names and types of a schema text."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return pa.table({name: pa.array(values, kinds[kind]) for values, (name, kind) in zip(columns, (c.split() for c in schema.split(", ")))})


def unpacked(words: bytes, number: int) -> list[bytes]:
    return words.split(b" ") if number else []


def _close(number: int, part: str | None, one: _Open, fixed: int) -> pa.RecordBatch:
    ids = np.concatenate(one.ids)
    sizes = np.fromiter(map(len, one.ids), np.int64, len(one.ids))
    words = list(one.numbers)[fixed:]
    # frequent words get small numbers, two bytes each; the few beyond take four more
    order = np.argsort(-np.bincount(ids[ids >= 0], minlength=len(words)), kind="stable")
    rank = np.empty(len(words) + fixed, np.int64)
    rank[order] = np.arange(len(words))
    rank[len(words):] = np.arange(-fixed, 0)
    ids = rank[ids]
    counted = ids[np.repeat(~np.array(one.marks, bool), sizes)]
    counts = np.bincount(counted[counted >= 0], minlength=len(words))
    return table(SCHEMA, [[number], [part], [one.docs], [one.marks], [np.cumsum(sizes)], [b" ".join([words[i] for i in order])], [counts.astype("<i8").tobytes()],
                          [short(ids + 1)], [len(words)]]).to_batches()[0]


def short(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in two bytes each; the few from 65,535 on take four more at the end."""
    return np.minimum(numbers, 0xFFFF).astype("<u2").tobytes() + numbers[numbers >= 0xFFFF].astype("<u4").tobytes()


def opened_short(value: bytes, number: int) -> np.ndarray:
    low = np.frombuffer(value, "<u2", number)
    out = low.astype(np.int64)
    out[low == 0xFFFF] = np.frombuffer(value, "<u4", offset=2 * number)
    return out


def opened_ids(value: bytes, number: int) -> np.ndarray:
    """The ``number`` token ids of a slice; -1 is a fixed token."""
    return opened_short(value, number) - 1


def _encoder(split: Callable[[bytes], list[bytes]], fixed: dict[bytes, int], most: int):
    dropped = min(fixed.values(), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, total, opened = TaskContext.get().partitionId() << 32, 0, {}
        for batch in slices(batches, most=1 << 20):
            for doc, mark, part, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "part")), raw_texts(batch)):
                one = opened.get(part)
                if one is None:
                    one = opened[part] = _Open(fixed)
                words = split(text)
                ids = np.fromiter(map(one.numbers.__getitem__, words), np.int32, len(words))
                one.ids.append(ids[ids != dropped] if dropped < -1 else ids)
                one.docs.append(doc)
                one.marks.append(mark)
                one.size += len(text)
                total += len(text)
                # many small parts are closed together, so open ones never hold more than twice a slice
                for done in [part] if one.size >= most else list(opened) if total >= 2 * most else []:
                    closed = opened.pop(done)
                    total -= closed.size
                    yield _close(number, done, closed, len(fixed))
                    number += 1
        for part, one in opened.items():
            yield _close(number, part, one, len(fixed))
            number += 1
    return run


def encoded(rows: DataFrame, split: Callable[[bytes], list[bytes]], fixed: dict[bytes, int] | None = None, most: int | None = None) -> DataFrame:
    """Staged slices of ``rows`` (``doc_id, mark, part, text``); documents of one ``part`` share slices.

    ``split`` gives a text's tokens. ``fixed`` numbers below zero stand for tokens that are no words; the least, if below -1, is dropped.
    ``counts`` leaves marked documents out.
    """
    return stage(rows.select("doc_id", "mark", "part", "text").mapInArrow(_encoder(split, fixed or {}, most or SLICE_BYTES), SCHEMA), "slices")


def bin_count(sliced: DataFrame) -> int:
    total = sliced.agg(F.sum("n_words")).first()[0] or 0
    return max(int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BIN_WORDS + 1)


def by_bin(words: list[bytes], part: str | None, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a slice's words by bin, and where each bin ends."""
    start = zlib.crc32((part or "").encode())
    bin_of = np.fromiter((zlib.crc32(w, start) for w in words), np.int64, len(words)) % bins
    return np.argsort(bin_of, kind="stable"), np.cumsum(np.bincount(bin_of, minlength=bins))


def _cut(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, part, packed, counts, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "part", "words", "counts", "n_words"))):
                words, counts = unpacked(packed, n), np.frombuffer(counts, "<i8")
                order, ends = by_bin(words, part, bins)
                rows = [(b, order[e - k:e]) for b, (e, k) in enumerate(zip(ends, np.diff(ends, prepend=0))) if k]
                if rows:
                    yield table(PIECES, [[b for b, _ in rows], [number] * len(rows), [part] * len(rows), [b" ".join([words[i] for i in own]) for _, own in rows],
                                         [counts[own].tobytes() for _, own in rows], [len(own) for _, own in rows]]).to_batches()[0]
    return run


def _merge(pieces: pa.Table) -> pa.Table:
    """The distinct words of one bin in hash order, with their counts, and which of them each slice has."""
    sizes = pieces.column("n_words").to_pylist()
    parts = list(dict.fromkeys(pieces.column("part").to_pylist()))
    words = pa.array([w for packed, n in zip(pieces.column("words").to_pylist(), sizes) for w in unpacked(packed, n)], pa.binary()).dictionary_encode()
    of = np.repeat([parts.index(p) for p in pieces.column("part").to_pylist()], sizes)
    keys, index = np.unique(words.indices.to_numpy() * np.int64(len(parts)) + of, return_inverse=True)
    counts = np.bincount(index, np.concatenate([np.frombuffer(c, "<i8") for c in pieces.column("counts").to_pylist()]), len(keys)).astype("<i8")  # exact below 2^53
    known = words.dictionary.to_pylist()
    known = [known[k] for k in (keys // len(parts)).tolist()]
    order = np.argsort(np.fromiter(map(zlib.crc32, known), np.int64, len(known)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return table(MERGED, [[pieces.column("bin")[0].as_py()], [parts], [(keys % len(parts))[order].astype("<i4").tobytes()], [b" ".join([known[i] for i in order])],
                          [counts[order].tobytes()], [len(order)], [pieces.column("slice").to_pylist()], [sizes], [place[index].astype("<i4").tobytes()]])


def merged(sliced: DataFrame, bins: int) -> DataFrame:
    """Staged words of the corpus: a row per bin."""
    pieces = sliced.select("slice", "part", "words", "counts", "n_words").mapInArrow(_cut(bins), PIECES)
    return stage(pieces.groupBy("bin").applyInArrow(_merge, MERGED), "words")


def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes], np.ndarray]]:
    """Bins one by one: the row, its words and counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            yield row, unpacked(row["words"], row["n_words"]), np.frombuffer(row["counts"], "<i8")


def sent_back(row: dict, values: np.ndarray) -> pa.RecordBatch:
    """One value per word of a bin to all slices that have the word."""
    index = np.frombuffer(row["index"], "<i4")
    ends = np.cumsum(row["sizes"])
    return table(VALUES, [row["slices"], [row["bin"]] * len(ends), [values[index[e - n:e]].tobytes() for e, n in zip(ends, row["sizes"])]]).to_batches()[0]


def received(values: pa.Table, words: list[bytes], part: str | None, bins: int, kind: np.dtype) -> np.ndarray:
    """What came back to a slice, in the order of its words."""
    order, _ = by_bin(words, part, bins)
    rows = sorted(zip(values.column("bin").to_pylist(), values.column("values").to_pylist()))
    out = np.zeros(len(words), kind)
    out[order] = np.frombuffer(b"".join(v for _, v in rows), kind)
    return out

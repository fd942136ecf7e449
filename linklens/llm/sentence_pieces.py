"""Operator 4: SentencePiece models on the tokenizers library.

The model file is read as plain protobuf fields. From it come the normaliser (precompiled character map, extra white space,
dummy prefix), the white-space marker, the pieces with their scores, and byte fallback. Unigram models keep their scores; BPE models
become merges ordered by the score of the merged piece. Encoding and decoding run in multithreaded batches.

No piece reaches over the border between a character and a following white-space marker, nor over a line break that no piece holds,
so a normalised text is cut there, each distinct segment is encoded once, and the ids are put together
(``Model.cuts`` checks that condition for the model at hand; without it whole texts are encoded). Each new segment is decoded
again, and its ids are compared with those of the sentencepiece library: ``parity`` says whether both agree. The library decides nothing else:
ids come from the rebuilt tokenizer.

All splits of one BPE piece share its score, and the model joins the leftmost pair of the best score, while the backend ranks pairs. This matters
where pieces overlap themselves, in runs of the white-space marker: segments with such a run (``Model.runs``) are merged here by score and place.

Defined cases: null and empty texts have no ids, count as round trips and have parity; null ids and repeated rows stay; other
columns are kept by ``encode_rows`` and not read by ``digest``; an empty table gives no row.
"""

from __future__ import annotations

import array
import functools
import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.llm.words import WordCache, file_bytes, frugal, slices, unused_name, worker_cache

MARK = "▁"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


# --- the model file ----------------------------------------------------------

def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a protobuf message: varints as numbers, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at:at + size]
        at += size


class Model:
    """What a model file says, and its encoder."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normaliser: dict = {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(normaliser.get(n, 1)) for n in (3, 4, 5))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)

    @functools.cached_property
    def cuts(self) -> re.Pattern | None:
        """Segments that can be encoded one by one; None where a piece reaches over the borders."""
        if self.charsmap or self.squeeze or not self.escape or any(p[2] == USER_DEFINED for p in self.pieces):
            return None
        texts = [p[0] for p in self.pieces if p[2] == NORMAL]
        if any(MARK in t.lstrip(MARK) or "\n" in t for t in texts):
            return None
        return re.compile(r"\n|[ ▁]*[^ ▁\n]+|[ ▁]+")

    @functools.cached_property
    def runs(self) -> re.Pattern | None:
        """Segments whose merges meet equal scores; None where ranks alone decide."""
        plain = self.kind == BPE and self.cuts is not None and self.byte_fallback and not any(p[2] == UNUSED for p in self.pieces)
        return re.compile(r"[ ▁]{2}") if plain else None

    @functools.cached_property
    def places(self) -> dict[str, int]:
        """Ids of the pieces that merges may make."""
        return {text: i for i, (text, _, kind) in enumerate(self.pieces) if kind == NORMAL}

    def merged(self, segment: str) -> list[int]:
        """Ids of one segment: adjacent symbols join in order of score, then from the left."""
        symbols: list[str | None] = list(segment.replace(" ", MARK))
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        waiting: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] >= 0:
                text = symbols[left] + symbols[after[left]]
                if text in self.places:
                    heapq.heappush(waiting, (-self.pieces[self.places[text]][1], left, text))

        for i in range(len(symbols) - 1):
            offer(i)
        while waiting:
            _, left, text = heapq.heappop(waiting)
            right = after[left]
            if symbols[left] is None or right < 0 or symbols[left] + symbols[right] != text:
                continue  # one of the two has joined another symbol since
            symbols[left], symbols[right], after[left] = text, None, after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [i for s in symbols if s is not None
                for i in ((self.places[s],) if s in self.places else (self.byte_ids[b] for b in s.encode()))]

    @functools.cached_property
    def byte_ids(self) -> dict[int, int]:
        return {int(text[1:-1], 16): i for i, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}

    def normalizer(self, prefix: bool = True):
        from tokenizers import Regex, normalizers as n
        steps = [n.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [n.Replace(Regex(r"^ +| +$"), ""), n.Replace(Regex(" {2,}"), " ")]
        if prefix and self.dummy_prefix:
            steps.append(n.Prepend(" "))
        return n.Sequence([*steps, *([n.Replace(" ", MARK)] if self.escape else [])])

    def merges(self) -> list[tuple[str, str]]:
        """Every split of a piece into two pieces, ordered by the piece's score, then by the halves."""
        rank = {p[0]: i for i, p in enumerate(self.pieces)}
        usable = {p[0] for p in self.pieces if p[2] in (NORMAL, USER_DEFINED, UNUSED)}
        found = [(-score, rank[text[:i]], rank[text[i:]], text[:i], text[i:]) for text, score, kind in self.pieces if kind == NORMAL
                 for i in range(1, len(text)) if text[:i] in usable and text[i:] in usable]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self, prefix: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import AddedToken, Tokenizer, decoders, models
        if self.kind == UNIGRAM:
            model = models.Unigram([(p[0], p[1]) for p in self.pieces], unk_id=self.unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            unknown = None if self.unknown is None else self.pieces[self.unknown][0]
            model = models.BPE({p[0]: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=unknown, fuse_unk=True,
                               byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model kind {self.kind} is not supported")
        out = Tokenizer(model)
        out.normalizer = self.normalizer(prefix)
        strip = [decoders.Strip(" ", 1, 0)] if prefix and self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        added = [AddedToken(p[0], normalized=False) for p in self.pieces if p[2] == USER_DEFINED]
        if added:
            out.add_tokens(added)
        return out


@worker_cache
def load_model(data: bytes) -> Model:
    return Model(data)


@worker_cache
def whole_tokenizer(data: bytes):
    return load_model(data).tokenizer()


# --- encoding ----------------------------------------------------------------

# Segments that a worker keeps; a worker that did other work before has less room than the cache of op1's words needs.
CACHE_SEGMENTS = 300_000
# Texts of one slice: all its segments lie in memory at once, each an object of some 60 bytes.
SLICE_BYTES = 1 << 20
# Marks of a segment's value, before its ids.
ROUND_TRIP, PARITY = 1, 2


@worker_cache
def _segment_cache(data: bytes) -> tuple[WordCache, dict[str, int]]:
    """Ids of each segment, and the marks of the few segments that lack one."""
    import sentencepiece
    model = load_model(data)
    tokenizer, blank, runs = model.tokenizer(prefix=False), model.dummy_prefix, model.runs
    plain = sentencepiece.SentencePieceProcessor(model_proto=data)

    lead = plain.encode("\n")

    odd: dict[str, int] = {}

    def evaluate(segments: list[str]) -> Iterator[bytes]:
        for first in range(0, len(segments), 10_000):
            block = segments[first:first + 10_000]
            ids = [model.merged(s) if runs is not None and runs.search(s) else e.ids
                   for s, e in zip(block, tokenizer.encode_batch_fast(block, add_special_tokens=False))]
            back = tokenizer.decode_batch(ids, skip_special_tokens=False)
            # The library puts its own blank before a text: a segment that begins with one is given without it, any other
            # follows a line break, whose ids are then cut off.
            asked = [s[1:] if blank and s[0] == " " and len(s) > 1 else "\n" + s for s in block]
            for segment, given, found, text, check in zip(block, asked, ids, back, plain.encode(asked, num_threads=1)):
                check = check[len(lead):] if given[0] == "\n" and given[1:] == segment else check
                if text != segment or check != found:
                    odd[segment] = ROUND_TRIP * (text == segment) + PARITY * (check == found)
                yield array.array("I", found).tobytes()
    return WordCache(evaluate, CACHE_SEGMENTS), odd


def encode_texts(data: bytes, texts: list[str]) -> tuple[list[bytes], list[int]]:
    """The ids of each text as little-endian unsigned 32-bit integers, and its marks."""
    model = load_model(data)
    if model.cuts is None:
        import sentencepiece
        tokenizer, plain = whole_tokenizer(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = [e.ids if t else [] for t, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False))]
        back = tokenizer.decode_batch(ids, skip_special_tokens=False)
        checks = plain.encode(texts, num_threads=1)
        return ([np.array(i, "<u4").tobytes() for i in ids],
                [ROUND_TRIP * (b == t) + PARITY * (i == c) for t, i, b, c in zip(texts, ids, back, checks)])
    cut = model.cuts.findall
    split = [cut((" " if model.dummy_prefix else "") + t) if t else [] for t in texts]
    fresh: set[str] = set()
    for segments in split:
        fresh.update(segments)
    cache, odd = _segment_cache(data)
    get = cache.lookup(fresh)
    out = [b"".join(map(get, segments)) for segments in split]
    marks = [ROUND_TRIP | PARITY] * len(texts)
    if not odd.keys().isdisjoint(fresh):
        for i, segments in enumerate(split):
            for mark in {odd[s] for s in segments if s in odd}:
                marks[i] &= mark
    for segment in [s for s in odd if s not in cache.known]:  # no more of these than cached segments
        del odd[segment]
    return out, marks


def decode_ids(data: bytes, ids: list[list[int]]) -> list[str]:
    """Texts of ids, by the library's decoder."""
    return whole_tokenizer(data).decode_batch([list(i) for i in ids], skip_special_tokens=False)


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def encode_rows(docs: DataFrame, model: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` (``columns``: only these) with ``n_tokens``, ``token_ids``, ``round_trip`` and ``parity``.

    Columns of ``docs`` with one of these names are left out.
    """
    data = file_bytes(model)
    new = ("n_tokens", "token_ids", "round_trip", "parity")
    keep = [c for c in (columns or docs.columns) if c not in new]
    given = unused_name(docs.columns, "text_in")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, given, most=SLICE_BYTES):
            codes, marks = encode_texts(data, _texts(batch, given))
            sizes = np.array([len(c) // 4 for c in codes], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()),
                                           pa.array(np.frombuffer(b"".join(codes), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(sizes), ids, pa.array([bool(m & ROUND_TRIP) for m in marks]),
                 pa.array([bool(m & PARITY) for m in marks])], [*keep, *new])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType()),
                           T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType()),
                           T.StructField("parity", T.BooleanType())])
    return source.mapInArrow(frugal(run), schema)


def digest(docs: DataFrame, model: str) -> DataFrame:
    """Per row: number and checksum of the ids, and whether decoding and the reference library agree."""
    data = file_bytes(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            codes, marks = encode_texts(data, _texts(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array([zlib.crc32(c) for c in codes], pa.int64()),
                 pa.array([bool(m & ROUND_TRIP) for m in marks]), pa.array([bool(m & PARITY) for m in marks])],
                ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        frugal(run), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean")

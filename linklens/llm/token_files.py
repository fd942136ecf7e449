"""Operator 1: token ids in directly addressable codes.

Every id is cut into byte chunks. Level 0 holds the lowest chunk of all ids, level 1 the next chunk of those ids that have
one, and so on. A bitmap per level marks the ids that go on, and a rank directory counts its set bits, so that any id is
reached by one rank per level without decoding a block.

``write_codes`` stores the ids of all documents in ascending order of doc_id as segments of whole documents; each row of
the written table is one self-contained segment (layout: ``pack_segment``). ``document_digest`` reads the segments back.

Defined cases: a null or empty text gives just the end id; null ids come first; rows with the same id are ordered by
their text; an empty table gives no segment and no row; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linklens.llm.words import WordCache, file_bytes, load_tokenizer, raw_texts, slices
from linklens.session import scratch_dir

MAGIC = b"LDAC0001"
# One rank entry for so many bitmap bytes.
RANK_BYTES = 64
# A segment is closed at the first document end beyond so many ids.
SEGMENT_IDS = 1 << 18
SEGMENT_SCHEMA = "part int, seq int, first_id long, n_docs long, n_tokens long, payload binary"


# --- the code ----------------------------------------------------------------

def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(chunks, bitmap, ranks)`` of each level of unsigned 32-bit ids."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        chunks, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), RANK_BYTES), dtype=np.uint64) \
            if len(bitmap) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.uint32) if len(counts) else np.zeros(0, np.uint32)
        levels.append((chunks, bitmap, ranks))
        rest = rest[more]
        if not len(rest):
            return levels


class Codes:
    """Random access to coded ids."""

    def __init__(self, levels):
        self.levels = levels

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bitmap, ranks, i: int) -> int:
        """Set bits before position ``i``."""
        byte, block = i >> 3, (i >> 3) // RANK_BYTES
        if block >= len(ranks):  # i is the end and a multiple of a directory block
            block = len(ranks) - 1
        inside = int(np.bitwise_count(bitmap[block * RANK_BYTES:byte]).sum())
        tail = int(bitmap[byte]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(ranks[block]) + inside + tail.bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(bitmap, ranks, i), shift + 8
        return value

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``; only their own chunks are touched."""
        out = np.zeros(max(0, end - start), np.uint32)
        at = np.arange(len(out))
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(bitmap[start >> 3:(end + 7) >> 3], bitorder="little")[start & 7:(start & 7) + len(at)]
            start = self._rank(bitmap, ranks, start)
            at = at[bits.astype(bool)]
            end = start + len(at)
        return out


def pack_segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """A segment: magic, counts, the documents (id, null mark, number of ids), then each level with its lengths."""
    levels = encode_levels(ids)
    parts = [MAGIC, struct.pack("<QQI", len(doc_ids), len(ids), len(levels)),
             np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
             np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(counts, "<u8").tobytes()]
    for arrays in levels:
        parts.append(struct.pack("<QQQ", *map(len, arrays)))
        parts += [a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays]
    return b"".join(parts)


def open_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Document ids, the number of ids of each, and their codes, as views on the segment's bytes."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, _, n_levels = struct.unpack_from("<QQI", payload, 8)
    at = 28

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype, n, at)
        at += out.nbytes
        return out

    values, nulls, counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    levels = []
    for _ in range(n_levels):
        sizes = struct.unpack_from("<QQQ", payload, at)
        at += 24
        levels.append(tuple(take(dtype, n) for dtype, n in zip(("u1", "u1", "<u4"), sizes)))
    return [None if null else int(v) for v, null in zip(values, nulls)], counts.astype(np.int64), Codes(levels)


# --- encoding ----------------------------------------------------------------

def separator(tokenizer) -> tuple[str, int]:
    """A word that is one token of its own, a late one of the vocabulary, and its id."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    for token, number in sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda item: -item[1]):
        word = token.removesuffix(suffix)
        if word.isascii() and word.isalnum() and tokenizer.encode(word, add_special_tokens=False).ids == [number]:
            return word, number
    raise ValueError("the vocabulary has no word that is one token")


def _word_values(spec: str, run: int = 2_000):
    """The ids of each word as bytes, by the tokenizer.

    Words are encoded in runs with a separator word after each of them. If the separator's id comes exactly as often as it was put in, it marks
    the ends of the words; otherwise a word of the run holds that id itself, and the run is encoded word by word.
    """
    tokenizer = load_tokenizer(spec)
    word, number = separator(tokenizer)
    between = f" {word} "

    def one_by_one(words: list[bytes]) -> Iterator[bytes]:
        for encoding in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False):
            yield np.array(encoding.ids, "<u4").tobytes()

    def evaluate(words: list[bytes]) -> Iterator[bytes]:
        for first in range(0, len(words), run * 16):
            runs = [words[at:at + run] for at in range(first, min(len(words), first + run * 16), run)]
            texts = [between.join(map(bytes.decode, r)) + between for r in runs]
            for members, encoding in zip(runs, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(encoding.ids, "<u4")
                ends = np.flatnonzero(ids == number)
                if len(ends) != len(members):
                    yield from one_by_one(members)
                    continue
                raw, begin = ids.tobytes(), 0
                for end in (ends * 4).tolist():
                    yield raw[begin:end]
                    begin = end + 4
    return evaluate


@functools.lru_cache(maxsize=4)
def splits_at_space(spec: str) -> bool:
    """Whether the tokenizer drops white space between words, so that words can be encoded one by one."""
    steps = (json.loads(spec).get("pre_tokenizer") or {}).get("pretokenizers") or []
    return any(s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed" for s in steps)


# Words of these signs alone are cut into pieces here: printable ASCII and the letters of Latin-1. No two of them compose, and each letter has one lower case.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
# The splitting rule that is known, and the same for plain words in lower case.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+)"
# No piece holds both signs and letters, so this can't be part of one.
SUFFIX = "</w>"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def added_contents(spec: str) -> list[str] | None:
    """The added tokens of a tokenizer whose rules for plain words are ``PIECE`` and lower case; None for any other tokenizer."""
    rules = json.loads(spec)
    model, added = rules["model"], rules.get("added_tokens") or []
    known = [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
             {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    if (rules.get("normalizer") != {"type": "Sequence", "normalizers": NORMAL} or rules.get("pre_tokenizer") != {"type": "Sequence", "pretokenizers": known}
            or any(a.get("normalized") for a in added) or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("end_of_word_suffix") != SUFFIX):
        return None
    return [a["content"] for a in added]


def _piece_values(spec: str, run: int = 2_000):
    """The ids of each piece as bytes, by the tokenizer's model; normal form, lower case and splitting are done.

    Pieces are encoded in runs. The last token of a piece, and no other, has the suffix that ends a word; if a run has as many of them as pieces,
    they mark the ends, otherwise the run is encoded piece by piece.
    """
    rules = json.loads(spec)
    rules |= {"normalizer": None, "added_tokens": []}
    rules["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    tokenizer = load_tokenizer(json.dumps(rules))
    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[number for token, number in vocabulary.items() if token.endswith(SUFFIX)]] = True

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def evaluate(pieces: list[str]) -> Iterator[bytes]:
        for first in range(0, len(pieces), run):
            members = pieces[first:first + run]
            ids = ids_of(" ".join(members))
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(members):
                yield from (ids_of(piece).tobytes() for piece in members)
                continue
            raw, begin = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                yield raw[begin:end]
                begin = end
    return evaluate


class WordIds:
    """Ids of distinct words, from one bounded cache of pieces (text) and of whole words that aren't cut (bytes)."""

    def __init__(self, spec: str):
        self.spec, self.added, self.made = spec, added_contents(spec), {}
        self.cache = WordCache(self._evaluate)
        self.cache.known[""] = b""  # what lies behind the last piece of a word

    def _evaluate(self, fresh: list) -> Iterator[bytes]:
        kind = type(fresh[0])
        if kind not in self.made:
            self.made[kind] = (_piece_values if kind is str else _word_values)(self.spec)
        return self.made[kind](fresh)

    def of(self, words: pa.Array) -> pa.Array:
        """The ids of each of ``words`` as bytes."""
        if self.added is None:
            plain = pa.array(np.zeros(len(words), bool))
        else:
            plain = pc.match_substring_regex(words, PLAIN)
            for content in self.added:
                plain = pc.and_not(plain, pc.match_substring(words, content))
        lower = pc.utf8_lower(words.filter(plain))
        cut = pc.split_pattern(pc.replace_substring_regex(lower, PIECE, r"\1 "), " ")
        pieces = cut.flatten().dictionary_encode()
        whole = objects(words.filter(pc.invert(plain)).cast(pa.large_binary()))
        names = objects(pieces.dictionary)
        values = pa.array([*map(self.cache.lookup(names), names), *map(self.cache.lookup(whole), whole)], pa.large_binary())
        at = np.concatenate([pieces.indices.to_numpy(), len(names) + np.arange(len(whole))])
        ends = np.concatenate([cut.offsets.to_numpy(), len(pieces) + 1 + np.arange(len(whole))])
        joined = regrouped(values.take(pa.array(at)), ends)
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])] = np.arange(len(words))
        return joined.take(pa.array(place))


def objects(values: pa.Array) -> list:
    """``to_pylist`` of values without nulls, without a scalar for each."""
    return values.to_numpy(zero_copy_only=False).tolist()


def regrouped(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Neighbouring byte strings joined, from each of ``ends`` to the next."""
    if len(ends) < 2:
        return pa.array([], pa.large_binary())
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, "<i8")[values.offset:][ends]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), data])


_CACHES: dict[str, WordIds] = {}


def encode_texts(spec: str, texts: list[bytes]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.

    Where the tokenizer drops white space, each distinct word is encoded once and the texts are put together from them;
    ASCII white space is in every tokenizer's ``\\s``, and neither normal form nor merges reach over it. Words of plain signs are cut
    further by the tokenizer's own rule, so that case and punctuation make no new word.
    """
    if not splits_at_space(spec):
        tokenizer = load_tokenizer(spec)
        return [np.array(e.ids, "<u4").tobytes()
                for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    if spec not in _CACHES:
        _CACHES[spec] = WordIds(spec)
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    words = split.flatten().dictionary_encode()
    return regrouped(_CACHES[spec].of(words.dictionary).take(words.indices), split.offsets.to_numpy()).to_pylist()


def _packer(spec: str, end_id: int, segment_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        ids, counts, parts, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            codes = np.frombuffer(b"".join(parts), "<u4")
            row = [[part], [seq], [ids[0]], [len(ids)], [len(codes)], [pack_segment(ids, counts, codes)]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)],
                                              ["part", "seq", "first_id", "n_docs", "n_tokens", "payload"])

        for batch in slices(batches):
            for doc_id, code in zip(batch.column("doc_id").to_pylist(), encode_texts(spec, raw_texts(batch))):
                code += end
                ids.append(doc_id)
                counts.append(len(code) // 4)
                parts.append(code)
                total += len(code) // 4
                if total >= segment_ids:
                    yield close()
                    seq, total = seq + 1, 0
                    ids, counts, parts = [], [], []
        if ids:
            yield close()
    return pack


def write_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> str:
    """Encode the texts of ``docs`` and write them to ``path`` in ascending order of doc_id.

    One shuffle: rows are dealt by range of (doc_id, text hash), so a hot id is split and no task has more than its range.
    """
    spec = file_bytes(tokenizer).decode()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(_packer(spec, end_id, segment_ids), SEGMENT_SCHEMA)
     .write.mode("overwrite").parquet(path))
    return path


def segment_starts(codes: DataFrame) -> DataFrame:
    """Ids before each segment: a running sum over the few parts and one within each part."""
    sizes = codes.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
            .select("part", "seq", (F.col("part_start") + F.col("inside")).alias("segment_start")))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload"))):
            ids, counts, codes = open_segment(payload)
            ends = np.cumsum(counts)
            crcs = [zlib.crc32(codes.span(int(e - n), int(e)).astype("<u4").tobytes()) for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array([seq] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
                 pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                ["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def document_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: place, number and checksum of its ids."""
    codes = spark.read.parquet(path)
    docs = codes.select("part", "seq", "payload").mapInArrow(
        _digest, "part int, seq int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return (docs.join(segment_starts(codes), ["part", "seq"])
            .select("doc_id", (F.col("segment_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"))


def encoded_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the codes below the shared folder and return what the files hold per document."""
    spark = docs.sparkSession
    return document_digest(spark, write_codes(docs, scratch_dir(spark, "codes"), tokenizer, end_id))

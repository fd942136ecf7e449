"""Operator 9: sharding along a Hilbert curve, in DataFrame functions only.

Metadata dimensions are quantised into 2^bits steps at approximate quantiles, every cell of the grid gets its index on the Hilbert
curve, and the rows in curve order are cut into runs of equal counts (law ``rows``: counts at most one apart). Each run covers a
compact region of every dimension, so that minimum and maximum of a file prune on any of them.

A row's place is counted, not sorted out by one task: rows per (cell, part) are summed, the few cells are added up along the curve, the parts
within their cell, and rows are numbered within a part. Parts are hash ranges of the row, so a hot cell is spread over up to ``PARTS``
tasks.

Defined cases: null texts have size 1 and no checksum; null dimensions take step 0; null ids come first within a part; repeated rows get
different slots; an empty table gives no row; ``shard_rows`` keeps all columns, the digest reads only its own.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens.session import stage

BITS = 4
PARTS = 4096


def text_key(value: Column, prefix: str, length: int = 7) -> Column:
    """A number that keeps the order of texts: the first bytes after a common prefix."""
    rest = F.substring(value.cast("binary"), len(prefix.encode()) + 1, length)
    return F.conv(F.rpad(F.hex(rest), 2 * length, "0"), 16, 10).cast("long")


def metadata(docs: DataFrame) -> dict[str, Column]:
    """The dimensions of documents: source, language and size."""
    return {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "size": F.octet_length("text").cast("long")}


def quantised(rows: DataFrame, dimensions: Mapping[str, str], bits: int) -> Column:
    """A row's cell: its step in each dimension, written one after the other.

    The cuts are approximate quantiles, a fixed number of values that come to the driver; ``dimensions`` gives column types.
    """
    texts = [d for d, kind in dimensions.items() if kind == "string"]
    ends = rows.agg(F.count(F.lit(1)), *[f(d) for d in texts for f in (F.min, F.max)]).first()[1:]
    prefix = {d: os.path.commonprefix([ends[2 * i] or "", ends[2 * i + 1] or ""]) for i, d in enumerate(texts)}
    keys = {d: text_key(F.col(d), prefix[d]) if d in prefix else F.col(d).cast("long") for d in dimensions}
    levels = F.array(*[F.lit(i / (1 << bits)) for i in range(1, 1 << bits)])
    cuts = rows.agg(*[F.percentile_approx(key, levels, F.lit(10_000)) for key in keys.values()]).first()
    number = F.lit(0)
    for key, borders in zip(keys.values(), cuts):
        step = sum((F.coalesce(key > F.lit(c), F.lit(False)).cast("int") for c in borders or []), F.lit(0))
        number = number * (1 << bits) + step
    return number


def hilbert_index(point: Column, dimensions: int, bits: int) -> Column:
    """Index on the Hilbert curve of an array of ``dimensions`` numbers below 2^bits (Skilling's transform)."""
    one = lambda shift: F.call_function("shiftleft", F.lit(1), shift)
    at = lambda x, i: F.element_at(x, i + 1)

    def undo(x: Column, step: Column) -> Column:
        i = step % dimensions
        bit = one(F.lit(bits - 1) - F.floor(step / dimensions).cast("int"))
        low = bit - 1
        turned = at(x, i).bitwiseAND(bit) != 0
        swap = F.element_at(x, 1).bitwiseXOR(at(x, i)).bitwiseAND(low)
        return F.when(turned, F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))).otherwise(
            F.transform(x, lambda v, k: v.bitwiseXOR(F.when(k == 0, swap).otherwise(F.lit(0))).bitwiseXOR(F.when(k == i, swap).otherwise(F.lit(0)))))

    turns = F.sequence(F.lit(0), F.lit(max(0, dimensions * (bits - 1) - 1)))
    x = F.aggregate(turns, point, undo) if bits > 1 else point
    # Gray code: every component takes the ones before it, then the last one's turns go into all
    gray = F.aggregate(F.sequence(F.lit(2), F.lit(dimensions)), x, lambda a, i: F.transform(
        a, lambda v, k: F.when(k == i - 1, v.bitwiseXOR(F.element_at(a, i - 1))).otherwise(v))) if dimensions > 1 else x
    last = F.element_at(gray, -1)
    turn = F.aggregate(F.sequence(F.lit(1), F.lit(bits - 1)), F.lit(0), lambda t, q: F.when(
        last.bitwiseAND(one(q)) != 0, t.bitwiseXOR(one(q) - 1)).otherwise(t)) if bits > 1 else F.lit(0)
    pair = F.transform(F.array(F.struct(gray.alias("gray"), turn.alias("turn"))), lambda s: F.transform(s["gray"], lambda v: v.bitwiseXOR(s["turn"])))
    places = F.sequence(F.lit(0), F.lit(dimensions * bits - 1))
    woven = F.transform(pair, lambda y: F.aggregate(places, F.lit(0).cast("long"), lambda out, p: (out * 2) + F.when(
        at(y, p % dimensions).bitwiseAND(one(F.lit(bits - 1) - F.floor(p / dimensions).cast("int"))) != 0, F.lit(1)).otherwise(F.lit(0))))
    return F.element_at(woven, 1)


def _ordered(rows: DataFrame, dimensions: Mapping[str, str], bits: int, tie: Column, narrow: bool) -> DataFrame:
    """``rows`` with ``place`` (0 to rows - 1 in curve order) and ``total``; ``narrow`` rows are staged, since they are read twice."""
    placed = rows.withColumn("cell", quantised(rows, dimensions, bits)).withColumn("part", F.pmod(tie, F.lit(PARTS)).cast("int"))
    if narrow:
        placed = stage(placed, "curve-cells")
    counts = placed.groupBy("cell", "part").agg(F.count("*").alias("n"))
    per_cell = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    n = len(dimensions)
    point = F.array(*[F.call_function("shiftright", F.col("cell"), F.lit(bits * (n - 1 - i))).bitwiseAND((1 << bits) - 1) for i in range(n)])
    curve = per_cell.withColumn("curve", hilbert_index(point, n, bits))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^(bits * dimensions) rows
    everything = Window.partitionBy()
    curve = curve.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"), F.sum("n").over(everything).alias("total"))
    inside = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows
    starts = (counts.withColumn("part_start", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(curve), "cell")
              .select("cell", "part", (F.col("cell_start") + F.col("part_start")).alias("start"), "total"))
    numbered = placed.withColumn("row_in_part", F.row_number().over(Window.partitionBy("cell", "part").orderBy(*ORDER)))
    return numbered.join(starts, ["cell", "part"]).withColumn("place", F.col("start") + F.col("row_in_part") - 1)


ORDER = ("tie", "order_id", "order_text")


def assign(rows: DataFrame, dimensions: Mapping[str, str], shards: int = 16, bits: int = BITS, narrow: bool = False) -> DataFrame:
    """``rows`` with ``shard`` and gapless ``slot``; ``order_id`` and ``order_text`` order rows of one cell."""
    ordered = _ordered(rows.withColumn("tie", F.xxhash64("order_id", "order_text")), dimensions, bits, F.col("tie"), narrow)
    # shard s begins at ceil(s * total / shards)
    shard = F.expr(f"cast((place * {shards}L) div total as int)")
    first = F.expr(f"cast(shard as bigint) * total div {shards} + if(cast(shard as bigint) * total % {shards} = 0, 0, 1)")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col("place") - first)


def shard_digest(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """Per row: size, checksum, law, shard and slot. Texts are read once and not shuffled."""
    dims = metadata(docs)
    narrow = docs.select(F.col("doc_id").alias("order_id"), F.crc32(F.col("text").cast("binary")).alias("order_text"),
                         (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size_out"), *[v.alias(k) for k, v in dims.items()])
    placed = assign(narrow, {"source": "string", "lang": "string", "size": "long"}, shards, bits, narrow=True)
    return placed.select(F.col("order_id").alias("doc_id"), F.col("size_out").alias("size"), F.col("order_text").alias("text_crc32"), F.lit("rows").alias("law"),
                         "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """``row_in`` (all columns), ``shard`` and ``slot``."""
    dims = metadata(docs)
    narrow = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_in"), F.col("doc_id").alias("order_id"),
                         F.crc32(F.col("text").cast("binary")).alias("order_text"), *[v.alias(k) for k, v in dims.items()])
    return assign(narrow, {"source": "string", "lang": "string", "size": "long"}, shards, bits).select("row_in", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, bits: int = BITS) -> None:
    """One folder a shard, rows in curve order; the files' minima and maxima prune on every dimension."""
    rows = shard_rows(docs, shards, bits)
    (rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select(*[F.col("row_in")[c].alias(c) for c in docs.columns], F.col("shard").alias("shard"))
     .write.mode("overwrite").partitionBy("shard").parquet(path))

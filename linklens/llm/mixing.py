"""Operator 10: mixing sources to target weights by capped water-filling.

Targets: a common level times a source's weight, but no more than ``epochs`` times its size; what a capped source can't take goes to the others by
weight. The level is found in closed form on the table of sources: in order of cap / weight, source i is capped exactly if the
level that the sources from i on would share lies above its own. Whole repetitions of a document are the whole part of
target / size; the rest is a seeded sample: documents in the order of a hash until the fraction of the source's words is reached.

The sample is cut twice per source, so that one long document at the border does not leave the source far from its target: first the documents above
the mean size, by their share, then the others, by what is still missing. A cut is a place in hash order, and the number of copies that are
taken of the draw at that place. To find it, words per (source, hash prefix) are added up, prefixes below the border count whole, and
only the border prefix of each source is ordered, after its equal draws have collapsed to one row each. No task sees a whole source or all copies of a row,
and what is joined to the documents is one row per source. Copies of the one draw at a border are numbered by scan partition and offset.

Defined cases: null texts have size 0; a null source is the last source; rows of size 0 are taken 0 words; sources of size 0 have target 0 and take
nothing; null ids and repeated rows are rows of their own; rows with equal id, text and source are copies of one draw: a border may lie between
them, and which of them are taken is open where they differ in other columns; an empty table gives no row. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens.session import stage

# The contract's weights, by rank of the source's name.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 13
# Hexadecimal digits of a hash prefix: each holds one of 65,536 parts of a source.
PREFIX = 4
WORD = r"[^\x20\x09-\x0D]+"


def size_of() -> F.col:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def drawn() -> F.col:
    """A seeded hash of id and text, as hexadecimal digits."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{SEED}:"), part("doc_id"), F.lit(":"), F.md5(part("text").cast("binary"))).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, draw`` of every row, staged: the texts are read once."""
    return stage(docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of().alias("size"),
                             drawn().alias("draw")), "mixture-sizes")


def before_each(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over the rows before, in ``order``.

    Rows are dealt by range and staged; running sums stay inside a range and are shifted by those of the ranges below, one row a range.
    """
    dealt = stage(rows.repartitionByRange(*order).withColumn("lot", F.spark_partition_id()), "mixture-ranges")
    lots = dealt.groupBy("lot").agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])
    below = Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select("lot", *[F.coalesce(F.sum(f"all_{n}").over(below), F.lit(0)).alias(f"below_{n}") for n in sums])
    inside = Window.partitionBy("lot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumns({f"in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(lots, "lot").select(
        *rows.columns, *[(F.col(f"below_{n}") + F.col(f"in_{n}")).alias(n) for n in sums])


def targets(per_source: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; sources may be as many as there are documents."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = before_each(per_source.select("source", "source_size"), [F.col("source").asc_nulls_last()], place=F.lit(1))
    rows = placed.select("source", "source_size", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"))
    rows = rows.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    # staged: the sums, the level and the targets read it
    rows = stage(before_each(rows, [F.col("ratio"), F.col("source").asc_nulls_last()], capped=F.col("cap"), passed=F.col("weight")), "mixture-levels")
    total, weight = rows.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = (F.lit(total) - F.col("capped")) / (F.lit(weight) - F.col("passed"))
    # the first source whose cap is not below its share sets the level of all that follow; of equal ratios the first has the highest level
    shared = rows.select("ratio", level.alias("level")).where("ratio >= level").agg(
        (-F.min(F.struct("ratio", (-F.col("level")).alias("below")))["below"]).alias("shared")).first()[0] or 0.0
    return rows.select("source", "source_size", F.least("cap", F.col("weight") * shared).alias("target"))


def cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``name, cut, edge, reached``: rows of a source with ``draw < cut`` and ``edge.n`` copies of ``edge.draw`` have ``reached`` words, near the ``wanted`` ones.

    ``rows`` has ``source, size, draw``, ``wanted`` has ``name, wanted``.
    """
    prefixed = rows.withColumn("prefix", F.substring("draw", 1, PREFIX))
    sums = prefixed.groupBy("source", "prefix").agg(F.sum("size").alias("words"))
    inside = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    # staged: one row per source and prefix, read by both parts below
    sums = stage(sums.join(wanted, sums["source"].eqNullSafe(wanted["name"])).select("name", "prefix", "words", "before", "wanted"), "mixture-sums")
    fits = F.col("before") + F.col("words") <= F.col("wanted")
    end = F.concat(F.col("prefix"), F.lit("g"))  # above every hash with this prefix
    no_edge = F.lit(None).cast("struct<draw: string, n: bigint>")
    whole = sums.where(fits).groupBy("name").agg(F.max(end).alias("cut"), F.first(no_edge).alias("edge"), F.max(F.col("before") + F.col("words")).alias("reached"))
    border = sums.where(~fits & (F.col("before") < F.col("wanted"))).select("name", F.col("prefix").alias("at"), "before", "wanted")
    near = prefixed.join(border, prefixed["source"].eqNullSafe(border["name"]) & (prefixed["prefix"] == border["at"]))
    near = near.groupBy("name", "before", "wanted", "draw", "size").agg(F.count(F.lit(1)).alias("copies"))
    running = Window.partitionBy("name").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("done", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(running), F.lit(0)))
    # a copy is taken if the middle of its words lies before the border
    fitting = F.floor((F.col("wanted") - F.col("done")) / F.col("size") + 0.5)
    near = near.withColumn("n", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(fitting, F.col("copies")))).otherwise(F.col("copies")))
    taken = near.where("n > 0").groupBy("name").agg(
        F.max(F.when(F.col("n") == F.col("copies"), F.concat("draw", F.lit("0")))).alias("cut"),
        F.max(F.when(F.col("n") < F.col("copies"), F.struct("draw", "n"))).alias("edge"), F.max(F.col("done") + F.col("n") * F.col("size")).alias("reached"))
    return whole.unionByName(taken).groupBy("name").agg(F.max("cut").alias("cut"), F.max("edge").alias("edge"), F.max("reached").alias("reached"))


def plan(rows: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """One row per source: ``name, source_size, target, mean, whole`` and for large and small rows ``cut, edge``."""
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"))
    means = per_source.select(F.col("source").alias("name"), "mean")
    table = targets(per_source.select("source", "source_size"), weights, epochs).withColumnRenamed("source", "mixed")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-9)  # a ratio a rounding error below a whole number is that number
    table = stage(table.join(means, F.col("mixed").eqNullSafe(F.col("name"))).select(
        "name", "source_size", "target", "mean", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), ratio - whole).alias("part")), "mixture-targets")
    marked = rows.join(table, rows["source"].eqNullSafe(table["name"])).select("source", "size", "draw", (F.col("size") > F.col("mean")).alias("large"))
    large, small = (marked.where(F.col("large") == flag).select("source", "size", "draw") for flag in (True, False))
    share = large.groupBy("source").agg(F.sum("size").alias("words"))
    wanted = share.join(table, share["source"].eqNullSafe(table["name"])).select("name", (F.col("part") * F.col("words")).alias("wanted"))
    first = stage(cuts(large, wanted).select(F.col("name").alias("first"), F.struct("cut", "edge").alias("large"), "reached"), "mixture-cuts")
    rest = table.join(first, table["name"].eqNullSafe(first["first"]), "left").drop("first")
    missing = F.col("part") * F.col("source_size") - F.coalesce("reached", F.lit(0))
    second = cuts(small, rest.select("name", missing.alias("wanted"))).select(F.col("name").alias("second"), F.struct("cut", "edge").alias("small"))
    return stage(rest.join(second, rest["name"].eqNullSafe(second["second"]), "left").select(
        "name", "source_size", "target", "mean", "whole", "large", "small"), "mixture-plan")


def repeated(rows: DataFrame, table: DataFrame, epochs: float) -> DataFrame:
    """``rows`` (with ``source, size, draw``) of the planned sources with ``source_size, target`` and ``copies``, how often each is taken."""
    planned = rows.join(table, rows["source"].eqNullSafe(table["name"])).withColumn(
        "border", F.when(F.col("size") > F.col("mean"), F.col("large")).otherwise(F.col("small")))
    out = [*rows.columns, "source_size", "target"]
    times = lambda more: F.least(F.col("whole") + more.cast("int"), F.lit(int(epochs))).alias("copies")
    at_edge = F.coalesce(F.col("draw") == F.col("border.edge.draw"), F.lit(False))
    plain = planned.where(~at_edge).select(*out, times(F.coalesce(F.col("draw") < F.col("border.cut"), F.lit(False))))
    # staged with their scan partition: the copies of an edge are numbered inside it and shifted by one offset a partition
    edge = stage(planned.where(at_edge).select(*out, "name", "whole", F.col("border.edge.n").alias("n"), F.spark_partition_id().alias("lot")), "mixture-edges")
    lots = edge.groupBy("name", "draw", "lot").agg(F.count(F.lit(1)).alias("rows"))
    below = Window.partitionBy("name", "draw").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select(F.col("name").alias("of"), F.col("draw").alias("with"), F.col("lot").alias("in"), F.coalesce(F.sum("rows").over(below), F.lit(0)).alias("below"))
    number = F.row_number().over(Window.partitionBy("name", "draw", "lot").orderBy(F.lit(0)))
    numbered = edge.withColumn("number", number).join(
        lots, F.col("name").eqNullSafe(F.col("of")) & (F.col("draw") == F.col("with")) & (F.col("lot") == F.col("in")))
    return plain.unionByName(numbered.select(*out, times(F.col("below") + F.col("number") <= F.col("n"))))


def mixture(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """Per row: size, its source's size and target, and the words that the mix takes of it."""
    rows = sizes(docs)
    return repeated(rows, plan(rows, weights, epochs), epochs).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def sampled(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """The mix itself: every row as often as it is taken."""
    table = plan(sizes(docs), weights, epochs)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_in"), F.col("source").cast("string").alias("source"),
                       size_of().alias("size"), drawn().alias("draw"))
    taken = repeated(rows, table, epochs).where("copies > 0")
    return taken.select("row_in", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row_in")[c].alias(c) for c in docs.columns])

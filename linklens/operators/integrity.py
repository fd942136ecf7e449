"""Checksums, manifests, file profiles and tolerant table comparison."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linklens.functions.scalars import FALSE_TEXT, is_close, seconds_between

# Files the check itself writes, and scalar text patterns.
SELF_GENERATED = ("checksums.sha256", "integrity_report.json", "reproducibility_report.json")
HEX64 = "^[0-9a-f]{64}$"
INT_TEXT = r"^[+-]?\d+$"
FLOAT_TEXT = r"^[+-]?(?:\d+\.\d*|\d*\.\d+|\d+)(?:[eE][+-]?\d+)?$"
DIFF_LIMIT = 100
DIFF_SLICES = 256


def file_hashes(files: DataFrame) -> DataFrame:
    """``run_id, path, sha256`` of files with a ``content`` or a ``sha256`` taken where they lie; self-generated files are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.col("sha256") if "sha256" in files.columns else F.sha2("content", 256)
    return files.where(~name.isin(*SELF_GENERATED)).select("run_id", "path", digest.alias("sha256"))


def manifest_lines(hashes: DataFrame) -> DataFrame:
    return hashes.select("run_id", F.concat("sha256", F.lit("  "), "path").alias("line"), "path")


def _resolved(path: Column) -> Column:
    """Path segments with ``.`` and ``..`` applied; null once the path leaves its root."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        F.split(path, "/"), empty,
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
        .otherwise(F.array_append(acc, part)))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """``run_id, line_no, line`` to entries with ``entry_status`` ok, malformed, duplicate or unsafe.

    Of repeated paths the first line counts; it is found by a map-side minimum
    and matched on path and line, so copies never meet in one task.
    """
    text = F.regexp_replace("line", r"[\r\n]+$", "")
    split = F.instr(text, "  ")
    rows = lines.where(text != "").withColumns({
        "sha256": F.when(split > 0, F.lower(F.trim(F.substring(text, F.lit(1), split - 1)))),
        "path": F.when(split > 0, F.trim(F.substring(text, split + 2, F.length(text))))})
    formed = F.coalesce(F.col("sha256").rlike(HEX64) & (F.col("path") != ""), F.lit(False))
    rows = rows.withColumn("_formed", formed)
    first = (rows.where("_formed").groupBy("run_id", "path").agg(F.min("line_no").alias("line_no"))
             .withColumn("_first", F.lit(True)))
    parts = _resolved(F.col("path"))
    return (rows.join(first, ["run_id", "path", "line_no"], "left")
            .withColumn("_parts", F.when(F.col("_formed"), parts))
            .withColumn("entry_status",
                        F.when(~F.col("_formed"), "malformed").when(F.col("_first").isNull(), "duplicate")
                        .when(F.startswith(F.col("path"), F.lit("/")) | F.col("_parts").isNull(), "unsafe").otherwise("ok"))
            .withColumn("target", F.when(F.col("entry_status") == "ok", F.array_join("_parts", "/")))
            .select("run_id", "line_no", "path", "sha256", "entry_status", "target"))


def untracked_files(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Present files no well-formed manifest line names."""
    tracked = entries.where(F.col("entry_status").isin("ok", "unsafe")).select("run_id", "path")
    return hashes.select("run_id", "path").join(tracked, ["run_id", "path"], "left_anti")


def verify_manifest(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """``run_id, path, status``: ok, missing, mismatched, malformed, unsafe or untracked."""
    now = hashes.select("run_id", F.col("path").alias("target"), F.col("sha256").alias("_now"))
    state = (F.when(F.col("entry_status").isin("malformed", "duplicate"), "malformed")
             .when(F.col("entry_status") == "unsafe", "unsafe").when(F.col("_now").isNull(), "missing")
             .when(F.col("_now") != F.col("sha256"), "mismatched").otherwise("ok"))
    checked = entries.join(now, ["run_id", "target"], "left").select("run_id", "path", state.alias("status"))
    return checked.unionByName(untracked_files(entries, hashes).withColumn("status", F.lit("untracked")))


def integrity_summary(verified: DataFrame, strict_untracked: bool = False) -> DataFrame:
    """Per run the verdict and a count of each state. A run without any manifest line is invalid."""
    counts = verified.groupBy("run_id").agg(*[F.count_if(F.col("status") == s).alias(f"{s}_files") for s in (
        "ok", "missing", "mismatched", "malformed", "unsafe", "untracked")])
    bad = F.col("missing_files") + F.col("mismatched_files") + F.col("malformed_files") + F.col("unsafe_files")
    if strict_untracked:
        bad = bad + F.col("untracked_files")
    listed = bad + F.col("ok_files") + (F.lit(0) if not strict_untracked else -F.col("untracked_files"))
    return counts.withColumns({"checked_files": F.col("ok_files") + F.col("mismatched_files"),
                               "strict_untracked": F.lit(strict_untracked), "integrity_valid": (bad == 0) & (listed > 0)})


# --- sample file profiles ------------------------------------------------------

def file_profile(df: DataFrame, keys: Sequence[str] = ("run_id", "file")) -> DataFrame:
    """Rows, failed rows (null without a status column) and window of each sample file."""
    if "sample_status" in df.columns:
        failed = F.count_if(F.coalesce(F.lower(F.trim("sample_status")), F.lit("")) != "ok")
        source = F.lit("sample_status")
    elif "sample_ok" in df.columns:
        failed = F.count_if(F.lower(F.trim(F.col("sample_ok").cast("string"))).isin(*FALSE_TEXT))
        source = F.lit("sample_ok")
    else:
        failed, source = F.lit(None).cast("long"), F.lit(None).cast("string")

    def names(column: str) -> Column:
        # Interfaces and targets of one run come from its configuration: a handful.
        if column not in df.columns:
            return F.array().cast("array<string>")
        return F.array_sort(F.collect_set(F.when(F.trim(column) != "", F.trim(column))))

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), failed.alias("failed_rows"), source.alias("status_source"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        (names("interface") if "interface" in df.columns else F.first(names("interface"))).alias("interfaces"),
        (names("target") if "target" in df.columns else F.first(names("target"))).alias("targets"),
    ).withColumn("duration_seconds", seconds_between(F.col("first_timestamp"), F.col("last_timestamp")))


def run_metadata(profiles: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """Fold file profiles to one row per run; ``configured`` adds ``run_id, configured_targets``."""
    def union(column: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))

    rows = profiles.groupBy("run_id").agg(
        F.sum("rows").alias("total_rows"), F.coalesce(F.sum("failed_rows"), F.lit(0)).alias("failed_rows_known_total"),
        F.count_if(F.col("failed_rows").isNull()).alias("failure_status_unknown_files"),
        F.min("first_timestamp").alias("first_timestamp"), F.max("last_timestamp").alias("last_timestamp"),
        union("interfaces").alias("discovered_interfaces"), union("targets").alias("targets"))
    if configured is not None:
        rows = known_targets(rows.join(configured, "run_id", "left")).drop("configured_targets")
    return rows.withColumns({
        "interface": F.when(F.size("discovered_interfaces") == 1, F.get("discovered_interfaces", F.lit(0))),
        "duration_seconds": seconds_between(F.col("first_timestamp"), F.col("last_timestamp"))})


def known_targets(rows: DataFrame) -> DataFrame:
    """``targets`` becomes configured plus discovered names, trimmed and sorted."""
    configured = F.filter(F.transform(F.coalesce("configured_targets", F.array().cast("array<string>")), lambda t: F.trim(t)),
                          lambda t: t != "")
    return rows.withColumn("targets", F.array_sort(F.array_union(F.col("targets"), configured)))


# --- tolerant comparison -------------------------------------------------------

def cell_type(text: Column) -> Column:
    t = F.trim(text)
    return (F.when(t.isNull() | (t == ""), "null").when(F.lower(t).isin("true", "false"), "bool")
            .when(t.rlike(INT_TEXT), "int")
            .when(t.rlike(FLOAT_TEXT) & F.coalesce(F.abs(t.try_cast("double")) < float("inf"), F.lit(False)), "float")
            .otherwise("text"))


def _numbered(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Keys, the occurrence of each key (in order of its values) and the values as text."""
    values = sorted(c for c in df.columns if c not in keys)
    copies = W.partitionBy(*keys).orderBy(*[F.col(c).cast("string") for c in values] or [F.lit(1)])
    return df.select(*[F.col(k).alias(f"_{side}_{k}") for k in keys], *[F.col(c).cast("string").alias(f"_{side}_v_{c}") for c in values],
                     F.row_number().over(copies).alias(f"_{side}_no"))


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], artifact: str = "table",
               rel_tol: float = 1e-9, abs_tol: float = 1e-9) -> DataFrame:
    """Cells that differ: ``artifact, keys, column, kind, left, right``.

    Rows meet once, on their keys (null equals null) and the key's occurrence; only differing cells are unfolded.
    """
    keys = list(keys)
    first, second = _numbered(left, keys, "l"), _numbered(right, keys, "r")
    same_row = first["_l_no"] == second["_r_no"]
    for k in keys:
        same_row = same_row & first[f"_l_{k}"].eqNullSafe(second[f"_r_{k}"])
    both = first.join(second, same_row, "full_outer")
    cells = []
    for c in [c for c in dict.fromkeys([*left.columns, *right.columns]) if c not in keys]:
        value = [F.col(f"_{s}_v_{c}") if c in df.columns else F.lit(None).cast("string") for s, df in (("l", left), ("r", right))]
        there = [F.col(f"_{s}_no").isNotNull() if c in df.columns else F.lit(False) for s, df in (("l", left), ("r", right))]
        kind = _difference(*value, *there, rel_tol, abs_tol)
        cells.append(F.when(kind.isNotNull(), F.struct(F.lit(c).alias("column"), kind.alias("kind"), value[0].alias("left"), value[1].alias("right"))))
    named = [F.coalesce(f"_l_{k}", f"_r_{k}").alias(k) for k in keys]
    return both.select(*named, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(F.lit(artifact).alias("artifact"), *keys, "c.*")


def _difference(left: Column, right: Column, in_left: Column, in_right: Column, rel_tol: float, abs_tol: float) -> Column:
    """``only_left``, ``only_right``, ``changed`` or null."""
    lt, rt = cell_type(left), cell_type(right)
    a, b = F.trim(left), F.trim(right)

    def number(text: Column, kind: Column) -> Column:
        return (F.when(kind == "bool", F.when(F.lower(text) == "true", 1.0).otherwise(0.0))
                .when(kind.isin("int", "float"), text.try_cast("double")))

    x, y = number(a, lt), number(b, rt)
    boolean = (lt == "bool") | (rt == "bool")
    same = (F.when((lt == "null") | (rt == "null"), lt == rt).when(boolean, F.coalesce(x == y, F.lit(False)))
            .when(x.isNotNull() & y.isNotNull(), is_close(x, y, rel_tol, abs_tol)).otherwise(a == b))
    return F.when(in_left & ~in_right, "only_left").when(in_right & ~in_left, "only_right").when(in_left & in_right & ~same, "changed")


def diff_limit(differences: DataFrame, order: Iterable[str], limit: int = DIFF_LIMIT) -> DataFrame:
    """The first ``limit`` differences per artifact.

    Each of many slices of an artifact keeps its own first rows, so the final
    numbering sees at most ``limit`` rows per slice.
    """
    order = list(order)
    sliced = differences.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(DIFF_SLICES)))
    local = W.partitionBy("artifact", "_slice").orderBy(*order)
    kept = sliced.withColumn("_local", F.row_number().over(local)).where(F.col("_local") <= limit).drop("_local", "_slice")
    return kept.withColumn("diff_no", F.row_number().over(W.partitionBy("artifact").orderBy(*order))).where(
        F.col("diff_no") <= limit)


def check_reproducibility(first: Mapping[str, DataFrame], second: Mapping[str, DataFrame],
                          keys: Mapping[str, Sequence[str]], rel_tol: float = 1e-9, abs_tol: float = 1e-9) -> DataFrame:
    """Per artifact of two replays: difference count and verdict."""
    rows = None
    for name in sorted(first):
        found = table_diff(first[name], second[name], keys[name], name, rel_tol, abs_tol).agg(
            F.count(F.lit(1)).alias("difference_count")).select(F.lit(name).alias("artifact"), "difference_count")
        rows = found if rows is None else rows.unionByName(found)
    return rows.withColumn("reproducible", F.col("difference_count") == 0)

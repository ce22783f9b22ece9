"""Deletes, upserts and guards as new versions of tables (nothing is changed in place)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete_condition(raw_files: DataFrame, children: dict[str, DataFrame], condition: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the raw files of a condition and their child rows; (table, deleted) counts, with the imports left without files."""
    doomed = raw_files.filter(F.lower(F.trim("biological_condition")) == condition.lower().strip()).select("raw_file_id").distinct()
    out = {"raw_files": raw_files.join(doomed, "raw_file_id", "left_anti")}
    counts = raw_files.join(doomed, "raw_file_id", "left_semi").agg(F.lit("raw_files").alias("table_name"), F.count("*").alias("deleted"))
    for name, df in children.items():
        out[name] = df.join(doomed, "raw_file_id", "left_anti")
        counts = counts.unionByName(df.join(doomed, "raw_file_id", "left_semi").agg(F.lit(name).alias("table_name"), F.count("*").alias("deleted")))
    orphan = orphan_imports(raw_files, doomed).agg(F.lit("imports").alias("table_name"), F.count("*").alias("deleted"))
    return out, counts.unionByName(orphan)


def orphan_imports(raw_files: DataFrame, doomed: DataFrame) -> DataFrame:
    """import_id whose files are all doomed; taken before the delete."""
    m = raw_files.join(doomed.withColumn("__d", F.lit(1)), "raw_file_id", "left")
    return m.groupBy("import_id").agg(F.sum(F.coalesce("__d", F.lit(0))).alias("__k"), F.count("*").alias("__n")).filter("__k = __n").select("import_id")


def delete_import(tables: dict[str, DataFrame], import_id: int) -> dict[str, DataFrame]:
    """Tables without an import, its raw files and their rows."""
    doomed = tables["raw_files"].filter(F.col("import_id") == import_id).select("raw_file_id").distinct()
    return {n: df.filter(F.col("import_id") != import_id) if "import_id" in df.columns else df.join(doomed, "raw_file_id", "left_anti") if "raw_file_id" in df.columns else df for n, df in tables.items()}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; a new value that is not null replaces the old one."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in rest if c in new.columns])
    j = old.join(n, keys, "full")
    return j.select(*keys, *[F.coalesce(f"__new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in rest])


def exclude_runs(excluded: DataFrame, new: DataFrame) -> DataFrame:
    """Exclusions with the new ones; a run already excluded keeps its reason where the new one is null."""
    return upsert(excluded, new, ["raw_file_id"])


def include_runs(excluded: DataFrame, again: DataFrame) -> DataFrame:
    return excluded.join(again.select("raw_file_id"), "raw_file_id", "left_anti")


def update_where(df: DataFrame, keys: DataFrame, key: str, **values) -> DataFrame:
    """``df`` with constants in the rows whose key is listed."""
    m = df.join(keys.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return m.select(*[F.when(F.col("__hit"), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def refuse_duplicates(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, or an error that names up to ten repeated keys."""
    bad = duplicates(df, keys).limit(10).collect()
    if bad:
        raise ValueError(f"{what} repeats: " + ", ".join(str(tuple(r)[:-1]) for r in bad))
    return df

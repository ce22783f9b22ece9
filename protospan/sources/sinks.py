"""Writers: tables, matrices, references and reports. Writing goes to a new folder first and is swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.operators.dml import upsert


def save_import(rows: DataFrame, folder: str, import_id: int) -> DataFrame:
    """Appends the quantity summary of one import: sums above 0 as mean and median, one detection each."""
    out = rows.filter("intensity > 0").select(F.lit(import_id).cast("long").alias("import_id"), F.col("protein").alias("protein_id"), "run", F.col("intensity").alias("median_intensity"), F.col("intensity").alias("mean_intensity"), F.lit(1).alias("detection_count"))
    out.write.mode("append").partitionBy("import_id").parquet(folder)
    return out


def save_upsert(old: DataFrame, new: DataFrame, keys: list[str], folder: str) -> None:
    """A new version of a table with ``new`` merged in; ``folder`` must not be the one ``old`` is read from."""
    upsert(old, new, keys).write.mode("errorifexists").parquet(folder)


def replace_folder(df: DataFrame, folder: str) -> None:
    """Replaces a table: written beside it, then swapped in by two renames.

    A failure while writing leaves the old table; one between the renames leaves it as ``.old``, from where the next
    call takes it back. Readers may miss the table between the renames, since folders have no atomic exchange.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(folder + x) for x in ("", ".new", ".old"))
    fs = target.getFileSystem(conf)
    if fs.exists(old) and not fs.exists(target):
        fs.rename(old, target)
    df.write.mode("overwrite").parquet(folder + ".new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def wide_csv(long: DataFrame, row: str, column: str, value: str, folder: str, most: int = 20_000) -> None:
    """A matrix as CSV: quoted where needed, blank where missing. Refuses more columns than ``most``."""
    names = [r[0] for r in long.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    long.groupBy(row).pivot(column, names).agg(F.first(value)).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def sparse_lines(long: DataFrame, labels: DataFrame) -> DataFrame:
    """line per run: class number, then dim:value with protein numbers from 1 by name without case and values above 0."""
    from pyspark.sql import Window

    p = long.filter("value > 0").select("protein").distinct().withColumn("dim", F.row_number().over(Window.orderBy(F.lower("protein"), "protein")))
    c = labels.select("label").distinct().withColumn("cls", F.row_number().over(Window.orderBy("label")))
    j = long.filter("value > 0").join(p, "protein").join(labels, "run").join(c, "label")
    items = F.array_sort(F.collect_list(F.struct("dim", "value")))
    text = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["dim"].cast("string"), x["value"].cast("string"))), " ")
    return j.groupBy("run", "cls").agg(text.alias("t")).select("run", F.concat_ws(" ", F.col("cls").cast("string"), "t").alias("line"))


STAT_COLUMNS = ["Protein", "BestCellType", "SpecificityDelta", "WeightedScore", "KW_H", "KW_pValue", "BestDetection", "IsRobust"]


def reference_lines(profiles: DataFrame, metadata: dict[str, str], stats: DataFrame | None = None) -> DataFrame:
    """section, head, best, value, gene, line: a reference as lines, in the order of these columns.

    Metadata, expression (4 decimals), detection (0 to 1) and, with ``stats`` (protein, best, delta, weighted, h, p,
    detection, robust), the marker statistics. Missing values are written as zero; genes go by their best type and value.
    """
    spark = profiles.sparkSession
    types = [r.cell_type for r in profiles.select("cell_type").distinct().orderBy("cell_type").collect()]  # a column each
    best = profiles.groupBy("gene").agg(F.max_by(F.struct("cell_type", "median"), F.struct("median", "cell_type")).alias("b"))
    order = [F.col("b.cell_type").alias("best"), (-F.col("b.median")).alias("value"), "gene"]
    heads = [(0, k, f"##{a}:{b}") for k, (a, b) in enumerate(metadata.items())]
    out = None
    for section, (name, number) in enumerate((("EXPRESSION", F.col("median")), ("DETECTION", F.col("pct") / 100)), 1):
        heads += [(section, 0, f"##SECTION:{name}"), (section, 1, "\t".join(["Protein", *types]))]
        at = profiles.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("cell_type", F.round(number, 4).alias("x")))).alias("m")).join(best, "gene")
        cells = [F.format_string("%.4f", F.coalesce(F.element_at("m", F.lit(t)), F.lit(0.0))) for t in types]
        rows = at.select(F.lit(section).alias("section"), F.lit(2).alias("head"), *order, F.concat_ws("\t", "gene", *cells).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    if stats is not None:
        heads += [(3, 0, "##SECTION:MARKER_STATS"), (3, 1, "\t".join(STAT_COLUMNS))]
        four = lambda c: F.format_string("%.4f", F.round(c, 4))
        e = F.format_string("%.4E", "p")  # exponents have three digits or more
        power = F.regexp_replace(e, r"(E[+-])(\d\d)$", "$1@$2")
        fields = ["gene", "s.best", four("s.delta"), four("s.weighted"), four("s.h"), F.replace(power, F.lit("@"), F.lit("0")), four("s.detection"), F.when(F.col("s.robust"), "TRUE").otherwise("FALSE")]
        named = best.join(stats.select(F.col("protein").alias("gene"), F.struct("best", "delta", "weighted", "h", "detection", "robust").alias("s"), "p"), "gene")
        out = out.unionByName(named.select(F.lit(3).alias("section"), F.lit(2).alias("head"), *order, F.concat_ws("\t", *fields).alias("line")))
    top = spark.createDataFrame([(a, b, "", 0.0, "", line) for a, b, line in heads], "section int, head int, best string, value double, gene string, line string")
    return top.unionByName(out)


REFERENCE_ORDER = ["section", "head", "best", "value", "gene"]


def write_reference(lines: DataFrame, folder: str) -> None:
    """One text file of ``reference_lines`` in order; sorting spills where a reference is large."""
    lines.repartition(1).sortWithinPartitions(*REFERENCE_ORDER).select("line").write.mode("overwrite").text(folder)


def write_lines(df: DataFrame, lines: list[str], folder: str) -> None:
    df.sparkSession.createDataFrame(list(enumerate(lines)), "n int, line string").coalesce(1).sortWithinPartitions("n").select("line").write.mode("overwrite").text(folder)


def csv_report(df: DataFrame, columns: list[str], folder: str, sep: str = ",") -> None:
    """A report with fixed columns in order, 'NA' for missing ranks left to the caller."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(folder)


def build_reference_store(expression: DataFrame, cells: DataFrame, folder: str) -> None:
    """Profiles of counts per cell type (gene, cell, count with cell, cell_type) as a table of their own."""
    from protospan.operators.aggregates import count_profiles

    replace_folder(count_profiles(expression, cells), folder)

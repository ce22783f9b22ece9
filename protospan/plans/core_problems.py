"""Queries of the general data-quality problems."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.functions.lineage import cut_lineage
from protospan.functions.missing import measured_or_null, text_or_null
from protospan.operators import eav, impute, orphans, packed, spikes
from protospan.sources.tables import read

# fixed values: the features of cell_features as spelled in its description
FEATURES = [
    "AreaShape_Area", "AreaShape_Perimeter", "AreaShape_Orientation", "AreaShape_Extent", "AreaShape_Solidity", "Intensity_StdIntensity",
    "Intensity_IntegratedIntensity", "Intensity_MADIntensity", "Texture_Contrast", "Texture_AngularSecondMoment", "Texture_Homogeneity",
    "Texture_Entropy", "Texture_Correlation", "RadialDistribution_FracAtD_1of3", "RadialDistribution_FracAtD_2of3",
    "RadialDistribution_FracAtD_3of3", "RadialDistribution_RadialCV", "Neighbors_Count", "Location_EdgeDistance", "Granularity_Spectrum_1",
]
WHOLE = {"AreaShape_Area", "Intensity_IntegratedIntensity", "Neighbors_Count"}


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "isolated_cells")
    return spikes.implausible(cells, "cell_id", "cellenone_run_id", "drop_no", "loaded_at", spikes.SpikeConfig(spikes.CELL_MEASURES))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).select("cell_id", "measure").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return p1_flags(spark, d).groupBy("measure", "reason").agg(F.count_distinct("cell_id").alias("cells"))


def _feature_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "cell_features").select("cell_id", "feature", "value")
    spelled = eav.spelling_table(rows, "feature", FEATURES)
    named = rows.join(spelled, F.col("feature") == F.col("spelling"))
    return eav.long_cells(named, "cell_id", "attribute", "value")


def _report_cells(spark: SparkSession, d: str) -> DataFrame:
    q = lambda c: F.col(f"`{c}`")
    return eav.long_cells(read(spark, d, "diann_report"), text_or_null(q("Run")), text_or_null(q("Protein.Group")), measured_or_null(q("PG.MaxLFQ")))


def p2_cell_features_wide(spark: SparkSession, d: str) -> DataFrame:
    cells = _feature_cells(spark, d)
    fixed = spark.createDataFrame([(n, i) for i, n in enumerate(FEATURES)], "attribute string, idx int")
    columns = [(i, n, "bigint" if n in WHOLE else "double") for i, n in enumerate(FEATURES)]
    return eav.wide_rows(eav.sparse_rows(cells, fixed), columns, entity_name="cell_id").withColumn("cell_id", F.col("cell_id").cast("long"))


def p2_runs_wide(spark: SparkSession, d: str, block: int | None = None, block_width: int = 4096) -> DataFrame:
    """The run-by-group table, or one block of its columns. Blocks are built one by one and joined by run; the driver learns the names of the columns made."""
    cells = _report_cells(spark, d)
    names = eav.dictionary(read(spark, d, "diann_report").select(text_or_null(F.col("`Protein.Group`")).alias("attribute")), "attribute")
    if block is None:
        names = cut_lineage(names)  # read once per block
    sparse = eav.sparse_rows(cells, names, block_width)
    if block is None:
        sparse = cut_lineage(sparse)
    blocks = [block] if block is not None else range(max(1, -(-names.count() // block_width)))
    seen: set[str] = {"run"}
    out = None
    for n in blocks:
        mine = names.filter(F.floor(F.col("idx") / block_width) == n).orderBy("idx").collect()  # block_width names at most
        columns = []
        for r in mine:  # column names differ without case: a later one gets its number
            name = r.attribute if r.attribute.lower() not in seen else f"{r.attribute}#{r.idx}"
            seen.add(name.lower())
            columns.append((r.idx, name, "double"))
        one = eav.wide_rows(sparse, columns, n, "Run")
        out = one if out is None else out.join(one, "Run", "full")
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for table, cells in (("cell_features", _feature_cells(spark, d)), ("diann_report", _report_cells(spark, d))):
        names = eav.dictionary(cells, "attribute")
        held = eav.filled_cells(eav.sparse_rows(cells, names), names)
        out.append(held.select(F.lit(table).alias("table_name"), "entity", "attribute"))
    return out[0].unionByName(out[1])


def p3_orphans(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for r in orphans.REFERENCES:
        one = orphans.orphans(read(spark, d, r.table), r.record, r.column, read(spark, d, r.parent), r.key, r.table)
        out = one if out is None else out.unionByName(one)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_orphans(spark, d).select("table_name", "record_id").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(p3_orphans(spark, d))


PACKED = ["Protein.Group", "Protein.Ids", "Genes"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.unpack(read(spark, d, "diann_report"), "report_row", "Run.Index", PACKED)


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    return impute.fill(read(spark, d, "diann_report"), impute.REPORT_TARGETS)


def p5_supported(spark: SparkSession, d: str) -> DataFrame:
    """The same by groups of at least five values, so that small groups back off to coarser ones."""
    return impute.fill(read(spark, d, "diann_report"), [replace(t, min_support=5) for t in impute.REPORT_TARGETS])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    filled = p5_filled(spark, d)
    marks = F.array(*[F.when(F.col(f"`{t.column}__filled`"), F.lit(t.column)) for t in impute.REPORT_TARGETS])
    return filled.select("report_row", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("field_name"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_cell_features_wide, p2_runs_wide, p3_found, p3_report, p4_found, p5_found, p5_filled, p5_supported)}

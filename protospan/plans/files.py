"""Queries of the file formats: texts written from the tables to the shared folder and read back by the format's reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protospan.functions import scalars as X
from protospan.functions.lineage import scratch
from protospan.operators import joins
from protospan.plans import analytics as N
from protospan.plans import relational as Q
from protospan.plans import relations as L
from protospan.plans.analytics import _PROF
from protospan.plans.registry import Registry
from protospan.plans.relations import REP
from protospan.sources import formats, sinks
from protospan.sources.tables import read

reg = Registry()
W = f"with {REP}, "


def _written(lines: DataFrame, name: str = "lines.txt") -> str:
    """Folder of a text file of ``lines`` (n, line) in order."""
    folder = f"{scratch(lines.sparkSession)}/{name}"
    lines.coalesce(1).sortWithinPartitions("n").select("line").write.text(folder)
    return folder


def _hits(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "cell_detections").filter("channel IS NOT NULL AND cellenone_run_id IS NOT NULL")
    return c.groupBy(F.col("channel").alias("gene"), F.concat(F.lit("r"), F.col("cellenone_run_id").cast("string")).alias("cell")).agg(F.count("*").cast("int").alias("count"))


_HITS = "hits as (select channel gene, 'r' || cellenone_run_id cell, cast(count(*) as int) count from cell_detections where channel is not null and cellenone_run_id is not null group by 1, 2)"


@reg.add(f"with {_HITS} select gene, cell, count from hits where trim(gene) <> ''".replace("gene, cell, count from", "trim(gene) as gene, cell, count from"))
def sc7_expression_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Detections per channel and run as a matrix of text, with a header one short, read back."""
    h = _hits(spark, d).filter("trim(gene) <> ''")
    cells = h.agg(F.array_sort(F.collect_set("cell"))).scalar()  # a column per run
    row = h.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("cell", "count"))).alias("m")).select("gene", "m", cells.alias("c"))
    body = row.select(F.lit(1).alias("n"), F.concat_ws("\t", "gene", F.transform("c", lambda x: F.coalesce(F.element_at("m", x), F.lit(0)).cast("string"))).alias("line"))
    head = spark.range(1).select(F.lit(0).alias("n"), F.array_join(cells, "\t").alias("line"))
    return formats.read_expression_tsv(spark, _written(head.unionByName(body)))


@reg.add("select cast(cell_id as varchar) as cell, nullif(trim(target_well), '') as cell_type from isolated_cells")
def sc8_cell_metadata(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch(spark)
    read(spark, d, "isolated_cells").select(F.col("cell_id").alias("cell"), F.trim("target_well").alias("cell_type")).write.csv(folder, sep="\t", header=True)
    return formats.read_cell_metadata(spark, folder)


@reg.add(W + f"{_PROF} select gene, cell_type, round(coalesce(median, 0), 4) as median, round(round(coalesce(pct, 0), 4) * 100, 2) as pct from (select distinct gene from prof) cross join (select distinct cell_type from prof) left join prof using (gene, cell_type) where not regexp_matches(gene, '[\\t\\r\\n]')")
def sc9_reference(spark: SparkSession, d: str) -> DataFrame:
    """The exported reference read back (a class without the gene as zero), but for names with tabs or line ends, which the format cannot hold."""
    p = N._profiles(spark, d).withColumns({"median": F.round("median", 4), "pct": F.round(F.round("pct", 4) * 100, 2)}).filter(~F.col("gene").rlike("[\\t\\r\\n]"))
    folder = f"{scratch(spark)}/reference.pref"
    sinks.write_reference(sinks.reference_lines(p, {"SourceDataset": "conditions"}), folder)
    return formats.read_pref(spark, folder).select("gene", "cell_type", "median", F.round("pct", 2).alias("pct"))


def _accession(seq: Column) -> Column:
    return F.concat(F.lit("P"), F.upper(F.substring(F.md5(seq), 1, 8)))


def _fasta(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "diann_report").select(F.col("`Stripped.Sequence`").alias("s")).filter("s <> ''").distinct()
    kind = F.when(F.length("s") % 2 == 0, "sp").otherwise("tr")
    head = F.concat(F.lit(">"), kind, F.lit("|"), _accession(F.col("s")), F.lit("|"), F.substring("s", 1, 4), F.lit("_HUMAN Part of "), F.length("s").cast("string"), F.lit(" OS=Homo sapiens GN=G"), F.length("s").cast("string"))
    folder = scratch(spark)
    s.select(F.concat(head, F.lit("\n"), F.regexp_replace("s", "(.{10})", "$1\n")).alias("line")).write.text(folder)
    return formats.read_fasta(spark, folder)


_SEQ = """seqs as (select distinct "Stripped.Sequence" s, 'P' || upper(substr(md5("Stripped.Sequence"), 1, 8)) acc from diann_report where "Stripped.Sequence" <> '')"""


@reg.add(f"with {_SEQ} select acc as accession, substr(s, 1, 4) || '_HUMAN' as entry, 'Part of ' || length(s) as description, 'Homo sapiens' as organism, 'G' || length(s) as gene, s as sequence, length(s) % 2 = 0 as reviewed from seqs")
def sc11_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Peptides as FASTA records over several lines, read back."""
    return _fasta(spark, d).select("accession", "entry", "description", "organism", "gene", "sequence", "reviewed")


@reg.add(f"with {_SEQ} select acc || case when length(s) % 3 = 0 then '-2' else '' end as accession, s as sequence from seqs union all select 'NONE-1', null")
def sc12_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences by accession, isoforms by their base."""
    s = read(spark, d, "diann_report").select(F.col("`Stripped.Sequence`").alias("s")).filter("s <> ''").distinct()
    asked = s.select(F.concat(_accession(F.col("s")), F.when(F.length("s") % 3 == 0, "-2").otherwise("")).alias("accession"))
    return formats.sequences_of(_fasta(spark, d), asked.unionByName(spark.createDataFrame([("NONE-1",)], "accession string")))


_EDGES = "ga as (select distinct protein, trim(unnest(regexp_split_to_array(genes, '[;,]'))) g from gmap), ed as (select distinct a.g src, b.g dst, 500 + (length(a.g) * 97 + length(b.g) * 31) % 500 score from ga a join ga b using (protein) where a.g <> b.g and a.g <> '' and b.g <> '')"


@reg.add(W + _EDGES + " select src, dst, cast(score as int) as score from ed where score >= 700 union select dst, src, cast(score as int) from ed where score >= 700")
def sc15_links(spark: SparkSession, d: str) -> DataFrame:
    """Gene pairs as a list of links with species prefix and score, read back both ways from 700 on."""
    e = Q._edges(spark, d)
    p = lambda c: F.concat(F.lit("9606."), F.col(c))
    folder = scratch(spark)
    e.select(p("src").alias("protein1"), p("dst").alias("protein2"), (500 + (F.length("src") * 97 + F.length("dst") * 31) % 500).alias("combined_score")).write.csv(folder, sep=" ", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return formats.read_links(spark, folder)


_ALIAS = "al as (select protein, alias, pos, case (pos + length(protein)) % 3 when 0 then 'curated' when 1 then 'gene' else 'other' end source from (select protein, unnest(a) alias, generate_subscripts(a, 1) - 1 + length(protein) * 100 pos from (select protein, list_filter(list_transform(regexp_split_to_array(genes, '[;,]'), lambda x: trim(x)), lambda x: x <> '') a from gmap)))"
PRIORITY = {"curated": 100, "gene": 80}


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    g = L.genes(spark, d).select("protein", F.posexplode(X.split_group(F.col("genes"))).alias("i", "alias")).withColumn("pos", F.col("i") + F.length("protein") * 100)
    k = (F.col("pos") + F.length("protein")) % 3
    return g.select("protein", "alias", "pos", F.when(k == 0, "curated").when(k == 1, "gene").otherwise("other").alias("source"))


@reg.add(W + _ALIAS + " select lower(alias) as alias, count(distinct protein) > 0 as known, max(case source when 'curated' then 100 else 80 end) as priority from al where source <> 'other' group by 1")
def sc16_alias_sources(spark: SparkSession, d: str) -> DataFrame:
    """alias, known, priority of the source that decides its protein."""
    a = _aliases(spark, d)
    best = formats.best_aliases(a, PRIORITY)
    p = F.when(F.col("source") == "curated", 100).when(F.col("source") == "gene", 80)
    top = a.filter(p.isNotNull()).groupBy(F.lower("alias").alias("alias")).agg(F.max(p).alias("priority"))
    return best.join(top, "alias").select("alias", F.col("protein").isNotNull().alias("known"), "priority")


@reg.add("select distinct regexp_extract(trim(\"Protein.Ids\"), '^([^\\s,;]+)', 1) as accession from diann_report where trim(\"Protein.Ids\") <> '' and trim(\"Protein.Ids\")[1] not in ('#', '>') and regexp_extract(trim(\"Protein.Ids\"), '^([^\\s,;]+)', 1) <> ''")
def sc17_accessions(spark: SparkSession, d: str) -> DataFrame:
    """First accessions of a list of lines."""
    ids = read(spark, d, "diann_report").select(F.col("`Protein.Ids`").alias("value")).filter("trim(value) <> '' AND NOT startswith(trim(value), '>')").distinct()
    folder = scratch(spark)
    ids.unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(folder)
    return formats.accession_list(spark.read.text(folder))


@reg.add(f"with {_HITS}, ty as (select distinct 'r' || cellenone_run_id cell, case when cellenone_run_id % 2 = 0 then 'even' else 'odd' end cell_type from cell_detections where cellenone_run_id is not null) select cell_type, gene, round(median(count), 6) as median, round(avg(count), 6) as mean, round(count(*) / any_value(n), 6) as pct from hits join ty using (cell) join (select cell_type, count(*) n from ty group by 1) using (cell_type) group by 1, 2")
def sc20_reference_store(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of counts per class, written as a store and read back."""
    h = _hits(spark, d)
    run = read(spark, d, "cell_detections").select("cellenone_run_id").dropna().distinct()
    cells = run.select(F.concat(F.lit("r"), F.col("cellenone_run_id").cast("string")).alias("cell"), F.when(F.col("cellenone_run_id") % 2 == 0, "even").otherwise("odd").alias("cell_type"))
    folder = scratch(spark)
    sinks.build_reference_store(h, cells, folder)
    return spark.read.parquet(folder).select("cell_type", "gene", *[F.round(c, 6).alias(c) for c in ("median", "mean", "pct")])


@reg.add("select plate_id, plate_name from plates")
def sk3_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A table written, replaced and read back."""
    p, folder = read(spark, d, "plates"), scratch(spark)
    sinks.replace_folder(p.select("plate_id", F.lit("old").alias("plate_name")), folder)
    sinks.replace_folder(p.select("plate_id", "plate_name"), folder)
    return spark.read.parquet(folder)


@reg.add("select raw_file_id, try_cast(nullif(regexp_extract(raw_file_name, '(-?\\d+(?:\\.\\d+)?)\\s*$', 1), '') as double) as number from raw_files")
def x9_trailing_number(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "raw_files").select("raw_file_id", X.trailing_number(F.col("raw_file_name")).alias("number"))


@reg.add("""with s as (select distinct "Stripped.Sequence" s, substr("Stripped.Sequence", 1, 2) p from diann_report where length("Stripped.Sequence") >= 2), r as (select s, len(list_distinct(flatten(list_transform(list_filter(range(1, length(s)), lambda i: substr(s, i, 2) = p), lambda i: [i, i + 1])))) c from s)
select s as protein, cast(length(s) as int) as length, c as covered, round(c * 100.0 / length(s), 6) as percent from r""")
def x14_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each sequence under its own first two residues, wherever they occur."""
    s = read(spark, d, "diann_report").select(F.col("`Stripped.Sequence`").alias("sequence")).filter("length(sequence) >= 2").distinct()
    hits = s.select(F.col("sequence").alias("protein"), "sequence", F.substring("sequence", 1, 2).alias("peptide"))
    return joins.coverage(hits).withColumn("percent", F.round("percent", 6))

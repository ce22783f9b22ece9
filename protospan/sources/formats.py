"""Text, spreadsheet and instrument formats as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protospan.functions.dates import iso_or_raw

# ---- spreadsheets

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_cells(content: bytes) -> list[list[str | None]]:
    """Rows of the first sheet: shared, inline and formula strings, cells with or without a reference."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_NS + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_NS + "si")]
        sheet = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n).group(1)))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(_NS + "row"):
            line: list[str | None] = []
            for c in row.iter(_NS + "c"):
                at = _column_number(c.get("r")) if c.get("r") else len(line)
                line += [None] * (at - len(line) + 1)
                v, kind = c.find(_NS + "v"), c.get("t")
                if kind == "inlineStr":
                    line[at] = "".join(t.text or "" for t in c.iter(_NS + "t"))
                elif v is not None and v.text is not None:
                    line[at] = shared[int(v.text)] if kind == "s" else v.text
            out.append(line)
        return out


def read_xlsx_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, gene_row, gene, sample_column, sample, value (> 0) of gene matrices, one task per workbook."""

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = xlsx_cells(content)
                got = []
                for i, r in enumerate(rows[1:]):
                    for j in range(1, min(len(r), len(rows[0]))):
                        try:
                            v = float(r[j]) if r[j] not in (None, "") else 0.0
                        except ValueError:
                            continue
                        if v > 0 and r[0] and rows[0][j]:
                            got.append((name, i, r[0].strip(), j, rows[0][j].strip(), v))
                yield pd.DataFrame(got, columns=["file", "gene_row", "gene", "sample_column", "sample", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, gene_row int, gene string, sample_column int, sample string, value double")


def matrix_quant(cells: DataFrame) -> DataFrame:
    """run, condition, protein, intensity of a gene matrix; a sample's path gives run (leaf) and condition (its folder).

    A run name met twice becomes condition/run, then gets #2, #3...; of repeated gene rows the last is kept; samples
    without values are absent.
    """
    path = F.split(F.regexp_replace("sample", r"\\", "/"), "/")
    s = cells.select("file", "sample_column", "sample").distinct().withColumn("leaf", F.element_at(path, -1)).withColumn("condition", F.when(F.size(path) > 1, F.element_at(path, -2)))
    first = F.row_number().over(Window.partitionBy("leaf").orderBy("file", "sample_column"))
    s = s.withColumn("run", F.when((first == 1) | F.col("condition").isNull(), F.col("leaf")).otherwise(F.concat_ws("/", "condition", "leaf")))
    k = F.row_number().over(Window.partitionBy("run").orderBy("file", "sample_column"))
    s = s.withColumn("run", F.when(k > 1, F.concat(F.col("run"), F.lit("#"), k.cast("string"))).otherwise(F.col("run")))
    v = cells.join(s.select("file", "sample_column", "run", "condition"), ["file", "sample_column"])
    return v.groupBy("run", "condition", F.col("gene").alias("protein")).agg(F.max_by("value", "gene_row").alias("intensity"))


# ---- tab-separated tables


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line: lines of each file in order; a file is one row of its own, since its lines have no order otherwise."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return whole


def read_expression_tsv(spark: SparkSession, path: str) -> DataFrame:
    """gene, cell, count (> 0). The header may name the gene column or leave it out; other widths are an error."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    head, body = (lines.filter(F.col("n") == i).first() for i in (0, 1))
    if head is None or body is None:
        return spark.createDataFrame([], "gene string, cell string, count int")
    names, width = [x.strip().strip('"') for x in head.line.split("\t")], len(body.line.split("\t"))
    if width == len(names):
        names = names[1:]
    elif width != len(names) + 1:
        raise ValueError(f"{path}: {len(names)} names over {width} columns")
    f = F.split("line", "\t")
    plain = lambda c: F.trim(F.regexp_replace(c, '"', ""))
    table = spark.createDataFrame(list(enumerate(names)), "i int, cell string")
    long = lines.filter("n > 0").select(plain(F.get(f, F.lit(0))).alias("gene"), F.posexplode(F.slice(f, 2, len(names))).alias("i", "v"))
    return long.select("gene", "i", plain(F.col("v")).try_cast("int").alias("count")).filter("count > 0").join(table, "i").select("gene", "cell", "count")


def read_cell_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def read_label_tsv(spark: SparkSession, path: str) -> DataFrame:
    """run, label, delta_next, pruned_label, scores (name to number) and ranked names; a header one short is R row names."""
    lines = [r.line for r in numbered_lines(spark, path).filter(F.trim("line") != "").filter("n < 2").orderBy("n").collect()]
    if len(lines) < 2:
        return spark.createDataFrame([], "run string, label string, delta_next double, pruned_label string, scores map<string,double>, ranked array<string>")
    names, first = [x.strip().strip('"') for x in lines[0].split("\t")], lines[1].split("\t")
    if len(first) == len(names) + 1:
        names = ["run", *names]
    low = [n.lower() for n in names]
    at = lambda *alts: next((low.index(a) for a in alts if a in low), None)
    run, label, delta, pruned = at("run", "cell", "") or 0, at("labels", "label"), at("delta.next", "delta"), at("pruned.labels", "pruned")
    taken = {run, label, delta, pruned}

    def number(x: str) -> bool:
        try:
            float(x)
            return True
        except ValueError:
            return False

    scored = [i for i, n in enumerate(low) if n.startswith("scores.")] or [i for i in range(len(names)) if i not in taken and i < len(first) and number(first[i])]
    f = F.split("line", "\t")
    get = lambda i: F.trim(F.regexp_replace(F.get(f, F.lit(i)), '"', "")) if i is not None else F.lit(None).cast("string")
    pairs = F.array(*[F.struct(F.lit(re.sub(r"(?i)^scores\.", "", names[i])).alias("k"), get(i).try_cast("double").alias("v")) for i in scored])
    good = F.filter(pairs, lambda p: p["v"].isNotNull())
    body = numbered_lines(spark, path).filter("n > 0").filter((F.trim("line") != "") & (F.size(f) >= len(names)))
    ranked = F.transform(F.array_sort(F.transform(good, lambda p: F.struct((-p["v"]).alias("v"), p["k"].alias("k")))), lambda p: p["k"])
    return body.select(get(run).alias("run"), get(label).alias("label"), get(delta).try_cast("double").alias("delta_next"), get(pruned).alias("pruned_label"), F.map_from_entries(good).alias("scores"), ranked.alias("ranked"))


# ---- profile references


def read_pref(spark: SparkSession, path: str) -> DataFrame:
    """gene, cell_type, median, pct (0 to 1 read as percent) of a sectioned reference; an expression without detection is an error."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    w = Window.partitionBy("file").orderBy("n")
    lines = lines.withColumn("section", F.last(F.when(F.col("line").startswith("##SECTION:"), F.upper(F.trim(F.substring("line", 11, 64)))), ignorenulls=True).over(w))
    data = lines.filter(F.col("section").isin("EXPRESSION", "DETECTION") & ~F.col("line").startswith("##"))
    data = data.withColumn("k", F.row_number().over(Window.partitionBy("file", "section").orderBy("n")))
    f = F.split("line", "\t")
    heads = data.filter("k = 1").select("file", "section", F.posexplode(F.slice(f, 2, 1 << 20)).alias("i", "cell_type"))
    body = data.filter("k > 1").select("file", "section", F.trim(F.get(f, F.lit(0))).alias("gene"), F.posexplode(F.slice(f, 2, 1 << 20)).alias("i", "v"))
    long = body.join(heads, ["file", "section", "i"]).select("section", "gene", F.trim("cell_type").alias("cell_type"), F.trim("v").try_cast("double").alias("v")).filter("v IS NOT NULL")
    e = long.filter("section = 'EXPRESSION'").select("gene", "cell_type", F.col("v").alias("median"))
    p = long.filter("section = 'DETECTION'").select("gene", "cell_type", (F.col("v") * 100).alias("pct"))
    lacking = e.join(p, ["gene", "cell_type"], "left_anti").limit(3).collect()
    if lacking:
        raise ValueError("no detection for " + ", ".join(f"{r.gene}/{r.cell_type}" for r in lacking))
    return e.join(p, ["gene", "cell_type"])


def pref_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    rows = numbered_lines(spark, path).filter(F.col("line").rlike(r"^##[^:]+:") & ~F.col("line").startswith("##SECTION:")).collect()
    return {k.strip(): v.strip() for k, _, v in (r.line[2:].partition(":") for r in rows)}


# ---- sequences


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """accession, entry, description, organism, gene, header, sequence, reviewed: one row per record, files split at '>'."""
    recs = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.col("value"), "^>", "").alias("r")).filter(F.trim("r") != "")
    recs = recs.select(F.regexp_extract("r", r"^([^\r\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\r\n]*\r?\n?(.*)$", 1), r"\s", "").alias("sequence"))
    return recs.select("*", *fasta_header(F.col("header")))


def fasta_header(h: Column) -> list[Column]:
    """Columns of a header by four grammars in order: sp|tr, two fields with a bar, gi, any first word."""
    x = lambda p, i=1: F.when(F.regexp_extract(h, p, i) != "", F.regexp_extract(h, p, i))
    uni, gi, bare = r"^(?:sp|tr)\|([^|\s]+)\|(\S+)", r"^gi\|\d+\|\w+\|([^|\s]+)", r"^([^|\s]+)\|(\S+)"
    acc = F.when(h.rlike(uni), x(uni)).when(h.rlike(gi), x(gi)).when(h.rlike(bare), x(bare)).otherwise(x(r"^(\S+)"))
    entry = F.when(h.rlike(uni), x(uni, 2)).when(h.rlike(gi), None).when(h.rlike(bare), x(bare, 2))
    organism = F.coalesce(x(r"\bOS=(.+?)(?=\s+[A-Z]{2}=|$)"), x(r"\[([^\[\]]+)\]\s*$"))
    return [acc.alias("accession"), entry.alias("entry"), x(r"^\S+\s+(.+?)(?=\s+[A-Z]{2}=|\s*\[|$)").alias("description"), organism.alias("organism"), x(r"\bGN=(\S+)").alias("gene"), h.startswith("sp|").alias("reviewed")]


def sequence_of(fasta: DataFrame, accession: str) -> str | None:
    """The sequence of an accession, or of its base where it is an isoform."""
    base = re.sub(r"-\d+$", "", accession)
    r = fasta.filter(F.col("accession").isin(accession, base)).orderBy(F.col("accession") != accession).select("sequence").first()
    return r.sequence if r else None


def sequences_of(fasta: DataFrame, accessions: DataFrame) -> DataFrame:
    """accession, sequence of each asked accession, or of its base where it is an isoform; null where neither is there."""
    asked = accessions.select("accession").distinct()
    names = asked.select("accession", F.explode(F.array_distinct(F.array("accession", F.regexp_replace("accession", r"-\d+$", "")))).alias("name"))
    hit = names.join(fasta.select(F.col("accession").alias("name"), "sequence"), "name")
    best = hit.groupBy("accession").agg(F.min_by("sequence", F.struct(F.col("name") != F.col("accession"), F.col("sequence"))).alias("sequence"))
    return asked.join(best, "accession", "left")


def accession_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """accession of each line: comments and blanks left out, FASTA headers understood, else the first token."""
    l = F.trim(line)
    t = F.when(l.startswith(">"), F.coalesce(F.nullif(F.regexp_extract(l, r"^>(?:sp|tr)\|([^|\s]+)", 1), F.lit("")), F.regexp_extract(l, r"^>\s*([^\s|]+)", 1))).otherwise(F.regexp_extract(l, r"^([^\s,;]+)", 1))
    return lines.filter((l != "") & ~l.startswith("#")).select(t.alias("accession")).filter("accession <> ''").distinct()


# ---- interaction networks


def read_links(spark: SparkSession, path: str, score: int = 700, prefix: str = "9606.") -> DataFrame:
    """src, dst, score: both directions of links of at least the score, species prefix removed."""
    rows = spark.read.csv(path, sep=" ", header=True, schema="protein1 string, protein2 string, combined_score int").filter(F.col("combined_score") >= score)
    cut = lambda c: F.regexp_replace(c, "^" + re.escape(prefix), "")
    e = rows.select(cut("protein1").alias("src"), cut("protein2").alias("dst"), F.col("combined_score").alias("score"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score")).distinct()


def best_aliases(aliases: DataFrame, priority: dict[str, int]) -> DataFrame:
    """alias, protein: per alias without case the protein of the best source, ties by position. ``aliases``: protein, alias, source, pos."""
    p = F.lit(0)
    for name, value in priority.items():
        p = F.when(F.col("source").contains(name), F.greatest(p, F.lit(value))).otherwise(p)
    a = aliases.withColumn("p", p).filter("p > 0")
    return a.groupBy(F.lower("alias").alias("alias")).agg(F.max_by("protein", F.struct("p", -F.col("pos"))).alias("protein"))


def best_symbols(aliases: DataFrame, priority: dict[str, int]) -> DataFrame:
    """protein, symbol: of the best source, the shorter symbol first."""
    p = F.lit(0)
    for name, value in priority.items():
        p = F.when(F.col("source").contains(name), F.greatest(p, F.lit(value))).otherwise(p)
    a = aliases.withColumn("p", p).filter("p > 0")
    return a.groupBy("protein").agg(F.max_by("alias", F.struct(F.col("p"), -F.length("alias"), -F.col("pos"))).alias("symbol"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """accession, name, gene, organism of protein entries in local JSON lines."""
    schema = "primaryAccession string, uniProtkbId string, organism struct<scientificName:string>, genes array<struct<geneName:struct<value:string>>>, proteinDescription struct<recommendedName:struct<fullName:struct<value:string>>>"
    j = spark.read.schema(schema).json(path)
    return j.select(F.col("primaryAccession").alias("accession"), F.col("uniProtkbId").alias("entry"), F.col("proteinDescription.recommendedName.fullName.value").alias("name"), F.get("genes.geneName.value", F.lit(0)).alias("gene"), F.col("organism.scientificName").alias("organism"))


# ---- isolation runs


def parse_ini(text: str) -> dict[str, str]:
    """section.key to value of an INI text; quotes are removed."""
    out, section = {}, ""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1].strip()
        elif "=" in line and not line.startswith((";", "#")):
            k, _, v = line.partition("=")
            out[f"{section}.{k.strip()}" if section else k.strip()] = v.strip().strip('"')
    return out


def parse_pairs(text: str) -> list[dict[str, str]]:
    """Records of a table whose lines come in pairs: a line of names, then one of values, tab-separated."""
    lines = [x for x in text.splitlines() if x.strip()]
    return [dict(zip([c.strip() for c in a.split("\t")], [c.strip() for c in b.split("\t")])) for a, b in zip(lines[::2], lines[1::2])]


def read_isolation_runs(spark: SparkSession, folder: str) -> DataFrame:
    """file, kind, record (map) of a run folder: *.par settings, isolated*.xls cells, geoprops*.xls detections, *.log lines (Latin-1)."""

    def parse(batches):
        for pdf in batches:
            got = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1].lower()
                if name.endswith(".par"):
                    got.append((path, "settings", parse_ini(content.decode("utf-8", "replace"))))
                elif name.startswith("isolated"):
                    got += [(path, "cell", r) for r in parse_pairs(content.decode("latin-1"))]
                elif name.startswith("geoprops"):
                    lines = [x.split("\t") for x in content.decode("latin-1").splitlines() if x.strip()]
                    got += [(path, "detection", dict(zip(lines[0], x))) for x in lines[1:]] if lines else []
                elif name.endswith(".log"):
                    got += [(path, "log", {"n": str(i), "line": x}) for i, x in enumerate(content.decode("latin-1").splitlines())]
            yield pd.DataFrame(got, columns=["file", "kind", "record"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content").mapInPandas(parse, "file string, kind string, record map<string,string>")


def run_log(records: DataFrame) -> DataFrame:
    """file, name, value of 'name: value' log lines; dates in ISO form."""
    l = F.col("record")["line"]
    kv = records.filter("kind = 'log'").select("file", F.trim(F.regexp_extract(l, r"^([^:\t]+):", 1)).alias("name"), F.trim(F.regexp_extract(l, r"^[^:\t]+:\s*(.*)$", 1)).alias("value")).filter("name <> ''")
    return kv.withColumn("value", iso_or_raw(F.col("value")))

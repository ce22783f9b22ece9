import io
import zipfile

import pytest
from pyspark.sql import functions as F

from protospan.sources import formats as X
from protospan.sources import report as R
from protospan.sources import sinks


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def workbook():
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
    <row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="inlineStr"><is><t>d/c2/r1</t></is></c></row>
    <row><c r="A2" t="inlineStr"><is><t>G1</t></is></c><c r="B2"><v>5</v></c><c r="C2" t="str"><f>1+1</f><v>2.5</v></c></row>
    <row><c r="A3" t="inlineStr"><is><t>G1</t></is></c><c r="C3" t="inlineStr"><is><t>7</t></is></c></row>
    <row><c r="A4" t="inlineStr"><is><t>G2</t></is></c><c r="B4"><v>0</v></c></row></sheetData></worksheet>"""
    shared = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Gene</t></si><si><r><t>d/c1</t></r><r><t>/r1</t></r></si></sst>"""
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    return b.getvalue()


def test_xlsx(spark, tmp_path):
    cells = X.read_xlsx_matrix(spark, put(tmp_path, "m.xlsx", workbook()))
    assert {(r.gene, r["sample"], r.value) for r in cells.collect()} == {("G1", "d/c1/r1", 5.0), ("G1", "d/c2/r1", 2.5), ("G1", "d/c2/r1", 7.0)}
    q = {(r.run, r.condition, r.protein, r.intensity) for r in X.matrix_quant(cells).collect()}
    assert q == {("r1", "c1", "G1", 5.0), ("c2/r1", "c2", "G1", 7.0)}


@pytest.mark.parametrize("head", ["gene\tc1\tc2", '"c1"\t"c2"'])
def test_expression_tsv(spark, tmp_path, head):
    f = put(tmp_path, "e.tsv", head + '\n"g1"\t3\t0\ng2\t1\t4\n')
    assert {tuple(r) for r in X.read_expression_tsv(spark, f).collect()} == {("g1", "c1", 3), ("g2", "c1", 1), ("g2", "c2", 4)}


def test_expression_tsv_of_wrong_width(spark, tmp_path):
    with pytest.raises(ValueError):
        X.read_expression_tsv(spark, put(tmp_path, "w.tsv", "a\tb\nx\t1\t2\t3\t4\n"))


def test_label_tsv(spark, tmp_path):
    f = put(tmp_path, "l.tsv", "scores.A\tscores.B\tlabels\tdelta.next\tpruned.labels\nrun1\t0.2\t0.7\tB\t0.5\tB\nrun2\t0.9\t0.1\tA\tNA\tNA\nshort\t1\n")
    rows = {r.run: r for r in X.read_label_tsv(spark, f).collect()}
    assert set(rows) == {"run1", "run2"} and rows["run1"].ranked == ["B", "A"] and rows["run1"].scores == {"A": 0.2, "B": 0.7}
    assert rows["run2"].label == "A" and rows["run2"].delta_next is None


def test_pref_round_trip(spark, tmp_path):
    prof = spark.createDataFrame([("g1", "A", 2.0, 50.0), ("g1", "B", 1.0, 20.0), ("g2", "B", 3.5, 100.0)], "gene string, cell_type string, median double, pct double")
    stats = spark.createDataFrame([("g1", "A", 1.0, 0.75, 3.25, 0.00012345, 0.5, True)], "protein string, best string, delta double, weighted double, h double, p double, detection double, robust boolean")
    lines = [r.line for r in sinks.reference_lines(prof, {"name": "x", "version": "1"}, stats).orderBy(*sinks.REFERENCE_ORDER).collect()]
    assert lines[:6] == ["##name:x", "##version:1", "##SECTION:EXPRESSION", "Protein\tA\tB", "g1\t2.0000\t1.0000", "g2\t0.0000\t3.5000"]
    assert lines[-3:] == ["##SECTION:MARKER_STATS", "\t".join(sinks.STAT_COLUMNS), "g1\tA\t1.0000\t0.7500\t3.2500\t1.2345E-004\t0.5000\tTRUE"]
    f = put(tmp_path, "r.pref", "\n".join(lines) + "\n")
    got = {tuple(r) for r in X.read_pref(spark, f).select("gene", "cell_type", "median", F.round("pct", 4)).collect()}
    assert got == {("g1", "A", 2.0, 50.0), ("g1", "B", 1.0, 20.0), ("g2", "A", 0.0, 0.0), ("g2", "B", 3.5, 100.0)} and X.pref_metadata(spark, f)["name"] == "x"
    bad = put(tmp_path, "b.pref", "##SECTION:EXPRESSION\nGene\tA\ng1\t2\n##SECTION:DETECTION\nGene\tA\n")
    with pytest.raises(ValueError):
        X.read_pref(spark, bad)


def test_fasta(spark, tmp_path):
    f = put(tmp_path, "f.fasta", ">sp|P1|ALB_HUMAN Albumin OS=Homo sapiens OX=9606 GN=ALB PE=1\nMKW\nVTF\n>Q2|ENT2 some protein\nAAA\n>gi|12|ref|NP_1.1| thing [Mus musculus]\nCCC\n>plain\nGGG\n")
    rows = {r.accession: r for r in X.read_fasta(spark, f).collect()}
    assert rows["P1"].entry == "ALB_HUMAN" and rows["P1"].gene == "ALB" and rows["P1"].organism == "Homo sapiens" and rows["P1"].sequence == "MKWVTF" and rows["P1"].reviewed
    assert rows["Q2"].entry == "ENT2" and rows["NP_1.1"].organism == "Mus musculus" and rows["plain"].sequence == "GGG"
    assert X.sequence_of(X.read_fasta(spark, f), "P1-2") == "MKWVTF" and X.sequence_of(X.read_fasta(spark, f), "none") is None


def test_accession_list(spark):
    df = spark.createDataFrame([(x,) for x in ["# note", "", ">sp|P1|X y", "P2, other", "P3;P4", ">P5 x", None]], "value string")
    assert {r[0] for r in X.accession_list(df).collect()} == {"P1", "P2", "P3", "P5"}


def test_links_and_aliases(spark, tmp_path):
    f = put(tmp_path, "links.txt", "protein1 protein2 combined_score\n9606.A 9606.B 900\n9606.B 9606.A 900\n9606.A 9606.C 300\n")
    assert {tuple(r) for r in X.read_links(spark, f).collect()} == {("A", "B", 900), ("B", "A", 900)}
    al = spark.createDataFrame([("P1", "ABC", "HGNC", 1), ("P2", "abc", "Other", 0), ("P3", "abc", "HGNC", 2), ("P1", "AB", "HGNC", 3)], "protein string, alias string, source string, pos int")
    pr = {"HGNC": 100, "Other": 60}
    assert {r.alias: r.protein for r in X.best_aliases(al, pr).collect()} == {"abc": "P1", "ab": "P1"}
    assert {r.protein: r.symbol for r in X.best_symbols(al, pr).collect()} == {"P1": "AB", "P2": "abc", "P3": "abc"}


def test_isolation_folder(spark, tmp_path):
    d = tmp_path / "run"
    d.mkdir()
    (d / "a.par").write_text('[Gate]\nROI="1,2"\nX=3\n')
    (d / "isolated.xls").write_bytes("Drop\tDiameter\n11\t20,5\nDrop\tDiameter\n12\t21\n".encode("latin-1"))
    (d / "geoprops.xls").write_text("Drop\tX\n11\t5\n")
    (d / "run.log").write_bytes("Date: 3:41 AM - 1/19/2025\nNote \xb5m\n".encode("latin-1"))
    rec = X.read_isolation_runs(spark, str(d))
    by = {}
    for r in rec.collect():
        by.setdefault(r.kind, []).append(r.record)
    assert by["settings"] == [{"Gate.ROI": "1,2", "Gate.X": "3"}] and [x["Drop"] for x in by["cell"]] == ["11", "12"] and by["detection"][0]["X"] == "5"
    assert {r.name: r.value for r in X.run_log(rec).collect()}["Date"] == "2025-01-19T03:41:00"


def test_reports(spark, tmp_path):
    schema = "Run string, `Protein.Group` string, `Precursor.Id` string, `Precursor.Quantity` float"
    spark.createDataFrame([("a", "P", "x", 1.1), (" ", "P", "x", 2.0), ("a", None, "y", None)], schema).write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("b", "P", "x", 3.0)], schema).write.parquet(str(tmp_path / "two"))
    rows = R.load_reports(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert {(r.protein, r.run, r.intensity) for r in R.quant(rows).collect()} == {("P", "a", 1.1), ("P", "b", 3.0)}
    with pytest.raises(R.DuplicateRuns):
        spark.createDataFrame([("a", "P", "x", 1.0)], schema).write.parquet(str(tmp_path / "three"))
        R.load_reports(spark, [str(tmp_path / "one"), str(tmp_path / "three")])
    with pytest.raises(R.MissingColumn):
        R.report_rows(spark.createDataFrame([(1,)], "x int"))


def test_writers(spark, tmp_path):
    long = spark.createDataFrame([("r1", "b", 1.5), ("r1", "A", 2.0), ("r2", "b", 0.0), ("r2", "C", 4.0)], "run string, protein string, value double")
    labels = spark.createDataFrame([("r1", "x"), ("r2", "y")], "run string, label string")
    assert {r.run: r.line for r in sinks.sparse_lines(long, labels).collect()} == {"r1": "1 1:2.0 2:1.5", "r2": "2 3:4.0"}
    sinks.wide_csv(long, "run", "protein", "value", str(tmp_path / "wide"))
    assert spark.read.csv(str(tmp_path / "wide"), header=True).count() == 2
    folder = str(tmp_path / "table")
    for n in (3, 5):
        sinks.replace_folder(spark.range(n), folder)
        assert spark.read.parquet(folder).count() == n
    q = long.select("protein", "run", F.col("value").alias("intensity"))
    sinks.save_import(q, str(tmp_path / "imp"), 7)
    assert spark.read.parquet(str(tmp_path / "imp")).filter("import_id = 7").count() == 3
    sinks.write_lines(spark.range(1), ["b", "a"], str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["b", "a"]


def test_incremental_import(spark, tmp_path):
    from protospan.streaming.imports import watch_reports

    import shutil

    src, table = tmp_path / "in", str(tmp_path / "quant")
    src.mkdir()
    schema = "Run string, `Protein.Group` string, `Precursor.Id` string, `Precursor.Quantity` float"
    for k, run in enumerate(("a", "b")):
        spark.createDataFrame([(run, "P", "x", 1.0 + k)], schema).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        shutil.copy(next((tmp_path / f"w{k}").glob("*.parquet")), src / f"{run}.parquet")
        shutil.copy(src / "a.parquet", src / f"copy{k}.parquet")
        watch_reports(spark, str(src), table, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted((r.run, r.intensity) for r in spark.read.parquet(table).collect()) == [("a", 1.0), ("b", 2.0)]

from protospan.operators import impute
from protospan.operators.impute import Target

SCHEMA = "report_row long, `Run.Index` long, Run string, `Precursor.Id` string, `Protein.Group` string, `PG.MaxLFQ` float, __s string, __z int"


def filled(spark, rows):
    return {r.report_row: r for r in impute.fill(spark.createDataFrame([(*r, "keep", 1) for r in rows], SCHEMA), impute.REPORT_TARGETS).collect()}


def test_levels_and_marks(spark):
    got = filled(spark, [
        (1, 0, "r0", "p1", "A;B", 10.0), (2, 0, None, "p1", "A, B", None), (3, 0, "NA", "p2", "C", -1.0), (4, 1, "r1", "p1", " ", float("nan")), (5, 1, "r1", "p2", "C", 7.0),
        (6, 2, "unknown", "p3", "-", 0.0), (7, 1, "r1", "p2", "C", 9.0), (8, 0, "r0", "p9", "A;B", 20.0), (9, 0, "r0", "p9", "Z", 0.0),
    ])
    assert got[2].Run == "r0" and got[2].Run__filled and got[2]["PG.MaxLFQ__filled"] and got[2]["PG.MaxLFQ__level"] == 1
    assert got[3].Run == "r0" and got[3]["PG.MaxLFQ"] == 7.0 and got[3]["PG.MaxLFQ__level"] == 2
    assert got[4]["Protein.Group"] in ("A;B", "A, B") and got[4]["Protein.Group__filled"] and got[4]["PG.MaxLFQ__filled"]
    assert got[6].Run is None and not got[6].Run__filled and got[6]["Protein.Group"] is None and got[6]["PG.MaxLFQ__level"] is None
    assert not got[9]["PG.MaxLFQ__filled"] and not got[1].Run__filled
    assert all(r["__s"] == "keep" and r["__z"] == 1 for r in got.values()) and len(got) == 9


def test_mode_ties_take_the_smallest_text(spark):
    got = filled(spark, [(1, 0, "b", "p", "G", 1.0), (2, 0, "a", "p", "G", 1.0), (3, 0, None, "p", "G", 1.0)])
    assert got[3].Run == "a"


def test_least_support_backs_off(spark):
    rows = [("g1", "h", 1.0), ("g1", "h", None), ("g2", "h", 5.0), ("g2", "h", 5.0), ("g2", "h", 5.0)]
    df = spark.createDataFrame(rows, "g string, h string, x double")
    got = impute.fill(df, [Target("x", [["g"], ["h"]], kind="number", min_support=2)]).filter("x__filled").collect()
    assert [(r.g, r.x, r.x__level) for r in got] == [("g1", 5.0, 2)]


def test_empty_and_repeated(spark):
    assert impute.fill(spark.createDataFrame([], SCHEMA), impute.REPORT_TARGETS).count() == 0
    twice = [(1, 0, "r", "p", "G", 3.0), (1, 0, "r", "p", "G", 3.0), (2, 0, None, "p", None, None), (2, 0, None, "p", None, None)]
    df = impute.fill(spark.createDataFrame([(*r, "k", 1) for r in twice], SCHEMA), impute.REPORT_TARGETS)
    assert df.count() == 4 and df.filter("`PG.MaxLFQ` = 3 AND Run = 'r'").count() == 4

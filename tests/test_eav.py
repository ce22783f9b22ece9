import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from protospan.operators import eav

NAMES = ["AreaShape_Area", "Texture_Contrast", "Neighbors_Count", "RadialDistribution_FracAtD_1of3"]


def test_spellings(spark):
    met = ["AreaShape_Area", " AreaShape Area ", "areashape.area", "Cells_AreaShape_Area", "Area", "Texture_Contr", "Count", "FracAtD_1of3", "Other", None]
    got = {r.spelling: r.attribute for r in eav.spelling_table(spark.createDataFrame([(m,) for m in met], "feature string"), "feature", NAMES).collect()}
    assert all(got[m] == "AreaShape_Area" for m in met[:5])
    assert got["Texture_Contr"] == "Texture_Contrast" and got["Count"] == "Neighbors_Count" and got["FracAtD_1of3"] == NAMES[3]
    assert got["Other"] == "Other" and None not in got


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from("abcdefghij"), st.one_of(st.none(), st.floats(allow_infinity=False))), max_size=60))
def test_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "e long, a string, v double")
    cells = eav.long_cells(df, "e", "a", "v")
    names = eav.dictionary(df, "a")
    want: dict = {}
    for e, a, v in rows:
        if v is not None and v == v:
            want[str(e), a] = max(v, want.get((str(e), a), v))
    got = {(r.entity, r.attribute): r.value for r in eav.filled_cells(eav.sparse_rows(cells, names, block_width=3), names).collect()}
    assert got == want
    assert sorted(r.idx for r in names.collect()) == list(range(len({a for _, a, _ in rows})))


def test_dense_types_and_masks(spark):
    df = spark.createDataFrame([(1, "x", 2.0, "k"), (1, "y", 0.5, "k"), (2, "y", 7.25, "k"), (3, "x", None, "k")], "entity long, attribute string, value double, idx string")
    names = spark.createDataFrame([("x", 0), ("y", 1)], "attribute string, idx int")
    wide = eav.wide_rows(eav.sparse_rows(eav.long_cells(df, "entity", "attribute", "value"), names), [(0, "x", "bigint"), (1, "y", "double")])
    assert dict(wide.dtypes) == {"entity": "string", "x": "bigint", "y": "double"}
    assert {tuple(r) for r in wide.collect()} == {("1", 2, 0.5), ("2", None, 7.25)}


def test_hot_entity_and_empty(spark):
    df = spark.createDataFrame([(1, f"a{i % 50}", float(i)) for i in range(5000)] + [(2, "a1", 1.0)], "e long, a string, v double")
    names = eav.dictionary(df, "a")
    rows = eav.sparse_rows(eav.long_cells(df, "e", "a", "v"), names).collect()
    assert {r.entity: len(r.idx) for r in rows} == {"1": 50, "2": 1}
    none = df.filter("e < 0")
    assert eav.sparse_rows(eav.long_cells(none, "e", "a", "v"), eav.dictionary(none, "a")).count() == 0


@pytest.mark.parametrize("width", [1, 4])
def test_groups_cross_batches(spark, width):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(e, f"a{i}", 1.0) for e in range(4) for i in range(10)], "e long, a string, v double")
        names = eav.dictionary(df, "a")
        assert eav.filled_cells(eav.sparse_rows(eav.long_cells(df, "e", "a", "v"), names, width), names).count() == 40
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_all_blocks_of_the_run_table(spark, data):
    from protospan.plans.core_problems import p2_runs_wide

    whole = {r.Run: r.asDict() for r in p2_runs_wide(spark, data).collect()}
    got = p2_runs_wide(spark, data, block_width=200)
    assert got.columns == p2_runs_wide(spark, data).columns and len(got.columns) > 401
    assert {r.Run: r.asDict() for r in got.collect()} == whole

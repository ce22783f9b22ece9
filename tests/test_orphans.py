from datetime import datetime

from protospan.operators import orphans as O

T = lambda d: datetime(2026, 1, d)
CHILD = "id long, ref long, loaded_at timestamp_ntz, k string, m string"
PARENT = "key long, loaded_at timestamp_ntz, deleted_at timestamp_ntz, record_id string"


def found(spark, child, parent):
    df = O.orphans(spark.createDataFrame([(*c, "x", "y") for c in child], CHILD), "id", "ref", spark.createDataFrame([(*p, "z") for p in parent], PARENT), "key", "t")
    return {(r.record_id, r.reason) for r in df.collect()}, df


def test_reasons(spark):
    parent = [(1, T(1), None), (2, T(1), T(9)), (3, T(8), None), (3, T(9), None), (4, T(2), None), (None, T(1), None)]
    child = [(10, 1, T(5)), (11, 2, T(5)), (12, 3, T(5)), (13, 99, T(5)), (14, None, T(5)), (15, 4, T(3)), (15, 4, T(1)), (16, 3, T(8)), (None, 99, T(1)), (17, 1, None)]
    got, df = found(spark, child, parent)
    assert got == {(11, "deleted"), (12, "late"), (13, "missing"), (15, "late")}
    assert {(r.month, r.reason, r.orphans) for r in O.report(df).collect()} == {("2026-01", "deleted", 1), ("2026-01", "late", 2), ("2026-01", "missing", 1)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, T(1), None)])[0] == set()
    assert found(spark, [(1, 5, T(1))], [])[0] == {(1, "missing")}


def test_filter_never_denies_a_key_and_is_bounded(spark):
    keys = spark.range(0, 5000).withColumnRenamed("id", "k")
    bits = O.bits_for(5000)
    words = O.bloom_words(keys, "k", bits)
    assert len(words.first().words) == bits // 64
    probe = spark.range(0, 20000).select("id", O.may_contain(words.scalar(), __import__("pyspark").sql.functions.col("id"), bits).alias("m"))
    assert probe.filter("id < 5000 AND NOT m").count() == 0
    assert probe.filter("id >= 5000 AND m").count() < 15000 * 0.05
    assert O.bits_for(10**12) == O.MOST_BITS


def test_hot_parent(spark):
    got, _ = found(spark, [(i, 7, T(1)) for i in range(3000)], [(7, T(2), None)])
    assert len(got) == 3000

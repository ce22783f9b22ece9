"""References to records that are missing, deleted or later than the row that names them.

Keys of usable parents go into a Bloom filter held as 64-bit words: built by one aggregation
(``bit_or`` of bits per word, combined map-side) and read by every task as a constant array. A reference
whose bits are not all set is a definite orphan; only references that pass are verified by an exact join,
which also tells deleted and late parents.

Scale: the filter's size is chosen from the parents' count and never above ``MOST_BITS`` (4 MB, good for some
2.8 million keys); beyond it more references pass to the join, with the same result. Repeated deliveries combine map-side; a hot
parent meets one row per referring id, and AQE splits its partition.

Defined results: a null reference is no case; a record delivered several times counts once, by its first
``loaded_at``; one delivery with ``deleted_at`` makes a record deleted; a parent is late if its first
``loaded_at`` is after the first of the referring id (unknown times are not late); an empty parent table
makes every reference a case; an empty referring table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BITS = 1 << 25
BITS_PER_KEY = 12
HASHES = 4


@dataclass(frozen=True)
class Reference:
    table: str
    record: str
    column: str
    parent: str
    key: str


REFERENCES = [
    Reference("isolated_cells", "cell_id", "raw_file_id", "raw_files", "raw_file_id"),
    Reference("cell_images", "image_id", "cell_id", "isolated_cells", "cell_id"),
    Reference("cellenone_runs", "cellenone_run_id", "plate_id", "plates", "plate_id"),
    Reference("cell_detections", "detection_id", "cellenone_run_id", "cellenone_runs", "cellenone_run_id"),
]


def bits_for(keys: int) -> int:
    """A power of two between 1024 and MOST_BITS."""
    return min(MOST_BITS, max(1024, 1 << (max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) for seed in range(HASHES)]


def bloom_words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row: ``words``, array<bigint> of bits / 64 words in order."""
    place = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    words = place.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("x"))
    none = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
    full = words.unionByName(none).groupBy("w").agg(F.bit_or("x").alias("x"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda p: p["x"]).alias("words"))


def may_contain(words: Column, key: Column, bits: int) -> Column:
    """False only where the key is certainly not in the filter."""
    ok = F.lit(True)  # a subquery may not stand inside a lambda, so the places are spelled out
    for p in _places(key, bits):
        ok = ok & (F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
    return ok


def orphans(child: DataFrame, record: str, column: str, parent: DataFrame, key: str, table: str, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """(table_name, record_id, reference, reason, loaded_at) of orphan references; reason is missing, deleted or late."""
    gone = F.max(F.col(deleted).isNotNull()) if deleted in parent.columns else F.lit(False)
    parents = parent.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("__key")).agg(F.min(loaded).alias("__since"), gone.alias("__gone"))
    rows = child.filter(F.col(record).isNotNull())
    since = rows.groupBy(F.col(record).cast("long").alias("record_id"), F.col(column).cast("long").alias("__ref")).agg(F.min(loaded).alias("__seen"))
    since = since.withColumn("__seen", F.min("__seen").over(Window.partitionBy("record_id")))
    refs = since.filter(F.col("__ref").isNotNull())
    bits = bits_for(parent.select(key).count())
    words = bloom_words(parents, "__key", bits).scalar()
    # the filter stands in one column, so that the plan holds its subquery once; only references that pass it meet the
    # parents, the others keep a key of their own and join nothing
    probed = refs.withColumn("__w", words).withColumn("__maybe", may_contain(F.col("__w"), F.col("__ref"), bits)).drop("__w")
    probed = probed.withColumn("__z", F.when(F.col("__maybe"), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("record_id"), F.lit(1 << 30))))
    verify = probed.join(parents.withColumn("__y", F.lit(0).cast("long")), (F.col("__ref") == F.col("__key")) & (F.col("__z") == F.col("__y")), "left")
    reason = F.when(F.col("__key").isNull(), "missing").when(F.col("__gone"), "deleted").when(F.col("__since") > F.col("__seen"), "late")
    out = verify.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return out.select(F.lit(table).alias("table_name"), "record_id", F.col("__ref").alias("reference"), "reason", F.col("__seen").alias("loaded_at"))


def report(found: DataFrame) -> DataFrame:
    """Counts per table, month of ``loaded_at`` and reason."""
    month = F.date_format("loaded_at", "yyyy-MM")
    return found.groupBy("table_name", month.alias("month"), "reason").agg(F.count_distinct("record_id").alias("orphans"))

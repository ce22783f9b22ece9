"""Entity-attribute-value rows into wide tables.

Rows are reduced to one value per entity and attribute, attributes become column numbers, rows are
partitioned and sorted by entity and streamed through a builder that fills sparse columnar batches
(``idx``/``value`` pairs) or dense typed columns with validity masks.

Scale: the reduction combines map-side, so a hot entity sends at most one row per attribute and map
task. Columns are cut into blocks of ``block_width``, so one output row never exceeds that width and
the driver learns the names of one block only.

Defined results: rows without entity or attribute, or whose value is null or NaN, give no cell; of
several values of one cell the largest is kept; an entity without any value has no row; an empty table
gives an empty result. Columns besides the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protospan.functions.missing import finite, strip

BUCKETS = 256  # of the distributed numbering of attributes


def long_cells(df: DataFrame, entity, attribute, value) -> DataFrame:
    """(entity, attribute, value): one row per cell that holds a value."""
    e, a, v = (F.col(x) if isinstance(x, str) else x for x in (entity, attribute, value))
    rows = df.select(e.cast("string").alias("entity"), a.cast("string").alias("attribute"), v.cast("double").alias("value"))
    rows = rows.filter(F.col("entity").isNotNull() & F.col("attribute").isNotNull() & finite(F.col("value")))
    return rows.groupBy("entity", "attribute").agg(F.max("value").alias("value"))


def dictionary(df: DataFrame, attribute: str) -> DataFrame:
    """(attribute, idx): distinct attributes numbered from 0 without gaps, by hash bucket and name.

    Numbering is distributed: counts per bucket give offsets, a window per bucket gives the rest.
    """
    names = df.select(F.col(attribute).cast("string").alias("attribute")).filter(F.col("attribute").isNotNull()).distinct()
    names = names.withColumn("__b", F.pmod(F.xxhash64("attribute"), F.lit(BUCKETS)))
    counts = names.groupBy("__b").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows at most
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__at"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("attribute"))
    numbered = names.withColumn("__r", rank).join(offsets, "__b")
    return numbered.select("attribute", (F.col("__at") + F.col("__r") - 1).cast("int").alias("idx"))


def spelling_table(df: DataFrame, attribute: str, names: list[str], prefixes: tuple[str, ...] = ("cells",)) -> DataFrame:
    """(spelling, attribute): each spelling met, with the one of ``names`` that it stands for.

    Letters and digits in lower case are compared: equal; equal without an object prefix; the end of
    just one name (its group left out); the start of just one name (cut off). Other spellings stand
    for themselves.
    """
    norm = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    met = df.select(F.col(attribute).cast("string").alias("spelling")).filter(F.col("spelling").isNotNull())
    # read from an aggregate, not from the grouping column: no predicate on what follows moves below the grouping, where it would run once per row
    met = met.groupBy("spelling").agg(F.min("spelling").alias("__s"))
    key = F.regexp_replace(F.lower("__s"), r"[^a-z0-9]", "")
    for p in prefixes:
        key = F.when(key.startswith(p) & ~key.isin([norm(n) for n in names]), F.regexp_replace(key, f"^{p}", "")).otherwise(key)
    met = met.withColumn("key", key)
    # names is a fixed list: one array of structs instead of a join
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(norm(n)).alias("f")) for n in names])
    same = F.filter(pairs, lambda p: p["f"] == F.col("key"))
    end = F.filter(pairs, lambda p: p["f"].endswith(F.col("key")) & (F.length("key") >= 4))
    start = F.filter(pairs, lambda p: p["f"].startswith(F.col("key")) & (F.length("key") >= 8))
    pick = F.when(F.size(same) == 1, same[0]["n"]).when(F.size(end) == 1, end[0]["n"]).when(F.size(start) == 1, start[0]["n"]).otherwise(strip(F.col("__s")))
    return met.select("spelling", F.coalesce(pick, F.lit("")).alias("attribute"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Runs of equal (entity, block) in sorted batches; a run may cross batches."""
    held: tuple[str, int] | None = None
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ent = batch.column(0).to_numpy(zero_copy_only=False)
        blk = batch.column(1).to_numpy(zero_copy_only=False)
        idx = batch.column(2).to_numpy(zero_copy_only=False)
        val = batch.column(3).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((ent[1:] != ent[:-1]) | (blk[1:] != blk[:-1])) + 1
        bounds = np.concatenate([[0], cut, [len(ent)]])
        for a, b in zip(bounds[:-1], bounds[1:]):
            k = (ent[a], int(blk[a]))
            if held is not None and k != held:
                yield held[0], held[1], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                parts = []
            held = k
            parts.append((idx[a:b], val[a:b]))
    if held is not None:
        yield held[0], held[1], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


SPARSE = "entity string, block int, idx array<int>, value array<double>"


def _emit_sparse(rows: list) -> pa.RecordBatch:
    sizes = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32)
    idx = np.concatenate([r[2] for r in rows]).astype(np.int32)
    val = np.concatenate([r[3] for r in rows]).astype(np.float64)
    off = pa.array(sizes, pa.int32())
    arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())]
    arrays += [pa.ListArray.from_arrays(off, pa.array(idx)), pa.ListArray.from_arrays(off, pa.array(val))]
    return pa.RecordBatch.from_arrays(arrays, names=["entity", "block", "idx", "value"])


def sparse_rows(cells: DataFrame, names: DataFrame, block_width: int = 4096, batch_cells: int = 1 << 18) -> DataFrame:
    """One row per entity and block of columns: column numbers and values, in column order.

    ``cells``: as of ``long_cells``; ``names``: as of ``dictionary``.
    """
    coded = cells.join(names, "attribute").select("entity", F.floor(F.col("idx") / block_width).cast("int").alias("block"), "idx", "value")
    coded = coded.repartition("entity", "block").sortWithinPartitions("entity", "block", "idx")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in _groups(batches):
            rows.append(row)
            held += len(row[2])
            if held >= batch_cells:
                yield _emit_sparse(rows)
                rows, held = [], 0
        if rows:
            yield _emit_sparse(rows)

    return coded.mapInArrow(build, SPARSE)


def wide_rows(sparse: DataFrame, columns: list[tuple[int, str, str]], block: int = 0, entity_name: str = "entity", batch_cells: int = 1 << 20) -> DataFrame:
    """Dense typed columns of one block: ``columns`` are (idx, name, 'bigint' or 'double').

    A cell without a value is null by its validity mask. A whole-number column rounds to nearest.
    """
    order = {i: at for at, (i, _, _) in enumerate(columns)}
    top = max(order, default=-1) + 1
    place = np.full(top + 1, -1, np.int64)
    for i, at in order.items():
        place[i] = at
    width = len(columns)
    types = [pa.int64() if t == "bigint" else pa.float64() for _, _, t in columns]
    names = [entity_name, *[n for _, n, _ in columns]]
    schema = T.StructType([T.StructField(entity_name, T.StringType())] + [T.StructField(n, T.LongType() if t == "bigint" else T.DoubleType()) for _, n, t in columns])
    step = max(1, batch_cells // max(1, width))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column(1)
                n = batch.num_rows
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                idx = lists.flatten().to_numpy(zero_copy_only=False)
                val = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), sizes)
                col = place[np.minimum(idx, top)]
                keep = col >= 0
                data, mask = np.zeros((width, n)), np.ones((width, n), bool)
                data[col[keep], row[keep]] = val[keep]
                mask[col[keep], row[keep]] = False
                out = [batch.column(0)]
                for c in range(width):
                    v = np.rint(data[c]).astype(np.int64) if types[c] == pa.int64() else data[c]
                    out.append(pa.array(v, types[c], mask=mask[c]))
                yield pa.RecordBatch.from_arrays(out, names=names)

    picked = sparse.filter(F.col("block") == block).select("entity", "idx", "value")
    return picked.mapInArrow(fill, schema)


def filled_cells(sparse: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, attribute, value) back from sparse rows; the round trip of ``sparse_rows``."""
    pairs = sparse.select("entity", F.explode(F.arrays_zip("idx", "value")).alias("c"))
    return pairs.select("entity", F.col("c.idx").alias("idx"), F.col("c.value").alias("value")).join(names, "idx").select("entity", "attribute", "value")

"""Joins that are more than keys: greedy 1-1, ordinal, containment, graph edges, sparse products."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protospan.functions.lineage import cut_lineage
from protospan.functions.scalars import flat, name_tokens, natural_key
from protospan.operators import blocks as B


def explode_genes(quant: DataFrame, genes: DataFrame, parts: Column) -> DataFrame:
    """``quant`` with gene: the map's symbols, else the group's own members (J8)."""
    j = quant.join(genes, "protein", "left")
    return j.select(*quant.columns, F.explode(F.when(F.col("genes").isNotNull(), parts).otherwise(F.split("protein", ";"))).alias("gene"))


DROP, WELL = 0.9, 0.6


def _alike(left: DataFrame) -> DataFrame:
    """cell_id, file_id of the groups in which every cell has the same files and every file just these cells: the i-th cell gets the i-th file."""
    cells = left.groupBy("cell_id").agg(F.struct(F.bit_xor(F.xxhash64("file_id")).alias("x"), F.count("*").alias("n"), F.min("file_id").alias("f")).alias("g"))
    files = left.join(cells, "cell_id").groupBy("file_id").agg(F.min("g").alias("g"), F.max("g").alias("__o"), F.count("*").alias("met"))
    sizes = cells.groupBy("g").agg(F.count("*").alias("size"))
    files = files.join(sizes, "g").withColumn("own", (F.col("g") == F.col("__o")) & (F.col("met") == F.col("size")))
    whole = files.groupBy("g").agg(F.count_if("own").alias("own")).filter("own = g.n").select("g")  # all files of the cells are their own
    rank = lambda df, c: df.join(whole, "g", "left_semi").select("g", c, F.row_number().over(Window.partitionBy("g").orderBy(c)).alias("place"))
    return rank(cells, "cell_id").join(rank(files.filter("own"), "file_id"), ["g", "place"]).select("cell_id", "file_id")


def _without(left: DataFrame, won: DataFrame) -> DataFrame:
    return left.join(won.select("cell_id"), "cell_id", "left_anti").join(won.select("file_id"), "file_id", "left_anti")


def greedy_pairs(cells: DataFrame, files: DataFrame) -> DataFrame:
    """cell_id, file_id, score within a plate: 0.9 where a token of the name is the cell's drop number, 0.6 where the flat name holds its flat well.

    ``well`` is the well as written; flat texts keep letters and digits alone. Candidates come from equality of (plate,
    token) or of (plate, part of the name), parts being as long as some well is. Greedy one-to-one by score, then ids, until no pair is left: for each
    score, groups of cells and files that are all candidates of each other are paired by rank; of the others every round
    takes the pairs that are the best of both their cell and their file, so the first pair in order goes in each round.
    """
    place = cells.withColumn("well", flat(F.col("well")))
    lengths = place.filter("well <> ''").agg(F.coalesce(F.collect_set(F.length("well")), F.array().cast("array<int>"))).scalar()  # a well has a few characters
    name = flat(F.col("name"))
    sized = files.select("plate_id", "file_id", name.alias("__n"), F.explode(lengths).alias("__k")).filter(F.length("__n") >= F.col("__k"))
    part = F.transform(F.sequence(F.lit(1), F.length("__n") - F.col("__k") + 1), lambda i: F.concat(F.lit("w"), F.substring("__n", i, F.col("__k"))))
    words = F.transform(name_tokens(F.col("name")), lambda x: F.concat(F.lit("d"), x))
    tokens = files.select("plate_id", "file_id", F.explode(F.array_distinct(words)).alias("token")).unionByName(sized.select("plate_id", "file_id", F.explode(F.array_distinct(part)).alias("token")))
    marks = F.array(F.struct(F.concat(F.lit("d"), F.col("drop_no").cast("string")).alias("token"), F.lit(DROP).alias("score")), F.struct(F.concat(F.lit("w"), F.nullif("well", F.lit(""))).alias("token"), F.lit(WELL).alias("score")))
    keys = place.select("plate_id", "cell_id", F.explode(marks).alias("m")).select("plate_id", "cell_id", "m.token", "m.score").filter("token IS NOT NULL")
    every = cut_lineage(keys.join(tokens, ["plate_id", "token"]).groupBy("cell_id", "file_id").agg(F.max("score").alias("score")))
    out = every.limit(0)
    for score in (DROP, WELL):
        left = cut_lineage(_without(every.filter(F.col("score") == score).select("cell_id", "file_id"), out))
        while not left.isEmpty():
            alike = _alike(left)
            best = left.withColumn("__c", F.row_number().over(Window.partitionBy("cell_id").orderBy("file_id"))).withColumn("__f", F.row_number().over(Window.partitionBy("file_id").orderBy("cell_id")))
            won = cut_lineage(alike.unionByName(best.filter("__c = 1 AND __f = 1").select("cell_id", "file_id")).distinct())
            out = cut_lineage(out.unionByName(won.withColumn("score", F.lit(score))))
            left = cut_lineage(_without(left, won))
    return out


def ordinal_pairs(cells: DataFrame, files: DataFrame) -> DataFrame:
    """plate_id, place, cell_id, file_id: i-th cell by drop with i-th file in natural order; the longer side keeps its rest."""
    c = cells.withColumn("place", F.row_number().over(Window.partitionBy("plate_id").orderBy("drop_no", "cell_id"))).select("plate_id", "place", "cell_id")
    f = files.withColumn("place", F.row_number().over(Window.partitionBy("plate_id").orderBy(natural_key(F.col("name")), "file_id"))).select("plate_id", "place", "file_id")
    return c.join(f, ["plate_id", "place"], "full")


def occurrences(sequence: Column, peptide: Column) -> Column:
    """Places from 1 of a peptide in a sequence, overlapping ones too, without case."""
    s, p = F.upper(sequence), F.upper(peptide)
    last = F.length(s) - F.length(p) + 1
    return F.when((F.length(p) > 0) & (last >= 1), F.filter(F.sequence(F.lit(1), last), lambda i: F.substring(s, i, F.length(p)) == p)).otherwise(F.array().cast("array<int>"))


def coverage(hits: DataFrame) -> DataFrame:
    """protein, length, covered, percent of residues under at least one peptide. ``hits``: protein, sequence, peptide."""
    at = hits.select("protein", F.length("sequence").alias("length"), F.length("peptide").alias("k"), F.explode_outer(occurrences(F.col("sequence"), F.col("peptide"))).alias("i"))
    res = at.select("protein", "length", F.explode_outer(F.when(F.col("i").isNotNull(), F.sequence("i", F.col("i") + F.col("k") - 1))).alias("r"))
    return res.groupBy("protein", "length").agg(F.count_distinct("r").alias("covered")).withColumn("percent", F.when(F.col("length") > 0, F.col("covered") * 100.0 / F.col("length")).otherwise(0.0))


def _products(left: DataFrame, right: DataFrame, names: list[str], types: list[str], of: Callable) -> DataFrame:
    """query, run and ``names``: what ``of`` makes of the shared features, the products of their x and the two runs' sizes."""

    def values(q, r):
        s, d = B.products(q.entries["p"], r.entries["p"], len(q.names), len(r.names))
        return s > 0, of(s, d, q.size["p"][:, None], r.size["p"][None])

    return B.paired(B.meetings(left, right, ["p"], []), ["p"], [], values, names, types)


def _rows(x: DataFrame, num: DataFrame, feature: str) -> DataFrame:
    return cut_lineage(B.vectors(x, num, feature, "x").select("run", F.col("i").alias("ip"), F.col("x").alias("xp")))


def partners(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """run, gene, x: how many edges lead from the run's genes to the gene."""
    return genes.select("run", F.col("gene").alias("src")).join(edges, "src").groupBy("run", F.col("dst").alias("gene")).agg(F.count("*").alias("x"))


def edge_pairs(genes: DataFrame, queries: DataFrame, edges: DataFrame) -> DataFrame:
    """query, run, pairs: interacting gene pairs between stated query runs and all other runs (J13), block against block."""
    num = B.numbers(genes, "gene")
    a = partners(genes.join(queries.select("run"), "run", "left_semi"), edges)
    return _products(_rows(a, num, "gene"), _rows(genes.withColumn("x", F.lit(1.0)), num, "gene"), ["pairs"], ["long"], lambda s, d, n, m: (d,))


def _of_queries(x: DataFrame, queries: DataFrame, names: list[str], types: list[str], of: Callable) -> DataFrame:
    rows = _rows(x, B.numbers(x, "protein"), "protein")
    return _products(rows.join(queries.select("run"), "run", "left_semi"), rows, names, types, of)


def sparse_products(x: DataFrame, queries: DataFrame) -> DataFrame:
    """query, run, dot, shared of stated query runs with all others over shared proteins (J9), block against block."""
    return _of_queries(x, queries, ["dot", "shared"], ["double", "long"], lambda s, d, n, m: (d, s))


def shared_jaccard(x: DataFrame, queries: DataFrame) -> DataFrame:
    """query, run, jaccard of the proteins of stated query runs and of all others that share one (SO5), block against block."""
    return _of_queries(x, queries, ["jaccard"], ["double"], lambda s, d, n, m: (s / (n + m - s),))

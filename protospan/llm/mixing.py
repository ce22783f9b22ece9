"""Mixing sources to target shares of tokens.

Texts of a source are put in a pseudorandom order and their tokens packed end to end into blocks of fixed length.
Shares are turned into block draws per source: a source that cannot reach its share even at its cap of repeats gives
all it may, and the others share the rest by their targets. Every output shard has the same number of blocks and gets
multinomial counts of its sources, drawn given the sources' totals, so that shares and caps hold exactly; the slots of
a source run through one pseudorandom permutation of its blocks per repeat, and blocks are joined in by their number.

Scale: tokens are counted and placed by prefix sums over hash buckets of ``bucket`` tokens, so no task sees a whole
source; blocks have at most ``block`` tokens; shards draw their counts in parallel by halving; only one row per listed
source reaches the driver (the table of targets is the bound). The permutation is computed from the slot number, no
order is stored or sorted.

Defined results: spellings of a source are one source; texts of null or unlisted sources are not used; a listed source
without tokens gets none and its share goes to the others; null and empty texts have no tokens; repeated rows count as
delivered; without targets or tokens the mix is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protospan.functions.lineage import cut_lineage
from protospan.llm.tokens import encode
from protospan.llm.truncation import source_key


MOST_EXACT = 1_000_000_000  # slots from which the generator's exact draw is out of range


@dataclass(frozen=True)
class MixConfig:
    block: int = 256  # tokens of a block
    shard: int = 1024  # blocks of an output shard; the final one has fewer
    total: int | None = None  # tokens of the mix; by default those of the listed sources
    seed: int = 17
    bucket: int = 1 << 22  # tokens of a bucket that one task puts in order, about
    path: str | None = None


def token_texts(docs: DataFrame, key: str, text: str, source: str, c: MixConfig) -> DataFrame:
    """src, key, ids of every text with a source."""
    rows = docs.select(source_key(F.col(source)).alias("src"), F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("src").isNotNull())
    coded = encode(rows.select(F.struct("src", "key").alias("k"), "text"), "k", "text", c.path)
    return coded.select("k.src", "k.key", "ids").filter(F.size("ids") > 0)


def pack(texts: DataFrame, c: MixConfig, tokens: dict[str, int]) -> DataFrame:
    """src, block, ids, n: blocks of ``c.block`` tokens, the last of a source shorter. ``tokens``: those of each source, which decide its buckets."""
    t = texts.select("src", "key", "ids", F.size("ids").cast("long").alias("n"), F.xxhash64("src", "key", F.lit(c.seed)).alias("h"), F.xxhash64("ids").alias("h2"))
    buckets = F.lit(1).cast("long")
    for src, n in tokens.items():  # one listed source each
        buckets = F.when(F.col("src") == src, F.lit(max(1, -(-n // c.bucket))).cast("long")).otherwise(buckets)
    t = t.withColumn("b", F.pmod("h", buckets))
    sums = t.groupBy("src", "b").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    sums = sums.select(F.col("src").alias("__s"), F.col("b").alias("__b"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("at"))
    inside = Window.partitionBy("src", "b").orderBy("h", "key", "h2").rowsBetween(Window.unboundedPreceding, -1)
    placed = t.withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, (F.col("src") == F.col("__s")) & (F.col("b") == F.col("__b")))
    placed = placed.select("src", "ids", "n", (F.col("at") + F.col("in")).alias("start"))
    L = c.block
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / L), F.floor((F.col("start") + F.col("n") - 1) / L))))
    lo = F.greatest(F.lit(0), F.col("block") * L - F.col("start"))
    hi = F.least(F.col("n"), (F.col("block") + 1) * L - F.col("start"))
    piece = cut.select("src", "block", F.struct((F.col("start") + lo).alias("p"), F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("x")).alias("q"))
    whole = piece.groupBy("src", "block").agg(F.array_sort(F.collect_list("q")).alias("q"))
    out = whole.select("src", "block", F.flatten(F.transform("q", lambda q: q["x"])).alias("ids"))
    return out.withColumn("n", F.size("ids"))


def allot(targets: list[tuple[str, float, int, int]], total: int) -> dict[str, float]:
    """Tokens per source of (source, share, repeats, tokens): shares of ``total``, cut at repeats x tokens, the rest shared on."""
    out: dict[str, float] = {}
    free = {s: (p, r * n) for s, p, r, n in targets if n > 0 and p > 0 and r > 0}
    left = float(total)
    while free:
        share = sum(p for p, _ in free.values())
        over = {s for s, (p, cap) in free.items() if left * p / share > cap}
        if not over:
            out |= {s: left * p / share for s, (p, _) in free.items()}
            break
        for s in over:
            out[s] = float(free.pop(s)[1])
        left = max(0.0, left - sum(out[s] for s in over))
    return out


def permuted(idx: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index under a keyed permutation of 0..size-1: a Feistel network, walked until it falls inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        h, m, k = half[at], mask[at], key[at]
        a, b = x >> h, x & m
        for r in range(4):
            y = b * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r + 1) * np.uint64(0xBF58476D1CE4E5B9)
            y ^= y >> np.uint64(29)
            y *= np.uint64(0x94D049BB133111EB)
            y ^= y >> np.uint64(32)
            a, b = b, a ^ (y & m)
        return (a << h) | b

    with np.errstate(over="ignore"):
        out = idx.astype(np.uint64)
        at = np.arange(len(out))
        while len(at):
            out[at] = once(out[at], at)
            at = at[out[at] >= size[at].astype(np.uint64)]
    return out.astype(np.int64)


def _plan(spark: SparkSession, docs_per: DataFrame, targets: DataFrame, c: MixConfig) -> list[dict]:
    """One row per listed source: share, repeats, tokens, blocks, draws. Gathers as many rows as there are targets."""
    want = targets.select(source_key(F.col("source")).alias("src"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("repeats"))
    want = want.filter(F.col("src").isNotNull()).groupBy("src").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
    rows = want.join(docs_per, "src", "left").select("src", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("src").collect()
    total = c.total if c.total is not None else sum(r.tokens for r in rows)
    got = allot([(r.src, r.share, r.repeats, r.tokens) for r in rows], total)
    out = []
    for r in rows:
        blocks = -(-r.tokens // c.block)
        mean = r.tokens / blocks if blocks else 0
        draws = min(r.repeats * blocks, round(got.get(r.src, 0.0) / mean)) if blocks else 0
        out.append({"src": r.src, "share": r.share, "repeats": r.repeats, "tokens": r.tokens, "blocks": blocks, "draws": draws, "capped": blocks > 0 and got.get(r.src, 0.0) >= r.repeats * r.tokens})
    return out


def _split(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source fall into ``left`` of all slots: multinomial given the totals (multivariate hypergeometric)."""
    total = int(counts.sum())
    if total < MOST_EXACT:
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    # beyond the generator's range: source by source by the normal law of the same mean and spread, kept feasible
    out, rest, want = np.zeros_like(counts), total, left
    for i, k in enumerate(counts.tolist()):
        rest -= k
        low, high = max(0, want - rest), min(k, want)
        p = want / (rest + k) if rest + k else 0.0
        spread = np.sqrt(max(0.0, k * p * (1 - p) * rest / max(1, rest + k - 1)))
        out[i] = min(high, max(low, round(rng.normal(k * p, spread))))
        want -= int(out[i])
    return out


def shard_counts(first: int, last: int, draws: np.ndarray, size: int, seed: int):
    """(shard, counts, places before it) of shards first to last - 1, of ``size`` slots each (the final one shorter).

    All slots are halved again and again, each half drawing its sources from what the whole has, by a generator of its
    own; any range of shards is reached from the top in so many steps as halvings, so shards are drawn in parallel.
    """
    total = int(draws.sum())
    shards = -(-total // size)

    def walk(lo: int, hi: int, counts: np.ndarray, before: np.ndarray):
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        left = _split(counts, (mid - lo) * size, np.random.default_rng([seed, lo, hi]))
        yield from walk(lo, mid, left, before)
        yield from walk(mid, hi, counts - left, before + left)

    if shards:
        yield from walk(0, shards, draws.astype(np.int64), np.zeros(len(draws), np.int64))


def slots(spark: SparkSession, plan: list[dict], c: MixConfig) -> DataFrame:
    """shard, src, repeat, block: every slot of the mix with the block that fills it."""
    used = [p for p in plan if p["draws"]]
    draws = np.array([p["draws"] for p in used], np.int64)
    n, size, seed = -(-int(draws.sum()) // c.shard), c.shard, c.seed
    names, blocks = [p["src"] for p in used], [p["blocks"] for p in used]

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if len(g):
                for shard, k, before in shard_counts(int(g["id"].iloc[0]), int(g["id"].iloc[-1]) + 1, draws, size, seed):
                    yield pd.DataFrame({"src": names, "blocks": blocks, "shard": shard, "first": before, "count": k})

    per = spark.range(n).mapInPandas(counts, "src string, blocks long, shard long, first long, count long").filter("count > 0")
    one = per.select("src", "blocks", "shard", F.explode(F.expr("sequence(first, first + count - 1)")).alias("k"))
    one = one.withColumn("repeat", F.floor(F.col("k") / F.col("blocks")))

    @F.pandas_udf(T.LongType())
    def place(idx: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(idx.to_numpy(np.int64), size.to_numpy(np.int64), key.to_numpy(np.int64).view(np.uint64)))

    return one.select("shard", "src", "repeat", place(F.pmod("k", "blocks"), F.col("blocks"), F.xxhash64("src", "repeat", F.lit(seed))).alias("block"))


def mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, c: MixConfig | None = None) -> tuple[DataFrame, list[dict]]:
    """(shard, src, repeat, block, n, ids) and the plan."""
    c = c or MixConfig()
    texts = cut_lineage(token_texts(docs, key, text, source, c))  # read for the plan and for the blocks
    plan = _plan(docs.sparkSession, texts.groupBy("src").agg(F.sum(F.size("ids")).alias("tokens")), targets, c)
    wanted = {p["src"]: p["tokens"] for p in plan if p["draws"]}
    blocks = pack(texts.filter(F.col("src").isin(*wanted)), c, wanted)
    at = slots(docs.sparkSession, plan, c)
    return at.join(blocks, ["src", "block"]).select("shard", "src", "repeat", "block", "n", "ids"), plan


def report(mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """One row per listed source: target, tokens there are, tokens used, share reached, most repeats, whether its cap held it back."""
    used = mixed.groupBy("src").agg(F.sum("n").alias("used_tokens"), F.max("repeat").alias("__r"))
    schema = "source string, target_share double, max_repeats int, available_tokens long, capped boolean"
    base = mixed.sparkSession.createDataFrame([(p["src"], p["share"], p["repeats"], p["tokens"], p["capped"]) for p in plan], schema)
    j = base.join(used, F.col("source") == F.col("src"), "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    total = F.sum("used_tokens").over(Window.partitionBy())  # one row per listed source
    return j.select("source", "target_share", "max_repeats", "available_tokens", "used_tokens", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0).alias("actual_share"), F.coalesce(F.col("__r") + 1, F.lit(0)).alias("most_repeats"), "capped")

import collections

import numpy as np
import pytest

from protospan.llm import mixing as M
from protospan.llm.mixing import MixConfig


def test_allot_shares_what_caps_leave():
    got = M.allot([("a", 0.5, 1, 100), ("b", 0.3, 5, 1000), ("c", 0.2, 5, 1000), ("d", 0.1, 3, 0)], 1000)
    assert got["a"] == 100 and "d" not in got
    assert got["b"] == pytest.approx(540) and got["c"] == pytest.approx(360)
    assert M.allot([("a", 1.0, 2, 10)], 1000) == {"a": 20.0}
    assert M.allot([], 10) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096])
def test_permutation_is_one(n):
    p = M.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
    assert sorted(p.tolist()) == list(range(n))
    if n > 16:
        assert p.tolist() != list(range(n))


def test_shards_draw_alike_whole_or_in_part():
    draws, size = np.array([5000, 300, 0, 47]), 64
    whole = list(M.shard_counts(0, 10**6, draws, size, 3))
    assert [s for s, _, _ in whole] == list(range(84)) and all(k.sum() == size for _, k, _ in whole[:-1])
    assert (sum(k for _, k, _ in whole) == draws).all()
    before = np.zeros(4, int)
    for _, k, b in whole:
        assert (b == before).all()
        before = before + k
    part = list(M.shard_counts(30, 41, draws, size, 3))
    assert [s for s, _, _ in part] == list(range(30, 41)) and all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(part, whole[30:41]))
    share = np.array([k[0] / size for _, k, _ in whole[:-1]])
    assert abs(share.mean() - 5000 / 5347) < 0.02 and 0.01 < share.std() < 0.06  # binomial: 0.03
    big = M._split(np.array([3 * 10**9, 10**9]), 2 * 10**9, np.random.default_rng(1))
    assert big.sum() == 2 * 10**9 and abs(big[0] - 1.5 * 10**9) < 10**5


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, block string, n int")


def test_blocks_hold_every_token_once(spark):
    c = MixConfig(block=16, bucket=100)
    d = docs(spark, [(f"document {i} says {'many ' * (i % 30)}words", ["A b", "a_b", "c"][i % 3]) for i in range(90)] + [("", "c"), (None, "c"), ("lost", None)])
    texts = M.token_texts(d, "doc_id", "text", "source", c)
    want = collections.Counter()
    for r in texts.collect():
        want.update((r.src, x) for x in r.ids)
    got, sizes = collections.Counter(), collections.defaultdict(dict)
    for r in M.pack(texts, c, {"a_b": 800, "c": 400}).collect():
        got.update((r.src, x) for x in r.ids)
        sizes[r.src][r.block] = r.n
    assert got == want and set(sizes) == {"a_b", "c"}
    for per in sizes.values():
        assert sorted(per) == list(range(len(per))) and all(n == 16 for b, n in per.items() if b < len(per) - 1)


def test_shares_caps_and_repeats(spark):
    c = MixConfig(block=8, shard=20, bucket=200)
    d = docs(spark, [("one two three four five six seven eight", "big")] * 300 + [("one two three four five six seven eight", "small")] * 10 + [("a b c d e f g h", "tiny")] * 2)
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.1, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed, plan = M.mix(d, "doc_id", "text", "source", t, c)
    mixed = mixed.cache()
    rep = {r.source: r for r in M.report(mixed, plan).collect()}
    assert rep["small"].capped and rep["small"].most_repeats == 4 and rep["tiny"].most_repeats <= 3 and rep["none"].used_tokens == 0
    assert rep["big"].most_repeats == 1 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    assert mixed.groupBy("src", "repeat", "block").count().filter("count > 1").count() == 0
    per = [r["count"] for r in mixed.groupBy("shard").count().orderBy("shard").collect()]
    assert len(per) > 10 and set(per[:-1]) == {20} and per[-1] <= 20
    again, _ = M.mix(d, "doc_id", "text", "source", t, c)
    key = ["shard", "src", "repeat", "block", "n"]
    assert sorted(map(tuple, mixed.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    mixed, plan = M.mix(none, "doc_id", "text", "source", t)
    assert mixed.count() == 0 and plan == [] and M.report(mixed, plan).count() == 0

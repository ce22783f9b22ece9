import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protospan.operators import spikes as S

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("cell_id", T.LongType()), ("cellenone_run_id", T.LongType()), ("drop_no", T.LongType()), ("diameter", T.DoubleType()), ("intensity", T.DoubleType()), ("circularity", T.DoubleType()), ("loaded_at", T.TimestampNTZType()), ("__pos", T.StringType()), ("measure", T.StringType()))])
CFG = S.SpikeConfig(S.CELL_MEASURES)


def series(n=120, seed=1, drift=0.0, sd=1.0):
    rng = np.random.default_rng(seed)
    return 20 + drift * np.arange(n) + np.clip(rng.normal(0, sd, n), -2.5 * sd, 2.5 * sd)


def test_spike_is_found_and_drift_is_not():
    y = series(drift=0.05)
    assert not S.flag_series(y, CFG).any()
    y[40] += 14
    y[90] -= 14
    assert list(np.flatnonzero(S.flag_series(y, CFG) == 1)) == [40, 90]


def test_second_population_is_normal():
    y = series(200)
    y[::5] += 5
    assert not (S.flag_series(y, CFG) == 1).any()


def test_long_still_stretch_is_found_and_few_equal_ones_are_not():
    y = series()
    y[10:13] = y[10]
    y[50:60] = y[50]
    assert list(np.flatnonzero(S.flag_series(y, CFG) == 2)) == list(range(50, 60))


def test_coarse_readings_are_not_stuck():
    assert not S.flag_series(np.round(series(300, sd=0.8)), CFG).any()


def test_esd_decides_and_takes_the_scale_anew(monkeypatch):
    y = series(100, seed=4)
    rest = y - np.median(y)
    rest[[3, 50]] += 40
    rest[70] += 9  # masked by the others until they are gone
    got = S.generalised_esd(rest, CFG.alpha, CFG.most, CFG.tail)
    assert list(np.flatnonzero(got)) == [3, 50, 70]
    m, s = S.usual(np.sort(rest), CFG.tail)
    assert abs(rest[70] - m) / s < S.esd_limit(100, 1, CFG.alpha)  # one scale for all would lose it
    monkeypatch.setattr(S, "esd_limit", lambda n, i, alpha: np.inf)
    assert not S.flag_series(y + rest, CFG).any()  # nothing but the test's limit makes a spike


def test_season_shows_a_spike_that_the_range_hides():
    rng = np.random.default_rng(8)
    at = np.arange(160)
    y = 50 + 12 * ((at % 8) < 3) + np.clip(rng.normal(0, 0.5, 160), -1.2, 1.2)
    y[83] += 12  # a low phase that reads like a high one
    assert list(np.flatnonzero(S.flag_series(y, CFG, at))) == [83]
    assert not S.flag_series(y, S.SpikeConfig(S.CELL_MEASURES, periods=()), at).any()
    keep = np.delete(at, [10, 11, 40])  # gaps do not shift the phase
    assert list(keep[S.flag_series(y[keep], CFG, keep) == 1]) == [83]


def test_spikes_on_both_sides():
    y = series(60, seed=6)
    y[[5, 20, 41]] += 30
    y[[11, 33]] -= 15
    assert list(np.flatnonzero(S.flag_series(y, CFG) == 1)) == [5, 11, 20, 33, 41]


def test_esd_limits_fall_and_are_near_known_values():
    assert S.esd_limit(54, 1, 0.05) == pytest.approx(3.159, abs=0.01)  # Rosner's example of 54 values
    assert S.esd_limit(54, 1, 0.05) > S.esd_limit(54, 10, 0.05)


def rows(y, run=1, first=0):
    return [(first + i, run, i, float(v), 100.0 + (i % 7), 0.9 + 0.001 * (i % 5), None, "x", "y") for i, v in enumerate(y)]


def test_blocks_give_what_one_series_gives(spark):
    y = series(900, seed=3)
    y[[100, 450, 700]] += 20
    y[300:310] = y[300]
    df = spark.createDataFrame(rows(y), SCHEMA)
    small = S.SpikeConfig(S.CELL_MEASURES, block=200, halo=60)
    get = lambda c: {(r.cell_id, r.measure, r.reason) for r in S.implausible(df, "cell_id", "cellenone_run_id", "drop_no", "loaded_at", c).collect()}
    assert get(small) == get(CFG)
    assert {(i, "diameter", "spike") for i in (100, 450, 700)} | {(i, "diameter", "stuck") for i in range(300, 310)} == get(CFG)


def test_edge_cases(spark):
    y = series()
    base = rows(y)
    odd = [(500, 1, 500, float("nan"), 300.0, 1.2, None, "", ""), (501, None, 5, -1.0, None, None, None, None, None), (502, 1, None, float("inf"), 0.0, 0.0, None, None, None), (500, 1, 500, float("nan"), 300.0, 1.2, None, "", ""), (503, 1, 503, None, None, None, None, None, None)]
    got = {(r.cell_id, r.measure) for r in S.implausible(spark.createDataFrame(base + odd, SCHEMA), "cell_id", "cellenone_run_id", "drop_no", "loaded_at", CFG).collect()}
    assert got == {(500, "diameter"), (500, "intensity"), (500, "circularity"), (501, "diameter"), (502, "diameter")}
    assert S.implausible(spark.createDataFrame([], SCHEMA), "cell_id", "cellenone_run_id", "drop_no", "loaded_at", CFG).count() == 0


def test_null_does_not_end_a_stretch(spark):
    y = series()
    y[50:58] = y[50]
    r = rows(y)
    r[53] = r[53][:3] + (None,) + r[53][4:]
    got = S.implausible(spark.createDataFrame(r, SCHEMA), "cell_id", "cellenone_run_id", "drop_no", "loaded_at", CFG).filter(F.col("reason") == "stuck")
    assert {x.cell_id for x in got.collect()} == {50, 51, 52, 54, 55, 56, 57}

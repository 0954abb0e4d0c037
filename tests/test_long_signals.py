"""Long recordings in blocks give what whole arrays give; exact quantiles of groups that no task holds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from biowave.functions import kernels as K
from biowave.operators import long_signals as L
from biowave.operators import order_statistics


@pytest.fixture(scope="module")
def whole():
    rng = np.random.default_rng(8)
    t = np.arange(30_011) / 1000
    return {
        "a": rng.standard_normal(30_011) + 3 * np.sin(2 * np.pi * 60 * t) + 5 + 40 * (t > 11.7), "b": rng.standard_normal(4096), "c": rng.standard_normal(700), "d": np.ones(5),
    }


@pytest.fixture(scope="module")
def pieces(spark, whole):
    rng, rows = np.random.default_rng(9), []
    for rec, x in whole.items():
        cuts = sorted({0, len(x), *rng.integers(0, len(x), 12).tolist()})
        rows += [(rec, a, x[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
    rows.append(("a", 17, []))
    return spark.createDataFrame(rows, "rec string, start bigint, signal array<double>").repartition(5).cache()


def joined(df):
    out = {}
    for r in df.orderBy("rec", "start").collect():
        at = out.setdefault(r["rec"], [])
        assert r["start"] == sum(map(len, at))
        at.append(r["signal"])
    return {k: np.concatenate(v) for k, v in out.items()}


FILTERS = {
    "band": (lambda p, n: L.band_pass(p, 1000.0, 20.0, 450.0, 4, n), lambda x: K.band_pass(x, 1000.0, 20.0, 450.0)),
    "high": (lambda p, n: L.high_pass(p, 1000.0, 5.0, 4, n), lambda x: K.high_pass(x, 1000.0, 5.0)),
    "low": (lambda p, n: L.low_pass(p, 1000.0, 200.0, 4, n), lambda x: K.low_pass(x, 1000.0, 200.0)),
    "notch": (lambda p, n: L.without_tone(p, 1000.0, 60.0, 30.0, n), lambda x: K.without_tone(x, 1000.0, 60.0, 30.0)),
}


@pytest.mark.parametrize(("name", "size"), [("band", 1000), ("high", 8192), ("low", 1000), ("notch", 8192), ("notch", 1000)])
def test_filters_over_seams(pieces, whole, name, size):
    blockwise, at_once = FILTERS[name]
    got = joined(blockwise(pieces, size))
    for rec, x in whole.items():
        want = at_once(x[None])[0]
        assert got[rec].shape == want.shape and np.abs(got[rec] - want).max() < 1e-9 * max(1.0, np.abs(x).max()), rec


@pytest.mark.parametrize(("rate_in", "rate_out"), [(2000, 1000), (1111, 1000), (128, 1000)])
def test_resampling_over_seams(pieces, whole, rate_in, rate_out):
    got = joined(L.resampled(pieces, rate_in, rate_out, 900))
    for rec, x in whole.items():
        want = K.resample(x[None], rate_in, rate_out)[0]
        assert got[rec].shape == want.shape and np.abs(got[rec] - want).max() < 1e-12 * max(1.0, np.abs(x).max()), rec


def test_hampel_windows_over_seams(pieces, whole):
    got = {r["rec"]: r for r in L.hampel_windows(pieces, 200.0, 2.0, 1.0, 1100).collect()}
    for rec, x in whole.items():
        if len(x) < 400:
            assert rec not in got
            continue
        want = K.hampel_energy(np.lib.stride_tricks.sliding_window_view(x, 400)[::200])
        assert got[rec]["n"] == len(want) and np.isclose(got[rec]["largest"], want.max()) and np.isclose(got[rec]["mean"], want.mean())


def test_a_gap_is_an_error(spark):
    df = spark.createDataFrame([("a", 0, [1.0] * 50), ("a", 60, [1.0] * 50)], "rec string, start bigint, signal array<double>")
    with pytest.raises(Exception, match="gap"):
        L.low_pass(df, 1000.0, 100.0).collect()


def test_reach_states_the_error():
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (1, 20_000))
    for b, a in (K.butterworth(4, K.band_edges(1000.0, 20.0, 450.0), "band"), K.notch(60.0, 30.0, 1000.0), K.butterworth(2, K.edge(1000.0, 1.0), "high")):
        for error in (1e-3, 1e-6):
            n = K.reach(b, a, error)
            inside = K.zero_phase(b, a, x[:, 10_000 - n : 10_100 + n])[:, n : n + 100]
            assert np.abs(inside - K.zero_phase(b, a, x)[:, 10_000:10_100]).max() <= error


def test_running_medians():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (3, 2000)).astype(float)
    for half in (0, 1, 40, 300, 1500):
        want = np.array([[np.median(np.pad(v, half, mode="edge")[k : k + 2 * half + 1]) for k in range(0, 2000, 97)] for v in x])
        assert np.array_equal(K.running_median(x, half)[:, ::97], want)


GROUPS = {
    "same": [3.5] * 3000, "two": [1.0] * 2999 + [2.0], "spread": (np.random.default_rng(1).standard_normal(5000) ** 9).tolist(), "one": [-7.0], "pair": [1.0, 2.0],
    "ends": [-math.inf] * 40 + [1.0, 2.0] * 600 + [math.inf] * 30, "tiny": [5e-324 * k for k in range(800)], "wide": [1.7e308, -1.7e308] * 200 + [0.0] * 5 + [float(k) for k in range(900)], "zero": [0.0, -0.0] * 300,
}


@pytest.mark.parametrize(("q", "few"), [(0.0, 10), (0.25, 4096), (0.5, 10), (0.99, 10), (1.0, 4096)])
def test_exact_quantiles(spark, monkeypatch, q, few):
    monkeypatch.setattr(order_statistics, "FEW", few)
    monkeypatch.setattr(order_statistics, "BINS", 16 if few == 10 else 1024)
    rows = [(g, v) for g, values in GROUPS.items() for v in values] + [("two", None), ("none", None), (None, 4.0), (None, 5.0)]
    got = {r["g"]: (r["n"], r["quantile"]) for r in order_statistics.quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), q).collect()}
    assert set(got) == {*GROUPS, None}
    for g, values in (GROUPS | {None: [4.0, 5.0]}).items():
        with np.errstate(all="ignore"):
            v, at = sorted(values), (len(values) - 1) * q
            low = math.floor(at)
            want = v[low] if at == low else v[low] + (v[low + 1] - v[low]) * (at - low)
        assert got[g][0] == len(values) and (got[g][1] == pytest.approx(want, rel=1e-12) or (math.isinf(want) or math.isnan(want))), g


def test_quantile_of_many_samples_in_many_tasks(spark):
    """Three million samples of one group: sums in BINS bins leave the tasks, not values."""
    df = spark.range(0, 3_000_000, 1, 16).select(((F.col("id") * 7919) % 3_000_000 / 7).alias("v"))
    assert order_statistics.quantile(df, [], F.col("v"), 0.99).first()["quantile"] == pytest.approx(np.quantile(np.arange(3_000_000) / 7, 0.99), rel=1e-12)


def test_arrays_are_worked_on_in_lots_of_bounded_size(spark):
    """However many rows a batch has; a function that sees more than a lot is an error."""
    from biowave.functions import spectral

    def of(x):
        assert x.size <= (1 << 19)
        return x * 2

    rows = spark.range(0, 600, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(1000) + F.col("id").cast("int") % 2), lambda v: (v + F.col("id")).cast("double")).alias("x"))
    out = rows.select("id", spectral.mapped(F.col("x"), of).alias("y"), spectral.features(["m"], lambda x: {"m": of(x).max(axis=1)}, F.col("x"))["m"].alias("m")).collect()
    assert len(out) == 600
    for r in out:
        n = 1000 + r["id"] % 2
        assert len(r["y"]) == n and r["y"][0] == 2.0 * (1 + r["id"]) and r["y"][-1] == r["m"] == 2.0 * (n + r["id"])

"""Ranges of recordings: the same numbers as whole files, and no more bytes than they stand in."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from biowave.sources import files, ranged
from tests_support import put_record


@pytest.fixture(scope="module")
def records(tmp_path_factory):
    rng, folder = np.random.default_rng(1), tmp_path_factory.mktemp("ecg")
    return folder, {
        name: put_record(folder, name, rng.integers(-2048, 2048, (n, c)), told=told)
        for name, n, c, told in (("long", 300_001, 2, True), ("odd", 1001, 3, True), ("one", 778, 1, False))
    }


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["ch"], r["start"])):
        at = out.setdefault((r["path"].rsplit("/", 1)[1].split(".")[0], r["ch"]), [])
        assert r["start"] == sum(map(len, at))
        at.append(r["signal"])
    return {k: np.concatenate(v) for k, v in out.items()}


@pytest.mark.parametrize(("stretch", "piece"), [(1 << 24, 1 << 16), (50_000, 999), (100, 7000)])
def test_records_in_stretches(spark, records, stretch, piece):
    folder, want = records
    ranged.register(spark)
    df = spark.read.format("wfdb212").option("stretch", stretch).option("piece", piece).load(str(folder))
    rows = df.collect()
    got = joined(rows)
    assert set(got) == {(name, ch) for name, x in want.items() for ch in range(x.shape[1])}
    assert all(np.array_equal(got[name, ch], want[name][:, ch]) for name, ch in got)
    whole = sum((folder / f"{n}.dat").stat().st_size for n in want)
    pieces = len({(r["path"], r["start"]) for r in rows})
    assert whole - 3 * pieces <= sum(r["bytes"] for r in rows) <= whole + 3 * pieces
    if stretch == 50_000:
        assert df.rdd.getNumPartitions() >= 6


def test_filters_leave_out_bytes(spark, records):
    folder, want = records
    ranged.register(spark)
    df = spark.read.format("wfdb212").option("stretch", 20_000).option("piece", 1000).load(str(folder))
    some = df.where((F.col("start") >= 120_000) & (F.col("start") < 123_000) & (F.col("path") == f"{folder}/long.hea"))
    rows = some.collect()
    assert np.array_equal(joined_from(rows, 0), want["long"][120_000:123_000, 0])
    assert some.rdd.getNumPartitions() == 1 and sum(r["bytes"] for r in rows) == 3000 * 2 * 3 // 2


def joined_from(rows, ch):
    return np.concatenate([r["signal"] for r in sorted((r for r in rows if r["ch"] == ch), key=lambda r: r["start"])])


def test_slices_read_their_bytes_alone(spark, records):
    folder, want = records
    rng = np.random.default_rng(2)
    asked = [("long", int(s), int(n)) for s, n in zip(rng.integers(0, 300_000, 300), rng.integers(1, 500, 300), strict=True)]
    asked += [("odd", s, 5) for s in range(0, 1001, 91)] + [("one", 770, 100), ("one", 778, 5), ("none", 0, 5), (None, 0, 5), ("one", -1, 5), ("odd", 3, 0), ("odd", 3, 2), ("odd", 3, 2)]
    df = spark.createDataFrame(asked, "record string, start bigint, n bigint")
    rows = ranged.read_slices(str(folder), df, near=10_000).collect()
    expected = sorted((r, s, *want[r][s : s + n, 0].tolist()) for r, s, n in asked if r in want and 0 <= s < len(want[r]) and n > 0)
    assert sorted((r["record"], r["start"], *r["signal"]) for r in rows) == expected
    channels = {name: x.shape[1] for name, x in want.items()}
    assert all(r["bytes"] <= (len(r["signal"]) * channels[r["record"]] / 2 + 1) * 3 for r in rows)
    assert sum(r["bytes"] for r in rows if r["record"] == "long") < 0.3 * (folder / "long.dat").stat().st_size
    # the reader for stores that only Spark opens gives the same
    old = files.read_wfdb(spark, str(folder), df.where("record = 'odd' AND n > 0")).collect()
    assert sorted((r["start"], *r["signal"]) for r in old) == sorted((r["start"], *r["signal"]) for r in rows if r["record"] == "odd")


def test_arrays_and_matrices(spark, tmp_path):
    ranged.register(spark)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5003, 3)).astype("<f4")
    (tmp_path / "a").mkdir()
    np.save(tmp_path / "a" / "x.npy", x[:, 0])
    np.save(tmp_path / "a" / "y.npy", (x[:100, 1] * 100).astype(">i2"))
    got = joined(spark.read.format("npy").option("stretch", 1000).option("piece", 300).load(str(tmp_path)).collect())
    assert np.array_equal(got["x", 0], x[:, 0].astype(float)) and np.array_equal(got["y", 0], (x[:100, 1] * 100).astype(">i2").astype(float))
    plain = files.mat_bytes({"stimulus": np.arange(5003)[:, None], "emg": x})
    (tmp_path / "a" / "plain.mat").write_bytes(plain)
    element = files.mat_bytes({"emg": x})[128:]
    (tmp_path / "a" / "tight.mat").write_bytes(plain[:128] + struct.pack("<II", 15, len(zlib.compress(element))) + zlib.compress(element))
    (tmp_path / "a" / "other.mat").write_bytes(files.mat_bytes({"force": x}))
    rows = spark.read.format("mat5").option("stretch", 1000).option("piece", 500).load(str(tmp_path)).collect()
    got = joined(rows)
    assert set(got) == {(n, ch) for n in ("plain", "tight") for ch in range(3)}
    assert all(np.array_equal(got[n, ch], x[:, ch].astype(float)) for n, ch in got)
    assert sum(r["bytes"] for r in rows if "plain" in r["path"]) == x.nbytes


def test_nothing_to_read(spark, tmp_path):
    ranged.register(spark)
    assert spark.read.format("wfdb212").load(str(tmp_path)).collect() == []
    no = spark.createDataFrame([], "record string, start bigint, n bigint")
    assert ranged.read_slices(str(tmp_path), no).collect() == []


def test_a_bad_file_is_a_row_with_an_error(spark, tmp_path):
    x = np.arange(300.0)[:, None]
    (tmp_path / "good.mat").write_bytes(files.mat_bytes({"b": x * 2, "a": x}))
    (tmp_path / "short.mat").write_bytes(files.mat_bytes({"a": x[:10]}))
    whole = files.mat_bytes({"a": x})
    (tmp_path / "bad.mat").write_bytes(whole[:128] + struct.pack("<II", 15, 40) + b"not deflated at all, but forty bytes lon")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_array_mat(spark, str(tmp_path)).collect()}
    assert set(got) == {"good.mat", "bad.mat"} and got["good.mat"]["signal"] == x[:, 0].tolist() and got["good.mat"]["error"] is None
    assert got["bad.mat"]["signal"] is None and got["bad.mat"]["error"]

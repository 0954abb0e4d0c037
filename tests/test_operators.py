import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from biowave.functions import arrays as A
from biowave.functions import kernels as K
from biowave.functions import metrics as M
from biowave.operators import calibrate, denoise, grading, identity, lookups, margins, mixing, noise_library, scoring, sequences, splitting
from biowave.sources import files


def one(df):
    return df.collect()[0]


def track(spark, labels, xs=None):
    rows = [(1, i, float(xs[i]) if xs else 1.0, v, i * 1000) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "rec bigint, i bigint, x double, label int, us bigint")


def test_islands_and_ties(spark):
    got = sorted((r["trial_start"], r["trial_end"], r["gesture"]) for r in sequences.islands(track(spark, [0, 1, 1, 0, 2, 2, 2, 0, 3])).collect())
    assert got == [(1, 2, 1), (4, 6, 2)]
    assert [r["gesture"] for r in sequences.islands(track(spark, [2, 2, 1, 1])).collect()] == [1]
    assert sequences.islands(track(spark, [0, 0])).count() == 0


def test_nearest_tie_is_the_later(spark):
    samples = spark.createDataFrame([(1, 25, 0), (1, 5, 1), (1, 90, 2), (2, 5, 3)], "rec bigint, us bigint, id bigint")
    marks = spark.createDataFrame([(1, 20, 7), (1, 30, 8)], "rec bigint, us bigint, label int")
    assert {r["id"]: r["label"] for r in sequences.align_nearest(samples, marks).collect()} == {0: 8, 1: 7, 2: 8, 3: None}


def test_sliding_skips_differing_ends(spark):
    got = sequences.sliding(track(spark, [1] * 8 + [2] * 8), 8, 4).collect()
    assert sorted((r["start"], r["label"]) for r in got) == [(0, 1), (8, 2)]


@pytest.mark.parametrize("clean, other, snr, prd", [([1.0, -2.0, 3.0], [2.0, -4.0, 6.0], 0.0, 100.0), ([1.0, 2.0], [1.0, 2.0], 100.0, 0.0)])
def test_metrics(spark, clean, other, snr, prd):
    r = one(spark.createDataFrame([(clean, other)], "c array<double>, o array<double>").select(M.snr(F.col("c"), F.col("o")).alias("s"), M.prd(F.col("c"), F.col("o")).alias("p"), M.rmse(F.col("c"), F.col("o")).alias("r")))
    assert r["s"] == pytest.approx(snr, abs=1e-9) and r["p"] == pytest.approx(prd, abs=1e-6)


def test_constant_and_zero_segments(spark):
    df = spark.createDataFrame([([1.0] * 20,), ([0.0] * 20,)], "s array<double>")
    rows = df.select(M.kurtosis(F.col("s")).alias("k"), A.sign_changes(F.col("s")).alias("z"), A.scale(F.col("s"), "Q99").alias("q"), A.scale(F.col("s"), "RMS", "tiny").alias("t")).collect()
    assert [r["k"] for r in rows] == [0, 0] and [r["z"] for r in rows] == [0, 0]
    assert [r["q"] for r in rows] == [1.0, 1.0] and rows[1]["t"] == 1e-12


def test_arrays(spark):
    df = spark.createDataFrame([([3.0, -5.0, 5.0, 1.0, 0.0, -2.0],)], "s array<double>")
    r = one(df.select(A.decimated(F.col("s"), 3).alias("d"), A.of_length(F.col("s"), 8).alias("l"), A.median(F.col("s")).alias("m"), A.moving_average(F.col("s"), 3).alias("a"), A.of_length(F.array().cast("array<double>"), 2).alias("e")))
    assert r["d"] == [-5.0, -2.0] and r["l"] == [3.0, -5.0, 5.0, 1.0, 0.0, -2.0, 3.0, -5.0] and r["m"] == 0.5 and r["e"] == [0.0, 0.0]
    assert np.allclose(r["a"], np.convolve([3, -5, 5, 1, 0, -2], np.ones(3) / 3, "same"))


def test_grade_bounds(spark):
    rows = [(18.0, "20", 20.0, 1.0, 0.01), (10.0, "20", 20.0, 1.0, 0.01), (1.8, "20", 20.0, 1.0, None), (float("nan"), "20", 20.0, 1.0, 0.0), (20.0, "1", 20.0, 1.0, 0.0), (1.0, "20", 20.0, 1.0, 0.0), (20.0, "20", 20.0, 1.0, None), (20.0, "NaN", 20.0, 1.0, 0.0)]
    got = grading.grade(spark.createDataFrame(rows, "snr_db double, smr_db string, shr_db double, ohm double, hamp_er double")).collect()
    assert [r["qc_grade"] for r in got] == ["A_excellent", "B_good", "C_unacceptable", "rejected", "rejected", "rejected", "A_excellent", "rejected"]
    assert [r["reason_flags"] for r in got] == ["OK", "OK", "OK", "nan_metric", "fail_spectral", "fail_snr", "fail_hampel", "nan_metric"]
    assert [r["pass_final"] for r in got] == [True, True, False, False, False, False, False, False]


def test_power_allocation(spark):
    at = lambda w: one(spark.range(1).select(mixing.component_power(F.lit(1.0), F.lit(-15), F.lit(2), F.lit(True), F.lit(w)).alias("p")))["p"]
    assert at(True) == pytest.approx(10**0.5) and at(False) == pytest.approx(10**1.5 - 10**0.5)


def test_mix_has_the_requested_ratio(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.standard_normal(64).tolist(), rng.standard_normal(64).tolist(), s) for s in (-15, 0, 10)]
    df = spark.createDataFrame(rows, "c array<double>, n array<double>, s int")
    target = mixing.component_power(A.power(F.col("c")), F.col("s"), F.lit(1), F.lit(False), F.lit(False))
    for r in df.select("s", M.snr(F.col("c"), mixing.mix(F.col("c"), F.col("n"), target)).alias("got")).collect():
        assert r["got"] == pytest.approx(r["s"], abs=1e-6)
    zero = df.select(mixing.mix(F.col("c"), F.transform("n", lambda v: v * 0), target).alias("m"), "c").collect()
    assert all(r["m"] == r["c"] for r in zero)


def test_margins_pool_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 2, 5.0), ("b", 1, float("nan"))], "g string, k int, value double")
    got = {(r["g"], r["k"]): (r["mean"], r["std"], r["n"]) for r in margins.cube_summary(df, ["g", "k"]).collect()}
    assert got[("Avg", "Avg")] == (3.0, 2.0, 3) and got[("a", "1")] == (1.0, 0.0, 1) and ("b", "1") not in got


def test_split_is_disjoint_and_spread(spark):
    df = spark.createDataFrame([("d1", f"s{k}", k) for k in range(20)] + [("d2", "only", 5), ("t", "x", 1)], "dataset string, subject string, segments bigint")
    got = {r["subject"]: r["split"] for r in splitting.subject_split(df, "t").collect()}
    assert {k for k, v in got.items() if v == "valid"} == {"s0", "s6", "s12", "s19"} and got["only"] == "train" and got["x"] == "test"


def test_scores(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 1, 1)], "subject int, label int, pred int")
    classes = spark.range(3).select(F.col("id").cast("int").alias("class"))
    got = {r["class"]: r for r in scoring.per_class(df, classes).collect()}
    assert (got[0]["tp"], got[0]["fp"], got[0]["fn"], got[0]["tn"]) == (1, 1, 0, 1) and got[2]["recall"] == 0
    assert one(scoring.inter_subject(df))["inter_subject_score"] == pytest.approx(0.25)


def test_names(spark):
    df = spark.createDataFrame([("/a/S12_E3_A1.mat",), ("/b/s7.mat",), ("/c/none.mat",)], "p string")
    got = df.select(identity.subject_of(F.col("p")).alias("s"), identity.exercise_of(F.col("p")).alias("e"), identity.stem(F.col("p")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(12, 3, "S12_E3_A1"), (7, -1, "s7"), (-1, -1, "none")]
    tags = one(spark.createDataFrame([("PLI+WGN",)], "t string").select(identity.has_tag(F.col("t"), "P").alias("p"), identity.has_tag(F.col("t"), "m").alias("m")))
    assert tags["p"] and not tags["m"]


def test_labels_of(spark):
    rows = [("PLI+Color", "/x/Color_pink_1.npy", ["PLI", "Color", "k=2"]), ("Color", "/x/color_a_pink_1.npy|/x/color_b_brown_2.npy", ["Color", "k=1"]), ("", "", []), (None, None, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, p string")
    got = [r[0] for r in df.select(mixing.labels_of(F.col("t"), F.col("p"))).collect()]
    assert got[0] == ["PLI", "Color", "Pink", "k=2"] and got[1] == ["Color", "k=1"] and got[2] == [] and got[3] == []


def test_deltas_and_first(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "m string, v double")
    assert {r["m"]: r["d_v"] for r in lookups.deltas(df, "m", "a", ["v"]).collect()} == {"a": 0.0, "b": 2.0}


def noisy(spark, kinds):
    t = np.arange(2000) / 1000
    clean = np.random.default_rng(0).standard_normal(2000)
    rows = [(k, (clean + 3 * np.sin(2 * np.pi * 60 * t)).tolist(), clean.tolist(), k, "") for k in kinds] + [("none", None, None, "WGN", "")]
    return spark.createDataFrame(rows, "id string, noisy array<double>, clean array<double>, noise_types string, noise_paths string")


def test_iir_chain_takes_the_line_out(spark):
    got = {r["id"]: r for r in denoise.denoise(noisy(spark, ["PLI", "", "ECG", "MOA"]), "hp", 1000.0).collect()}
    err = lambda k: np.mean((np.array(got[k]["denoised"]) - np.array(got[k]["clean"])) ** 2)
    assert err("PLI") < 0.1 and err("") == pytest.approx(4.5, rel=0.01) and got["none"]["denoised"] is None and not got["none"]["ok"]


def test_template_subtraction_takes_beats_out():
    beat = np.zeros(10000)
    for k in range(400, 9800, 800):
        beat[k - 25 : k + 25] += 5 * np.hanning(50)
    small = 0.02 * np.random.default_rng(0).standard_normal(10000)
    out, ok = denoise.template_subtraction(beat + small, 1000.0, denoise.DEFAULTS["ts"] | {"least_gap": 20})
    assert ok and (out[1000:-1000] ** 2).sum() < 0.5 * (beat[1000:-1000] ** 2).sum()
    flat, ok = denoise.template_subtraction(small[:500], 1000.0, denoise.DEFAULTS["ts"])
    assert not ok and (flat == small[:500]).all()


def test_template_query_subtracts(spark):
    from biowave.plans import signal_queries

    rows = signal_queries.denoise_template(spark, "/root/testdata/sf0.001").collect()
    done = [r for r in rows if r["ok"]]
    assert done and any(abs(r["gain"]) > 1e-6 for r in done)


@pytest.mark.parametrize("method", ["emd", "vmd", "ceemdan"])
def test_decomposition_denoisers(method):
    x = np.sin(2 * np.pi * 50 * np.arange(300) / 1000)[None] + 0.1 * np.random.default_rng(0).standard_normal((2, 300))
    for kind in ("WGN", "PLI+MOA", "ECG", "BW", ""):
        y, ok = denoise.run(method, x, 1000.0, kind, "", {method: {"modes": 4} | ({"trials": 2} if method == "ceemdan" else {})})
        assert y.shape == x.shape and np.isfinite(y).all() and ok.all()


def test_chunked_model_keeps_lengths(spark):
    df = spark.createDataFrame([([1.0] * 5000,), ([0.0] * 10,), (None,)], "noisy array<double>")
    got = [r["denoised"] for r in denoise.chunked_model(df, lambda: lambda m: m * 0.5).collect()]
    assert len(got[0]) == 5000 and got[0][0] == pytest.approx(0.5) and got[1] == [0.0] * 10 and got[2] is None


def test_noise_is_the_same_in_any_layout(spark):
    a = noise_library.synthesize(spark, {"PLI": 2, "WGN": 2, "Color": 2}, 1000, 1000.0).collect()
    b = noise_library.synthesize(spark, {"PLI": 2, "WGN": 2, "Color": 2}, 1000, 1000.0).repartition(3).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and len(a) == 6
    rec = spark.createDataFrame([("m", 0, np.random.default_rng(0).standard_normal(4000).tolist()), ("flat", 1, [1.0] * 4000), ("short", 2, [1.0, 2.0])], "source string, idx int, signal array<double>")
    assert [(r["source"], len(r["signal"])) for r in noise_library.from_recordings(rec, "MOA", 2000.0, 1000.0, 500, smooth=51).collect()] == [("m", 500)]


def test_sweep_and_parameters(spark):
    got = calibrate.sweep(noisy(spark, ["MOA"]).where("noisy IS NOT NULL"), "highpass", [5.0, 100.0], 1000.0).collect()
    assert {r["candidate"]: r["best"] for r in got} == {5.0: False, 100.0: True} and all(r["n_ok"] > 0 for r in got)
    assert calibrate.merged_parameters({"vmd": 6})["vmd"]["modes"] == 6


def test_sweep_counts_what_worked_alone(spark):
    t = np.arange(512) / 1000
    clean = np.sin(2 * np.pi * 60 * t) * (1 + np.sin(2 * np.pi * 3 * t))
    noisy_one = clean + np.random.default_rng(1).standard_normal(512) * 0.3
    rows = [(clean.tolist(), noisy_one.tolist(), "WGN", ""), (clean[:20].tolist(), noisy_one[:20].tolist(), "WGN", "")]  # too short to come apart
    df = spark.createDataFrame(rows, "clean array<double>, noisy array<double>, noise_types string, noise_paths string")
    both, one, none = (calibrate.sweep(d, "emd", [5.0, 20.0], 1000.0).orderBy("place").collect() for d in (df, df.where(F.size("clean") > 20), df.where(F.size("clean") == 20)))
    assert [tuple(r) for r in both] == [tuple(r) for r in one] and [r["n_ok"] for r in one] == [1, 1]
    assert [(r["gain"], r["n_ok"]) for r in none] == [(-999.0, 0)] * 2 and [r["best"] for r in none] == [True, False]


def test_classifier_learns_a_ring(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 2)) * 1.5
    rows = [(k, k % 3, int((v @ v) > 2), [float(a) for a in v]) for k, v in enumerate(x)]
    df = splitting.stratified_folds(spark.createDataFrame(rows, "id bigint, subject int, label int, features array<double>"), "id", "label", 3)
    p = calibrate.cross_validated(df, 3, gamma=0.5)
    assert p.count() == 300 and p.where("label = pred").count() > 270


def mat_bytes(arrays, packed):
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    out = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, a in arrays.items():
        code = {"float64": 9, "int32": 5, "uint8": 2}[str(a.dtype)]
        body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode()) + element(code, a.tobytes(order="F"))
        m = struct.pack("<II", 14, len(body)) + body
        if packed:
            z = zlib.compress(m)
            m = struct.pack("<II", 15, len(z)) + z
        out += m
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_mat_reader(spark, tmp_path, packed):
    emg = np.arange(40.0).reshape(4, 10)
    (tmp_path / "S1_E1.mat").write_bytes(mat_bytes({"emg": emg, "restimulus": np.arange(9, dtype=np.int32)[:, None], "x": np.zeros((1, 1), np.uint8)}, packed))
    (tmp_path / "broken.mat").write_bytes(b"no")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_mat(spark, str(tmp_path)).collect()}
    r = got["S1_E1.mat"]
    assert (r["n"], r["n_ch"]) == (10, 4) and r["emg"][1] == emg[1].tolist() and r["restimulus"][-1] == 8 and len(r["restimulus"]) == 10 and r["stimulus"] is None
    assert got["broken.mat"]["error"]


def test_npy_wfdb_and_csv(spark, tmp_path):
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    np.save(tmp_path / "a.npy", x)
    assert one(files.read_npy(spark, str(tmp_path)))["signal"] == x.reshape(-1).tolist()
    buf = io.BytesIO()
    np.save(buf, np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        files.parse_npy(buf.getvalue())
    v = np.array([100, -3, 2047, -2048, 5, 6])
    u = v & 0xFFF
    raw = b"".join(bytes([a & 255, (a >> 8) | ((b >> 8) << 4), b & 255]) for a, b in zip(u[::2].tolist(), u[1::2].tolist(), strict=True))
    (tmp_path / "16265.hea").write_text("16265 2 128 3\n16265.dat 212 200 12 0 0 0 0 ECG1\n16265.dat 212 200 12 0 0 0 0 ECG2\n")
    (tmp_path / "16265.dat").write_bytes(raw)
    got = one(files.read_wfdb(spark, str(tmp_path), spark.createDataFrame([("16265", 1, 2)], "record string, start bigint, n bigint")))
    assert got["signal"] == [2047 / 200, 5 / 200]
    many = spark.createDataFrame([("16265", k % 3, 1) for k in range(6)] + [("none", 0, 1)], "record string, start bigint, n bigint")
    rows = files.read_wfdb(spark, str(tmp_path), many, together=2).collect()
    assert sorted((r["start"], *r["signal"]) for r in rows) == sorted((k, v / 200) for k, v in enumerate([100, 2047, 5]) for _ in range(2))
    (tmp_path / "e.csv").write_text("t,a,b\n0,1.5,x\n1,2.5,3\n")
    assert [tuple(r) for r in files.read_positional_csv(spark, str(tmp_path / "e.csv"), {1: "u", 2: "v"}).collect()] == [(1.5, None), (2.5, 3.0)]
    assert files.latest(spark, str(tmp_path), "*.csv").endswith("e.csv")


def test_tables_are_written_once(spark, tmp_path):
    df = spark.range(3)
    files.write_table(df, str(tmp_path / "t"))
    files.write_table(spark.range(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    files.write_table(spark.range(5), str(tmp_path / "t"), force=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5 and "Title" in files.report(df, "Title")
    assert files.settings('{"a": {"b": 2}}', {"a": {"b": 1, "c": 3}}) == {"a": {"b": 2, "c": 3}}


@pytest.mark.parametrize("method", ["emd", "vmd", "ceemdan"])
def test_what_does_not_come_apart_is_said_so(method):
    t = np.arange(256) / 1000
    for x in (np.ones(1), np.ones(10), np.sin(t[:63]), np.r_[np.nan, np.sin(t)]):
        y, ok = denoise.run(method, x[None], 1000.0, "WGN", "")
        assert not ok[0] and np.array_equal(y[0], x, equal_nan=True)
    short = np.sin(2 * np.pi * 60 * t[:40])[None]
    y, ok = denoise.run(method, short, 1000.0, "PLI", "", {method: {"fallback": "hp"}})
    assert not ok[0] and not np.array_equal(y, short)  # filtered instead
    y, ok = denoise.run(method, np.zeros((1, 256)), 1000.0, "Color", "")
    assert np.isfinite(y).all()


def test_colour_is_filtered_before_it_comes_apart():
    t = np.arange(1000) / 1000
    slow = np.sin(2 * np.pi * 3 * t)[None]
    y, ok = denoise.run("emd", slow, 1000.0, "Color", "")
    assert ok[0] and (y**2).sum() < 0.05 * (slow**2).sum()


def test_modes_of_vmd_keep_their_drift_under_beats():
    t = np.arange(512) / 1000
    x = (np.sin(2 * np.pi * 4 * t) + 0.5 * np.sin(2 * np.pi * 90 * t))[None]
    kept, gone = (denoise.run("vmd", x, 1000.0, kinds, "", {"vmd": {"modes": 4}})[0] for kinds in ("ECG+BW", "BW"))
    assert (kept**2).sum() > 1.5 * (gone**2).sum()


def test_pairs_leave_nulls_alone(spark):
    rows = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 1), (None, None)], "a int, b int")
    assert lookups.without_pairs(rows, [(1, 1)], "a", "b").count() == 4


def test_folds_are_dealt_evenly_and_keep_every_row(spark):
    rows = spark.createDataFrame([(k, None if k % 50 == 0 else k % 7 // 3) for k in range(1000)], "id bigint, label int")
    got = splitting.stratified_folds(rows, "id", "label", 3)
    assert got.columns == ["id", "label", "fold"] and got.count() == 1000
    for r in got.groupBy("label").pivot("fold", [0, 1, 2]).count().collect():
        assert max(r[1:]) - min(r[1:]) <= 1


def test_numbers_by_appearance_have_no_gaps(spark):
    rows = spark.createDataFrame([(f"k{k * 7 % 900}", k) for k in range(2000)], "key string, at bigint")
    got = {r["key"]: (r["first"], r["index"]) for r in sequences.numbered_by_appearance(rows, "key", "at").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1][0])] == [k for k, _ in sorted(got.items(), key=lambda x: x[1][1])]
    assert sorted(i for _, i in got.values()) == list(range(900))
    assert sequences.numbered_by_appearance(rows.limit(0), "key", "at").count() == 0


def test_a_sweep_tries_every_candidate_once(spark):
    rows = noisy(spark, ["MOA"]).where("noisy IS NOT NULL")
    both = {r["candidate"]: r["gain"] for r in calibrate.sweep(rows, "highpass", [5.0, 100.0], 1000.0).collect()}
    for value, gain in both.items():
        alone = calibrate.sweep(rows, "highpass", [value], 1000.0).first()
        assert alone["gain"] == pytest.approx(gain) and alone["best"]
    assert [r["gain"] for r in calibrate.sweep(rows.limit(0), "highpass", [5.0], 1000.0).collect()] == [-999.0]


def test_manifest_conditions_results_and_yaml(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name,extra,n\na,x,1\nb,y,no\n")
    got = files.read_manifest(spark, str(tmp_path / "m.csv"), "n int, name string, missing double").collect()
    assert [tuple(r) for r in got] == [(1, "a", None), (None, "b", None)]
    df = spark.createDataFrame([(1, -5, 1, [1.0, 2.0], 1 / 3), (2, 0, 2, [3.0, 4.0], 2.0)], "seg bigint, snr int, k int, noisy array<double>, v double")
    files.write_conditions(df, str(tmp_path / "c"))
    assert (tmp_path / "c" / "samples" / "snr=-5" / "k=1").is_dir() and spark.read.parquet(str(tmp_path / "c" / "samples")).count() == 2
    assert spark.read.option("header", "true").csv(str(tmp_path / "c" / "metadata")).columns == ["seg", "snr", "k", "v"]
    files.write_results(df.drop("noisy"), str(tmp_path / "r"), ["snr"])
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).where("snr = -5").first()["v"] == "0.3333333333"
    assert files.settings("a:\n  b: 2\n", {"a": {"b": 1, "c": 3}}) == {"a": {"b": 2, "c": 3}} and files.settings("", {"a": 1}) == {"a": 1}


def test_mat_files_keep_their_matrices(spark, tmp_path):
    arrays = {"emg": np.arange(12.0).reshape(6, 2), "stimulus": np.arange(6, dtype=np.int16)[:, None], "u": np.array([[1, 2]], np.uint8)}
    (tmp_path / "a.mat").write_bytes(files.mat_bytes(arrays))
    assert all(np.array_equal(v, arrays[k]) for k, v in files.parse_mat(files.mat_bytes(arrays)).items())
    r = one(files.read_mat(spark, str(tmp_path)))
    assert r["emg"] == arrays["emg"].T.tolist() and r["stimulus"] == list(range(6)) and r["error"] is None
    denoised = spark.createDataFrame([(r["path"], [[0.5] * 3, [1.5] * 3])], "path string, signals array<array<double>>")
    files.write_mat(spark, str(tmp_path), denoised, 1000.0, str(tmp_path / "out"))
    again = files.parse_mat(bytes(spark.read.parquet(str(tmp_path / "out")).first()["content"]))
    assert set(again) == {*arrays, "preprocessed_emg", "fs_preprocessed"} and again["preprocessed_emg"].shape == (3, 2) and again["fs_preprocessed"] == 1000


def test_mixed_samples_of_odd_segments_and_items(spark):
    from biowave.operators import samples

    rng = np.random.default_rng(3)
    items = [(t, 0, f"{t}/0", rng.standard_normal(n).tolist()) for t, n in (("PLI", 3), ("WGN", 8), ("ECG", 9), ("MOA", 100), ("Color", 17))]
    library = spark.createDataFrame([*items, ("PLI", 1, "PLI/1", [1.0, -1.0]), ("other", 0, "o", [1.0])], "noise_type string, idx int, path string, signal array<double>")
    clean = {1: rng.standard_normal(8), 2: np.zeros(8), 3: rng.standard_normal(8)}
    segments = spark.createDataFrame([(k, v.tolist()) for k, v in clean.items()], "seg bigint, clean array<double>")
    got = samples.mixed_samples(segments, samples.grid_jobs(segments, (-15, 0), 5, for_all_k=True), library, 8).collect()
    assert len(got) == 3 * 2 * 5
    by_path = {p: np.array(v) for _, _, p, v in items} | {"PLI/1": np.array([1.0, -1.0])}
    for r in got:
        kinds, noise = r["noise_types"].split("+"), np.array(r["noisy"]) - clean[r["seg"]]
        assert len(set(kinds)) == len(kinds) == min(r["k"], 4 if r["snr"] == -15 else 5) and not (r["snr"] == -15 and "WGN" in kinds)
        if r["seg"] == 2:
            assert r["noise_paths"] == "" and not any(r["scalars"]) and not noise.any() and not r["wgn_capped"]
            continue
        if r["k"] == 1:  # a window of the item, scaled to the SNR
            item = by_path[r["noise_paths"]]
            fits = [np.resize(np.roll(item, -s), 8) for s in range(len(item))]
            assert any(np.allclose(noise, f * r["scalars"][0]) for f in fits)
            assert np.isclose(10 * np.log10((clean[r["seg"]] ** 2).sum() / (noise**2).sum()), r["snr"])
    assert samples.mixed_samples(segments.limit(0), samples.grid_jobs(segments), library, 8).count() == 0


def test_raw_gesture_chain_is_the_composition(spark):
    from biowave.operators import gesture

    x = np.random.default_rng(5).standard_normal((2, 300))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "s array<double>").select(gesture.from_raw(F.col("s"), 200, 100, 8.0, 40.0).alias("x"))
    got = df.select("x", gesture.sampled(F.col("x"), 10).alias("y")).collect()
    y = K.resample(K.band_pass(x, 200, 8.0, 40.0), 200, 100)
    for r, v in zip(got, y, strict=True):
        want = (v - v.min()) / (v.max() - v.min())
        assert np.allclose(r["x"], want) and np.allclose(r["y"], want[: len(want) // 10 * 10].reshape(-1, 10).max(axis=1))


def test_label_files_by_whole_numbers(spark):
    from biowave.operators import identity

    names = ["trial_1_v20.csv", "trial_1_v3.csv", "trial_11.csv", "t1b1.csv", "none.csv", None]
    files_ = spark.createDataFrame([(7, n) for n in names], "subject int, name string")
    got = identity.label_files(files_, spark.createDataFrame([(7, 1), (7, 11), (7, 2), (8, 1)], "subject int, trial int")).collect()
    assert {(r["trial"], r["name"]) for r in got} == {(1, "t1b1.csv"), (11, "trial_11.csv")}


def test_short_signals_are_not_filtered():
    x = np.random.default_rng(0).standard_normal((2, 40))
    for method, types in (("hp", "PLI+ECG"), ("highpass", "MOA")):
        assert np.array_equal(denoise.run(method, x[:, :27], 1000.0, types, "")[0], x[:, :27])
        assert not np.array_equal(denoise.run(method, x[:, :28], 1000.0, types, "")[0], x[:, :28])


def test_reports_of_quality_and_split(spark):
    rows = [(20.0, 20.0, 20.0, 1.0, 0.01), (12.0, 20.0, 20.0, 1.0, 0.5), (1.0, 20.0, 20.0, 1.0, 0.0), (30.0, 1.0, 20.0, 1.0, 0.0), (None, 1.0, 1.0, 1.0, 0.0)]
    graded = grading.grade(spark.createDataFrame(rows, "snr_db double, smr_db double, shr_db double, ohm double, hamp_er double"))
    text = grading.quality_report(graded, "db1")
    assert "db1" in text and "1 (20.00 %)" in text
    assert [int(line.split()[-1]) for line in text.splitlines() if line.startswith("stage")] == [1, 1, 1, 1]
    subjects = spark.createDataFrame([("a", f"a{k}", k + 1) for k in range(10)] + [("b", "b0", 5), ("t", "t0", 7)], "dataset string, subject string, segments int")
    text = splitting.split_report(splitting.subject_split(subjects, "t"), "t")
    assert "a: subjects 10, segments 55" in text and "b: subjects 1, none validates" in text and "test: subjects 1, segments 7" in text
    train, valid = (int(next(x for x in text.splitlines() if x.startswith(s)).split()[2].rstrip(",")) for s in ("train", "valid"))
    assert (train, valid) == (9, 2)


def test_a_sweep_decomposes_a_signal_once_for_all_candidates(monkeypatch):
    seen = []
    monkeypatch.setattr(denoise.K, "emds", lambda x, most, of=denoise.K.emds: seen.append(len(x)) or of(x, most))
    x = np.random.default_rng(5).standard_normal((3, 100))
    modes = denoise.Modes("emd")
    got = [denoise.run("emd", x, 128.0, "WGN", "", {"emd": {"f_min": f}}, modes) for f in (5.0, 10.0, 20.0)]
    assert seen == [3] and all(ok.all() for _, ok in got)
    alone = [denoise.run("emd", row[None], 128.0, "WGN", "", {"emd": {"f_min": 10.0}})[0][0] for row in x]
    assert np.allclose(got[1][0], alone)


def test_subjects_are_split_by_arithmetic_in_ranges(spark):
    """Places of validating subjects as listed by the definition; no expression holds a list of them, and no dataset is one task."""
    sizes = {"a": 1, "b": 2, "c": 3, "d": 7, "e": 11, "f": 53, "g": 1009, "t": 20}
    rows = [(d, f"{d}_{k}", (k * 7919) % 997 if k % 13 else 5) for d, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "dataset string, subject string, segments bigint")
    want = {}
    for d, n in sizes.items():
        v = min(max(round((1.0 - 0.8) * n), 2), n - 1)
        step = (n - 1) / max(v - 1, 1)
        places = {int(np.floor(k * step)) for k in range(max(v, 1))} if n > 1 else set()
        for rank, (_, subject, _) in enumerate(sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1]))):
            want[subject] = "test" if d == "t" else "valid" if rank in places else "train"
    out = splitting.subject_split(df, "t")
    assert {r["subject"]: r["split"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array_contains" not in plan and "partitionBy(dataset)" not in plan
    assert "transform(" not in plan.replace("Transform(", "")

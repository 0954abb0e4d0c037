"""Readers of recordings' file formats and writers of result tables: Spark lists and reads the files, a parser takes the bytes."""

from __future__ import annotations

import ast
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDING = "path string, n bigint, n_ch int, emg array<array<double>>, stimulus array<int>, restimulus array<int>, repetition array<int>, error string"


def parse_npy(data: bytes) -> np.ndarray:
    """A NumPy array file; arrays of objects are refused."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not a NumPy file")
    size, start = struct.unpack("<H", data[8:10])[0] if data[6] == 1 else struct.unpack("<I", data[8:12])[0], 10 if data[6] == 1 else 12
    head = ast.literal_eval(data[start : start + size].decode("latin1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject:
        raise ValueError("arrays of objects are not read")
    return np.frombuffer(data, kind, offset=start + size).reshape(head["shape"], order="F" if head["fortran_order"] else "C")


#: Fixed values of the MAT-file level 5 format: numeric data types by number.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack(order + "II", data[at : at + 8])
        if kind >> 16:  # small element: its data stands in the tag
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == 15 else -size % 8)


def parse_mat(data: bytes) -> dict[str, np.ndarray]:
    """The real numeric matrices of a level 5 MAT-file, by name."""
    order = "<" if data[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(data[128:], order):
        if kind == 15:
            body = zlib.decompress(body)
            kind, body = next(_elements(body, order))
        if kind != 14:
            continue
        parts = list(_elements(body, order))
        if len(parts) < 4 or parts[3][0] not in MAT_TYPES:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        out[parts[2][1].decode("latin1")] = np.frombuffer(parts[3][1], order + MAT_TYPES[parts[3][0]]).reshape(shape, order="F")
    return out


def _first(arrays: dict, names: list[str]):
    return next((arrays[n] for n in names if n in arrays), None)


def _aligned(track, n: int, how: str):
    """A label track of n samples: one too few or many is repaired, with how='pad' any difference, else it's an error."""
    if track is None:
        return None
    v = np.asarray(track).reshape(-1).astype(np.int32)
    if how != "pad" and abs(len(v) - n) > 1:
        raise ValueError(f"a track has {len(v)} labels for {n} samples")
    return np.pad(v, (0, max(0, n - len(v))), mode="edge")[:n] if len(v) else np.zeros(n, np.int32)


def recording(arrays: dict[str, np.ndarray], field: str | None = None, regrasp_first: bool = False, align: str = "strict") -> dict:
    """Signals, channel by channel, and label tracks from candidate names."""
    emg = _first(arrays, [*([field] if field else []), "emg", "EMG", "emg_signals"])
    if emg is None or emg.ndim != 2:
        raise ValueError("no matrix of signals")
    emg = emg.T if emg.shape[0] < emg.shape[1] else emg
    rest = ["regrasp", "restimulus", "restim", "restStimulus"] if regrasp_first else ["restimulus", "restStimulus", "restim"]
    tracks = {"stimulus": ["stimulus", "Stimulus"], "restimulus": rest, "repetition": ["repetition", "Repetition"]}
    n = emg.shape[0]
    return {"n": n, "n_ch": emg.shape[1], "emg": list(emg.T.astype(float))} | {k: _aligned(_first(arrays, v), n, align) for k, v in tracks.items()}


def _parsed(spark: SparkSession, path: str, pattern: str, schema: str, of) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, data in zip(part["path"], part["content"], strict=True):
                rows += of(file, data)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInPandas(batch, schema)


def read_mat(spark: SparkSession, path: str, field: str | None = None, regrasp_first: bool = False, align: str = "strict") -> DataFrame:
    """Recordings of the MAT-files below path; a file that can't be read is a row with an error."""

    def of(file: str, data: bytes) -> list[tuple]:
        try:
            r = recording(parse_mat(data), field, regrasp_first, align)
            return [(file, r["n"], r["n_ch"], r["emg"], r["stimulus"], r["restimulus"], r["repetition"], None)]
        except Exception as e:
            return [(file, None, None, None, None, None, None, str(e)[:200])]

    return _parsed(spark, path, "*.mat", RECORDING, of)


def read_array_mat(spark: SparkSession, path: str, first: tuple[str, ...] = ("a",), least: int = 256) -> DataFrame:
    """(path, signal, error): of each MAT-file the array with a wanted name, else its first; those with under `least` numbers give no
    row, and one that can't be read is a row with an error."""

    def of(file: str, data: bytes) -> list[tuple]:
        try:
            arrays = parse_mat(data)
        except Exception as e:
            return [(file, None, str(e)[:200])]
        found = _first(arrays, list(first))
        found = next(iter(arrays.values()), np.zeros(0)) if found is None else found
        return [(file, found.reshape(-1, order="F").astype(float), None)] if found.size >= least else []

    return _parsed(spark, path, "*.mat", "path string, signal array<double>, error string", of)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, signal): every array below path, flattened."""
    return _parsed(spark, path, "*.npy", "path string, signal array<double>", lambda f, d: [(f, parse_npy(d).reshape(-1).astype(float))])


def parse_212(data: bytes, channels: int, first: int, n: int) -> np.ndarray:
    """n samples a channel, from the first, of 12-bit pairs in three bytes."""
    start = first * channels
    raw = np.frombuffer(data, np.uint8)
    k = np.arange(start, start + n * channels)
    k = k[(k // 2) * 3 + 2 < len(raw)] if len(k) else k
    base, odd = (k // 2) * 3, k % 2
    v = np.where(odd == 0, raw[base] | (raw[base + 1] & 0x0F).astype(np.int64) << 8, raw[base + 2] | (raw[base + 1] & 0xF0).astype(np.int64) << 4)
    v = np.where(v > 2047, v - 4096, v)
    return v[: len(v) // channels * channels].reshape(-1, channels)


def read_wfdb(spark: SparkSession, path: str, slices: DataFrame, together: int = 256) -> DataFrame:
    """(record, start, signal) of slices (record, start, n): the first channel of format-212 records, in physical units.

    A record's slices are taken together, up to about `together` in a row, so that its bytes are moved and read once for them all.
    Slices of records that are not there give no row.
    """

    def of(pattern: str, name: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{pattern}").load(path)
        return found.select(F.regexp_extract("path", rf"([^/]+)\.{pattern}$", 1).alias("record"), F.col("content").alias(name))

    sizes = slices.groupBy("record").agg(F.ceil(F.count(F.lit(1)) / together).alias("_parts"))
    dealt = slices.join(sizes, "record").withColumn("_part", F.pmod(F.xxhash64("start", "n"), "_parts"))
    plan = dealt.groupBy("record", "_part").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("slices")).drop("_part")

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                lines = [x for x in r.head.decode("latin1").splitlines() if x and not x.startswith("#")]
                channels, spec = int(lines[0].split()[1]), lines[1].split()
                gain = float(spec[2].split("(")[0].split("/")[0]) or 200.0 if len(spec) > 2 else 200.0
                zero = float(spec[4]) if len(spec) > 4 else 0.0
                out = [(r.record, s["start"], (parse_212(r.data, channels, int(s["start"]), int(s["n"]))[:, 0] - zero) / gain) for s in r.slices]
                yield pd.DataFrame(out, columns=["record", "start", "signal"])

    met = plan.join(of("hea", "head"), "record").join(of("dat", "data"), "record").select("record", "slices", "head", "data")
    return met.mapInPandas(batch, "record string, start bigint, signal array<double>")


def read_positional_csv(spark: SparkSession, path: str, columns: dict[int, str]) -> DataFrame:
    """Columns of a CSV with a header by their places, as doubles; what isn't a number is null."""
    df = spark.read.option("header", "true").csv(path)
    return df.toDF(*[f"_{k}" for k in range(len(df.columns))]).select(*[F.col(f"_{k}").try_cast("double").alias(name) for k, name in columns.items()])


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema, by name, from CSV manifests with a header; columns that a manifest lacks are null, others are left out.

    Nothing is read to find types out. A cell that is not of its column's type is null.
    """
    names = spark.read.option("header", "true").csv(path).columns
    whole = spark.createDataFrame([], schema).schema
    kinds = {f.name: f.dataType.simpleString() for f in whole}
    rows = spark.read.schema(", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)).option("header", "true").option("enforceSchema", "true").csv(path)
    return rows.select(*[F.col(f"`{n}`") if n in names else F.lit(None).cast(k).alias(n) for n, k in kinds.items()])


def write_conditions(samples: DataFrame, path: str, force: bool = False) -> None:
    """Mixed samples by condition, a folder for each snr and k, and their metadata without arrays as CSV."""
    write_table(samples, f"{path}/samples", ["snr", "k"], force)
    arrays = {f.name for f in samples.schema if f.dataType.typeName() == "array"}
    write_table(samples.select(*[c for c in samples.columns if c not in arrays]), f"{path}/metadata", None, force, "csv")


def write_missing(conditions: DataFrame, build, path: str, batch: int = 8, fmt: str = "parquet") -> int:
    """Write what build makes of conditions that path doesn't have yet, `batch` conditions at a time; the number of batches written.

    conditions is a small grid, a row for each; build takes some of its rows and returns a table with its columns, by whose values the
    table is partitioned. A batch replaces the partitions of its conditions when it is complete, and only then its conditions
    are noted as done: a run that was killed goes on with the first batch that isn't noted, and writes that one again whole. A
    condition without rows is done, too. read_written reads what is done.
    """
    spark = conditions.sparkSession
    by = conditions.columns
    noted = _noted(spark, path)
    # null-safe: a condition may lack a value
    if noted is None:
        left = conditions
    else:
        same = F.lit(True)
        for c in by:
            same = same & conditions[c].eqNullSafe(noted[c])
        left = conditions.join(noted, same, "left_anti")
    todo = sorted({tuple(r) for r in left.collect()}, key=repr)
    for k in range(0, len(todo), batch):
        some = spark.createDataFrame(todo[k : k + batch], conditions.schema)
        writer = build(some).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt).partitionBy(*by)
        (writer.option("header", "true") if fmt == "csv" else writer).save(f"{path}/rows")
        some.coalesce(1).write.mode("append").parquet(f"{path}/done")
    return -(-len(todo) // batch)


def _noted(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(f"{path}/done")


def read_written(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows of the conditions that write_missing has noted as done."""
    noted, rows = spark.read.parquet(f"{path}/done").distinct(), spark.read.format(fmt).option("header", "true").option("inferSchema", str(fmt == "csv").lower()).load(f"{path}/rows")
    same = F.lit(True)
    for c in noted.columns:
        same = same & rows[c].eqNullSafe(noted[c])
    return rows.join(noted, same, "left_semi")


def write_results(rows: DataFrame, path: str, by: list[str], digits: int = 10, force: bool = False) -> None:
    """A result table as CSV, a folder for each combination of `by` (metric, dataset, noise type); doubles have `digits` significant digits."""
    shown = [F.format_string(f"%.{digits}g", c).alias(c) if k in ("double", "float") else F.col(c) for c, k in rows.dtypes]
    write_table(rows.select(*shown), path, by, force, "csv")


def mat_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """A level 5 MAT-file of real numeric matrices: what parse_mat reads."""
    numbers = {np.dtype("<" + v): k for k, v in MAT_TYPES.items()}
    classes = {"f8": 6, "f4": 7, "i1": 8, "u1": 9, "i2": 10, "u2": 11, "i4": 12, "u4": 13, "i8": 14, "u8": 15}  # fixed values of the format

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, v in arrays.items():
        m = np.atleast_2d(np.asarray(v))
        m = m.astype(m.dtype.newbyteorder("<"))
        head = element(6, struct.pack("<II", classes[m.dtype.str[1:]], 0)) + element(5, np.array(m.shape, "<i4").tobytes()) + element(1, name.encode("latin1"))
        out += element(14, head + element(numbers[m.dtype], m.tobytes(order="F")))
    return out


def with_denoised(data: bytes, denoised: np.ndarray, rate: float) -> bytes:
    """A MAT-file's matrices with the denoised signals, samples in rows, and their rate beside them."""
    return mat_bytes(parse_mat(data) | {"preprocessed_emg": np.asarray(denoised, "<f4"), "fs_preprocessed": np.array([[float(rate)]])})


def write_mat(spark: SparkSession, path: str, denoised: DataFrame, rate: float, out: str, force: bool = False) -> None:
    """MAT-files below path that have denoised channels (path, signals array<array<double>>), each with its own matrices and the new ones.

    The files are rows (path, content) of a Parquet table: each task writes its own, and a lost one is written again.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mat").load(path).select("path", "content")

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            content = [with_denoised(c, np.stack(s).T, rate) for c, s in zip(part["content"], part["signals"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "content": content})

    write_table(files.join(denoised.select("path", "signals"), "path").mapInPandas(batch, "path string, content binary"), out, force=force)


def latest(spark: SparkSession, path: str, pattern: str) -> str | None:
    """The file with the newest modification time, the last by name of equals."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return row[0] if row else None


def write_table(df: DataFrame, path: str, by: list[str] | None = None, force: bool = False, fmt: str = "parquet") -> None:
    """Write once: an existing table stays unless forced."""
    writer = df.write.mode("overwrite" if force else "ignore").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*by) if by else writer).save(path)


def report(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result table as text."""
    return f"{title}\n{'=' * len(title)}\n{df.limit(most).toPandas().to_string(index=False)}\n"


def settings(text: str, defaults: dict | None = None) -> dict:
    """Configuration from YAML, of which JSON is a part, over defaults; nested parts are merged. Without a YAML reader only JSON is read."""

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    try:
        import yaml
    except ImportError:
        return merge(defaults or {}, json.loads(text))
    return merge(defaults or {}, yaml.safe_load(text) or {})

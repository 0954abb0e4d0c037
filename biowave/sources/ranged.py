"""Recordings read by ranges: Python data sources whose partitions seek to their bytes and read nothing else.

    spark.dataSource.register(Wfdb)
    spark.read.format("wfdb212").option("stretch", 1 << 24).load("/data/ecg")

gives (path, ch, start, signal, bytes): pieces of at most `piece` samples of a channel, in partitions of about `stretch` samples.
Only headers are read to plan them, and filters on path and start leave out partitions and pieces. bytes is what was read for the
row. Files are opened with pyarrow's file systems, so path is a folder or URI that these know.
"""

from __future__ import annotations

import ast
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from biowave.sources.files import MAT_TYPES, parse_212

SCHEMA = "path string, ch int, start bigint, signal array<double>, bytes bigint"
STRETCH, PIECE = 1 << 24, 1 << 16


def opened(path: str):
    """(file system, path in it)."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, ending: str) -> list[str]:
    """The files below path with an ending, sorted; path itself if it is one."""
    system, at = opened(path)
    if system.get_file_info(at).type == pafs.FileType.File:
        return [at] if at.endswith(ending) else []
    found = system.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(ending))


@dataclass
class Stretch(InputPartition):
    path: str  #: of the file with the samples
    start: int
    n: int  #: samples of each channel
    layout: dict  #: what a format needs to find them

    def __init__(self, path: str, start: int, n: int, layout: dict):
        super().__init__((path, start, n))
        self.path, self.start, self.n, self.layout = path, start, n, layout


@dataclass
class Record:
    """Where a format-212 record's samples are, from its header."""

    channels: int
    samples: int
    gains: list[float]
    zeros: list[float]

    @staticmethod
    def read(system: pafs.FileSystem, head: str) -> Record:
        with system.open_input_file(head) as f:
            lines = [x.split() for x in f.read().decode("latin1").splitlines() if x and not x.startswith("#")]
        channels = int(lines[0][1])
        if any(s[1].split("x")[0] != "212" for s in lines[1 : channels + 1]):
            raise ValueError(f"{head}: only format 212 is read")
        size = system.get_file_info(head[:-4] + ".dat").size
        samples = int(lines[0][3]) if len(lines[0]) > 3 else size * 2 // 3 // channels
        spec = [s + [""] * (5 - len(s)) for s in lines[1 : channels + 1]]
        gains = [float(s[2].split("(")[0].split("/")[0] or 0) or 200.0 for s in spec]
        return Record(channels, samples, gains, [float(s[4] or 0) for s in spec])

    def take(self, f, start: int, n: int) -> tuple[np.ndarray, int]:
        """(samples x channels in physical units, bytes read); short at the record's end."""
        first = start * self.channels
        begin, end = first // 2 * 3, -(-(first + n * self.channels) // 2) * 3
        f.seek(begin)
        data = f.read(end - begin)
        # a range begins with a whole pair, of which the first sample may be another's
        skip = first % 2
        whole = parse_212(data, 1, skip, n * self.channels)[:, 0]
        raw = whole[: len(whole) // self.channels * self.channels].reshape(-1, self.channels)
        return (raw - np.array(self.zeros)) / np.array(self.gains), len(data)


class RangedReader(DataSourceReader):
    """Plans a format's files as stretches, and reads them in pieces."""

    ending = ""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.stretch, self.piece = int(options.get("stretch", STRETCH)), int(options.get("piece", PIECE))
        self.field = options.get("field", "emg")
        self.paths, self.low, self.high = None, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if f.attribute == ("path",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = wanted if self.paths is None else self.paths & wanted
            elif f.attribute == ("start",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = f.value + (not isinstance(f, LessThan))
                    self.high = high if self.high is None else min(self.high, high)
            yield f  # Spark asks again: a filter here only saves reading

    def wanted(self, start: int) -> bool:
        return start >= self.low and (self.high is None or start < self.high)

    def layouts(self, system: pafs.FileSystem, path: str) -> Iterator[tuple[int, dict]]:
        """(samples, layout) of each array of a file."""
        raise NotImplementedError

    def pieces(self, system: pafs.FileSystem, part: Stretch) -> Iterator[tuple[int, int, np.ndarray, int]]:
        """(channel, start, samples, bytes read) of a stretch."""
        raise NotImplementedError

    def partitions(self) -> list[Stretch]:
        system, _ = opened(self.path)
        step = max(1, self.stretch // self.piece) * self.piece  # pieces start at multiples of their length
        out = []
        for path in listed(self.path, self.ending):
            if self.paths is None or path in self.paths:
                for samples, layout in self.layouts(system, path):
                    stretches = range(0, samples, step if layout.get("split", True) else max(1, samples))
                    out += [Stretch(path, s, min(stretches.step, samples - s), layout) for s in stretches if self._any_wanted(s, min(stretches.step, samples - s))]
        return out or [Stretch("", 0, 0, {})]

    def _any_wanted(self, start: int, n: int) -> bool:
        return self.low < start + n and (self.high is None or start < self.high)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.n:
            system, _ = opened(self.path)
            for ch, start, signal, size in self.pieces(system, partition):
                yield partition.path, ch, start, signal.astype(float).tolist(), size

    def starts(self, part: Stretch) -> Iterator[tuple[int, int]]:
        for s in range(part.start, part.start + part.n, self.piece):
            if self.wanted(s):
                yield s, min(self.piece, part.start + part.n - s)


class WfdbReader(RangedReader):
    ending = ".hea"

    def layouts(self, system: pafs.FileSystem, path: str) -> Iterator[tuple[int, dict]]:
        record = Record.read(system, path)
        yield record.samples, {"record": record}

    def pieces(self, system: pafs.FileSystem, part: Stretch) -> Iterator[tuple[int, int, np.ndarray, int]]:
        record = part.layout["record"]
        with system.open_input_file(part.path[:-4] + ".dat") as f:
            for start, n in self.starts(part):
                x, size = record.take(f, start, n)
                for ch in range(record.channels):
                    yield ch, start, x[:, ch], size if ch == 0 else 0


class NpyReader(RangedReader):
    ending = ".npy"

    def layouts(self, system: pafs.FileSystem, path: str) -> Iterator[tuple[int, dict]]:
        with system.open_input_file(path) as f:
            head = f.read(12)
            if head[:6] != b"\x93NUMPY":
                raise ValueError(f"{path}: not a NumPy file")
            size, begin = (struct.unpack("<H", head[8:10])[0], 10) if head[6] == 1 else (struct.unpack("<I", head[8:12])[0], 12)
            f.seek(begin)
            told = ast.literal_eval(f.read(size).decode("latin1"))
        kind = np.dtype(told["descr"])
        if kind.hasobject:
            raise ValueError(f"{path}: arrays of objects are not read")
        yield int(np.prod(told["shape"])), {"begin": begin + size, "kind": kind.str, "ch": 0}

    def pieces(self, system: pafs.FileSystem, part: Stretch) -> Iterator[tuple[int, int, np.ndarray, int]]:
        yield from _column_pieces(self, system, part)


def _column_pieces(reader: RangedReader, system: pafs.FileSystem, part: Stretch) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Pieces of numbers that stand one after the other."""
    kind = np.dtype(part.layout["kind"])
    with system.open_input_file(part.path) as f:
        for start, n in reader.starts(part):
            f.seek(part.layout["begin"] + start * kind.itemsize)
            data = f.read(n * kind.itemsize)
            yield part.layout["ch"], start, np.frombuffer(data, kind), len(data)


class MatReader(RangedReader):
    """The signals' matrix of level 5 MAT-files, samples in rows: a channel's samples stand one after the other.

    Only tags are read to find it. A compressed matrix can't be entered midway: it is one partition, inflated as a whole.
    """

    ending = ".mat"

    def layouts(self, system: pafs.FileSystem, path: str) -> Iterator[tuple[int, dict]]:
        with system.open_input_file(path) as f:
            order, at, end = "<" if f.read(128)[126:128] == b"IM" else ">", 128, f.size()
            while at + 8 <= end:
                f.seek(at)
                kind, size = struct.unpack(order + "II", f.read(8))
                head = f.read(min(size, 512))
                if kind == 15:
                    head = zlib.decompressobj().decompress(head, 512)
                    found = self._matrix(head[8:], order)
                else:
                    found = self._matrix(head, order) if kind == 14 else None
                if found:
                    rows, cols, begin, number = found
                    if kind == 15:
                        yield rows, {"split": False, "at": at + 8, "size": size, "begin": begin + 8, "kind": order + number, "cols": cols}
                    else:
                        for ch in range(cols):
                            step = np.dtype(number).itemsize * rows * ch
                            yield rows, {"begin": at + 8 + begin + step, "kind": order + number, "ch": ch}
                at += 8 + size + (0 if kind == 15 else -size % 8)

    def _matrix(self, head: bytes, order: str) -> tuple[int, int, int, str] | None:
        """(rows, columns, where the numbers begin, their kind) of the matrix with the wanted name."""
        at, parts = 0, []
        while len(parts) < 4 and at + 8 <= len(head):
            kind, size = struct.unpack(order + "II", head[at : at + 8])
            small = kind >> 16
            begin, n = (at + 4, kind >> 16) if small else (at + 8, size)
            parts.append((kind & 0xFFFF, begin, n))
            at = at + 8 if small else at + 8 + n + -n % 8
        if len(parts) < 4 or head[parts[2][1] : parts[2][1] + parts[2][2]].decode("latin1") != self.field or parts[3][0] not in MAT_TYPES:
            return None
        shape = np.frombuffer(head[parts[1][1] : parts[1][1] + parts[1][2]], order + "i4")
        return int(shape[0]), int(np.prod(shape[1:])), parts[3][1], MAT_TYPES[parts[3][0]]

    def pieces(self, system: pafs.FileSystem, part: Stretch) -> Iterator[tuple[int, int, np.ndarray, int]]:
        if part.layout.get("split", True):
            yield from _column_pieces(self, system, part)
            return
        with system.open_input_file(part.path) as f:
            f.seek(part.layout["at"])
            data = f.read(part.layout["size"])
        x = np.frombuffer(zlib.decompress(data), part.layout["kind"], offset=part.layout["begin"], count=part.n * part.layout["cols"])
        for ch, column in enumerate(x.reshape(part.layout["cols"], part.n)):
            for start, n in self.starts(part):
                yield ch, start, column[start : start + n], len(data) if ch == start == 0 else 0


class Ranged(DataSource):
    of: type[RangedReader]

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangedReader:  # noqa: ANN001
        return self.of(dict(self.options))


class Wfdb(Ranged):
    of = WfdbReader

    @classmethod
    def name(cls) -> str:
        return "wfdb212"


class Npy(Ranged):
    of = NpyReader

    @classmethod
    def name(cls) -> str:
        return "npy"


class Mat(Ranged):
    of = MatReader

    @classmethod
    def name(cls) -> str:
        return "mat5"


def register(spark: SparkSession) -> None:
    """Make the formats known, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Wfdb, Npy, Mat):
        spark.dataSource.register(source)


def read_slices(path: str, slices: DataFrame, near: int = 1 << 20) -> DataFrame:
    """(record, start, signal, bytes) of slices (record, start, n): the first channel of the records below path, in physical units.

    Each slice's bytes are sought and read where the slice is; those of a record that are near each other are read by one task, in
    order. A slice that goes beyond its record is short; one that begins beyond it, or whose record isn't there, gives no row.
    """
    import pandas as pd

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(path)
        known, name, f = {}, None, None
        for part in parts:
            out = []
            for record, start, n in zip(part["record"], part["start"], part["n"], strict=True):
                if record not in known:
                    head = f"{base}/{record}.hea"
                    known = {record: Record.read(system, head) if system.get_file_info(head).is_file else None}
                if known[record] and 0 <= start < known[record].samples:
                    if name != record:
                        name, f = record, system.open_input_file(f"{base}/{record}.dat")
                    x, size = known[record].take(f, int(start), int(min(n, known[record].samples - start)))
                    out.append((record, start, x[:, 0], size))
            yield pd.DataFrame(out, columns=["record", "start", "signal", "bytes"])

    dealt = slices.where("record IS NOT NULL AND start IS NOT NULL AND n > 0").select("record", F.col("start").cast("bigint").alias("start"), F.col("n").cast("bigint").alias("n"))
    dealt = dealt.repartition("record", F.floor(F.col("start") / near)).sortWithinPartitions("record", "start")
    return dealt.mapInPandas(batch, "record string, start bigint, signal array<double>, bytes bigint")

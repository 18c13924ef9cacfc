"""LAS files as a data source: read by ranges of records, only the asked columns, and written with headers of the right counts and boxes.

    df = scan_las(spark, path)                     # all columns
    df = scan_las(spark, path, ["x", "z"], 50_000)  # two of them, so many records a task
    write_las(df, path)

Tasks open the files themselves, so the path must be one that pyarrow's file systems reach (local, hdfs, s3, gs); ``las.read_las`` reads files by Spark alone.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .las import BATCH, COUNT, COUNT4, FORMAT, LENGTH, OFFSET, OFFSETS, SCALES

COLUMNS = {"id": "long", "x": "double", "y": "double", "z": "double", "intensity": "int", "classification": "int", "file": "string"}
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
RECORDS = 1_000_000
#: places in a header and a record of format 0 of version 1.2; fixed values
HEAD, RECORD, BOX, CLASS = 227, np.dtype([("xyz", "<i4", 3), ("intensity", "<u2"), ("returns", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]), 179, 15


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and its name there."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def las_files(fs: pafs.FileSystem, path: str) -> list[str]:
    """The names of a file, or of the ``.las`` files in a folder, in order."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        return []
    if info.type == pafs.FileType.File:
        return [path]
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and f.path.lower().endswith(".las"))


@dataclass
class Records(InputPartition):
    """Records ``first`` to ``last`` of a file, which begin at ``start``; ``before``: the first one's id."""

    file: str
    start: int
    length: int
    kind: int
    first: int
    last: int
    before: int
    scale: tuple
    offset: tuple


class LasReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        if unknown := set(self.names) - set(COLUMNS):
            raise ValueError(f"no columns of a LAS file: {sorted(unknown)}")
        self.path, self.records = options["path"], max(1, int(options.get("records", RECORDS)))

    def partitions(self) -> list[Records]:
        fs, path = opened(self.path)
        out, before = [], 0
        for name in las_files(fs, path):
            with fs.open_input_file(name) as f:
                size, head = f.size(), f.read(375)
            if head[:4] != b"LASF" or len(head) < HEAD:
                raise ValueError(f"no LAS file: {name}")
            if head[FORMAT] & 0x80:
                raise ValueError(f"compressed points are not read: {name}")
            start, length, count = struct.unpack_from("<I", head, OFFSET)[0], struct.unpack_from("<H", head, LENGTH)[0], struct.unpack_from("<I", head, COUNT)[0]
            if head[25] >= 4 and len(head) == 375 and (more := struct.unpack_from("<Q", head, COUNT4)[0]):
                count = more
            count = max(0, min(count, (size - start) // length))  # a file that was cut short has fewer
            scale, offset = struct.unpack_from("<3d", head, SCALES), struct.unpack_from("<3d", head, OFFSETS)
            out += [Records(name, start, length, head[FORMAT] & 0x7F, lo, min(count, lo + self.records), before + lo, scale, offset) for lo in range(0, count, self.records)]
            before += count
        return out or [Records("", 0, 1, 0, 0, 0, 0, (1, 1, 1), (0, 0, 0))]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        fs, _ = opened(self.path)
        # formats 6 and up hold the class at another place
        record = np.dtype({"names": ["xyz", "intensity", "class"], "formats": [("<i4", 3), "<u2", "u1"], "offsets": [0, 12, CLASS if part.kind < 6 else CLASS + 1], "itemsize": part.length})
        with fs.open_input_file(part.file) as f:
            for lo in range(part.first, part.last, BATCH):
                n = min(BATCH, part.last - lo)
                data = np.frombuffer(f.read_at(n * part.length, part.start + lo * part.length), record)
                columns = []
                for c in self.names:
                    if c in "xyz":
                        k = "xyz".index(c)
                        columns.append(pa.array(data["xyz"][:, k] * part.scale[k] + part.offset[k]))
                    elif c == "id":
                        columns.append(pa.array(np.arange(part.before + lo - part.first, part.before + lo - part.first + n)))
                    elif c == "file":
                        columns.append(pa.array([part.file] * n))
                    else:
                        field = data["intensity"] if c == "intensity" else data["class"] & (31 if part.kind < 6 else 255)
                        columns.append(pa.array(field.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, self.names)


@dataclass
class Written(WriterCommitMessage):
    files: list


class LasWriter(DataSourceArrowWriter):
    """Each task writes files of ``points`` points at most; a job that ends keeps the files of its tasks' last attempts, and those before only if it appends."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names = schema.fieldNames()
        if missing := set("xyz") - set(self.names):
            raise ValueError(f"a LAS file needs {sorted(missing)}")
        self.path, self.points = options["path"], max(1, int(options.get("points", RECORDS)))
        self.scale, self.offset = float(options.get("scale", 0.01)), float(options.get("offset", 0.0))
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        self.before = [] if overwrite else las_files(fs, path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = opened(self.path)
        context, files, held, n = TaskContext.get(), [], [], 0
        name = f"{path}/part-{context.partitionId():05d}-{context.taskAttemptId():06d}"

        def close() -> None:
            data = np.concatenate(held)
            files.append(f"{name}-{len(files):04d}.las")
            with fs.open_output_stream(files[-1]) as f:
                f.write(self._header(data))
                f.write(data.tobytes())

        for batch in batches:
            for lo in range(0, batch.num_rows, self.points):
                part = self._records(batch.slice(lo, self.points))
                while len(part):
                    take = part[: self.points - n]
                    held.append(take)
                    part, n = part[len(take) :], n + len(take)
                    if n == self.points:
                        close()
                        held, n = [], 0
        if n:
            close()
        return Written(files)

    def _records(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, RECORD)
        for k, a in enumerate("xyz"):
            v = batch[a].to_numpy(zero_copy_only=False).astype(np.float64)
            steps = np.rint((v - self.offset) / self.scale)
            if not (np.abs(steps) < 2**31).all():
                raise ValueError(f"{a} is null, or beyond what a scale of {self.scale} can hold")
            out["xyz"][:, k] = steps
        for c, field, most in (("intensity", "intensity", 65535), ("classification", "class", 31)):
            if c in self.names:
                v = batch[c].fill_null(0).to_numpy(zero_copy_only=False)
                if len(v) and not 0 <= v.min() <= v.max() <= most:
                    raise ValueError(f"{c} is not between 0 and {most}")
                out[field] = v
        out["returns"] = 0b001001  # the first of one
        return out

    def _header(self, data: np.ndarray) -> bytes:
        head = bytearray(HEAD)
        head[:4], head[24], head[25] = b"LASF", 1, 2
        head[58 : 58 + 6] = b"swathe"
        struct.pack_into("<HII", head, 94, HEAD, HEAD, 0)
        struct.pack_into("<BHI5I", head, FORMAT, 0, RECORD.itemsize, len(data), len(data), 0, 0, 0, 0)
        struct.pack_into("<6d", head, SCALES, *[self.scale] * 3, *[self.offset] * 3)
        box = [f(data["xyz"][:, k]) * self.scale + self.offset for k in range(3) for f in (np.max, np.min)]
        struct.pack_into("<6d", head, BOX, *box)
        return bytes(head)

    def commit(self, messages: list) -> None:
        fs, path = opened(self.path)
        kept = {f for m in messages if m is not None for f in m.files} | set(self.before)
        for f in las_files(fs, path):
            if f not in kept:
                fs.delete_file(f)

    def abort(self, messages: list) -> None:
        fs, _ = opened(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        return LasWriter(schema, self.options, overwrite)


def scan_las(spark: SparkSession, path: str, columns: list[str] | None = None, records: int = RECORDS) -> DataFrame:
    """The points of a LAS file, or of all in a folder: id (dense, by file name and place), x, y, z, intensity, classification, file, or some ``columns`` of these; a task reads ``records`` records."""
    spark.dataSource.register(LasSource)
    reader = spark.read.format("las").option("records", records)
    return (reader.schema(", ".join(f"{c} {COLUMNS[c]}" for c in columns)) if columns else reader).load(path)


def write_las(points: DataFrame, path: str, mode: str = "overwrite", scale: float = 0.01, offset: float = 0.0, most: int = RECORDS) -> None:
    """Writes x, y, z, and intensity and classification where there are, in files of ``most`` points; coordinates become multiples of ``scale``."""
    points.sparkSession.dataSource.register(LasSource)
    kept = [c for c in ("x", "y", "z", "intensity", "classification") if c in points.columns]
    points.select(*kept).write.format("las").mode(mode).option("scale", scale).option("offset", offset).option("points", most).save(path)

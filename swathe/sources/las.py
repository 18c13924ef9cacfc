"""Points of LAS files (versions 1.0 to 1.4, uncompressed), by the public format description."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: places in the file header: offset of the points, format, length of a record, number of records (to 1.3), scales, offsets, number of records (1.4); fixed values
OFFSET, FORMAT, LENGTH, COUNT, SCALES, OFFSETS, COUNT4 = 96, 104, 105, 107, 131, 155, 247
BATCH = 1 << 16


def parse(data: bytes) -> Iterator[dict[str, np.ndarray]]:
    """x, y, z and intensity of a file's points in order, in batches."""
    if data[:4] != b"LASF":
        raise ValueError("no LAS file")
    if data[FORMAT] & 0x80:
        raise ValueError("compressed points are not read")
    first, length, count = struct.unpack_from("<I", data, OFFSET)[0], struct.unpack_from("<H", data, LENGTH)[0], struct.unpack_from("<I", data, COUNT)[0]
    if data[25] >= 4 and (more := struct.unpack_from("<Q", data, COUNT4)[0]):
        count = more
    scale, offset = np.array(struct.unpack_from("<3d", data, SCALES)), np.array(struct.unpack_from("<3d", data, OFFSETS))
    record = np.dtype({"names": ["xyz", "intensity"], "formats": [("<i4", 3), "<u2"], "offsets": [0, 12], "itemsize": length})
    count = min(count, (len(data) - first) // length)  # a file that was cut short has fewer
    for lo in range(0, count, BATCH):
        part = np.frombuffer(data, record, min(BATCH, count - lo), first + lo * length)
        xyz = part["xyz"] * scale + offset
        yield {"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": part["intensity"].astype(np.int32)}


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z, intensity of the points of all LAS files at ``path``; ids are dense, by file name and place.

    A file is read by one task, so clouds should come as many files, as they do.
    """

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for part in parse(data):
                    n = len(part["x"])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), *map(pa.array, part.values())], ["file", "place", *part])
                    at += n

    got = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(points, "file string, place long, x double, y double, z double, intensity int")
    counts = got.groupBy("file").agg(F.count("*").alias("n"))
    firsts = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row for each file
    return got.join(firsts, "file").select((F.col("before") + F.col("place")).alias("id"), "x", "y", "z", "intensity")

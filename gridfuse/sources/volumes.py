"""Reads NIfTI-1 volumes and writes labels as such."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def header(data: bytes) -> dict:
    """Shape (x, y, z, t), type, scale, spacing and offset of places, and where the values begin."""
    order = "<" if int.from_bytes(data[:4], "little") == 348 else ">"
    if len(data) < 348 or np.frombuffer(data, order + "i4", 1)[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dims = np.frombuffer(data, order + "i2", 8, 40)
    kind = int(np.frombuffer(data, order + "i2", 1, 70)[0])
    if kind not in TYPES:
        raise ValueError(f"data type {kind} is not supported")
    start, slope, shift = np.frombuffer(data, order + "f4", 3, 108)
    spacing = [float(d) or 1.0 for d in np.frombuffer(data, order + "f4", 8, 76)[1:4]]
    offset = [float(d) for d in np.frombuffer(data, order + "f4", 3, 268)] if np.frombuffer(data, order + "i2", 1, 252)[0] > 0 else [0.0] * 3
    shape = [int(d) for d in dims[1 : dims[0] + 1]] + [1] * (4 - dims[0])
    return {"type": order + TYPES[kind], "shape": shape, "start": int(start), "slope": float(slope), "shift": float(shift), "spacing": spacing, "offset": offset}


def parse(data: bytes) -> tuple[dict, np.ndarray]:
    """The header and the values (x, y, z, t) of one file, scaled by its header."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    h = header(data)
    values = np.frombuffer(data, h["type"], int(np.prod(h["shape"])), h["start"]).astype(float).reshape(h["shape"], order="F")
    return h, values * h["slope"] + h["shift"] if h["slope"] != 0 else values


def read_nifti(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """(path, file, vid, x, y, z, mx, my, mz, ts) of every voxel of the files, or of those where the one volume `mask` is over 0.

    `file` numbers the files by path and `vid` is unique among all: 2**40 times that number plus the place in the volume. mx, my and mz are places in the
    units of the header's spacing. A task reads one file and sends it by slices.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, data in zip(files.path, files.content, strict=True):
                h, values = parse(bytes(data))
                nx, ny, nz = values.shape[:3]
                y, x = np.indices((ny, nx)).reshape(2, -1)
                for z in range(nz):
                    places = {f"m{c}": v * s + o for c, v, s, o in zip("xyz", (x, y, np.full(len(x), z)), h["spacing"], h["offset"], strict=True)}
                    yield pd.DataFrame({"path": name, "lin": x + nx * (y + ny * z), "x": x, "y": y, "z": z, **places, "ts": list(values[x, y, z])})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, lin long, x int, y int, z int, mx double, my double, mz double, ts array<double>"
    names = sorted(r.path for r in files.select("path").collect())  # the names of the files, not their rows
    numbers = spark.createDataFrame(list(enumerate(names)), "file long, path string")
    rows = files.mapInPandas(run, schema).join(F.broadcast(numbers), "path").withColumn("vid", F.col("file") * (1 << 40) + F.col("lin"))
    if mask is not None:
        inside = spark.read.format("binaryFile").load(mask).select("path", "content").mapInPandas(run, schema)
        rows = rows.join(inside.filter(F.get("ts", 0) > 0).select("x", "y", "z"), ["x", "y", "z"], "left_semi")
    return rows.select("path", "file", "vid", "x", "y", "z", "mx", "my", "mz", "ts")


def write_labels(voxels: DataFrame, labels: DataFrame, path: str) -> None:
    """Parquet rows (vid, x, y, z, cid)."""
    voxels.select("vid", "x", "y", "z").join(labels, "vid").write.mode("overwrite").parquet(path)


def nifti_bytes(values: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    """A volume of 32-bit labels as one NIfTI-1 file."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *values.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 8, 32)
    struct.pack_into("<4f", head, 76, 1.0, *spacing)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + values.astype("<i4").tobytes(order="F")


def write_nifti(voxels: DataFrame, labels: DataFrame, folder: str, dims: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), only: int | None = None) -> DataFrame:
    """Writes the labels of each volume (column `file`, or all as one) as a NIfTI-1 file, or with `only` the mask of that label; returns (file, path).

    Voxels without a label are 0. A volume is one file, so one task writes it and holds its labels, four bytes a voxel of the given dims.
    """
    rows = voxels.select(F.col("file") if "file" in voxels.columns else F.lit(0).cast("long").alias("file"), "vid", "x", "y", "z").join(labels, "vid")

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        values = np.zeros(dims, np.int32)
        cid = part.cid.fillna(0).to_numpy(np.int32)
        values[part.x, part.y, part.z] = cid if only is None else cid == only
        name = f"labels-{int(key[0])}.nii"
        where, at = (fs.LocalFileSystem(), folder.removeprefix("file://")) if folder.startswith(("/", "file:")) else fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        with where.open_output_stream(f"{at}/{name}", compression=None) as out:
            out.write(nifti_bytes(values, spacing))
        return pd.DataFrame({"file": [key[0]], "path": [f"{folder}/{name}"]})

    return rows.groupBy("file").applyInPandas(run, "file long, path string")

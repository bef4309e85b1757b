"""Volume files: MetaImage (.mha, .mhd + .raw), NRRD (.nrrd, .nhdr + .raw) and dims-then-raw dumps.

Files come through Spark's binaryFile reader, so any store that Spark reads will
do. Headers are parsed first; where the values stand in a file of their own,
header and data rows are joined by path.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types of the two header formats as numpy types.
META_TYPES = {
    "MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4",
    "MET_LONG": "i8", "MET_ULONG": "u8", "MET_FLOAT": "f4", "MET_DOUBLE": "f8",
}
NRRD_TYPES = {
    "signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2",
    "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4",
    "float": "f4", "double": "f8",
}

HEADER = "path string, data_path string, offset long, type string, little boolean, channels int, size array<int>, spacing array<double>, origin array<double>"


def parse_meta(content: bytes) -> dict:
    """Fields of a MetaImage header; offset is that of attached values, -1 if they are in another file."""
    fields, at = {}, 0
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        key, _, value = content[at:end].decode("latin-1").partition("=")
        fields[key.strip()] = value.strip()
        at = end + 1
        if key.strip() == "ElementDataFile":
            break
    numbers = lambda k, default: [float(x) for x in fields.get(k, default).split()]
    size = [int(x) for x in numbers("DimSize", "")]
    local = fields["ElementDataFile"] == "LOCAL"
    return {
        "data": None if local else fields["ElementDataFile"], "offset": at if local else -1, "type": META_TYPES[fields["ElementType"]],
        "little": fields.get("BinaryDataByteOrderMSB", fields.get("ElementByteOrderMSB", "False")).lower() != "true",
        "channels": int(fields.get("ElementNumberOfChannels", 1)), "size": size,
        "spacing": numbers("ElementSpacing", "1 " * len(size)), "origin": numbers("Offset", fields.get("Position", fields.get("Origin", "0 " * len(size)))),
    }


def parse_nrrd(content: bytes) -> dict:
    """Fields of a NRRD header with raw encoding."""
    end = content.find(b"\n\n")
    head = content[: end if end >= 0 else len(content)].decode("latin-1")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.splitlines()[1:] if not x.startswith("#"))}
    if fields.get("encoding", "raw") != "raw":
        raise ValueError("only raw encoding is read")
    size = [int(x) for x in fields["sizes"].split()]
    vectors = [[float(x) for x in v.split(",")] for v in re.findall(r"\(([^)]*)\)", fields.get("space directions", ""))]
    spacing = [float(np.linalg.norm(v)) for v in vectors] or [float(x) for x in fields.get("spacings", "1 " * len(size)).split()]
    origin = re.findall(r"\(([^)]*)\)", fields.get("space origin", ""))
    data = fields.get("data file", fields.get("datafile"))
    channels = 1
    if len(size) == 4:
        channels, size, spacing = size[0], size[1:], spacing[-3:]
    return {
        "data": data, "offset": -1 if data else end + 2, "type": NRRD_TYPES[fields["type"]], "little": fields.get("endian", "little") == "little",
        "channels": channels, "size": size, "spacing": spacing, "origin": [float(x) for x in origin[0].split(",")] if origin else [0.0] * len(size),
    }


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            h = parse_nrrd(content) if path.endswith((".nrrd", ".nhdr")) else parse_meta(content)
            data = os.path.join(os.path.dirname(path), h["data"]) if h["data"] else path
            rows.append((path, data, h["offset"], h["type"], h["little"], h["channels"], h["size"], h["spacing"], h["origin"]))
        yield pd.DataFrame(rows, columns=["path", "data_path", "offset", "type", "little", "channels", "size", "spacing", "origin"])


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        data = []
        for r in batch.itertuples():
            kind = np.dtype(r.type).newbyteorder("<" if r.little else ">")
            n = int(np.prod(r.size)) * int(r.channels)
            # Values that follow an unknown header are the last ones of their file.
            start = int(r.offset) if r.offset >= 0 else len(r.content) - n * kind.itemsize
            data.append(np.frombuffer(r.content, kind, n, start).astype(np.float64))
        yield pd.DataFrame({"path": batch["path"], "size": batch["size"], "spacing": batch["spacing"], "origin": batch["origin"], "file_type": batch["type"], "channels": batch["channels"], "data": data})


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Sizes, spacings and origins of the header files under a path, without their values."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("path").rlike(r"\.(mha|mhd|nrrd|nhdr)$")).select("path", "content").mapInPandas(_headers, HEADER)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, spacing, origin, file_type, channels, data): all volumes under a path, x fastest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("data_path"), "content")
    out = "path string, size array<int>, spacing array<double>, origin array<double>, file_type string, channels int, data array<double>"
    return read_headers(spark, path).join(files, "data_path").mapInPandas(_values, out)


def read_dumps(spark: SparkSession, path: str, kind: str = "f4") -> DataFrame:
    """(path, size, data) of files that hold three unsigned dimensions and then the values."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [np.frombuffer(c, "<u4", 3).astype(np.int64).tolist() for c in batch["content"]]
            data = [np.frombuffer(c, "<" + kind, int(np.prod(s)), 12).astype(np.float64) for c, s in zip(batch["content"], sizes, strict=True)]
            yield pd.DataFrame({"path": batch["path"], "size": sizes, "data": data})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, size array<int>, data array<double>")


def encode_meta(data, size, spacing, origin, kind: str = "MET_FLOAT", channels: int = 1) -> bytes:
    """A MetaImage file with its values attached."""
    text = lambda xs: " ".join(f"{x:g}" for x in xs)
    head = ["ObjectType = Image", f"NDims = {len(size)}", "BinaryData = True", "BinaryDataByteOrderMSB = False", f"Offset = {text(origin)}", f"ElementSpacing = {text(spacing)}", f"DimSize = {text(size)}"]
    head += [f"ElementNumberOfChannels = {channels}"] * (channels > 1) + [f"ElementType = {kind}", "ElementDataFile = LOCAL\n"]
    return "\n".join(head).encode() + np.asarray(data).astype("<" + META_TYPES[kind]).tobytes()


def encode_dump(data, size, kind: str = "f4") -> bytes:
    return np.asarray(size, "<u4").tobytes() + np.asarray(data).astype("<" + kind).tobytes()


def encode_pgm(values: np.ndarray, low: float, high: float) -> bytes:
    """An 8-bit picture of a slice (rows, columns), windowed to [low, high]."""
    scaled = np.clip((values - low) / max(high - low, 1e-12), 0, 1) * 255
    return f"P5\n{values.shape[1]} {values.shape[0]}\n255\n".encode() + scaled.astype(np.uint8).tobytes()


def _save(folder: str, name: str, content: bytes) -> None:
    """Write a file as a whole, in any store that Arrow's file systems reach."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(content)
    store.move(temporary, f"{path}/{name}")


def write_volumes(volumes: DataFrame, folder: str, size, spacing=(1, 1, 1), origin=(0, 0, 0), form: str = "mha") -> None:
    """A file for each row (image_id, data) in a folder (path or address) that all executors reach: .mha, or .vol for a dump."""

    def save(rows) -> None:
        for r in rows:
            content = encode_meta(r.data, size, spacing, origin) if form == "mha" else encode_dump(r.data, size)
            _save(folder, f"{r.image_id}.{form}", content)

    volumes.select("image_id", "data").foreachPartition(save)


def write_fields(fields: DataFrame, folder: str, size, spacing=(1, 1, 1), origin=(0, 0, 0), names=("hx", "hy", "hz"), split: bool = False) -> None:
    """A vector file for each row (image_id and three arrays), or with ``split`` a file for each component, named by its axis."""

    def save(rows) -> None:
        for r in rows:
            parts = [np.asarray(r[n]) for n in names]
            if split:
                for a, p in zip("xyz", parts, strict=True):
                    _save(folder, f"{r.image_id}_{a}.mha", encode_meta(p, size, spacing, origin))
            else:
                _save(folder, f"{r.image_id}.mha", encode_meta(np.stack(parts, 1).ravel(), size, spacing, origin, channels=3))

    fields.select("image_id", *names).foreachPartition(save)


def read_fields(spark: SparkSession, path: str, names=("hx", "hy", "hz")) -> DataFrame:
    """(path, size, spacing, origin, three arrays) of the vector files under a path."""
    rows = read_volumes(spark, path).filter("channels = 3")
    pick = lambda k: F.transform(F.sequence(F.lit(0), F.expr("CAST(size(data) / 3 AS INT)") - 1), lambda i: F.get("data", 3 * i + k))
    return rows.select("path", "size", "spacing", "origin", *[pick(k).alias(n) for k, n in enumerate(names)])


def slices_of(volumes: DataFrame, size, axis: str, index: int) -> DataFrame:
    """(image_id, columns, data): the slice of each volume at an index of an axis, its rows one after the other."""
    sx, sy, sz = size
    at = lambda x, y, z: F.get("data", (x + sx * (y + sy * z)).cast("int"))
    wide, high = {"x": (sy, sz), "y": (sx, sz), "z": (sx, sy)}[axis]
    fixed = F.lit(index)

    def value(i):
        u, v = i % wide, F.floor(i / wide)
        return {"x": lambda: at(fixed, u, v), "y": lambda: at(u, fixed, v), "z": lambda: at(u, v, fixed)}[axis]()

    return volumes.select("image_id", F.lit(wide).alias("columns"), F.transform(F.sequence(F.lit(0), F.lit(wide * high - 1)), value).alias("data"))


def write_slices(volumes: DataFrame, folder: str, size, axis: str, index: int, form: str = "pgm") -> None:
    """A file for each volume with its slice: .pgm, windowed to the slice's own range, or .raw for floats."""

    def save(rows) -> None:
        for r in rows:
            v = np.asarray(r.data, dtype=np.float64).reshape(-1, r.columns)
            content = encode_pgm(v, v.min(), v.max()) if form == "pgm" else v.astype("<f4").tobytes()
            _save(folder, f"{r.image_id}_{axis}{index}.{form}", content)

    slices_of(volumes, size, axis, index).foreachPartition(save)

"""Reading and writing of source and result files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zipfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: Tables of the data set, with explicit types.
SCHEMAS = {
    "anomaly_label": _schema(BlockId=_S, Label=_S),
    "log_templates": _schema(EventId=_S, EventTemplate=_S),
    "event_traces": _schema(BlockId=_S, Label=_S, Type=_S, Features=_S, TimeInterval=_S, Latency=_D),
    "block_sequences": _schema(block_id=_S, trace_signature=_S, event_ids=_S, template_sequence=_S, sequence_length=_I, label=_S, conflicting_trace=_B),
    "split_ids": _schema(block_id=_S, trace_signature=_S, label=_S, split=_S),
    "normal_knowledge_base": _schema(trace_id=_S, event_ids=_S, template_text=_S, occurrence_count=_L, representative_block_id=_S),
    "evaluation_annotations": _schema(block_id=_S, trace_signature=_S, label=_S, split=_S, seen_in_train=_B, exact_match_in_normal_kb=_B, conflicting_trace=_B),
}


def matrix_schema(columns: list[str]) -> T.StructType:
    """Types of an occurrence matrix with these columns: every ``E<number>`` is a count."""
    return T.StructType([T.StructField(c, T.LongType() if re.fullmatch(r"E\d+", c) else T.StringType()) for c in columns])


def event_columns(columns: list[str]) -> list[str]:
    """The event columns in order of their numbers."""
    return sorted((c for c in columns if re.fullmatch(r"E\d+", c)), key=lambda c: int(c[1:]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with header; quotes are doubled inside fields, which may hold line ends. The header must have the
    schema's columns; columns are taken by name, in any order."""
    present = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in present]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    kinds = {f.name: f.dataType for f in schema.fields}
    whole = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in present])
    read = spark.read.schema(whole).options(header=True, quote='"', escape='"', multiLine=True)
    return read.csv(path).select(*(f.name for f in schema.fields))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Delivered lines as they are, with the file they come from."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A CSV table that `read_csv` reads back; arrays must be JSON texts. Null and empty text both come back as null."""
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_json(path: str | Path) -> object:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def save_json(path: str | Path, value: object) -> None:
    """One JSON document; refuses NaN. The file appears at once or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False), encoding="utf-8")
    os.replace(part, target)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, below the folder, and bytes of all files in a folder and the folders in it, or of one file; contents are
    not read."""
    return _listed(spark, path).select("name", "bytes")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``name`` below the folder and ``bytes`` of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    below = F.col("path").substr(F.lit(len(folder) + 2), F.length("path"))
    name = F.when(F.startswith("path", F.lit(folder + "/")), below).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.select("path", name.alias("name"), F.col("length").alias("bytes"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """`inventory` with the SHA-256 of each file. A task streams each of its files by `file_sha256`, whatever its size;
    executors must reach the folder, as a local path or through a file system that pyarrow knows."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [file_sha256(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(digests, pa.string())], names=["name", "bytes", "sha256"])

    return _listed(spark, path).mapInArrow(hashed, "name string, bytes long, sha256 string")


def file_sha256(path: str | Path, step: int = 1 << 20) -> str:
    """SHA-256 of a file, read in steps."""
    digest, path = hashlib.sha256(), str(path)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        system, place = FileSystem.from_uri(quote(path, safe=":/@"))
        stream = system.open_input_stream(place)
    else:
        stream = open(path, "rb")
    with stream as file:
        while block := file.read(step):
            digest.update(block)
    return digest.hexdigest()


def npy_headers(path: str | Path) -> list[dict]:
    """Name, shape, type and order of the arrays in an NPY or NPZ file, from their headers alone: nothing is unpickled
    and no data are read."""
    import ast

    def header(file, name: str) -> dict:
        magic = file.read(8)
        if magic[:6] != b"\x93NUMPY":
            raise ValueError(f"{name} is no NPY file")
        size = struct.unpack("<H", file.read(2))[0] if magic[6] == 1 else struct.unpack("<I", file.read(4))[0]
        found = ast.literal_eval(file.read(size).decode("latin1"))
        return {"name": name, "shape": tuple(found["shape"]), "dtype": str(found["descr"]), "fortran_order": found["fortran_order"]}

    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as archive:
            found = []
            for name in sorted(archive.namelist()):
                with archive.open(name) as file:
                    found.append(header(file, name.removesuffix(".npy")))
            return found
    with open(path, "rb") as file:
        return [header(file, Path(path).stem)]


def read_npy(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """The rows of a dense matrix as vectors with their row number, mapped from disk; numbers only."""
    import numpy as np

    matrix = np.load(path, mmap_mode="r", allow_pickle=False)
    rows = ((i, [float(x) for x in row]) for i, row in enumerate(matrix))
    return spark.createDataFrame(list(rows), f"{id_col} long, vector array<float>")


def latest_version(names: list[str], stem: str) -> str | None:
    """Of ``stem.csv``, ``stem_v2.csv`` and so on the one with the largest version; a name without is version 1."""
    versions = {n: int(m[1] or 1) for n in names if (m := re.fullmatch(rf"{re.escape(stem)}(?:_v(\d+))?\.csv", n))}
    return max(versions, key=versions.get, default=None)


def next_version(folder: str | Path, split: str = "test") -> tuple[Path, Path, int]:
    """Paths of the next report and its settings, and its version; a report is never overwritten."""
    stem = "comparison" if split == "test" else f"comparison_{split}"
    names = [p.name for p in Path(folder).glob(f"{stem}*.csv")]
    last = latest_version(names, stem)
    version = 1 if last is None else int((re.search(r"_v(\d+)\.csv$", last) or [0, 1])[1]) + 1
    end = "" if version == 1 else f"_v{version}"
    return Path(folder, f"{stem}{end}.csv"), Path(folder, f"{stem}{end}_config.json"), version


def summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Result summaries of all files that match, with the file's path."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("path", F.col("_metadata.file_path"))


def load_env(path: str | Path) -> None:
    """Set KEY=VALUE lines as environment variables that are not set yet; comments and other lines are skipped."""
    file = Path(path)
    for line in file.read_text(encoding="utf-8").splitlines() if file.exists() else ():
        key, sep, value = line.strip().partition("=")
        if sep and not key.startswith("#"):
            os.environ.setdefault(key.strip(), value.strip().strip("\"'"))

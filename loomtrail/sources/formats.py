"""Reading and writing record files: jsonl (plain, gz, zst), json, parquet, msgpack; fingerprints and sidecars."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = (".jsonl.gz", ".jsonl.zst", ".jsonl", ".json", ".parquet", ".msgpack")
NESTED_KEY = "loomtrail.nested"


def infer_format(path: str) -> str:
    for s in SUFFIXES:
        if path.rstrip("/").endswith(s):
            return s[1:]
    raise ValueError(f"unknown format: {path}")


def msgpack(value: Any) -> bytes:
    """The parts of MessagePack that JSON values need."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        return struct.pack(">Bq", 0xD3, value) if not 0 <= value < 128 else bytes([value])
    if isinstance(value, float):
        return struct.pack(">Bd", 0xCB, value)
    if isinstance(value, str):
        raw = value.encode()
        return struct.pack(">BI", 0xDB, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return struct.pack(">BI", 0xDD, len(value)) + b"".join(map(msgpack, value))
    return struct.pack(">BI", 0xDF, len(value)) + b"".join(msgpack(k) + msgpack(v) for k, v in value.items())


def unmsgpack(data: bytes, at: int = 0) -> tuple[Any, int]:
    """(value, where it ends)."""
    t, at = data[at], at + 1
    if t < 0x80 or t >= 0xE0:
        return (t if t < 0x80 else t - 256), at
    if t in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[t], at
    numbers = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}
    if t in numbers:
        f = ">" + numbers[t]
        return struct.unpack_from(f, data, at)[0], at + struct.calcsize(f)
    if 0xA0 <= t < 0xC0:
        n, kind = t & 31, "s"
    elif 0x90 <= t < 0xA0:
        n, kind = t & 15, "l"
    elif t < 0x90:
        n, kind = t & 15, "m"
    else:
        f, kind = {0xD9: (">B", "s"), 0xDA: (">H", "s"), 0xDB: (">I", "s"), 0xC4: (">B", "b"), 0xC5: (">H", "b"), 0xC6: (">I", "b"), 0xDC: (">H", "l"), 0xDD: (">I", "l"), 0xDE: (">H", "m"), 0xDF: (">I", "m")}[t]
        n, at = struct.unpack_from(f, data, at)[0], at + struct.calcsize(f)
    if kind in "sb":
        raw = data[at : at + n]
        return (raw.decode() if kind == "s" else raw), at + n
    items = []
    for _ in range(n * (2 if kind == "m" else 1)):
        value, at = unmsgpack(data, at)
        items.append(value)
    return (dict(zip(items[::2], items[1::2], strict=True)) if kind == "m" else items), at


def _lines(kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                raw = bytes(content)
                if kind == "jsonl.zst":
                    import zstandard

                    lines = zstandard.ZstdDecompressor().stream_reader(raw).read().decode().split("\n")
                else:
                    lines, at = [], 0
                    while at < len(raw):
                        value, at = unmsgpack(raw, at)
                        lines += [json.dumps(x) for x in (value if isinstance(value, list) else [value])]
                yield pd.DataFrame({"value": [x for x in lines if x.strip()]})

    return run


def load(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None, skip_bad: bool = False) -> DataFrame:
    """Records of a file or folder. Malformed lines raise unless skip_bad. Columns that export flattened are decoded."""
    kind = kind or infer_format(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
        for f in df.schema.fields:
            if NESTED_KEY in f.metadata:
                df = df.withColumn(f.name, F.from_json(f"`{f.name}`", f.metadata[NESTED_KEY]))
        return df
    reader = spark.read.option("mode", "DROPMALFORMED" if skip_bad else "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader
    if kind in ("jsonl", "jsonl.gz"):
        return reader.json(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_lines(kind), "value string")
    kind_of = schema if schema is not None else spark.read.json(lines.rdd.map(lambda r: r[0])).schema
    return lines.select(F.from_json("value", kind_of if isinstance(kind_of, str) else kind_of.simpleString(), {"mode": "PERMISSIVE" if skip_bad else "FAILFAST"}).alias("r")).select("r.*")


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as JSON strings; their types are kept in the columns' metadata."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name, metadata={NESTED_KEY: f.dataType.simpleString()}) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


WRITTEN = "path string, n long"


def _write_parts(folder: str, kind: str):
    """One file a partition: JSON lines in zstd frames, or a packed list of records. Files of failed attempts have names of their own and stay unlisted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        name, n, out, close = f"part-{uuid.uuid4().hex}.{kind}", 0, None, []
        for f in frames:
            for line in f["value"]:
                if out is None:
                    where.create_dir(base, recursive=True)
                    raw = where.open_output_stream(f"{base}/{name}", compression=None)
                    if kind == "jsonl.zst":
                        import zstandard

                        out = zstandard.ZstdCompressor().stream_writer(raw, closefd=False)
                        close = [out, raw]
                    else:
                        out, close = raw, [raw]
                out.write((line + "\n").encode() if kind == "jsonl.zst" else msgpack(json.loads(line)))
                n += 1
        for c in close:
            c.close()
        if out is not None:
            yield pd.DataFrame([(f"{folder}/{name}", n)], columns=["path", "n"])

    return run


def _replace(spark: SparkSession, made: str, path: str, only: set[str] | None = None) -> None:
    """Put a finished folder in the place of another one: the old one is moved aside, and goes when the new one is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old, aside = hadoop(made), hadoop(path), hadoop(made + ".old")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if only is not None:
        for f in fs.listStatus(new):
            if f.getPath().getName() not in only:
                fs.delete(f.getPath(), False)
    fs.mkdirs(old.getParent())
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"cannot put {path} in place")
    if had:
        fs.delete(aside, True)


def export(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Write a folder of part files beside the place it is meant for and move it there when all are done, so a failure leaves what was there.

    A packed file is a sequence of records, as many as its partition holds."""
    import uuid

    kind, spark = kind or infer_format(path), df.sparkSession
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    only = None
    if kind == "parquet":
        flatten(df).write.parquet(made)
    elif kind in ("jsonl", "jsonl.gz"):
        df.write.option("ignoreNullFields", False).option("compression", "gzip" if kind == "jsonl.gz" else "none").json(made)
    elif kind in ("jsonl.zst", "msgpack"):
        lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
        rows = lines.mapInPandas(_write_parts(made, kind), WRITTEN).collect()  # a row a file
        only = {r["path"].rpartition("/")[2] for r in rows}
        if not rows:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(made)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    else:
        raise ValueError(f"cannot write {kind}")
    _replace(spark, made, path, only)


def export_strict(df: DataFrame, path: str, kind: str | None = None) -> dict[str, int]:
    """Audit before writing: nothing is written if a residual is found. Returns the residual counts."""
    from ..functions.text import residual_counts

    found = {r["kind"]: r["n"] for r in residual_counts(df).collect()}
    if not any(found.values()):
        export(df, path, kind)
    return found


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def sidecar(df: DataFrame, source: str, params: dict) -> str:
    """Provenance as JSON: source, parameters, schema, rows and filled columns, from one aggregation."""
    row = df.agg(F.count("*").alias("n"), *[F.count(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]).first()
    kept = {k: (len(v) if k == "redact" else v) for k, v in params.items()}  # never the terms themselves
    return json.dumps({"source": source, "params": kept, "schema": json.loads(df.schema.json()), "records": row["n"], "filled": {c: row[f"c{k}"] for k, c in enumerate(df.columns)}}, sort_keys=True)


def dataset_card(name: str, df: DataFrame, description: str = "") -> dict:
    """A Croissant description of a table."""
    fields = [{"@type": "cr:Field", "name": f.name, "dataType": f.dataType.simpleString()} for f in df.schema.fields]
    return {"@context": {"@vocab": "https://schema.org/", "cr": "http://mlcommons.org/croissant/"}, "@type": "Dataset", "conformsTo": "http://mlcommons.org/croissant/1.1", "name": name, "description": description, "recordSet": [{"@type": "cr:RecordSet", "name": "records", "field": fields}]}

"""What the operators share: tables, the folder all executors see, and files in any store."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 512
#: Python workers live for many tasks; they give back what they have freed instead of keeping it for later.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches (texts may be long), and this package on the path of local Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("RAYON_NUM_THREADS", "1")
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own, but only in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="loomtrail-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and of which everything needed is written elsewhere by now."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            df._stored_at = None


def utf8_bytes(text: str | Column = "text") -> Column:
    """UTF-8 length; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")


def hash64(*cols: Column) -> Column:
    """A non-negative 60-bit number from md5, so that any engine can compute it: parts joined by '|', null as ''."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df but for columns of these names, in any case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in a local, HDFS or object store."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:") if uri.startswith(("/", "file:")) else "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def ensure_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, so that others can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])

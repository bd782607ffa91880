"""Where queries are registered: a function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _ready(f):
    """f, with this package on the path of local Python workers, wherever the driver was started."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
        return f(spark, sf_dir)

    return run


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = _ready(f)
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Event types of the `events` table as atoms of a work session.
ATOMS = {"click": "SEARCH", "view": "OPEN_SRC_PY", "purchase": "EDIT_SRC_PY", "signup": "RUN_PYTEST_TEST_PY", "error": "SUBMIT"}


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, agent, pos, type, atom, ts, value, k: a session per user, events in order."""
    from ..operators.sequences import positions

    e = table(spark, sf_dir, "events")
    atom = F.create_map(*[F.lit(x) for kv in ATOMS.items() for x in kv])
    return positions(
        e.select(
            F.col("user_id").alias("id"),
            F.pmod("user_id", F.lit(4)).alias("agent"),
            F.col("event_type").alias("type"),
            F.element_at(atom, F.col("event_type")).alias("atom"),
            "ts",
            "event_id",
            "value",
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        ),
        "id",
        "ts",
        "event_id",
    )


TRACES = (
    "ev AS (SELECT user_id AS id, user_id % 4 AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS type, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ATOMS.items())
    + " END AS atom, ts, event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"
)


def rounded(c, digits: int = 6):
    return F.round(c, digits)


def half_up(c, digits: int = 6):
    """Numbers that are not negative, rounded as the SQL does; unlike F.round without a decimal object a row, for many rows."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits

"""Session defaults and the few plan-level facts operators ask for."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_BYTES_KEY = "spark.tablewright.smallTableBytes"
SMALL_BYTES_DEFAULT = 32 * 1024 * 1024


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster callers bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors of the session, once.

    Functions that run in Python workers are sent by name; the workers find
    them in the archive wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tablewright-")) / "tablewright.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate of the plan's output; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, share: float = 1.0) -> bool:
    """True when the plan's estimated output fits (a share of) one task's limit.

    Operators use it to choose between a one-task form and a distributed form
    of the same exact result; an unknown size counts as large.
    """
    limit = df.sparkSession.conf.get(SMALL_BYTES_KEY, str(SMALL_BYTES_DEFAULT))
    return plan_bytes(df) <= int(limit) * share


def _shared_dir(spark: SparkSession) -> str:
    """The folder all executors share for intermediate tables."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tablewright-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    Used where a result must be identical for every later reader (numbered
    partitions) or where an iteration would otherwise grow its lineage.
    """
    _shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Calls whose jobs Spark may be given at the same time.
TOGETHER = 8


def together(spark: SparkSession, calls: Sequence[Callable[[], Any]]) -> list[Any]:
    """What each of ``calls`` returns, each in a thread of its own.

    For chains of short jobs that do not need each other: Spark runs the jobs
    of all chains side by side instead of waiting for each chain's driver.
    """
    if len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(min(TOGETHER, len(calls))) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]]


#: Rows of a partition that many passes read.
PASS_ROWS = 32_768


def spread(df: DataFrame) -> DataFrame:
    """``df`` staged, in partitions of ``PASS_ROWS`` rows where it came in larger ones.

    A well compressed file of millions of rows is one partition; what passes
    over it again and again would keep one core busy.
    """
    held = stage(df)
    parts = -(-held.count() // PASS_ROWS)
    return stage(held.repartition(parts)) if parts > held.rdd.getNumPartitions() else held


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on equal keys where null equals null, with the keys of ``left``.

    Groups by a null key are groups like any other; ``USING`` would lose them.
    ``small`` broadcasts ``right``, whose size the caller has checked.
    """
    named = right.withColumnsRenamed({k: f"_match_{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_match_{i}"))
    joined = left.join(F.broadcast(named) if small else named, same, how)
    return joined.drop(*[f"_match_{i}" for i in range(len(keys))])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join per-group values to the rows of each group; a null key is a group.

    The groups are computed once and measured. If they are small, they are
    broadcast and the rows, hot groups included, stay where they are; otherwise
    Spark joins on the keys and splits hot ones at run time.
    """
    fixed = stage(groups)
    limit = int(rows.sparkSession.conf.get(SMALL_BYTES_KEY, str(SMALL_BYTES_DEFAULT)))
    # Arrays count with all their values: the length of the row as text, 8 bytes a value at least.
    each = F.length(F.to_json(F.struct("*"))) + F.lit(32 * len(fixed.columns))
    held = fixed.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    return match(rows, fixed, keys, how, small=held <= limit)


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the shared folder, for a stream's output or progress."""
    return f"{_shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def scalars(row: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery.

    The subquery runs once and is shared by every expression that uses it, so
    statistics reach the rows without a join and without leaving the plan.
    """
    return row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias("s")).scalar()


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames side by side as one row.

    Aggregates that already contain scalar subqueries are combined this way:
    Catalyst's merging of nested scalar subqueries is not dependable.
    """
    out = first
    for other in others:
        out = out.join(F.broadcast(other))
    return out


def attach(df: DataFrame, row: DataFrame, name: str = "_s") -> DataFrame:
    """Add the one-row frame ``row`` to every row of ``df`` as struct ``name``."""
    return df.withColumn(name, scalars(row))

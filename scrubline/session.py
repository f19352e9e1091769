"""Session helpers shared by the operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scrubline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session; Spark sends the archive from the driver."""
    context = spark.sparkContext
    if getattr(context, "_scrubline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='scrubline-')}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._scrubline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table called name of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only where neither that setting nor a folder set before exists, as in tests
    on one machine, a folder of this machine is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    context.setCheckpointDir(named or Path(tempfile.mkdtemp(prefix="scrubline-")).as_uri())


def work_folder(spark: SparkSession) -> str:
    """A new folder for files that several steps share, in the shared checkpoint folder; its address, as Spark takes it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/work-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def only(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The needed columns of df, cast to the types given, whatever else df has.

    A column is taken by its exact name, else by the only one that differs in letter
    case; of several columns with that exact name the first counts.
    """
    places = {}
    for name in columns:
        alike = [i for i, n in enumerate(df.columns) if n.lower() == name.lower()]
        exact = [i for i in alike if df.columns[i] == name]
        if not exact and len(alike) != 1:
            raise ValueError(f"missing column: {name}")
        places[name] = (exact or alike)[0]
    # By place, as other columns may have clashing names.
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return numbered.select(*(numbered[f"c{places[c]}"].cast(t).alias(c) for c, t in columns.items()))

"""Recipes replayed over streams: each micro-batch through the same plan as a table."""

from __future__ import annotations

import shutil
import uuid
import warnings
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubline.errors import DriftError, ScrublineError
from scrubline.plans.drift import HASHED_ROWS, detect_drift
from scrubline.plans.engine import REASON, execute
from scrubline.plans.ops import COMPARISON
from scrubline.plans.recipe import Op, Recipe, ValidationRule
from scrubline.plans.registry import CHECKS, ROW_ID, op_spec
from scrubline.session import work_folder
from scrubline.sources.assembly import crosses_lines, file_lines
from scrubline.sources.files import read_table, write_table

_LOCAL_CHECKS = frozenset({"not_null", "valid_email", "valid_url", "valid_phone"})


@dataclass
class StreamSummary:
    """What a replay did; batches are micro-batches."""

    rows_in: int = 0
    rows_out: int = 0
    changed: int = 0
    dropped: int = 0
    quarantined: int = 0
    batches: int = 0


def op_streams(op: Op) -> bool:
    """Whether an operation gives the same batch by batch as over the whole table; no, unless it is known."""
    return bool(op_spec(op.name).streamable(op.params))


def rule_streams(rule: ValidationRule) -> bool:
    """Whether a check needs only its own row."""
    check = rule.check.strip()
    return check in _LOCAL_CHECKS or bool(COMPARISON.match(check)) or (check not in CHECKS and check.split(":")[0].split()[0] in ("in", "matches", "regex"))


def check_streamable(recipe: Recipe) -> None:
    """Raise with the first operation or check that needs the whole table."""
    for where, op in [*((f"column {x.source!r}", o) for x in recipe.columns for o in x.ops), *(("the table", o) for o in recipe.frame_ops)]:
        if not op_streams(op):
            raise ScrublineError(f"{op.name} on {where} needs the whole table and cannot be streamed")
    for rule in recipe.validations:
        if not rule_streams(rule):
            raise ScrublineError(f"check {rule.label} needs the whole table and cannot be streamed")


def replay_stream(recipe: Recipe, source: DataFrame, out: str, quarantine: str, checkpoint: str, mode: str = "review", fmt: str = "parquet", counted: bool = True) -> StreamSummary:
    """A streaming DataFrame through a recipe, until what is there now is done.

    Each micro-batch writes its clean rows and its held rows to folders of its own
    number, so a batch that is run again after a failure replaces itself.
    """
    check_streamable(recipe)
    summary = StreamSummary()

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist() if counted else df
        done = execute(recipe, df, mode)
        done.output().write.mode("overwrite").format(fmt).save(f"{out}/batch={number}")
        held = done.quarantine.drop(ROW_ID)
        held.write.mode("overwrite").format(fmt).save(f"{quarantine}/batch={number}")
        if counted:
            summary.rows_in += df.count()
            summary.rows_out += done.cleaned.count()
            summary.quarantined += done.quarantine.count()
            summary.dropped += done.dropped.count()
            summary.changed += done.diff.count()
            df.unpersist()
        summary.batches += 1

    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return summary


def _checked_head(spark: SparkSession, recipe: Recipe, path: str, mode: str, on_drift: str) -> None:
    """Raise or warn if the first rows of a file differ in columns or types from what the recipe was made for."""
    if not recipe.fingerprint:
        warnings.warn("the recipe has no fingerprint, so changes of the input are not looked for", stacklevel=3)
        return
    how = {k: v for k, v in recipe.read.items() if k in ("columns", "skiprows", "sep", "encoding")}
    found = [f for f in detect_drift(recipe, read_table(spark, path, nrows=HASHED_ROWS, **how)) if f.severity != "info"]
    if found and (on_drift == "error" or mode == "strict"):
        raise DriftError("; ".join(f.message for f in found))
    if found and on_drift == "warn":
        warnings.warn("; ".join(f.message for f in found), stacklevel=3)


def replay_file(spark: SparkSession, recipe: Recipe, path: str, out: str, mode: str = "review", quarantine: str | None = None, max_files: int = 1, on_drift: str = "error") -> StreamSummary:
    """A CSV file or folder through a recipe, all columns as text, with the results in place only once all of it is done.

    out is one CSV file if it ends so, else a folder of Parquet parts. Held rows go
    beside it (quarantine, or out with .quarantine before its suffix), as a file only
    if there are any. The recipe's separator, encoding and columns are used; its first
    rows are checked for changes (on_drift error, warn or ignore).
    """
    suffix = Path(path).suffix.lower()
    if suffix not in (".csv", ".txt", ".tsv", ""):
        raise ScrublineError(f"only CSV can be streamed, not {suffix}")
    check_streamable(recipe)
    if unfit := {"nrows", "skiprows"} & {k for k, v in recipe.read.items() if v}:
        raise ScrublineError(f"the recipe reads with {', '.join(sorted(unfit))}, which cannot be streamed")
    if on_drift != "ignore" and Path(path).is_file():
        _checked_head(spark, recipe, path, mode, on_drift)
    sep = recipe.read.get("sep") or ("\t" if suffix == ".tsv" else ",")
    charset = {"utf-8-sig": "UTF-8", "cp1252": "windows-1252"}.get(recipe.read.get("encoding", "utf-8-sig"), recipe.read.get("encoding"))
    options = {"header": True, "sep": sep, "encoding": charset, "quote": '"', "escape": '"', "multiLine": crosses_lines(file_lines(spark, path), sep)}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    folder = path if Path(path).is_dir() else str(Path(path).parent)
    source = spark.readStream.schema(schema).options(**options).option("maxFilesPerTrigger", max_files)
    source = source.option("recursiveFileLookup", True).option("pathGlobFilter", "*" if folder == path else Path(path).name).csv(folder)
    if recipe.read.get("columns"):
        source = source.select(*(F.col(f"`{n}`") for n in names if n in set(recipe.read["columns"])))
    single = Path(out).suffix.lower() in (".csv", ".tsv", ".txt")
    held_out = quarantine or (str(Path(out).with_suffix(f".quarantine{Path(out).suffix}")) if single else f"{out}.quarantine")
    work = Path(out).with_name(f".{Path(out).name}.{uuid.uuid4().hex}")
    try:
        made = replay_stream(recipe, source, f"{work}/clean", f"{work}/held", f"{work}/checkpoint", mode)
        for part, target in (("clean", out), ("held", held_out)):
            rows = spark.read.parquet(f"{work}/{part}").drop("batch") if (work / part).exists() else spark.createDataFrame([], source.schema)
            if single and (part == "clean" or made.quarantined):
                write_table(rows, target)
            elif not single:
                shutil.rmtree(target, ignore_errors=True)
                if (work / part).exists():
                    shutil.move(str(work / part), target)
                else:
                    rows.write.parquet(target)
        return made
    finally:
        shutil.rmtree(work, ignore_errors=True)


def replay_to_table(spark: SparkSession, recipe: Recipe, df: DataFrame) -> DataFrame:
    """df written, replayed as a stream of files, and the clean rows read again."""
    work = work_folder(spark)
    df.write.parquet(f"{work}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{work}/in")
    replay_stream(recipe, source, f"{work}/out", f"{work}/held", f"{work}/state", counted=False)
    return spark.read.parquet(f"{work}/out").drop("batch", REASON)


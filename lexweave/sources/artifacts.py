"""Configuration, artifacts, cached steps, text-line exchange and external tools."""

from __future__ import annotations

import dataclasses
import os
import shlex
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge(base: Mapping[str, Any], *overlays: Mapping[str, Any] | None) -> dict[str, Any]:
    """``base`` with the values of the overlays in turn; nested mappings are merged, None overlays are passed over."""
    out = dict(base)
    for overlay in overlays:
        for k, v in (overlay or {}).items():
            out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def truth(value: str | None, default: bool = False) -> bool:
    """A switch: 1, true, yes, y and on are true in any case, None is the default."""
    return default if value is None else value.strip().lower() in {"1", "true", "yes", "y", "on"}


def from_environment(config, prefix: str = "LEXWEAVE_", environment: Mapping[str, str] | None = None):
    """A dataclass instance with the fields that the environment names (prefix and upper-case field), read as the type of the field's value."""
    held = os.environ if environment is None else environment
    found = {}
    for f in dataclasses.fields(config):
        text = held.get(f"{prefix}{f.name.upper()}")
        if text is not None:
            now = getattr(config, f.name)
            found[f.name] = truth(text) if isinstance(now, bool) else type(now)(text) if isinstance(now, (int, float, str)) else text
    return dataclasses.replace(config, **found)


def _found(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _found(spark, path)
    return system.exists(p)


def bytes_below(spark: SparkSession, path: str) -> int:
    """Bytes of the file or of all files of the folder; 0 where there is none."""
    system, p = _found(spark, path)
    return system.getContentSummary(p).getLength() if system.exists(p) else 0


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The table at ``path``, made by ``build`` and written there first where there is none, an unfinished one, or ``fresh`` asks for it."""
    if fresh or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """The pipeline at ``path``; None where there is none, so a policy without its model can degrade."""
    spark = SparkSession.active()
    return PipelineModel.load(path) if exists(spark, f"{path.rstrip('/')}/metadata") else None


def save_splits(sentences: DataFrame, path: str, seed: int = 42, part: float = 0.2) -> tuple[str, str]:
    """Training and validation Parquet folders beside each other, split within each language; returns their paths."""
    from lexweave.operators.sampling import holdout

    paths = f"{path.rstrip('/')}_train", f"{path.rstrip('/')}_valid"
    for df, p in zip(holdout(sentences, seed, part), paths):
        df.write.mode("overwrite").parquet(p)
    return paths


def write_examples(rows: DataFrame, path: str) -> None:
    """Training examples as JSON lines, one object a row; nulls are left out."""
    rows.write.mode("overwrite").json(path)


def write_numbered_lines(sentences: DataFrame, path: str, partitions: int | None = None) -> None:
    """``sent_id``, a tab and the words joined by spaces: the line carries its sentence, so no file order is needed."""
    rows = sentences.select(F.concat_ws("\t", F.col("sent_id").cast("string"), F.array_join("raw", " ")).alias("value"))
    (rows.repartition(partitions) if partitions else rows).write.mode("overwrite").text(path)


def read_numbered_lines(sentences: DataFrame, path: str) -> DataFrame:
    """``sent_id, lang, raw, pred, status`` from lines that a tool answered with: ``ok``, or the words as they are where a line is missing, doubled or of another length."""
    lines = sentences.sparkSession.read.text(path).select(F.split("value", "\t", 2).alias("z"))
    lines = lines.select(F.try_to_number(F.get("z", F.lit(0)), F.lit("9" * 18)).cast("long").alias("sent_id"), F.filter(F.split(F.coalesce(F.get("z", F.lit(1)), F.lit("")), " "), lambda w: w != "").alias("pred"))
    lines = lines.groupBy("sent_id").agg(F.count("*").alias("n"), F.min("pred").alias("pred"))
    t = sentences.select("sent_id", "lang", "raw").join(lines, "sent_id", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "doubled").when(F.size("pred") != F.size("raw"), "length").otherwise("ok")
    return t.withColumn("status", status).select("sent_id", "lang", "raw", F.when(F.col("status") == "ok", F.col("pred")).otherwise(F.col("raw")).alias("pred"), "status")


def line_counts(sentences: DataFrame, answered: DataFrame) -> DataFrame:
    """``lang, status, n`` of ``read_numbered_lines``: all ``ok`` where a tool answered every line."""
    return answered.groupBy("lang", "status").agg(F.count("*").alias("n"))


def external(sentences: DataFrame, command: str | None, timeout: int = 600) -> DataFrame:
    """``sent_id, lang, raw, pred`` of a program that reads lines of words and writes as many; without a command the words as they are.

    ``command`` has ``{input}`` and ``{output}`` for two files. It runs once a
    batch where the rows are, in a folder of the task that is removed after it;
    an error or another number of lines fails the task, a line of another
    length copies the words. It is run without a shell.
    """
    kept = sentences.select("sent_id", "lang", "raw")
    if not command:
        return kept.withColumn("pred", F.col("raw"))

    def run(batches):
        for pdf in batches:
            words = [list(w) for w in pdf["raw"]]
            with tempfile.TemporaryDirectory() as folder:
                source, target = Path(folder, "in.txt"), Path(folder, "out.txt")
                source.write_text("".join(" ".join(w) + "\n" for w in words), encoding="utf-8")
                parts = [p.format(input=source, output=target) for p in shlex.split(command)]
                subprocess.run(parts, check=True, timeout=timeout, capture_output=True)
                lines = target.read_text(encoding="utf-8").split("\n")
            lines = lines[:-1] if lines and not lines[-1] else lines
            if len(lines) != len(words):
                raise ValueError(f"{len(lines)} lines came back for {len(words)}")
            answers = [line.split() for line in lines]
            yield pdf.assign(pred=[a if len(a) == len(w) else w for a, w in zip(answers, words)])

    return kept.mapInPandas(run, "sent_id long, lang string, raw array<string>, pred array<string>")


def missing_path(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset a local session (tests) takes a temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: what several parts of a plan need is worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Sets of result tables that appear at once, with the papers that belong to them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.sequences import trace_signature
from loomtrace.operators.evaluation import confusion, confusion_rows
from loomtrace.operators.quality import counters, missing_keys, repeated_keys, union_checks
from loomtrace.sources.files import provenance, read_json, save_json, write_parquet


@contextmanager
def staged(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder to write to, which takes the name ``folder`` if all goes well and is removed if not. It is an error if
    ``folder`` exists. Works on every file system that Spark's Hadoop client knows."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    target, part = paths(folder), paths(f"{folder.rstrip('/')}.part-{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(folder)
    try:
        yield part.toString()
        if not system.rename(part, target):
            raise OSError(f"could not rename {part.toString()}")
    except BaseException:
        system.delete(part, True)
        raise


def block_sequences(traces: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """The table of prepared traces: ``block_id``, ``trace_signature``, ``event_ids`` and ``template_sequence`` (JSON
    arrays), ``sequence_length``, ``label``, ``conflicting_trace``. What a sequence is written as is made once for each
    distinct sequence and joined to its blocks."""
    names = F.create_map(*(F.lit(x) for pair in templates.items() for x in pair))
    patterns = traces.groupBy("event_ids").agg((F.count_distinct("label") > 1).alias("conflicting_trace")).select(
        "event_ids", trace_signature(F.col("event_ids")).alias("trace_signature"), F.to_json("event_ids").alias("_ids"),
        F.to_json(F.transform("event_ids", lambda e: F.element_at(names, e))).alias("template_sequence"), F.size("event_ids").alias("sequence_length"), "conflicting_trace",
    )
    joined = traces.select("block_id", "label", "event_ids").join(patterns, "event_ids")
    return joined.select("block_id", "trace_signature", F.col("_ids").alias("event_ids"), "template_sequence", "sequence_length", "label", "conflicting_trace")


def write_confusions(predictions: DataFrame, path: str, *run: str) -> None:
    """The confusion matrix of every run as CSV, in one folder for each run."""
    named = predictions.withColumn("run", F.concat_ws("_", *run))
    confusion_rows(confusion(named, "run"), "run").repartition("run").write.partitionBy("run").option("header", True).csv(path)


def schema_paper(path: str | Path, **tables: DataFrame) -> None:
    """Columns and types of tables as JSON."""
    save_json(path, {name: {f.name: f.dataType.simpleString() for f in df.schema} for name, df in tables.items()})


def provenance_paper(path: str | Path, spark: SparkSession, folder: str, checks: DataFrame, settings: Mapping[str, object]) -> None:
    """Where a result comes from: every source file with size and SHA-256, the counts of all checks, and the settings."""
    files = [r.asDict() for r in provenance(spark, folder).orderBy("name").collect()]  # one row for each file
    save_json(path, {"sources": files, "checks": {r["check"]: r["violations"] for r in checks.collect()}, "settings": dict(settings)})


def encoded_tables(folder: str | Path, sources: Mapping[str, DataFrame], encode: Callable[[DataFrame], DataFrame], sign: str) -> dict[str, bool]:
    """Encode each source once and keep its vectors as a table; whether it was encoded now. A table that was made under the
    same signature is left as it is, another one is replaced."""
    made = {}
    for name, df in sources.items():
        paper = Path(folder, f"{name}.json")
        made[name] = not (paper.exists() and read_json(paper).get("signature") == sign)
        if made[name]:
            paper.unlink(missing_ok=True)  # half a table has no paper
            write_parquet(encode(df), str(Path(folder, name)), mode="overwrite")
            save_json(paper, {"signature": sign})
    return made


def encoded(spark: SparkSession, folder: str | Path, name: str, sign: str) -> DataFrame:
    """A table of vectors; an error where it is missing or was made under another signature."""
    paper = Path(folder, f"{name}.json")
    if not paper.exists() or read_json(paper).get("signature") != sign:
        raise ValueError(f"no vectors of {name} for these settings: encode them first")
    return spark.read.parquet(str(Path(folder, name)))


def vector_checks(rows: DataFrame, vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Whether vectors stand for the rows: rows without, vectors beyond the rows, repeated and empty ones."""
    return union_checks(
        missing_keys(rows, vectors, key, "rows_without_vector"), missing_keys(vectors, rows, key, "vectors_without_row"), repeated_keys(vectors, key, "repeated_vectors"),
        counters(vectors, empty_vectors=F.coalesce(F.size(vector), F.lit(0)) <= 0),
    )


def mixed_knowledge_checks(variants: DataFrame) -> DataFrame:
    """Whether the mixed knowledge base is the normal one and then the anomaly one, each in its order: entries of
    ``variants`` (``variant``, ``kb_index``, ``label``, ``pattern``) that differ from it."""
    sizes = variants.where("variant = 'normal'").agg(F.count("*").alias("normals"))
    wanted = variants.where("variant <> 'mixed'").join(F.broadcast(sizes)).withColumn("at", F.col("kb_index") + F.when(F.col("variant") == "anomaly", F.col("normals")).otherwise(0))  # one row
    both = wanted.select("at", "label", "pattern").join(variants.where("variant = 'mixed'").select(F.col("kb_index").alias("at"), F.col("label").alias("_label"), F.col("pattern").alias("_pattern")), "at", "full")
    same: Column = F.col("label").eqNullSafe(F.col("_label")) & F.col("pattern").eqNullSafe(F.col("_pattern"))
    return counters(both, mixed_entries_differ=~same)


def comparable(reports: DataFrame, expected: str, column: str = "query_manifest") -> DataFrame:
    """Rows of a report that were made for other queries than the expected ones."""
    return counters(reports, rows_of_other_queries=~F.col(column).eqNullSafe(F.lit(expected)))

"""Queries, stages and experiments from the command line."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtrace import runs
from loomtrace.operators import experiment as X
from loomtrace.operators.classify import encode_texts
from loomtrace.operators.evaluation import report_order, run_summary
from loomtrace.operators.report import write_report
from loomtrace.operators.splits import hash_split, normal_knowledge, with_template_text
from loomtrace.plans import registry
from loomtrace.plans.base import signed, templates, traces
from loomtrace.sources import publish
from loomtrace.sources.files import write_parquet

PREPARED = ("normal_kb", "kb_variants", "hash_group_split", "stratified_split", "evaluation_annotations", "conflicting_sequences", "split_composition", "seen_unseen_by_label")
PROFILE = (
    "quality_counters", "event_statistics", "transitions", "summary_by_label_length", "summary_by_label_latency", "type_missingness", "type_distribution",
    "length_ecdf", "latency_ecdf", "unique_event_rates", "group_size_histogram", "duplicate_summary", "trace_examples", "missing_value_counts",
)
REPORTED = ("duplicate_summary", "quality_counters", "type_missingness", "summary_by_label_length", "summary_by_label_latency", "event_statistics")


def stage(spark: SparkSession, names: tuple[str, ...], folder: str, out: str) -> None:
    """Tables of a stage, all at once or none, with their schemas and provenance beside them."""
    queries = registry.queries()
    with publish.staged(spark, out) as part:
        for name in names:
            write_parquet(queries[name](spark, folder), f"{part}/{name}")
        if "normal_kb" in names:
            write_parquet(publish.block_sequences(traces(spark, folder), templates(spark, folder)), f"{part}/block_sequences")
    publish.schema_paper(Path(out, "schemas.json"), **{n: spark.read.parquet(f"{out}/{n}") for n in names})
    publish.provenance_paper(Path(out, "provenance.json"), spark, folder, queries["quality_counters"](spark, folder), {"tables": list(names)})


def profile(spark: SparkSession, folder: str, out: str) -> None:
    stage(spark, PROFILE, folder, out)
    parts = {name: [r.asDict() for r in spark.read.parquet(f"{out}/{name}").limit(40).collect()] for name in REPORTED}  # a report shows the first rows
    write_report(Path(out, "REPORT.md"), "Profile of the traces", parts, folder)


def embed(spark: SparkSession, folder: str, out: str) -> None:
    """Vectors of the knowledge base's texts, by the stand-in encoder, unless they are there already."""
    knowledge = with_template_text(normal_knowledge(hash_split(signed(traces(spark, folder)))), templates(spark, folder)).select("sig", "template_text")
    print(json.dumps(publish.encoded_tables(Path(out, "vectors"), {"normal_kb": knowledge}, lambda df: encode_texts(df, "sig", "template_text"), runs.digest({"folder": folder, "encoder": "hash"}))))


def experiment(spark: SparkSession, folder: str, out: str) -> None:
    """Test predictions of all methods, their scores, confusion matrices and locked thresholds."""
    rows = hash_split(signed(traces(spark, folder)))
    log = lambda text: print(text, flush=True)
    with publish.staged(spark, out) as part:
        with runs.timed(log, "answers of all runs"):
            said, locked = X.run_experiment(rows, templates(spark, folder))
            write_parquet(said, f"{part}/predictions")
            write_parquet(locked, f"{part}/locks")
        said = spark.read.parquet(f"{part}/predictions")
        with runs.timed(log, "scores"):
            numbered = said.withColumns({"query_seconds_uncached": F.col("latency_seconds"), "candidate_count": F.lit(X.POOL), "filtered_out": F.lit(X.POOL) - F.col("context_count"), "context_setting": F.col("setting")})
            write_parquet(run_summary(numbered, "method", "kb", "context_setting"), f"{part}/summary")
            publish.write_confusions(said, f"{part}/confusion", "method", "kb", "setting")
    wrong = X.identity_violations(said_again := spark.read.parquet(f"{out}/predictions"), X.queries_of(rows).where("split = 'test'"), "method", "kb", "setting").where("violations > 0")
    if broken := [r["check"] for r in wrong.collect()]:
        raise ValueError(f"failed checks: {', '.join(broken)} in {said_again.inputFiles()[:1]}")


def report(spark: SparkSession, out: str) -> None:
    """The scores of an experiment as a readable report, in reading order."""
    rows = report_order(spark.read.parquet(f"{out}/summary").withColumn("contexts", F.regexp_extract("context_setting", r"^k(\d+)$", 1).try_cast("int")))
    columns = ("method", "kb", "context_setting", "queries", "precision", "recall", "f1", "average_contexts", "average_prompt_tokens")
    write_report(Path(out, "REPORT.md"), "Runs", {"test": [r.asDict() for r in rows.select(*columns).collect()]}, out)  # one row for each run


def checked(spark: SparkSession, name: str, folder: str) -> int:
    """Print the checks that fail; 1 if any does."""
    broken = registry.queries()[name](spark, folder).where(F.col("violations") > 0).collect()
    for row in broken:
        print(f"{row['check']}: {row['violations']}")
    return int(bool(broken))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomtrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, takes in {"list": "", "run": "query folder", "prepare": "folder out", "profile": "folder out", "verify": "folder", "delivered": "folder", "audit": "folder", "embed": "folder out", "experiment": "folder out", "report": "out", "all": "folder out"}.items():
        command = commands.add_parser(name)
        for argument in takes.split():
            command.add_argument(argument)
        if name in ("list", "run"):
            command.add_argument("--out")
            command.add_argument("--module", action="append", default=[], help="a module with further QUERIES, such as that of the operators for training data")
    given = parser.parse_args(arguments)
    if given.command in ("list", "run"):
        queries = registry.queries()
        for module in given.module:
            queries |= importlib.import_module(module).QUERIES
        if given.command == "list":
            print("\n".join(sorted(queries)))
            return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "run":
        made = queries[given.query](spark, given.folder)
        write_parquet(made, given.out) if given.out else made.show(50, truncate=120)
        return 0
    if given.command in ("verify", "delivered"):
        return checked(spark, {"verify": "verifier_checks", "delivered": "delivered_checks"}[given.command], given.folder)
    if given.command == "audit":
        registry.queries()["audit_ratios"](spark, given.folder).show(truncate=False)
        return 0
    if given.command == "report":
        report(spark, given.out)
        return 0
    folder, out = given.folder, given.out
    steps = {
        "prepare": lambda to: stage(spark, PREPARED, folder, to), "profile": lambda to: profile(spark, folder, to), "embed": lambda to: embed(spark, folder, to), "experiment": lambda to: experiment(spark, folder, to),
    }
    if given.command == "all":
        for name, step in steps.items():
            step(str(Path(out, name)))
        report(spark, str(Path(out, "experiment")))
    else:
        steps[given.command](out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

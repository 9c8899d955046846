"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm._common import delete_at_exit, delete_paths, reads_any, scratch_scope, shared_dir
from shelfspark.llm.decontaminate import decontamination_stage
from shelfspark.llm.language_id import language_stage
from shelfspark.llm.line_dedup import line_stage
from shelfspark.llm.near_copies import simhash_stage
from shelfspark.llm.packing import packing_stage

#: Scratch tables of stages that were called one by one, by input folder.
_written: dict[str, list[str]] = {}


def _stage(function):
    """The stage as it is called by itself. What earlier stages on this input wrote to scratch goes once their result has been
    written: docs then no longer reads it. Where stages are chained without a write in between, it stays until the session ends."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not reads_any(docs, _written.setdefault(sf_dir, [])):
            delete_paths(spark, _written[sf_dir])
        with scratch_scope() as tables:
            out = function(spark, docs, sf_dir)
        _written[sf_dir] += tables
        return out

    return run_stage


FUNCTIONS = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
STAGES = [(name, _stage(function)) for name, function in FUNCTIONS]

#: Language ID and packing are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scratch tables and the stages' results are this run's own: they go when the next result has been written, the last when
    the session ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    before = []
    for name, function in FUNCTIONS:
        with scratch_scope() as tables:
            function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        delete_paths(spark, [*tables, *before])
        docs, before = spark.read.parquet(f"{folder}/{name}"), [f"{folder}/{name}"]
    return docs

"""Command line over the job operators: ``python -m docgrain COMMAND ...``.

A store is a folder with the tables jobs, parts, docs and edits. Commands that change it append; the
newest row of a job or edit counts.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import blocks, jobs, merge, outline, parts
from .sources.files import read_documents

KEYS = ["job_id", "part"]
EDITS = "job_id string, part int, source_hash string, text string, updated_at string"
#: Parts smaller than this aren't worth a request.
LEAST_SIZE = 200


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%S") + f".{time.time_ns() % 10**9:09d}"


def _table(spark: SparkSession, store: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{store}/{name}")
    return jobs.upsert(rows, rows.limit(0), ["job_id"] if name in ("jobs", "docs") else KEYS, "stored_at")


def _edits(spark: SparkSession, store: str) -> DataFrame:
    try:
        return spark.read.schema(EDITS).parquet(f"{store}/edits")
    except Exception as e:  # no edit yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], EDITS)


def _parts(spark: SparkSession, store: str) -> DataFrame:
    """Parts of the last split of each job."""
    rows = spark.read.parquet(f"{store}/parts")
    last = rows.groupBy("job_id").agg(F.max("stored_at").alias("stored_at"))
    return rows.join(last, ["job_id", "stored_at"])


def split(spark: SparkSession, store: str, path: str, size: int, target: str = "") -> DataFrame:
    """Splits the files at ``path`` into the store; splitting a changed file again keeps the edits of texts that stayed."""
    if size < LEAST_SIZE:
        raise ValueError(f"the size must be at least {LEAST_SIZE}")
    at, docs = _now(), read_documents(spark, path)
    docs = docs.withColumn("job_id", jobs.job_id(F.col("path"), F.lit(size)))
    rows = parts.split(docs, size, ["job_id"])
    for name, df in (("parts", rows), ("docs", docs), ("jobs", jobs.manifests(rows, docs, size, "job_id", target=target))):
        df.withColumn("stored_at", F.lit(at)).write.mode("append").parquet(f"{store}/{name}")
    return _table(spark, store, "jobs").where(F.col("stored_at") == at).select("job_id", "source_file", "total_parts")


def fresh(spark: SparkSession, store: str) -> DataFrame:
    return jobs.fresh_edits(_edits(spark, store), _parts(spark, store), KEYS)


def status(spark: SparkSession, store: str) -> DataFrame:
    state = jobs.staleness(_table(spark, store, "jobs"), _table(spark, store, "docs").select(F.col("path").alias("source_file"), "text"), "source_file")
    return jobs.status(_parts(spark, store), fresh(spark, store), KEYS).join(state.select("job_id", "source_file", "state"), "job_id")


def get(spark: SparkSession, store: str, job: str, part: int) -> DataFrame:
    wanted = spark.createDataFrame([(job, part)], "job_id string, part int")
    return jobs.get_parts(_parts(spark, store), fresh(spark, store), wanted, KEYS)


def put(spark: SparkSession, store: str, job: str, part: int, text: str, skip_verify: bool = False) -> DataFrame:
    rows = spark.createDataFrame([(job, part, text)], "job_id string, part int, text string")
    done = jobs.put_parts(_parts(spark, store), rows, KEYS, _now(), skip_verify).cache()
    columns = [c.split()[0] for c in EDITS.split(", ")]
    done.where("stored").select(*columns).write.mode("append").parquet(f"{store}/edits")
    return done.select(*KEYS, "stored", "reasons")


def merged(spark: SparkSession, store: str) -> DataFrame:
    own = _table(spark, store, "jobs")
    return jobs.merge_stamped(_parts(spark, store), fresh(spark, store), _table(spark, store, "docs").select("job_id", "text"), own, KEYS)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    top = argparse.ArgumentParser(prog="docgrain")
    commands = top.add_subparsers(dest="command", required=True)
    for name, given in {"split": ["store", "path"], "status": ["store"], "get": ["store", "job", "part"], "put": ["store", "job", "part", "file"],
                        "merge": ["store"], "outline": ["path"], "section": ["path", "address"], "verify": ["path", "rewritten"]}.items():
        c = commands.add_parser(name)
        for x in given:
            c.add_argument(x, type=int if x == "part" else str)
        if name == "split":
            c.add_argument("--size", type=int, default=8000)
            c.add_argument("--target", default="")
        if name == "put":
            c.add_argument("--skip-verify", action="store_true")
    a = top.parse_args(args)
    spark = spark or SparkSession.builder.appName("docgrain").getOrCreate()
    if a.command in ("outline", "section"):
        parsed = blocks.with_blocks(read_documents(spark, a.path).withColumnRenamed("path", "file"))
        if a.command == "outline":
            return outline.outline_text(outline.topics(parsed, ["file"])).orderBy("file", "block_idx").select("file", "rendered")
        return outline.sections(parsed, parsed.select("file", F.lit(a.address).alias("address")), ["file"])
    if a.command == "verify":
        texts = [read_documents(spark, p).first()["text"] for p in (a.path, a.rewritten)]
        pair = spark.createDataFrame([tuple(texts)], "source string, rewritten string")
        return merge.verify(pair).select("reasons")
    if a.command == "split":
        return split(spark, a.store, a.path, a.size, a.target)
    if a.command == "get":
        return get(spark, a.store, a.job, a.part)
    if a.command == "put":
        with open(a.file, encoding="utf-8") as f:
            return put(spark, a.store, a.job, a.part, f.read(), a.skip_verify)
    return status(spark, a.store) if a.command == "status" else merged(spark, a.store)


if __name__ == "__main__":
    for row in main().toLocalIterator():
        sys.stdout.write("\t".join("" if v is None else str(v) for v in row) + "\n")

"""Documents from files, parts and manifests to storage and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "id string, source_file string, total_parts int, size int, target string, language string, glossary map<string,string>, "
    "gaps array<int>, provenance struct<tool: string, version: string, url: string, source: string, source_sha256: string, "
    "source_chars: int, target_lang: string, model: string, mode: string, translated: string, machine_translation: boolean>, "
    "parts array<struct<part: int, file: string, chars: int, heading: string>>, chunks array<string>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: path, text; line ends and outer blanks as they are."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def line_rows(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line: keys, line_idx (from 0), line (blank lines empty)."""
    from ..functions.text import lines

    return docs.select(*keys, F.posexplode(lines(F.col(text))).alias("line_idx", "line"))


def write_parts(parts: DataFrame, path: str, by: str = "job_id", buckets: int = 64) -> None:
    """Part rows as Parquet, in ``buckets`` folders by hash of the job, so that a job is read from one of them."""
    bucket = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
    parts.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_parts(spark: SparkSession, path: str, job: str | None = None, by: str = "job_id", buckets: int = 64) -> DataFrame:
    """Parts of :func:`write_parts`; of one job, from its folder alone."""
    parts = spark.read.parquet(path)
    if job is not None:
        one = spark.range(1).select(F.pmod(F.xxhash64(F.lit(job)), F.lit(buckets)).cast("int")).first()[0]
        parts = parts.where((F.col("bucket") == one) & (F.col(by) == job))
    return parts.drop("bucket")


def write_part_files(parts: DataFrame, path: str, file: str = "file", text: str = "text") -> None:
    """Each part as a file of its own below ``path``, named by ``file``, written by the tasks through Hadoop-style
    partition folders: one folder a file, its text as it is."""
    rows = parts.select(F.col(file).alias("file"), F.regexp_replace(text, "\n\\z", "").alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\n").partitionBy("file").text(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests from JSON files. Where ``parts`` is missing it is filled from the older ``chunks``."""
    m = spark.read.schema(MANIFEST).json(path, multiLine=True)
    filled = F.transform(
        "chunks",
        lambda f, i: F.struct(
            (i + 1).alias("part"), f.alias("file"), F.lit(0).alias("chars"), F.lit(None).cast("string").alias("heading")
        ),
    )
    have = F.coalesce(F.size("parts"), F.lit(0)) > 0
    return m.withColumn("parts", F.when(have, F.col("parts")).otherwise(filled))


def write_manifests(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)

"""JSON array files with older field names, and users' own text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def backfill(rows: DataFrame) -> DataFrame:
    """Older rows have `text` for `body`, no topic and no tags: the present names and defaults instead."""
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(F.array(F.lit("none")))
    return rows.withColumns({"body": F.coalesce(F.nullif("body", F.lit("")), F.col("text")), "topic": F.coalesce(F.nullif("topic", F.lit("")), F.lit("general")), "tags": tags})


def text_files(files: DataFrame) -> DataFrame:
    """name, kind, content, word_count of plain text files (path, content), as UTF-8 with bad bytes replaced."""
    name = F.substring_index("path", "/", -1)
    content = F.expr("make_valid_utf8(cast(content as string))")
    return files.select(name.alias("name"), F.lower(F.substring_index(name, ".", -1)).alias("kind"), content.alias("content")).withColumn("word_count", text.n_words(F.col("content")))

"""Base relations from files: delimited text without a header, and fact files; and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separator by file extension.
SEPARATORS = {"csv": ",", "tsv": "\t", "txt": " "}


def read_relation(spark: SparkSession, path: str, schema: str, separator: str | None = None) -> DataFrame:
    """A delimited file with declared columns; a last column that lines lack is 1."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    separator = separator or SEPARATORS.get(path.rstrip("/").rsplit(".", 1)[-1], ",")
    df = spark.read.csv(path, sep=separator, schema=kind, header=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    last = kind.fields[-1]
    if isinstance(last.dataType, T.NumericType) and len(kind.fields) > 1:
        df = df.withColumn(last.name, F.coalesce(F.col(f"`{last.name}`"), F.lit(1).cast(last.dataType)))
    return df


def read_facts(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Relations of a fact file: lines `all name` begin a relation, comma-separated rows follow.

    A whole file is read as one text each, as its lines have an order; large relations belong in delimited files."""
    head = r"^\s*all\s+(\w+)\s*$"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    begins = F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 1))
    named = files.withColumn("name", F.last(begins, ignorenulls=True).over(Window.partitionBy("file").orderBy("at")))
    kept = named.where(F.col("name").isNotNull() & ~F.col("line").rlike(head) & (F.trim("line") != ""))
    rows = kept.select("name", F.split("line", r"\s*,\s*").alias("v"))
    out = {}
    for name, schema in schemas.items():
        kind = T._parse_datatype_string(schema)
        out[name] = rows.where(F.col("name") == name).select(*(F.trim(F.regexp_replace(F.get("v", F.lit(i)), r'^\s*"|"\s*$', "")).cast(f.dataType).alias(f.name) for i, f in enumerate(kind.fields)))
    return out


def write_tsv(df: DataFrame, path: str) -> None:
    """Rows as tab-separated text."""
    df.write.mode("overwrite").csv(path, sep="\t", emptyValue="", quote="")

"""Sources and sinks: tables written in each format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources import relations
from lattica.store import shared_folder

from .common import read


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _through(kind: str, table: str, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, path = read(spark, sf_dir, table), _path(spark, kind)
        df.write.format(kind).options(**options).save(path)
        return spark.read.schema(df.schema).format(kind).options(**options).load(path)

    return run


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "text")
    read(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.text(path)
    return spark.read.text(path)


def _delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation file without its last column: that is 1."""
    path = _path(spark, "relation") + ".tsv"
    relations.write_tsv(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), path)
    return relations.read_relation(spark, path, "a int, b int, w int")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "facts")
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").agg(F.concat_ws("\n", F.lit("all arc"), F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(", ", "n_nationkey", F.concat(F.lit('"'), "n_name", F.lit('"'))))))).alias("value"))
    rows.coalesce(1).write.text(path)
    return relations.read_facts(spark, path, {"arc": "a int, b string"})["arc"]


def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition discovery and pruning."""
    path = _path(spark, "partitioned")
    read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables in buckets of their join key: the join needs no exchange."""
    names = [f"bucketed_{uuid.uuid4().hex}" for _ in range(2)]
    read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").write.bucketBy(8, "o_orderkey").sortBy("o_orderkey").saveAsTable(names[0])
    read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").write.bucketBy(8, "l_orderkey").sortBy("l_orderkey").saveAsTable(names[1])
    o, li = spark.table(names[0]), spark.table(names[1])
    return o.join(li.hint("merge"), o.o_orderkey == li.l_orderkey).groupBy("o_custkey").agg(F.sum("l_quantity").alias("q"))


def _ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"ctas_{uuid.uuid4().hex}"
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    return spark.sql(f"SELECT n_regionkey, n FROM {name}")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    found = [c.name for c in spark.catalog.listColumns("nation")]
    return spark.createDataFrame([(n,) for n in found], "name string")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return df.cache().where("n > 1")


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")


def _transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through an external process."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT TRANSFORM (n_nationkey, n_name) USING 'cat' AS (k INT, name STRING) FROM nation")


def _csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, quotes within quotes, dates in another form, blanks around values, and lines with a field missing or of another kind."""
    path = _path(spark, "csv-options")
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat(F.lit('"a \\"'), F.col("n_name"), F.lit('\\"; b"')), F.lit(" 31/01/2020 "), F.when(F.col("n_regionkey") == 0, F.lit("none")).otherwise(F.col("n_regionkey").cast("string")))
    rows = read(spark, sf_dir, "nation").select(line.alias("value"))
    rows.unionAll(spark.createDataFrame([("#note;1;2;3",), ("x;y;31/01/2020;1",)], "value string")).coalesce(1).write.text(path)
    kind = "k int, name string, day date, region int"
    return spark.read.csv(path, schema=kind, sep=";", comment="#", escape="\\", nullValue="none", dateFormat="dd/MM/yyyy", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="DROPMALFORMED").where("k is not null").select("k", "name", F.date_format("day", "yyyy-MM-dd").alias("day"), "region")


def _json_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, single quotes, unquoted names, leading zeros, numbers as text, and what can't be read kept apart."""
    path = _path(spark, "json-options")
    line = F.format_string("/* row */ {k: 0%d, 'name': '%s', more: {list: [1, %d]}}", "n_nationkey", "n_name", "n_regionkey")
    rows = read(spark, sf_dir, "nation").select(line.alias("value"))
    rows.unionAll(spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    kind = "k string, name string, more struct<list: array<int>>, bad string"
    found = spark.read.schema(kind).options(allowComments="true", allowSingleQuotes="true", allowUnquotedFieldNames="true", allowNumericLeadingZeros="true", columnNameOfCorruptRecord="bad").json(path)
    return found.select(F.col("k").cast("int").alias("k"), "name", F.col("more.list")[1].alias("region"), "bad")


def _whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as one text and as bytes each."""
    path = _path(spark, "whole")
    read(spark, sf_dir, "nation").select("n_name", "n_regionkey").coalesce(1).write.partitionBy("n_regionkey").text(path)
    texts = spark.read.text(path, wholetext=True).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("value")).alias("chars"), F.min(F.array_min(F.filter(F.split("value", r"\n"), lambda x: x != ""))).alias("least"))
    size = spark.read.format("binaryFile").load(f"{path}/*/*.txt").select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("r"), "length", F.octet_length("content").alias("read"))
    return texts.join(size.where("length = read"), F.col("n_regionkey") == F.col("r")).select(F.col("n_regionkey").cast("int").alias("region"), "files", "chars", "length", "least")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function is made, shown, described, used and dropped."""
    name = f"net_{uuid.uuid4().hex[:8]}"
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    spark.sql(f"CREATE TEMPORARY FUNCTION {name}(price DOUBLE, discount DOUBLE COMMENT 'a share') RETURNS DOUBLE COMMENT 'what is paid' RETURN price * (1 - discount)")
    known = [r[0] for r in spark.sql(f"SHOW USER FUNCTIONS LIKE '{name}'").collect()]
    told = " ".join(r[0] for r in spark.sql(f"DESCRIBE FUNCTION EXTENDED {name}").collect())
    out = spark.sql(f"SELECT l_returnflag, round(sum({name}(l_extendedprice, l_discount)), 2) AS net, {len(known)} AS shown, {'what is paid' in told} AS described FROM lineitem GROUP BY l_returnflag")
    spark.sql(f"DROP TEMPORARY FUNCTION {name}")
    left = spark.sql(f"SHOW USER FUNCTIONS LIKE '{name}'").count()
    return out.withColumn("left_over", F.lit(left))


PROGRAMS = {
    "format_csv_options": (_csv_options, "SELECT n_nationkey AS k, 'a \"' || n_name || '\"; b' AS name, '2020-01-31' AS day, nullif(n_regionkey, 0) AS region FROM nation"),
    "format_json_options": (_json_options, "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region, CAST(NULL AS VARCHAR) AS bad FROM nation UNION ALL SELECT NULL, NULL, NULL, '{broken'"),
    "source_whole_files": (_whole_files, "SELECT n_regionkey AS region, CAST(1 AS BIGINT) AS files, CAST(sum(length(n_name) + 1) AS BIGINT) AS chars, CAST(sum(length(n_name) + 1) AS BIGINT) AS length, min(n_name) AS least FROM nation GROUP BY n_regionkey"),
    "ddl_function": (_functions, "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, 1 AS shown, true AS described, 0 AS left_over FROM lineitem GROUP BY l_returnflag"),
    "format_parquet": (_through("parquet", "nation", compression="gzip"), "SELECT * FROM nation"),
    "format_orc": (_through("orc", "nation"), "SELECT * FROM nation"),
    "format_json": (_through("json", "nation"), "SELECT * FROM nation"),
    "format_csv": (_through("csv", "nation", header="true", quote='"', nullValue="NULL"), "SELECT * FROM nation"),
    "format_text": (_text, "SELECT n_name AS value FROM nation"),
    "format_relation_file": (_delimited, "SELECT n_nationkey AS a, n_regionkey AS b, 1 AS w FROM nation"),
    "format_fact_file": (_facts, "SELECT n_nationkey AS a, n_name AS b FROM nation"),
    "format_partitioned": (_partitioned, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'"),
    "format_bucketed_join": (_bucketed, "SELECT o_custkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey"),
    "ddl_create_table_as": (_ctas, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"),
    "catalog_columns": (_catalog, "SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) t(name)"),
    "cache_columnar": (_cached, "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 1"),
    "local_relation": (_local, "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(x, y)"),
    "external_process": (_transform, "SELECT n_nationkey AS k, n_name AS name FROM nation"),
}
QUERIES = {name: q for name, (q, _) in PROGRAMS.items()}
ORACLE_SQL = {name: text for name, (_, text) in PROGRAMS.items()}

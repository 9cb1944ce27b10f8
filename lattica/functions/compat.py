"""Functions of the query dialect that Spark SQL has no built-in for, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.store import Store


def field(value: Column, *options) -> Column:
    """The place of the first option equal to value, from 1; 0 if there is none or value is null."""
    out = F.lit(0)
    for i, o in reversed(list(enumerate(options, 1))):
        out = F.when(value == (o if isinstance(o, Column) else F.lit(o)), i).otherwise(out)
    return F.when(value.isNull(), 0).otherwise(out)


def word_ngrams(df: DataFrame, text: str, n: int, k: int) -> DataFrame:
    """(ngram, estfrequency): the k most frequent n-grams of words within sentences; exact, ties by the n-gram."""
    sentence = df.select(F.explode(F.sentences(F.lower(F.col(text)))).alias("s"))
    grams = F.transform(F.sequence(F.lit(1), F.size("s") - (n - 1)), lambda i: F.slice("s", i, n))
    found = sentence.where(F.size("s") >= n).select(F.explode(grams).alias("ngram"))
    return found.groupBy("ngram").agg(F.count(F.lit(1)).cast("double").alias("estfrequency")).orderBy(F.desc("estfrequency"), "ngram").limit(k)


def context_ngrams(df: DataFrame, text: str, pattern: list[str | None], k: int) -> DataFrame:
    """(ngram, estfrequency): the k most frequent fillings of the pattern's nulls."""
    n, blanks = len(pattern), [i for i, p in enumerate(pattern) if p is None]
    sentence = df.select(F.explode(F.sentences(F.lower(F.col(text)))).alias("s"))
    grams = F.transform(F.sequence(F.lit(1), F.size("s") - (n - 1)), lambda i: F.slice("s", i, n))
    found = sentence.where(F.size("s") >= n).select(F.explode(grams).alias("g"))
    for i, p in enumerate(pattern):
        if p is not None:
            found = found.where(F.col("g")[i] == p)
    filled = found.select(F.array(*(F.col("g")[i] for i in blanks)).alias("ngram"))
    return filled.groupBy("ngram").agg(F.count(F.lit(1)).cast("double").alias("estfrequency")).orderBy(F.desc("estfrequency"), "ngram").limit(k)


def bitmap_of(positions: Column) -> Column:
    """The bitmap of an array of positions, as sorted different positions."""
    return F.array_sort(F.array_distinct(positions))


def bitmap_and(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def bitmap_or(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def bitmap_empty(a: Column) -> Column:
    return F.size(a) == 0


def in_lines(value: Column, lines: DataFrame, df: DataFrame) -> DataFrame:
    """df with `in_file`: whether value is a line of lines(value)."""
    known = lines.select(F.col("value").alias("line__")).distinct().withColumn("hit__", F.lit(True))
    return df.join(known, value == F.col("line__"), "left").withColumn("in_file", F.coalesce("hit__", F.lit(False))).drop("line__", "hit__")


def parse_url_tuple(url: Column, *parts: str) -> list[Column]:
    """One column for each part; `QUERY:key` takes a query key."""
    out = []
    for p in parts:
        name, _, key = p.partition(":")
        args = [url, F.lit(name)] + ([F.lit(key)] if key else [])
        out.append(F.try_parse_url(*args).alias(p))
    return out


def tagged_union(tag: Column, *options: Column) -> Column:
    """A value of one of several types: a struct with the tag and the chosen option set."""
    return F.struct(tag.alias("tag"), *(F.when(tag == i, o).alias(f"option{i}") for i, o in enumerate(options)))


def with_index(df: DataFrame, *by: str) -> DataFrame:
    """df with its rows' places, from 0, in an order. Ranges of the order are numbered apart, and shifted by what
    lies before them: no range needs the others' rows, and only the ranges' sizes come together."""
    store = Store(df.sparkSession, "index")
    parts = max(2, df.sparkSession.sparkContext.defaultParallelism)
    dealt = store.written(df.repartitionByRange(parts, *by).withColumn("range__", F.spark_partition_id()))
    sizes = dealt.groupBy("range__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(sizes.select("range__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("first__")))
    at = F.row_number().over(Window.partitionBy("range__").orderBy(*by)) - 1 + F.col("first__")
    return dealt.join(first, "range__").select(*df.columns, at.cast("long").alias("at"))

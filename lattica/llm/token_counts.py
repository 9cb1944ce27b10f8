"""Exact length histogram: how many documents encode to each number of tokens, with suffix
sums that answer totals, quantiles and truncated totals for every context limit.

For a limit L (a row of the histogram): docs_ge and tokens_ge count what has L tokens or more;
tokens_truncated is the sum of min(length, L) over all documents; docs_le and tokens_le cover
what fits whole, and quantile is the share of documents of at most L tokens. Limits between
rows follow from the next row above (see `at_limit`).

The histogram has a row for each different length. Its sums run over blocks of BLOCK lengths
and then over the blocks' totals, so that no task holds more than a block or a row a block.
Defined results: a null text has 0 tokens; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path, tokenizer
from .common import task_memo, written

BLOCK = 64


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            n = tokenizer(path).counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(task_memo(run), "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """counted: n_tokens of each document. One row for each length, with suffix sums."""
    summed = counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    rows = written(summed, "lengths")  # read twice below
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("b_docs", "b_tokens")), *(F.sum(c).over(all_blocks).alias(f"{c}_all") for c in ("b_docs", "b_tokens")))
    suffix = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(blocks, "block").select("n_tokens", "docs", "tokens", (F.sum("docs").over(suffix) + F.col("b_docs_above")).alias("docs_ge"), (F.sum("tokens").over(suffix) + F.col("b_tokens_above")).alias("tokens_ge"), "b_docs_all", "b_tokens_all")
    docs_le = F.col("b_docs_all") - F.col("docs_ge") + F.col("docs")
    tokens_le = F.col("b_tokens_all") - F.col("tokens_ge") + F.col("tokens")
    return summed.select(
        "n_tokens", "docs", "tokens", "docs_ge", "tokens_ge", docs_le.alias("docs_le"), tokens_le.alias("tokens_le"),
        (tokens_le + F.col("n_tokens") * (F.col("docs_ge") - F.col("docs"))).alias("tokens_truncated"),
        (docs_le / F.col("b_docs_all")).alias("quantile"),
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """Documents and tokens beyond a context limit, and all tokens when cut at it: one row."""
    over = F.col("n_tokens") > limit
    return hist.agg(
        F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0)).alias("tokens_over"),
        F.coalesce(F.sum(F.col("docs") * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)).alias("tokens_truncated"),
    )


def token_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    return histogram(lengths(docs, path))

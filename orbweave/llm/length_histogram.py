"""Token counts: an exact histogram of document lengths.

One pass encodes every text and counts how many documents have each length; the
histogram is small whatever the corpus, and written, so that nothing is encoded twice.  Suffix sums over it answer, for every
context limit, how many documents and tokens lie above and how many tokens stay
when documents are cut there, and every quantile.  They are summed over blocks
of ``BLOCK`` lengths first and then within each block, so that no task gets the
whole histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import in_batches, written
from orbweave.llm.word_tokens import load

BLOCK = 256
LENGTH = pa.schema([("length", pa.int64())])


def document_lengths(docs: DataFrame, tokenizer: str, text_column: str = "text") -> DataFrame:
    """The encoded length of every text; null and empty texts have length 0."""

    def lengths(texts: pa.Array) -> list:
        return [np.diff(load(tokenizer).encode([t or "" for t in texts.to_pylist()])[1])]

    return docs.select(F.col(f"`{text_column}`").cast("string").alias("text")).mapInArrow(in_batches(["text"], LENGTH, lengths), "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """Rows (length, n_docs) of a column ``length``; null lengths count as 0."""
    return lengths.groupBy(F.coalesce("length", F.lit(0).cast("long")).alias("length")).agg(F.count("*").alias("n_docs"))


def with_suffix_sums(counts: DataFrame) -> DataFrame:
    """One row a length that occurs.

    docs_at_least and tokens_at_least: documents of that length or more, and
    their tokens; total_docs and total_tokens; truncated_tokens: what all
    documents hold when each is cut to that length; quantile: the share of
    documents of at most that length.  Equal to the same sums over documents.
    Between two lengths, ``truncated_tokens`` is linear in the limit.  An empty
    table gives no rows.  ``counts`` has a row a length, as `histogram` gives it.
    """
    counts = written(counts.select("length", "n_docs"), "histogram")
    counts = counts.select("length", "n_docs", F.floor(F.col("length") / BLOCK).cast("long").alias("block"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), zero).alias(f"later_{c}") for c in ("docs", "tokens")), *(F.sum(c).over(everything).alias(f"total_{c}") for c in ("docs", "tokens")))
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    at_least = F.col("later_docs") + F.sum("n_docs").over(own)
    tokens = F.col("later_tokens") + F.sum(F.col("n_docs") * F.col("length")).over(own)
    out = counts.join(blocks, "block").select("length", "n_docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"), "total_docs", "total_tokens")
    return out.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).withColumn("quantile", (F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row (docs_cut, tokens_kept) for any limit, from the suffix sums."""
    above = F.col("length") > limit
    lowest = F.min(F.when(above, F.struct("length", "docs_at_least", "tokens_at_least")))
    return sums.agg(F.max("total_tokens").alias("t"), lowest.alias("a")).select(F.coalesce("a.docs_at_least", F.lit(0)).cast("long").alias("docs_cut"), (F.col("t") - F.coalesce(F.col("a.tokens_at_least") - F.col("a.docs_at_least") * limit, F.lit(0))).cast("long").alias("tokens_kept"))


def length_at_quantile(sums: DataFrame, share: float) -> DataFrame:
    """One row (length): the least that a ``share`` of the documents keep to."""
    return sums.agg(F.min(F.when(F.col("quantile") >= share, F.col("length"))).alias("length"))

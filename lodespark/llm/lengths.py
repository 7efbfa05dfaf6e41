"""Token counts: an exact histogram of encoded lengths, from which suffix sums answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.llm.bpe import VOCABULARY, token_lengths


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each encoded length that occurs, also to be read as a context limit.

    n_tokens; docs, with that length; docs_from and tokens_from, the documents of at least that length and their tokens;
    total_docs and total_tokens; kept_tokens, what remains if each document is truncated to n_tokens; share_upto, the
    share of documents of at most that length (the least n_tokens with share_upto >= q is the q-quantile).

    Each row of docs counts, repeated ones too; null and empty texts have length 0; other columns are ignored; an empty
    table gives no rows. The window runs over the histogram, one row per distinct length, not over documents.
    """
    h = token_lengths(docs, vocabulary)
    back = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("docs_from", F.sum("docs").over(back)).withColumn("tokens_from", F.sum(F.col("docs") * F.col("n_tokens")).over(back))
    total = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = h.withColumn("total_docs", F.max("docs_from").over(total)).withColumn("total_tokens", F.max("tokens_from").over(total))
    kept = F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    upto = (F.col("total_docs") - F.col("docs_from") + F.col("docs")) / F.col("total_docs")
    return h.withColumn("kept_tokens", kept).withColumn("share_upto", F.round(upto, 9))


def answers(histogram: DataFrame, limit: int, q: float = 0.5) -> DataFrame:
    """One row: total_tokens, kept_tokens under limit, truncated_docs (longer than limit), and the q-quantile.

    limit needn't be a length that occurs; an empty histogram gives zeros and a null quantile.
    """
    over = F.col("n_tokens") > limit
    return histogram.agg(
        F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.col("docs") * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias("truncated_docs"),
        F.min(F.when(F.col("share_upto") >= q, F.col("n_tokens"))).alias("quantile_tokens"),
    )

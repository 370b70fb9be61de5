"""Token counts by an exact length histogram.

Documents are encoded and aggregated by encoded length. The histogram has a row for each
distinct length; running sums from its long end answer, for any context limit, how many
documents and tokens lie beyond it and how many tokens remain when all are cut to it.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import str_texts, table


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens of each text in a byte-level BPE given as a rank file.

    A null text counts as empty, with no tokens. Every row counts, repeated ones too; ids and
    other columns, whatever their names, are not read. An empty input gives no rows.
    """

    def run(batches):
        import pyarrow as pa
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) for t in str_texts(batch.column(0))], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each distinct n_tokens, with sums over it.

    n_docs, tokens: at this length. docs_from, tokens_from: at this length or longer (suffix
    sums). truncated_tokens: of all documents, each cut to this length. share_upto: share of
    documents at most this long. An empty input gives no rows.
    """
    hist = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    # the windows run over the distinct lengths, of which there are at most the longest length's many
    suffix, every = Window.orderBy(F.desc("n_tokens")), Window.partitionBy()
    hist = hist.withColumns({"docs_from": F.sum("n_docs").over(suffix), "tokens_from": F.sum("tokens").over(suffix), "all_tokens": F.sum("tokens").over(every), "all_docs": F.sum("n_docs").over(every)})
    cut = F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")
    upto = (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")
    return hist.select("n_tokens", "n_docs", "tokens", "docs_from", "tokens_from", cut.alias("truncated_tokens"), upto.alias("share_upto"))


def truncated_total(hist: DataFrame, limit: int) -> Column:
    """An aggregate over a histogram: all tokens with each document cut to limit, for any limit."""
    return F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs"))


def quantile(hist: DataFrame, q: float) -> Column:
    """An aggregate over a histogram: the least length that a share q of the documents does not exceed."""
    return F.min(F.when(F.col("share_upto") >= q, F.col("n_tokens")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return length_histogram(token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))

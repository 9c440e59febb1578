"""Token totals for every context limit from an exact length histogram.

Documents are encoded and aggregated by encoded length; prefix and suffix sums over the ordered lengths then answer totals,
quantiles and truncated totals: with limit L a document of n tokens counts min(n, L).

Cases: null and empty texts have length 0 and count as documents; rows may repeat and each counts; extra columns are
ignored; an empty table gives no rows. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import running_totals, slices, written

#: Fixed value: the pattern that splits text before the merges of the rank files in TOKENIZERS.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"


def encoding(path: str):
    """The byte-level BPE of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in slices(batches):
            counts = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """A row for each encoded length: n_docs, n_tokens; docs_longer and tokens_longer (the suffix sums beyond it);
    truncated_total, if every document is cut at this length; docs_share, the share of documents no longer than it."""
    by = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))
    by = written(by.withColumn("tokens", F.col("length") * F.col("n_docs")), "lengths")  # each document is encoded once
    run = running_totals(by, ["length"], {"docs_before": "n_docs", "tokens_before": "tokens"}, "length-histogram")
    totals = by.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("_docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("_tokens"))
    run = run.join(F.broadcast(totals))  # one row
    longer = F.col("_docs") - F.col("docs_before") - F.col("n_docs")
    upto = F.col("tokens_before") + F.col("tokens")
    return run.select(
        "length", "n_docs", F.col("tokens").alias("n_tokens"), longer.alias("docs_longer"), (F.col("_tokens") - upto).alias("tokens_longer"),
        (upto + F.col("length") * longer).alias("truncated_total"), ((F.col("docs_before") + F.col("n_docs")) / F.col("_docs")).alias("docs_share"),
    )


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at `limit`, for any limit, from the histogram's rows."""
    whole = F.col("length") <= limit
    return table.agg(F.sum(F.when(whole, F.col("n_tokens")).otherwise(limit * F.col("n_docs")))).first()[0] or 0


def quantile(table: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of documents doesn't exceed."""
    return table.filter(F.col("docs_share") >= share).agg(F.min("length")).first()[0]

"""Exact token counts from the histogram of encoded lengths.

Documents are aggregated by their number of tokens; suffix sums over that histogram answer totals,
quantiles and truncated totals for any context limit. The sums are taken in two levels, over bands of
lengths and within each band, so no task sees all lengths.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_slices, whole_text
from .packing import vocabulary

BAND = 256
#: Longer runs without white space go to the tokenizer whose merging stays near-linear; the ids are the same.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")

_ENCODINGS: dict[str, object] = {}


def _encoding(stem: str):
    """This worker's (tiktoken, tokenizers) pair for the vocabulary ``stem``."""
    if stem not in _ENCODINGS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(f"{stem}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        exact = Tokenizer.from_file(f"{stem}.json")
        exact.encode_special_tokens = True
        _ENCODINGS[stem] = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ), exact
    return _ENCODINGS[stem]


def token_lengths(
    docs: DataFrame, stem: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and ``n_tokens`` of every row; null and empty texts have 0 tokens. ``stem``: the vocabulary's path without suffix."""
    stem = stem or vocabulary("byte_bpe_50k.json").removesuffix(".json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, exact = _encoding(stem)
        for whole in batches:
            for batch in text_slices(whole):
                sizes = []
                for text in batch.column("text").to_pylist():
                    sizes.append(
                        len(
                            exact.encode(
                                text, add_special_tokens=False
                            ).ids if LONG_RUN.search(text) else fast.encode_ordinary(text)
                        )
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"]
                )

    return rows.mapInArrow(measure, "doc_id long, n_tokens long").withColumnRenamed("doc_id", id_col)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of the distinct lengths."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame, band: int = BAND) -> DataFrame:
    """What each context limit would hold, for every distinct length as the limit, from suffix sums.

    n_tokens (the limit), n_docs of just that length, docs_longer, tokens_longer (whole tokens of longer
    documents), docs_up_to, tokens_up_to, total_docs, total_tokens, truncated_tokens (all documents cut to
    the limit), quantile (share of documents up to the limit). Limits between two lengths follow from the
    next smaller row: ``truncated_at``. An empty histogram gives no rows.
    """
    histogram = durable(histogram, "length-histogram")  # read twice below, and behind it lies the tokenizer
    rows = histogram.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_tokens"),
        F.floor(F.col("n_tokens") / band).alias("_band")
    )
    after = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = rows.groupBy("_band").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    bands = bands.select(
        "_band", F.coalesce(
            F.sum("_d").over(after), F.lit(0)
        ).alias("_docs_after"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(every).alias("total_docs"), F.sum("_t").over(every).alias("total_tokens"))
    within = Window.partitionBy("_band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns(
        {
            "_docs_in": F.coalesce(F.sum("n_docs").over(within), F.lit(0)),
            "_tokens_in": F.coalesce(F.sum("_tokens").over(within), F.lit(0))
        }
    ).join(bands, "_band")
    longer = (F.col("_docs_after") + F.col("_docs_in")).alias("docs_longer")
    out = out.select(
        "n_tokens", "n_docs", longer, (F.col("_tokens_after") + F.col("_tokens_in")).alias("tokens_longer"),
        "total_docs", "total_tokens"
    )
    return out.withColumns({
        "docs_up_to": F.col("total_docs") - F.col("docs_longer"), "tokens_up_to": F.col("total_tokens") - F.col("tokens_longer"),
        "truncated_tokens": F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens"),
        "quantile": (F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs"),
    })


def truncated_at(totals: DataFrame, limit: int) -> DataFrame:
    """One row: all tokens when every document is cut to ``limit``; 0 for an empty table."""
    found = totals.agg(
        F.max(
            F.struct(F.when(F.col("n_tokens") <= limit, F.col("n_tokens")).alias("n"), "tokens_up_to", "docs_longer")
        ).alias("b"),
        F.max("total_docs").alias("d")
    )
    rest = F.when(F.col("b.n").isNull(), F.col("d") * limit).otherwise(
        F.col("b.tokens_up_to") + F.col("b.docs_longer") * limit
    )
    return found.select(F.coalesce(rest, F.lit(0)).alias("truncated_tokens"))


def quantile_length(totals: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that a share ``q`` of the documents doesn't exceed."""
    return totals.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))

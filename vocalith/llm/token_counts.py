"""Token counts for every context limit from the exact histogram of encoded lengths.

Documents are counted by (group, encoded length); sums over the longer lengths then answer, for every limit, how many
tokens remain when documents are cut there, how many documents are cut, and which share of documents fits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .encode import encoder, tokenizer_path


def encoded_lengths(docs: DataFrame, group: str, text: str, tokenizer: str) -> DataFrame:
    """(grp, length) of every document."""

    def run(batches):
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in bytescan.slices(whole, text):
                at = batch.schema.get_field_index
                yield pa.RecordBatch.from_arrays([batch.column(at(group)).cast(pa.string()), pa.array(enc.lengths(batch.column(at(text))))], names=["grp", "length"])

    return docs.select(group, text).mapInArrow(run, "grp string, length long")


def histogram(docs: DataFrame, group: str = "lang", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(grp, length, n_docs): as many rows as there are distinct lengths in a group. A null group is a group, a null text has length 0."""
    return encoded_lengths(docs, group, text, tokenizer or tokenizer_path()).groupBy("grp", "length").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row per group and distinct length L, read as a context limit.

    n_docs of that length; docs_within (length <= L); tokens_within (theirs); docs_cut (length > L); tokens_total;
    tokens_kept when every document is cut at L; quantile: share of documents within L. Between two rows all answers
    follow from the lower one: tokens_kept(L + d) = tokens_kept(L) + d * docs_cut(L). Empty in, empty out.
    """
    all_ = Window.partitionBy("grp")
    longer = all_.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_docs") * F.col("length")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = hist.select(
        "grp", "length", "n_docs",
        zero(F.sum("n_docs").over(longer)).alias("docs_cut"),
        zero(F.sum(tokens).over(longer)).alias("_tokens_over"),
        F.sum("n_docs").over(all_).alias("_docs"),
        F.sum(tokens).over(all_).cast("long").alias("tokens_total"),
    )
    within = F.col("tokens_total") - F.col("_tokens_over")
    return out.select(
        "grp", F.col("length").alias("context_limit"), "n_docs",
        (F.col("_docs") - F.col("docs_cut")).alias("docs_within"),
        within.alias("tokens_within"), "docs_cut", "tokens_total",
        (within + F.col("docs_cut") * F.col("length")).alias("tokens_kept"),
        ((F.col("_docs") - F.col("docs_cut")) / F.col("_docs")).alias("quantile"),
    )

"""Stored inverted indexes: positions by token, and keys by trigram.

A posting lies in the folder of its term's bucket, sorted by term, so a query reads the files of its terms'
buckets alone and of those the row groups that hold them. The terms of a query are a short list on the driver.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def token_postings(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """(bucket, term, key, at): every token's places with their weights, in order; ``tokens`` is an array of (t, pos, w)."""
    each = docs.select(F.col(key).alias("key"), F.explode(tokens).alias("x")).groupBy(F.col("x.t").alias("term"), "key").agg(F.sort_array(F.collect_list(F.struct("x.pos", "x.w"))).alias("at"))
    return each.select(bucket_of(F.col("term")).alias("bucket"), "term", "key", "at")


def gram_postings(docs: DataFrame, key: str, grams: Column) -> DataFrame:
    """(bucket, term, key): every distinct trigram of a document."""
    each = docs.select(F.col(key).alias("key"), F.explode(F.array_distinct(grams)).alias("term"))
    return each.select(bucket_of(F.col("term")).alias("bucket"), "term", "key")


def of_terms(postings: DataFrame, terms: list[str]) -> DataFrame:
    """The postings of these terms: only their buckets are read."""
    return postings.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms}))).where(F.col("term").isin(terms))


def with_all(postings: DataFrame, terms: list[str]) -> DataFrame:
    """(key, tokens): the documents that hold every term, with these terms' places as an array of (t, pos, w) in order."""
    found = of_terms(postings, terms).groupBy("key").agg(F.count("*").alias("n"), F.flatten(F.collect_list(F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), F.col("term").alias("t"), x["w"].alias("w"))))).alias("x"))
    return found.where(F.col("n") == len(set(terms))).select("key", F.transform(F.array_sort("x"), lambda x: F.struct(x["t"].alias("t"), x["pos"].alias("pos"), x["w"].alias("w"))).alias("tokens"))


def with_share(postings: DataFrame, terms: list[str], least: float) -> DataFrame:
    """(key): the documents that hold at least this share of the terms."""
    found = of_terms(postings, terms).groupBy("key").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= least * len(set(terms)) - 1e-9).select("key")

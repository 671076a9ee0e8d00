"""Text lineage and identity hypotheses as stars instead of cliques."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.sources.files import through


def reproduced(texts: DataFrame) -> DataFrame:
    """(rev, first, method): every later row of a digest group to the group's first, by exact bytes or, where
    those differ, by the text with white space collapsed."""
    plain = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    x = through(texts.select("rev", F.sha2("text", 256).alias("exact"), F.sha2(plain, 256).alias("loose")), "digests")  # texts are read and digested once

    def star(digest: str, method: str):
        first = x.groupBy(digest).agg(F.min("rev").alias("first"))  # added up before the shuffle, so a hot digest is a row a task
        y = x.join(first, digest)
        return y.where("rev > first").select("rev", "first", F.lit(method).alias("method"))

    exact, loose = star("exact", "exact_bytes"), star("loose", "normalised")
    return exact.unionByName(loose.join(exact.select("rev", "first"), ["rev", "first"], "left_anti"))


def built_on(revs: DataFrame) -> DataFrame:
    """(rev, parent) where a revision's diff base is a revision of the same page."""
    parent = revs.select(F.col("rev").alias("parent"), F.col("page").alias("parent_page"))
    return revs.join(parent, (F.col("diff_base") == F.col("parent")) & (F.col("page") == F.col("parent_page"))).select("rev", "parent")


def label_star(revs: DataFrame, key: str, id: str) -> DataFrame:
    """(key, first, other): every id of a key to its smallest."""
    x = revs.where(F.col(key).isNotNull() & (F.trim(F.col(key)) != "")).select(key, id).distinct()
    least = x.groupBy(key).agg(F.min(id).alias("first"))
    return x.join(least, key).where(F.col(id) > F.col("first")).select(key, "first", F.col(id).alias("other"))


def prefix_star(revs: DataFrame) -> DataFrame:
    """(first, other, prefix): labels that share an address prefix, each pair once, under its lowest prefix."""
    star = label_star(revs, "ip16", "label")
    return star.groupBy("first", "other").agg(F.min("ip16").alias("prefix"))


def range_overlap(spans: DataFrame, ranges: DataFrame, shift: int = 21) -> DataFrame:
    """(span_id, list, n, first): ranges that overlap each span, by list; bucketed, so it is an equi-join."""
    cut = lambda df: df.withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))))
    a, b = cut(spans.select("span_id", "lo", "hi")), cut(ranges.select("range_id", "list", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"), "lo", "hi")).drop("lo", "hi")
    # a pair that shares several buckets counts in the first of them
    both = a.join(b, "bucket").where((F.col("lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("hi")) & (F.col("bucket") == F.shiftright(F.greatest("lo", "r_lo"), shift)))
    return both.groupBy("span_id", "list").agg(F.count("*").alias("n"), F.min("range_id").alias("first"))

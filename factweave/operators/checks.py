"""Checks of populations, relations, declarations and answers; each is a grouping or a join, none reads a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def population_status(declared: DataFrame, counts: DataFrame, records: DataFrame) -> DataFrame:
    """(ns, n_declared, n_repeated, n_missing, n_undeclared, complete) for declared rows (ns, event_id), declared counts
    (ns, n) and records (ns, event_id).

    A population is complete where its ids are those of the records, none twice, and the count is theirs.
    """
    side = lambda df, c: df.groupBy("ns", "event_id").agg(F.count("*").alias(c))
    both = side(declared, "d").join(side(records, "r"), ["ns", "event_id"], "full_outer").fillna(0, ["d", "r"])
    sums = both.groupBy("ns").agg(F.sum("d").alias("n_declared"), F.sum(F.greatest(F.col("d") - 1, F.lit(0))).alias("n_repeated"), F.count_if((F.col("d") == 0) & (F.col("r") > 0)).alias("n_undeclared"), F.count_if((F.col("d") > 0) & (F.col("r") == 0)).alias("n_missing"))
    sure = (F.col("n_repeated") + F.col("n_missing") + F.col("n_undeclared") == 0) & (F.col("n") == F.col("n_declared"))
    return sums.join(counts.select("ns", "n"), "ns", "left").select("ns", "n_declared", "n_repeated", "n_missing", "n_undeclared", F.coalesce(sure, F.lit(False)).alias("complete"))


def same_version(pairs: DataFrame, record: str = "sha", claim: str = "attested") -> DataFrame:
    """The pairs whose claim may speak of the record's version: either digest is unknown, or they are equal."""
    return pairs.where(F.col(record).isNull() | F.col(claim).isNull() | (F.col(record) == F.col(claim)))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that several rows carry: an error where they are to be ids."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def previous_digest(records: DataFrame) -> DataFrame:
    """(event_id, parent): the first record (ns, event_id, sha) that holds a record's previous digest, itself excepted."""
    seen = records.groupBy("ns", F.col("sha").alias("previous")).agg(F.min("event_id").alias("parent"))
    return records.where("sha <> previous").join(seen, ["ns", "previous"]).select("event_id", "parent")


def resolved(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges with the keys of both ends; null where an end is unknown."""
    end = lambda s: entities.select(F.col("entity_id").alias(s), F.col("key").alias(f"{s}_key"))
    return edges.join(end("subject"), "subject", "left").join(end("object"), "object", "left")


def matched(labels: DataFrame, suggestions: DataFrame, key: str) -> DataFrame:
    """(key, n, status) of every label: one suggestion, several (an error) or none (missing)."""
    n = suggestions.groupBy(key).agg(F.count("*").alias("n"))
    status = F.when(F.col("n") == 1, "one").when(F.col("n") > 1, "several").otherwise("missing")
    return labels.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def published(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, status): whether a message's digest is the one published under its id."""
    x = messages.join(citations.select("id", F.col("sha256").alias("told")), "id", "left")
    return x.select("id", F.when(F.col("told").isNull(), "unpublished").when(F.col("told") == F.col("sha256"), "same").otherwise("differs").alias("status"))


def relation_violations(edges: DataFrame) -> DataFrame:
    """(rule, n) over edges (kind, outcome, object, candidates, n_witnesses, n_citations, authenticated)."""
    kind, n = F.col("kind"), F.size("candidates")
    rules = {
        "no_witness": F.col("n_witnesses") < 1,
        "no_citation": F.col("n_citations") < 1,
        "candidate_not_object": (F.col("outcome") == "supported") & kind.isin("produced", "executed") & ((n != 1) | (F.col("candidates")[0] != F.col("object"))),
        "actor_not_authenticated": (F.col("outcome") == "supported") & (kind == "same_actor") & ~F.col("authenticated"),
        "candidate_repeats": n != F.size(F.array_distinct("candidates")),
    }
    sums = edges.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules))).alias("x")).select("x.*")


def attribution_violations(edges: DataFrame, behind: DataFrame, claims: DataFrame) -> DataFrame:
    """(rule, n) over what substrate.attribute() and reconcile.kept() gave: edges (event_id, outcome, n_candidates, cid,
    witnesses), the claims behind them (event_id, cid, witness, citation) and all claims (cid, witness).

    A supported edge has one claim, which is its object; every edge has a witness; as many claims stand behind an edge as
    it says; each is cited, exists, was seen by the witness it names, and that witness is among its edge's.
    """
    by = behind.groupBy("event_id").agg(F.count("*").alias("m"), F.min("cid").alias("only"))
    e = edges.select("event_id", "outcome", "n_candidates", "cid", "witnesses").join(by, "event_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    good = F.col("outcome") == "supported"
    of_edges = {
        "supported_by_other_than_one": good & ((F.col("n_candidates") != 1) | F.col("cid").isNull()), "object_not_candidate": good & ~F.col("cid").eqNullSafe(F.col("only")),
        "no_witness": F.size("witnesses") < 1, "candidates_differ": F.col("n_candidates") != F.col("m"),
    }
    c = claims.select(F.col("cid").alias("known"), F.col("witness").alias("seen_by")).repartition("known").distinct()  # dealt once, as the join needs it
    named = F.coalesce(F.array_contains("witnesses", F.col("witness")), F.lit(False))
    b = behind.join(edges.select("event_id", "witnesses"), "event_id").select("cid", "witness", F.col("citation").isNull().alias("bare"), named.alias("named"))
    b = b.join(c, F.col("cid") == F.col("known"), "left")
    of_claims = {
        "not_cited": F.col("bare"), "claim_unknown": F.col("known").isNull(), "seen_by_another": F.col("known").isNotNull() & ~F.col("witness").eqNullSafe(F.col("seen_by")),
        "witness_not_named": ~F.col("named"),
    }

    def counted(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
        sums = rows.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()))
        return sums.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules))).alias("x")).select("x.*")

    return counted(e, of_edges).unionByName(counted(b, of_claims))


def declaration_violations(domains: DataFrame) -> DataFrame:
    """(rule, n) over trust declarations (id, related_to): repeated, unknown or one-sided."""
    ids = domains.select(F.col("id").alias("related_to")).distinct()
    named = domains.where(F.col("related_to").isNotNull())
    back = named.select(F.col("id").alias("related_to"), F.col("related_to").alias("id"))
    found = {
        "repeated": named.groupBy("id", "related_to").count().where("count > 1"),
        "unknown": named.join(ids, "related_to", "left_anti"),
        "one_sided": named.join(back, ["id", "related_to"], "left_anti"),
    }
    out = None
    for rule, rows in found.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows with the number of all rows and whether rows follow."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("a page has 1 to 1000 rows and starts at 0 or later")
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def outcome_rank(outcome: Column) -> Column:
    return F.when(outcome == "contradicted", 0).when(outcome == "supported", 1).when(outcome == "ambiguous", 2).when(outcome == "not_assessable", 3).otherwise(4)

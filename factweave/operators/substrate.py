"""What records and claims of a kind of evidence are, as columns, and how the declared trust of their sources is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import reconcile as R
from factweave.sources.files import in_buckets, through

DECLARED = 10_000  # relations that a case may declare; they are read as one map


def _column(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Substrate:
    """Expressions (Columns or SQL) that read one kind of evidence.

    record: event_id, name, and where it has them ns, sha (its version), token_sha (its commitment), ts, ts_lower,
    payload, idem (a first creation makes later ones no-ops), witness.  claim: cid, keys (an array of structs ns, name: what
    it says it made; none: no claim), and where it has them event_id, attested (the version it speaks of), token,
    payload, t0, t1, witness, citation.  by_event: a claim names its record's id.  published: no clock or receipt is to
    be weighed; one claim of the record's key is what was published, several can't be told apart.  parse adds columns to the
    claims' rows that their expressions share.
    """

    record: dict[str, Column | str]
    claim: dict[str, Column | str]
    by_event: bool = True
    published: bool = False
    parse: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def records(self, rows: DataFrame) -> DataFrame:
        kinds = {"ns": "string", "name": "string", "sha": "string", "token_sha": "string", "ts": "timestamp", "payload": "string", "idem": "boolean", "witness": "string"}
        absent = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in self.record}
        return rows.select(*(_column(v).alias(k) for k, v in {**self.record, **absent}.items())).withColumnRenamed("witness", "record_witness").withColumn("idem", F.coalesce("idem", F.lit(False)))

    def said(self, rows: DataFrame) -> DataFrame:
        """What claims say, a row each."""
        kinds = {"attested": "string", "token": "string", "payload": "string", "t0": "timestamp", "t1": "timestamp", "witness": "string", "citation": "string"}
        absent = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in self.claim}
        return self.parse(rows).select(*(_column(v).alias(k) for k, v in {**self.claim, **absent}.items()))

    def claims(self, said: DataFrame) -> DataFrame:
        """One row for each key that a claim creates; said: what said() gives, written, so no filter on the keys parses again."""
        x = said.withColumn("key", F.explode("keys"))
        return x.withColumns({"claim_ns": F.col("key.ns"), "claim_name": F.col("key.name")}).drop("keys", "key")


@dataclass(frozen=True)
class Trust:
    """A case's declarations: the domain of each witness (rows witness, domain), which domains declare authentic records
    and exclusive receipt tokens, and how pairs of domains relate (independent or same; else unknown)."""

    witnesses: DataFrame
    authentic: frozenset[str] = frozenset()
    exclusive: frozenset[str] = frozenset()
    relations: dict[tuple[str, str], str] = field(default_factory=dict)

    def domain_of(self, rows: DataFrame, witness: str, into: str) -> DataFrame:
        w = self.witnesses.select(F.col("witness").alias("_witness"), F.col("domain").alias(into))
        return rows.join(w, F.col(witness) == F.col("_witness"), "left").drop("_witness")

    def relation(self, domains: Column) -> Column:
        """same for one domain or where all pairs are declared same, independent where all are, else unknown."""
        if len(self.relations) > DECLARED:
            raise ValueError(f"more than {DECLARED} declared relations")
        known = {f"{min(a, b)}|{max(a, b)}": r for (a, b), r in self.relations.items()}
        table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else F.lit(None).cast("map<string, string>")
        pairs = F.flatten(F.transform(domains, lambda a: F.transform(F.filter(domains, lambda b: b > a), lambda b: F.coalesce(F.try_element_at(table, F.concat(a, F.lit("|"), b)), F.lit("unknown")))))
        all_are = lambda x, r: (F.size(x) > 0) & F.forall(x, lambda p: p == r)
        said = F.transform(F.array(pairs), lambda x: F.when(all_are(x, "independent"), "independent").when(all_are(x, "same"), "same").otherwise("unknown"))[0]  # pairs are made once
        return F.when(F.size(domains) == 1, "same").otherwise(said)


def attribute(kind: Substrate, records: DataFrame, claims: DataFrame, trust: Trust | None = None, bound: str | float | None = None, repeated: str = "refuse", dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, pairs): which claim explains each record, and what reconcile.kept() takes for the claims behind an edge.

    edges: event_id, outcome, method, n_candidates, cid, witnesses, left, first.  A record's observers are its own witness and
    all that claim its key, so trust is taken over their domains (a witness without one makes it unknown).  repeated:
    refuse raises where an id stands on several claims, before anything is judged; skip takes their word.  dealt: claims of an
    event lie together already.  What claims say is kept in buckets of the event, so both results and kept() read it where it lies.
    """
    r = kind.records(records)
    if repeated == "refuse":
        R.refuse_repeated(claims.select(_column(kind.claim["cid"]).alias("cid")))
    if kind.published:
        c = kind.claims(through(kind.said(claims), "claims"))  # what claims say is read once, whatever it takes to parse it
        on = (F.col("name") == F.col("claim_name")) & (F.col("ns").isNull() | (F.col("ns") == F.col("claim_ns")))
        pairs = r.join(c.drop("payload"), on, "left").withColumn("has", F.col("cid").isNotNull())
        n = F.count("cid")
        sums = pairs.groupBy("event_id").agg(n.alias("n_candidates"), F.min("cid").alias("one"), F.first("record_witness").alias("record_witness"), F.collect_set("witness").alias("w"))
        outcome = F.when(F.col("n_candidates") == 1, "supported").when(F.col("n_candidates") > 1, "ambiguous").otherwise("unmatched")
        edges = sums.withColumn("outcome", outcome).withColumn("method", F.lit("published_revision_ref"))
        return edges.select("event_id", "outcome", "method", "n_candidates", F.when(F.col("outcome") == "supported", F.col("one")).alias("cid"), F.array_sort(F.array_union(F.array_compact(F.array("record_witness")), "w")).alias("witnesses"), F.lit("has").alias("left"), F.col("one").alias("first")), pairs
    if trust is None or not kind.by_event:
        raise ValueError("claims that name no record's id, or sources of unknown trust, can't be reconciled by the ladder")
    trust = replace(trust, witnesses=through(trust.witnesses, "witnesses"))  # a table with a size, so a small one is sent to the rows
    c = trust.domain_of(kind.claims(in_buckets(kind.said(claims), "claims", "event_id", dealt)), "witness", "domain")
    member = lambda s: F.col("domain").isin(*s) if s else F.lit(False)
    c = c.withColumns({"authentic": F.coalesce(member(trust.authentic), F.lit(False)), "exclusive": F.coalesce(member(trust.exclusive), F.lit(False))})
    by_key = c.groupBy(F.col("claim_ns").alias("k_ns"), F.col("claim_name").alias("k_name")).agg(F.collect_set(F.coalesce("domain", F.lit("?"))).alias("seen"))
    by_key = through(by_key, "observers")
    r = trust.domain_of(r, "record_witness", "own")
    r = r.join(by_key, (F.col("ns") == F.col("k_ns")) & (F.col("name") == F.col("k_name")), "left")
    domains = F.array_sort(F.array_union(F.array(F.coalesce("own", F.lit("?"))), F.coalesce("seen", F.array().cast("array<string>"))))
    r = r.withColumn("domains", domains)  # a column, so they are sorted once and not for each use
    r = r.withColumn("trusted", (trust.relation(F.col("domains")) == "independent") & ~F.array_contains("domains", "?")).drop("own", "k_ns", "k_name", "seen", "domains")
    how = {"keyed": True, "versions": True, "payloads": True}
    edges = R.reconcile(r, c, bound, idempotent=True, witnesses=True, **how)
    return edges, R.candidates(r, c, bound, **how)


def registry(function: str = "registry_write") -> Substrate:
    """Records of a registry and the tool events that say they wrote to it: rows function, name, namespace, payload (the
    call's arguments), receipt, error, pending, truncated, cid, t0, t1, witness, citation."""
    from factweave.operators import receipts

    event = {c: F.col(c) for c in ("function", "name", "namespace", "payload", "error", "pending", "truncated")}
    fields = ("namespace", "name", "event_id", "sha256", "receipt_token")
    read = lambda r: F.struct(*(F.try_variant_get(r, f"$.{p}", "string").alias(p) for p in fields))
    parse = lambda rows: rows.withColumn("_r", F.try_parse_json("receipt")).withColumns({"_ok": receipts.confirms(event, F.col("_r"), function), "_said": read(F.col("_r"))})
    said = lambda p: F.col(f"_said.{p}")
    key = F.array(F.struct(said("namespace").alias("ns"), said("name").alias("name")))
    return Substrate(
        record={"event_id": "cast(event_id as string)"} | {c: c for c in ("ns", "name", "sha", "token_sha", "ts", "payload", "idem", "witness")},
        claim={
            "cid": "cid", "keys": F.when(F.col("_ok"), key), "event_id": said("event_id"), "attested": said("sha256"), "token": said("receipt_token"),
            "payload": "payload", "t0": "t0", "t1": "t1", "witness": "witness", "citation": "citation",
        },
        parse=parse,
    )


def wiki_saves() -> Substrate:
    """Save events (event_id, revision_ref, page, witness) and the stored revisions they name (rev, page, witness)."""
    return Substrate(
        record={"event_id": "event_id", "ns": "page", "name": "cast(revision_ref as string)", "witness": "witness"},
        claim={"cid": "rev", "keys": "array(struct(page as ns, cast(rev as string) as name))", "witness": "witness"},
        published=True,
    )

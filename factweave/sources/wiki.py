"""The graph of a wiki export: nodes and edges that its rows state, each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.receipts import family_outcome
from factweave.sources.files import entity_id

#: What else a row's time may have been read from.
CLOCKS = ("request_time", "success_time", "recent_changes_time", "write_date", "archived_at", "rcs_date")


def _text(path: str) -> Column:
    return F.try_variant_get(F.col("v"), f"$.{path}", "string")


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.try_parse_json("attrs"))


def _node(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(F.lit(kind).alias("subkind"), key.alias("key"), F.lit(True).alias("referenced")))


def nodes(rows: DataFrame) -> DataFrame:
    """(entity_id, subkind, key, native): every row's own node and those it refers to; native where a row of the export
    is the node's own, and not a reference alone."""
    own = F.struct(F.col("tbl").alias("subkind"), F.col("key"), F.lit(False).alias("referenced"))
    is_ = lambda *t: F.col("tbl").isin(*t)
    sites = F.transform(F.try_variant_get("v", "$.origins", "array<variant>"), lambda o: _node("site", F.try_variant_get(o, "$.site", "string")))
    named = F.array(
        own, F.when(is_("revision", "page", "wiki_event") & (_text("wiki") != ""), _node("wiki", _text("wiki"))), F.when(is_("revision"), _node("page", _text("page_key"))), F.when(is_("revision"), _node("label", _text("label"))),
        F.when(is_("revision") & (_text("ip16") != ""), _node("network_prefix", _text("ip16"))), F.when(is_("revision"), _node("body", _text("body_sha256"))), F.when(is_("page") & (_text("page_family") != ""), _node("page_family", _text("page_family"))),
    )
    every = F.array_compact(F.concat(named, F.coalesce(F.when(is_("record"), sites), F.array().cast("array<struct<subkind: string, key: string, referenced: boolean>>"))))
    x = _parsed(rows).select(F.explode(every).alias("x")).select("x.*")
    once = x.groupBy("subkind", "key").agg((~F.bool_and("referenced")).alias("native"))
    return once.select(entity_id(F.col("subkind"), F.col("key")).alias("entity_id"), "subkind", "key", "native")


def edges(rows: DataFrame, confidence: float = 0.8) -> DataFrame:
    """(subject, kind, object, method, outcome), each once; of page families only confident ones are supported."""
    me = entity_id(F.col("tbl"), F.col("key"))

    def edge(when: Column, subject: Column, kind: str, object: Column, method: str = "source_field", outcome: Column | str = "supported") -> Column:
        out = F.lit(outcome) if isinstance(outcome, str) else outcome
        return F.when(F.coalesce(when, F.lit(False)), F.struct(subject.alias("subject"), F.lit(kind).alias("kind"), object.alias("object"), F.lit(method).alias("method"), out.alias("outcome")))

    is_ = lambda *t: F.col("tbl").isin(*t)
    to = lambda kind, path: entity_id(F.lit(kind), _text(path))
    family = family_outcome(_text("page_family_confidence"), confidence)
    sites = F.transform(F.try_variant_get("v", "$.origins", "array<variant>"), lambda o: edge(F.try_variant_get(o, "$.site", "string").isNotNull(), me, "located_on", entity_id(F.lit("site"), F.try_variant_get(o, "$.site", "string")), "published_origin"))
    every = F.array(
        edge(is_("revision", "page", "wiki_event") & (_text("wiki") != ""), me, "located_on", to("wiki", "wiki")), edge(is_("revision") & _text("page_key").isNotNull(), me, "located_on", to("page", "page_key")),
        edge(is_("revision") & _text("label").isNotNull(), to("label", "label"), "authored", me, "claimed_label", "ambiguous"), edge(is_("revision") & (_text("ip16") != ""), to("network_prefix", "ip16"), "sent", me, "published_ip16"),
        edge(is_("revision"), me, "member_of", to("body", "body_sha256"), "body_sha256"), edge(is_("page") & (_text("page_family") != ""), me, "member_of", to("page_family", "page_family"), "published_page_family", family),
    )
    kind = "array<struct<subject: string, kind: string, object: string, method: string, outcome: string>>"
    x = _parsed(rows).select(F.explode(F.array_compact(F.concat(every, F.coalesce(F.when(is_("record"), sites), F.array().cast(kind))))).alias("e"))
    return x.select("e.*").distinct()


def times(rows: DataFrame) -> DataFrame:
    """(tbl, key, clock, at, uncertainty, winning): a timed row's own time and the times of its other clocks."""
    clocks = F.array(F.struct(F.coalesce(_text("winning_clock"), F.lit("published_time")).alias("clock"), _text("time").alias("at"), F.lit(True).alias("winning")), *(F.when(_text(c).isNotNull(), F.struct(F.lit(c).alias("clock"), _text(c).alias("at"), F.lit(False).alias("winning"))) for c in CLOCKS))
    x = _parsed(rows).where(_text("time").isNotNull()).select("tbl", "key", F.try_variant_get("v", "$.uncertainty_seconds", "double").alias("uncertainty"), F.explode(F.array_compact(clocks)).alias("c"))
    return x.select("tbl", "key", "c.clock", F.try_to_timestamp("c.at").alias("at"), "uncertainty", "c.winning")

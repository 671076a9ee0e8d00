"""What each question of the docket may rest on: tables and columns, to be held against its plan (see trace)."""

from __future__ import annotations

from factweave.plans import evidence
from factweave.plans.catalogue import QUERIES
from factweave.sources import trace

_CLAIMS = "l_extendedprice l_linenumber l_orderkey l_partkey l_quantity l_shipdate l_suppkey"  # a claim's id is a digest of several
_JUDGED = f"{_CLAIMS} l_linestatus l_returnflag"
CONTRACT = {
    "DQ1": {"documents": "doc_id lang source"},
    "DQ2": {"documents": "lang source"},
    "DQ3": {"documents": "doc_id n_chars source"},
    "DQ4": {"orders": "o_orderkey o_orderstatus"},
    "DQ5": {"documents": "doc_id source"},
    "DQ6": {"documents": "doc_id source"},
    "DQ7": {"documents": "n_chars source"},
    "DQ8": {"documents": "doc_id lang"},
    "LQ1": {"lineitem": _JUDGED, "orders": "o_orderdate o_orderkey o_orderstatus"},
    "LQ2": {"events": "event_id event_type"},
    "LQ3": {"orders": "o_custkey o_orderkey o_orderpriority o_orderstatus"},
    "LQ4": {"lineitem": _JUDGED, "orders": "o_orderdate o_orderkey o_orderpriority o_orderstatus"},
    "LQ5": {"lineitem": _CLAIMS, "orders": "o_orderdate o_orderkey o_orderstatus"},
    "LQ6": {"lineitem": _JUDGED, "orders": "o_orderdate o_orderkey o_orderstatus"},
    "LQ7": {"events": "event_type ts user_id"},
    "LQ8": {"events": "event_id event_type props ts"},
}


def traceability(spark, d, contract: dict[str, dict[str, str]] | None = None) -> dict[str, tuple[list[str], list[str]]]:
    """By question the columns its plan reads that the contract doesn't list, and those listed that it doesn't read."""
    contract = CONTRACT if contract is None else contract
    out = {}
    for question, (name, _, _) in evidence._DOCKET.items():
        with trace.tracing():
            found = trace.columns_read(QUERIES[name](spark, d))
        out[question] = trace.untraced(found, contract.get(question, {}))
    return out

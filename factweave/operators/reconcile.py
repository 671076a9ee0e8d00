"""The decision ladder: which claim produced each record, or why no answer is given."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.checks import population_status, repeated
from factweave.operators.receipts import normalised, prepared, same_prepared, unwrapped


def binding(token: Column, commitment: Column) -> Column:
    """unavailable: no commitment; unbound: no token; bound: the token's digest is the commitment; else mismatch."""
    return bound_by(F.sha2(token, 256), commitment)


def bound_by(digest: Column, commitment: Column) -> Column:
    """The same for the token's digest."""
    return F.when(commitment.isNull(), "unavailable").when(digest.isNull(), "unbound").when(digest == commitment, "bound").otherwise("mismatch")


def clock_bound(bound: str | float | None, times: int = 1) -> Column | None:
    """times the bound, given as an interval ('365 days') or in seconds; null for none.  It must be finite and not negative."""
    if bound is None:
        return None
    if isinstance(bound, str):
        if bound.strip().startswith("-"):
            raise ValueError("a clock bound is finite and not negative")
        return F.expr(f"{times} * interval {bound}")
    if not math.isfinite(bound) or bound < 0:
        raise ValueError("a clock bound is finite and not negative")
    return F.expr(f"{times} * interval {float(bound):.6f} seconds")


def candidates(records: DataFrame, claims: DataFrame, bound: str | float | None, keyed: bool = False, versions: bool = False, payloads: bool = False, vary: Callable[[DataFrame], DataFrame] | None = None, told: tuple[str, ...] = ()) -> DataFrame:
    """Each record with its claims by event id (or none), and what the ladder asks of each pair.

    keyed: a claim must also give the record's name (claim_name) and, where the record has one, its namespace
    (claim_ns).  versions: a digest that the claim attests must be the record's where both are known.  These are
    conditions of the one equi-join, never a join of their own, and no keys of it: rows are dealt by the event alone, as
    the aggregation needs them.  A record's ts_lower, if it has the column, is the
    earliest time it may have been made; without a value nothing is too early.  Tokens are digested before the join,
    once for each claim.  What the sources' declarations say of a record's observers may stand in its column trusted, else
    each claim says it in indep.  vary changes the joined pairs before
    they are judged, and may repeat them under other assumptions (see reconcile()).  told: more of the claims' columns.
    """
    extra = ["claim_ns", "claim_name"] * keyed + ["attested"] * versions
    extra += [c for c in ("indep", "witness", "citation") if c in claims.columns] + [*told]
    named = claims.select(F.col("event_id").alias("claim_event"), "cid", "t0", "t1", F.sha2("token", 256).alias("digest"), "authentic", "exclusive", *extra, *([F.col("payload").alias("claim_payload")] if payloads else []))
    lower = [c for c in ("ts_lower",) if c in records.columns]
    observed = [c for c in ("trusted", "record_witness") if c in records.columns]
    on = F.col("event_id") == F.col("claim_event")
    if keyed:
        on &= F.coalesce(F.col("name") == F.col("claim_name"), F.lit(False)) & (F.col("ns").isNull() | (F.col("ns") == F.col("claim_ns")))
    if versions:
        on &= F.col("sha").isNull() | F.col("attested").isNull() | (F.col("sha") == F.col("attested"))
    given = records.select("event_id", "ns", "token_sha", "ts", "idem", *lower, *observed, *["name"] * keyed, *["sha"] * versions, *["payload"] * payloads)
    pair = given.join(named, on, "left")
    if vary:
        pair = vary(pair)
    b = clock_bound(bound)
    has = F.col("cid").isNotNull()
    bind = F.when(has, bound_by(F.col("digest"), F.col("token_sha")))
    kept = has & (bind != "mismatch")
    if b is None:
        late = early = F.lit(None).cast("boolean")
    else:
        late, early = F.col("t0") > F.col("ts") + b, F.col("t1") < F.col("ts") - b
        if lower:
            early = F.coalesce(F.col("t1") < F.col("ts_lower") - b, F.lit(False))
    fit = kept & ~(late | early)
    same = F.coalesce(F.col("claim_payload") == F.col("payload"), F.lit(False)) if payloads else F.lit(False)
    other = F.coalesce(F.col("claim_payload") != F.col("payload"), F.lit(False)) if payloads else F.lit(False)
    untimed = kept if b is None else kept & (F.col("t0").isNull() | F.col("t1").isNull() | F.col("ts").isNull() | (~F.col("clock") if "clock" in pair.columns else F.lit(False)))
    return pair.select(
        "*", has.alias("has"), bind.alias("bind"), kept.alias("rem"), (kept & late).alias("late"), (kept & (late | early)).alias("off"),
        untimed.alias("untimed"), fit.alias("fit"), (fit & same).alias("exact"), (fit & ~other).alias("close"),
    )


def reconcile(records: DataFrame, claims: DataFrame, bound: str | float | None = "365 days", idempotent: bool = False, keyed: bool = False, versions: bool = False, payloads: bool = False, vary: Callable[[DataFrame], DataFrame] | None = None, per: tuple[str, ...] = (), witnesses: bool = False, told: tuple[str, ...] = ()) -> DataFrame:
    """event_id, outcome, method, n_candidates and the claim (if supported) of every record.

    One shuffle on the event id serves the join and the aggregation; the rules are one CASE over its counts, so
    row order decides nothing.  idempotent: of several fitting claims of an idempotent record, the earliest
    stands alone if it ended more than twice the bound before the next began.  keyed and versions: see candidates();
    a keyed record without a name can't be matched (field_check).  payloads: of several fitting claims, those with
    another payload than the record's go where one has the same.  Without a bound nothing is timed
    (clock_bound_missing).  Ids of claims are unique: see refuse_repeated().  witnesses adds those of the record
    (record_witness) and of the claims that were left (witness), and what kept() needs.  told: columns of the claims that
    come back, at the end, with the claim of a supported record.

    vary repeats each joined pair under several assumptions, told apart by the columns per, which come back; a pair
    without cid counts as a record without that claim, and where clock is false nothing is timed.  As it follows the join and the aggregation
    keeps the join's partitioning, evidence is shuffled once for all assumptions.
    """
    x = candidates(records, claims, bound, keyed, versions, payloads, vary, told)
    named = ("cid", "bind", "authentic", "exclusive", *told)
    timed = idempotent and bound is not None
    if timed:  # the join has sorted by event, so this neither moves nor sorts rows again
        fits = F.when(F.col("idem") & F.col("fit"), F.struct("t0", "t1", *named, *["witness"] * witnesses))
        x = x.withColumn("f", fits).withColumn("earliest", F.min("f").over(Window.partitionBy("event_id", *per)))
    n = lambda c: F.count_if(F.col(c))
    best = lambda c: F.max(F.when(F.col(c), F.struct(*named)))
    sums = x.groupBy("event_id", *per).agg(
        n("has").alias("n_all"), n("rem").alias("n_rem"), n("untimed").alias("n_untimed"), n("late").alias("n_late"), n("off").alias("n_off"), n("fit").alias("n_fit"),
        F.coalesce(F.first("trusted") if "trusted" in x.columns else F.bool_and("indep"), F.lit(False)).alias("independent"), best("fit").alias("one"), F.first("ns").alias("ns"), F.first("idem").alias("idem"),
        *([F.first("name").alias("name")] if keyed else []),
        *([F.first("earliest").alias("earliest"), F.min(F.when(F.col("f") > F.col("earliest"), F.col("f.t0"))).alias("next")] if timed else []),
        *([n("exact").alias("n_exact"), n("close").alias("n_close"), best("close").alias("near")] if payloads else []),
        *([F.collect_set(F.when(F.col(c), F.col("witness"))).alias(f"w_{c}") for c in ("has", "rem", "fit", "close")] + [F.first("record_witness").alias("record_witness")] if witnesses else []),
    ).withColumn("left", F.lit("fit"))
    if timed:
        first = F.col("earliest")
        alone = F.coalesce(F.col("earliest.t1") + clock_bound(bound, 2) < F.col("next"), F.lit(False))
        sums = sums.withColumn("one", F.when(alone, F.struct(*(first[c].alias(c) for c in named))).otherwise(F.col("one"))).withColumn("left", F.when(alone, "first").otherwise(F.col("left"))).withColumn("n_fit", F.when(alone, F.lit(1)).otherwise(F.col("n_fit")))
    if payloads:
        parted = (F.col("n_fit") > 1) & (F.col("n_exact") > 0)
        sums = sums.withColumns({"left": F.when(parted, "close").otherwise(F.col("left")), "one": F.when(parted, F.col("near")).otherwise(F.col("one")), "n_fit": F.when(parted, F.col("n_close")).otherwise(F.col("n_fit"))})
    rule = F.when(F.col("name").isNull(), "field_check") if keyed else F.when(F.lit(False), "field_check")
    rule = rule.when((F.col("n_all") > 0) & (F.col("n_rem") == 0), "receipt_binding_mismatch").when(F.col("n_rem") == 0, "key_and_version")
    rule = rule.when(F.col("n_untimed") > 0, "clock_bound_missing").when(F.col("n_late") == F.col("n_rem"), "contradiction_R3")
    rule = rule.when(F.col("n_off") == F.col("n_rem"), "execution_window_disjoint").when(F.col("ns").isNull(), "namespace_unknown")
    rule = rule.when(F.col("n_fit") > 1, "unseparated_candidates").when(~F.col("independent"), "trust_not_independent")
    rule = rule.when((F.col("one.bind") == "bound") & F.col("one.exclusive"), "independent_receipt_binding").when(F.col("one.bind") == "unbound", "receipt_binding_missing")
    rule = rule.when(F.col("one.authentic"), "independent_receipt").when(F.col("one.bind") == "bound", "receipt_possession_only").otherwise("attribution_unbound")
    out = sums.withColumn("method", rule).withColumn("outcome", outcome_of(F.col("method")))
    count = F.when(F.col("method") == "receipt_binding_mismatch", F.col("n_all")).when(F.col("method").isin("contradiction_R3", "execution_window_disjoint", "clock_bound_missing"), F.col("n_rem")).otherwise(F.col("n_fit"))
    more = []
    if witnesses:
        stage = F.when(F.col("method").isin("field_check", "key_and_version"), "none").when(F.col("method") == "receipt_binding_mismatch", "has")
        stage = stage.when(F.col("method").isin("contradiction_R3", "execution_window_disjoint", "clock_bound_missing"), "rem").otherwise(F.col("left"))
        of = F.when(stage == "none", F.array()).when(stage == "has", F.col("w_has")).when(stage == "rem", F.col("w_rem")).when(stage == "close", F.col("w_close")).otherwise(F.col("w_fit"))
        if timed:
            of = F.when(stage == "first", F.array_compact(F.array("earliest.witness"))).otherwise(of)
        more = [F.array_sort(F.array_union(F.array_compact(F.array("record_witness")), of)).alias("witnesses"), stage.alias("left"), F.col("one.cid").alias("first")]
    its = lambda c: F.when(F.col("outcome") == "supported", F.col(f"one.{c}")).alias(c)
    return out.select("event_id", *per, "outcome", "method", count.cast("long").alias("n_candidates"), its("cid"), *more, *(its(c) for c in told))


def kept(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(event_id, cid, witness, citation) of the claims that stand behind each edge of reconcile(..., witnesses=True), as
    rows, for a record may have any number; pairs: what candidates() gives for the same records and claims."""
    e = edges.select(F.col("event_id").alias("of"), "left", "first").where("left <> 'none'")
    stays = F.when(F.col("left") == "has", F.col("has")).when(F.col("left") == "rem", F.col("rem")).when(F.col("left") == "close", F.col("close")).when(F.col("left") == "first", F.col("cid") == F.col("first")).otherwise(F.col("fit"))
    return pairs.join(e, F.col("event_id") == F.col("of")).where(stays).select("event_id", "cid", "witness", "citation")


def refuse_repeated(claims: DataFrame, id: str = "cid") -> DataFrame:
    """claims, if no id stands on two of them; else a ValueError that names some.  Counts ids, in one shuffle, at once."""
    twice = repeated(claims.select(id), id).orderBy(id).limit(6).collect()
    if twice:
        raise ValueError(f"repeated action ids: {', '.join(str(r[id]) for r in twice[:5])}{' and more' if len(twice) > 5 else ''}")
    return claims


def outcome_of(method: Column) -> Column:
    bad = method.isin("receipt_binding_mismatch", "contradiction_R3", "execution_window_disjoint")
    good = method.isin("independent_receipt_binding", "independent_receipt")
    return F.when(bad, "contradicted").when(good, "supported").when(method == "key_and_version", "unmatched").when(method.isin("clock_bound_missing", "field_check"), "not_assessable").otherwise("ambiguous")


def absent_claims(claims: DataFrame, records: DataFrame, population: DataFrame, bound: str = "365 days", declared: DataFrame | None = None) -> DataFrame:
    """Claims that name no record, judged where exactly one population of their namespace is declared.

    With declared, the ids (ns, event_id) of the populations, a population counts as complete only if those are the
    records' ids, none twice, and its count n is theirs; without it the flag complete is taken at its word.
    """
    once = population.withColumn("declared", F.count("*").over(Window.partitionBy("ns"))).where("declared = 1").drop("declared")
    if declared is not None:
        status = population_status(declared, once, records).select("ns", F.col("complete").alias("equal"))
        once = once.join(status, "ns").withColumn("complete", F.col("complete") & F.col("equal")).drop("equal")
    b = F.expr(f"interval {bound}")
    ids = records.select("event_id").distinct().hint("shuffle_hash")  # so claims are not sorted for it
    gone = claims.join(ids, "event_id", "left_anti").join(once, "ns")
    sure = F.col("complete") & (F.col("t0") - b >= F.col("started_at")) & (F.col("t1") + b <= F.col("stopped_at")) & F.col("indep")
    return gone.select("cid", "ns", F.when(sure, "contradicted").otherwise("not_assessable").alias("outcome"))


def binding_checks(claims: DataFrame, records: DataFrame) -> DataFrame:
    """Claims that name a record but whose token is missing or wrong."""
    x = claims.join(records.select("event_id", "token_sha"), "event_id").withColumn("bind", binding(F.col("token"), F.col("token_sha")))
    return x.where("bind in ('mismatch', 'unbound')").select("cid", "event_id", "bind", F.when((F.col("bind") == "mismatch") & F.col("indep"), "contradicted").otherwise("ambiguous").alias("outcome"))


def said_and_done(rows: DataFrame, command: str, output: str, unwrap: bool) -> DataFrame:
    """rows with command and output as pairs are judged: once for each row, before any pair is made."""
    c = F.col(command).cast("string")
    return rows.withColumn(command, normalised(F.coalesce(unwrapped(c, ("-c",)) if unwrap else c, F.lit("")))).withColumn(output, prepared(F.col(output).cast("string")))


def pair_outcome(exec_: Column, cmd: Column, e_cmd: Column, output: Column, e_output: Column) -> Column:
    """no_pair without an execution, unmatched by another command, not_assessable where a side has no output, else
    whether the outputs say the same (see receipts.same_output)."""
    same = same_prepared(output, e_output)
    return F.when(exec_.isNull(), "no_pair").when(cmd != e_cmd, "unmatched").when(same.isNull(), "not_assessable").when(same, "supported").otherwise("contradicted")


def corroborate(tools: DataFrame, execs: DataFrame, slack: str = "12 hours") -> DataFrame:
    """Each tool call with every sandbox execution of its transcript within the window, and the pair's outcome.

    Commands are compared without shell and spacing, outputs tolerantly.  A call without a command (null) is none; one
    without an end meets its whole transcript.  Calls meet executions by transcript and day, so a long transcript is no
    single group; tool is unique.
    """
    s, day = F.expr(f"interval {slack}"), lambda t: F.datediff(t.cast("date"), F.lit("1970-01-01"))
    tools = said_and_done(tools.where("cmd is not null"), "cmd", "output", False)
    e = said_and_done(execs, "cmd", "output", True).select("transcript", "exec", "t", F.col("cmd").alias("e_cmd"), F.col("output").alias("e_output"), day(F.col("t")).alias("day"))
    ended = tools.where("t1 is not null").withColumn("day", F.explode(F.sequence(day(F.col("t0") - s), day(F.col("t1") + s))))
    near = ended.join(e, ["transcript", "day"]).where((F.col("t") >= F.col("t0") - s) & (F.col("t") <= F.col("t1") + s))
    judged = lambda pairs: pairs.select("tool", "exec", pair_outcome(F.col("exec"), F.col("cmd"), F.col("e_cmd"), F.col("output"), F.col("e_output")).alias("outcome"))
    open_ = tools.where("t1 is null").join(e.drop("day"), "transcript")
    pairs = judged(near).unionByName(judged(open_))
    alone = F.col("outcome").isNull()
    return tools.select("tool").join(pairs, "tool", "left").withColumn("outcome", F.when(alone, "no_pair").otherwise(F.col("outcome")))

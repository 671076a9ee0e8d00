"""Transcripts read from nested lines, and what tool calls and sandbox runs say of each other."""

import hashlib
import json

import pytest

from factweave.operators import reconcile as R
from factweave.sources import transcripts as T

AT = "2026-01-01T00:00:0{}+00:00"


def tool(id, t, **more):
    return {"event": "tool", "uuid": id, "timestamp": AT.format(t), "function": "bash", "arguments": {"cmd": "echo REAL"}, "result": "REAL"} | more


LINES = [
    {"transcript_id": "B", "messages": [
        {"id": "m0", "role": "user", "content": "Handle: B\nAgent label = b1\nHandle: C"}, {"id": "m1", "role": "assistant", "content": "Handle: no"},
        {"id": "m2", "role": "system", "content": [{"text": "Handle: B"}, {"image": 1}, {"text": "more"}]}, {"role": "user", "content": "Handle: lost"}],
     "events": [
        tool("e0", 0, function="start_job", arguments={"version": "a" * 64}, result=json.dumps({"started": True, "job_id": "job-1"})),
        tool("e1", 1, function="start_job", arguments={"version": "b" * 64}, result=json.dumps({"started": True, "job_id": "job-1"})),
        tool("e2", 2, function="start_job", result=json.dumps({"started": True, "job_id": "job-2"}), error={"type": "x"}),
        tool("e3", 3, function="start_job", result=json.dumps({"started": "true", "job_id": "job-3"})),
        {"event": "sandbox", "uuid": "e4", "timestamp": AT.format(3), "cmd": "bash -c 'echo REAL'", "output": "REAL\nextra", "result": 0},
        {"event": "model", "uuid": "e5", "timestamp": AT.format(4), "completed": AT.format(9)}, {"event": "state", "uuid": "e6", "timestamp": AT.format(9)}, {"event": "info", "timestamp": AT.format(9)}]},
    {"transcript_id": "D", "event": tool("e0", 5, result=[{"text": "x"}, {"text": "y"}])},
    {"transcript_id": "D", "event": tool("e0", 6, result="again")},
    {"transcript_id": "E"},
    {"message": {"id": "m"}},
]


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lines")
    (path / "a.jsonl").write_text("\n".join(map(json.dumps, LINES)) + "\n\n{broken\n")
    return str(path), T.load(spark, str(path), (T.HANDLE, r"Agent label = (\S+)"))


def test_nodes(read):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {(r.subkind, r.key): r for r in read[1].nodes.collect()}
    assert {k: v.n for k, v in got.items()} == {
        **{("tool_event", f"B:e{i}"): 1 for i in range(4)}, ("tool_event", "D:e0"): 2, ("sandbox_exec", "B:e4"): 1, **{("message", f"B:m{i}"): 1 for i in range(3)},
        ("handle", "B:B"): 2, ("handle", "B:C"): 1, ("handle", "B:b1"): 1, ("job", "job-1"): 2,
    }
    assert got["job", "job-1"].claimed == "a" * 64 and got["job", "job-1"].via == "B:e0"  # the first launch stands
    assert got["tool_event", "D:e0"].output == "x\ny" and got["tool_event", "D:e0"].claimed == sha("x\ny")
    assert got["message", "B:m2"].claimed == sha("Handle: B\nmore") and got["handle", "B:B"].via == "B:m0"
    assert got["sandbox_exec", "B:e4"].command == "bash -c 'echo REAL'" and got["tool_event", "B:e2"].error is not None


def test_edges_sessions_and_problems(read):
    t = read[1]
    kinds = {}
    for e in t.edges.collect():
        kinds[e.kind, e.outcome] = kinds.get((e.kind, e.outcome), 0) + 1
    assert kinds == {("member_of", "supported"): 6, ("member_of", "ambiguous"): 3, ("sent", "supported"): 3, ("launched", "ambiguous"): 2}
    ends = {r.transcript: (r.events_considered, r.messages, r.final_event, r.final_type) for r in t.sessions.collect()}
    assert ends == {"B": (7, 3, "B:e6", "state"), "D": (2, 0, "D:e0", "tool"), "E": (0, 0, None, None)}
    assert sorted((r.reason, r.transcript, r.key, r.n) for r in t.problems.collect() if r.transcript) == [("event_without_uuid", "B", None, 1), ("message_without_id", "B", None, 1), ("repeated_event", "D", "D:e0", 2)]
    assert [(r.reason, r.n) for r in t.problems.where("transcript is null").collect()] == [("no_transcript", 2)]
    assert {(r.handle, r.n_sessions, r.final_event) for r in t.final_of_handles().collect()} == {(h, 1, "B:e6") for h in ("B", "C", "b1")}


def test_one_scan(spark, read, capsys):
    T.facts(T.items(spark, read[0])).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan


def test_patterns_have_one_group(spark, read):
    with pytest.raises(ValueError):
        T.facts(T.items(spark, read[0]), ("no group",))


@pytest.mark.parametrize(("said", "ran", "outcome"), [("REAL", "REAL\nextra", "supported"), ("fabricated", "REAL", "contradicted"), ("", "REAL", "not_assessable"), (" a\n\nb \nc\nd", " a\nb\r\nc\ne", "supported")])
def test_tolerant_pairs(spark, said, ran, outcome):
    """The same command within a shell; another command in the window neither corroborates nor contradicts."""
    tools = spark.sql("select 'x' transcript, 1 tool, timestamp'2026-01-01 00:00:00' t0, timestamp'2026-01-01 00:00:01' t1, 'echo  REAL' cmd, :said output", {"said": said})
    execs = spark.createDataFrame([("x", 1, "bash -c 'echo REAL'", ran, 0.0), ("x", 2, "rm unrelated", "denied", 1.5), ("x", 3, "echo REAL", ran, 4.0)], "transcript string, exec int, cmd string, output string, s double")
    execs = execs.selectExpr("transcript", "exec", "cmd", "output", "timestamp_millis(cast(1767225600000 + s * 1000 as long)) t")
    assert sorted((r.exec, r.outcome) for r in R.corroborate(tools, execs, "2 seconds").collect()) == [(1, outcome), (2, "unmatched")]
    open_ = tools.selectExpr("transcript", "tool", "t0", "cast(null as timestamp) t1", "cmd", "output")
    assert sorted((r.exec, r.outcome) for r in R.corroborate(open_, execs, "2 seconds").collect()) == [(1, outcome), (2, "unmatched"), (3, outcome)]
    none = tools.selectExpr("transcript", "tool", "t0", "t1", "cast(null as string) cmd", "output")
    assert R.corroborate(none, execs).collect() == []

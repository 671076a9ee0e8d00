"""Every question's plan reads what its contract lists, and nothing else."""

from factweave.plans import questions

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    assert questions.traceability(spark, SF) == {q: ([], []) for q in questions.CONTRACT}
    assert len(questions.CONTRACT) == 16


def test_an_unlisted_column_shows(spark):
    short = {**questions.CONTRACT, "LQ7": {"events": "event_type ts value"}, "DQ6": {}}
    got = {q: x for q, x in questions.traceability(spark, SF, short).items() if x != ([], [])}
    assert got == {"LQ7": (["events.user_id"], ["events.value"]), "DQ6": (["documents.doc_id", "documents.source"], [])}

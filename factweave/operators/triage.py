"""Labels and dispositions of messages as column expressions: all of it stays in one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that name each label, in the order in which they are tried.
MENTIONS = r"(?i)\b(writ\w*|wrote|sav\w*|upload\w*|stor\w*|cop(?:y|ied)|mirror\w*|registry|receipt)\b"
CUT_SHORT = r"(?i)^\s*(\.\.\.|…|\[truncated)"
FAILED = r"(?i)\b(fail\w*|reject\w*|denied|error|refused|forbidden)\b"
CASCADE = {
    "quotes_other_claim": r"(?i)(\btold me\b|\baccording to\b|\breported that\b|\bcopied from\b|\bper \w+'s\b|\b\w+ says it\b|\bbanner said\b)",
    "reports_failed_write": FAILED,
    "denies_write": r"(?i)\b(did not|didn't|never|haven't|have not|nothing)\b",
    "plans_write": r"(?i)\b(will|going to|about to|let me|i'll|plan\w*|next|please|prepare|mirror)\b",
    "claims_completed_write": r"(?i)\b(wrote|written|saved|uploaded|stored|created|accepted|succeeded|copied|is in)\b",
}


def write_claim(role: Column, text: Column, calls: Column) -> Column:
    """What a message says about a write; calls: whether it calls (a tool row: answers) the writing function.

    A null text counts as empty, a null role as no tool and null calls as false.
    """
    text, calls = F.coalesce(text, F.lit("")), F.coalesce(calls, F.lit(False))
    truthy = lambda path: ~F.coalesce(F.get_json_object(text, path), F.lit("")).isin("", "false", "0")
    tool = F.when(~calls, "no_write_claim").when(text.rlike(FAILED), "reports_failed_write")
    tool = tool.when(truthy("$.accepted") | truthy("$.event_id"), "claims_completed_write").otherwise("insufficient_context")
    said = F.when(text.rlike(CUT_SHORT), "insufficient_context").when(~text.rlike(MENTIONS) & ~calls, "no_write_claim")
    for label, pattern in CASCADE.items():
        said = said.when(text.rlike(pattern), label)
    return F.when(role == "tool", tool).otherwise(said.when(calls, "plans_write").otherwise("no_write_claim"))


def search_disposition(score: Column, confidence: Column) -> Column:
    """Queue of a search answer: scores of 1.5 go to review, unsure ones of 0.5 to uncertain; null: unscored."""
    return F.when(score.isNull(), "unscored").when(score >= 1.5, "review").when((score >= 0.5) & (confidence < 0.5), "uncertain").otherwise("background")


# What counts as saying something about a write, and the policy's limits.
WRITE_STATEMENTS = ("claims_completed_write", "reports_failed_write", "plans_write", "denies_write", "quotes_other_claim")
UNCERTAIN_BELOW, BACKGROUND_MAX_WRITE_MASS, RELAY_NOTE_AT = 0.8, 0.1, 0.05
ROUNDING = 0.005


def answer_status(probabilities: Column, options: list[str], choice: Column | None = None, score: Column | None = None) -> Column:
    """answered, unavailable (null probabilities), or which rule a distribution over the options breaks.

    choice: the option chosen, which must be offered and of the highest probability; score: the expectation of
    the options' positions.  Keys must be exactly the options, values within 0 and 1 and of sum 1 but for rounding.
    """
    ps, n = F.map_values(probabilities), len(options)
    off = F.exists(ps, lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    total = F.aggregate(ps, F.lit(0.0), lambda a, p: a + p)
    named = F.array_sort(F.map_keys(probabilities)) == F.array(*(F.lit(o) for o in sorted(options)))
    out = F.when(probabilities.isNull(), "unavailable").when(~named, "options_differ").when(off, "not_a_probability")
    out = out.when(F.abs(total - 1) > ROUNDING * n + 1e-9, "sum_differs")
    if choice is not None:
        out = out.when(choice.isNull() | ~choice.isin(*options), "choice_not_offered").when(F.try_element_at(probabilities, choice) + 1e-9 < F.array_max(ps), "choice_not_highest")
    if score is not None:
        expected = sum((F.try_element_at(probabilities, F.lit(o)) * k for k, o in enumerate(options)), F.lit(0.0))
        out = out.when(score.isNull() | F.isnan(score) | (F.abs(score - expected) > ROUNDING * n * (n - 1) / 2 + 0.01), "score_differs")
    return out.otherwise("answered")


def write_disposition(status: Column, label: Column, probabilities: Column, confidence: Column) -> tuple[Column, Column]:
    """Queue of a write-claim answer, and whether it may be relayed; anything but an answered one is unscored."""
    p = lambda o: F.coalesce(F.try_element_at(probabilities, F.lit(o)), F.lit(0.0))
    mass = sum((p(o) for o in WRITE_STATEMENTS), F.lit(0.0))
    says, sure = label.isin(*WRITE_STATEMENTS), F.coalesce(confidence, F.lit(0.0)) >= UNCERTAIN_BELOW
    queue = F.when(status != "answered", "unscored").when(says, "review")
    queue = queue.when((label == "insufficient_context") | ~sure | (mass > BACKGROUND_MAX_WRITE_MASS), "uncertain").otherwise("background")
    relayed = (status == "answered") & says & (label != "quotes_other_claim") & (p("quotes_other_claim") >= RELAY_NOTE_AT)
    return queue, F.coalesce(relayed, F.lit(False))

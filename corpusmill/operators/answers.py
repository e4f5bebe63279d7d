"""Checks of answers: what they cite, what they may not say, and whether they meet the expectations of a case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.relations import digests

# Questions about one's own case, and answers that foretell its outcome.
PERSONAL = r"(?i)\b(my|me|i|we|our)\b.*\b(evict|eviction|housing\s+court|court\s+case|nonpayment|holdover|landlord)\b|\b(will|can)\s+i\s+(win|lose|be\s+evicted)"
OUTCOME = r"(?i)\b(you|your case)\b.{0,80}\b(will|would|can)\b.{0,40}\b(win|lose|be evicted|succeed|fail)\b|\b(you will win|you will lose)\b"
# Statuses of answers, and the behaviours that a case may expect instead of an answer.
ANSWERED, DECLINED = ["answered", "synthetic_demo"], ["unsupported", "insufficient_coverage"]
NO_ANSWER = ["unsupported", "unsupported_outcome_prediction"]
# What an answer without its internal ids is cleaned of, in this order, and what stands there instead.
CLEANED = [(r"\(\s*\)", ""), (r"(?im)^[ \t]*(?:citations?|sources?)\s*:\s*[,;|\-\s]*\n?", ""), (r"[ \t]+([,.;:])", "$1"), (r"\n{3,}", "\n\n")]


def personal_scenario(question: Column) -> Column:
    return F.coalesce(question.rlike(PERSONAL), F.lit(False))


def outcome_prediction(answer: Column) -> Column:
    return F.coalesce(answer.rlike(OUTCOME), F.lit(False))


def valid_citations(cited: Column, retrieved: Column) -> Column:
    """The cited ids that were retrieved, each once, in the order of citing."""
    return F.filter(F.array_distinct(cited), lambda c: F.array_contains(retrieved, c))


def public_citations(answers: DataFrame, key: str, cited: str, results: DataFrame) -> DataFrame:
    """key, place and the citation, source name and URL of each cited result, in the order of citing; unknown ids are left out.

    ``results``: key, chunk_id, citation, source_name, source_url.
    """
    asked = answers.select(key, F.posexplode(cited).alias("place", "chunk_id"))
    return asked.join(results.select(key, "chunk_id", "citation", "source_name", "source_url"), [key, "chunk_id"])


def without_ids(answer: Column, ids: Column) -> Column:
    """An answer without internal ids, longest first, and without the brackets, labels and gaps that they leave behind."""
    by_length = F.array_sort(F.array_distinct(ids), lambda a, b: F.length(b) - F.length(a))
    bare = F.aggregate(by_length, answer, lambda text, i: F.replace(text, i, F.lit("")))
    return reduce(lambda text, rule: F.regexp_replace(text, *rule), [*CLEANED, (r"(?U)^\s+|\s+$", "")], bare)


def failed_expectations(cases: DataFrame) -> DataFrame:
    """``cases`` with failures, the names of the expectations that an answer doesn't meet; absent expectations hold.

    Columns: expected_status, min_citation_count, required_source_name_contains, required_source_type,
    required_citation_contains, required_answer_terms of the case; answer, answer_status, and citations, an array of
    structs with citation, source_name and source_type, of the answer.
    """
    held = lambda field: F.transform(F.coalesce(F.col("citations"), F.array().cast(cases.schema["citations"].dataType)), lambda c: F.lower(F.coalesce(c[field], F.lit(""))))
    within = lambda field, wanted: F.exists(held(field), lambda x: F.contains(x, F.lower(F.col(wanted))))
    given = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    answer = F.lower(F.coalesce("answer", F.lit("")))
    tests = {
        "status": given("expected_status") & ~F.col("expected_status").eqNullSafe(F.col("answer_status")),
        "citation_count": F.size(held("citation")) < F.coalesce("min_citation_count", F.lit(0)),
        "source_name": given("required_source_name_contains") & ~within("source_name", "required_source_name_contains"),
        "source_type": given("required_source_type") & ~F.array_contains(held("source_type"), F.lower(F.coalesce("required_source_type", F.lit("")))),
        "citation": given("required_citation_contains") & ~within("citation", "required_citation_contains"),
    }
    terms = F.filter(F.coalesce("required_answer_terms", F.array().cast("array<string>")), lambda t: ~F.contains(answer, F.lower(t)))
    named = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    return cases.withColumn("failures", F.concat(named, F.transform(terms, lambda t: F.concat(F.lit("term:"), t))))


def case_passes(behavior: Column, status: Column, expected_citations: Column, returned_citations: Column, expected_source: Column, returned_sources: Column) -> Column:
    """Whether an answer does what its case expects: declines, or answers with one of the citations and the source expected."""
    cites = (F.size(expected_citations) <= 0) | F.arrays_overlap(expected_citations, returned_citations)
    sourced = expected_source.isNull() | F.array_contains(returned_sources, expected_source)
    return F.coalesce(F.when(behavior.isin(NO_ANSWER), status.isin(DECLINED)).otherwise(status.isin(ANSWERED) & cites & sourced), F.lit(False))


def evaluation_run(checks: DataFrame, run: str, passed: str, snapshot: str) -> DataFrame:
    """A row per run: cases, passed ones, whether all passed, and whether the snapshot stayed the same, without which none counts."""
    whole = checks.groupBy(run).agg(F.count("*").alias("cases"), F.count_if(F.col(passed)).alias("passed"), F.count_distinct(snapshot).alias("_snapshots"))
    return whole.select(run, "cases", "passed", ((F.col("cases") == F.col("passed")) & (F.col("_snapshots") == 1)).alias("all_passed"), (F.col("_snapshots") > 1).alias("stopped"))


def report_digest(report: DataFrame, run: str, *columns: str) -> DataFrame:
    """run and a hash of its rows, whatever their order."""
    return digests(report, run, *columns)

"""Schemas of records that come in as JSON, and their checks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASK = """
schema_version string, task_id string, benchmark_id string, upstream_task_id string, split string, task_family string,
input struct<prompt:string,language:string,as_of:string,attachments:array<string>>,
expected_output struct<answer_form:string,citation_required:boolean,structured_fields:array<string>>,
constraints struct<internet_required:boolean,timeout_seconds:bigint,max_search_calls:bigint,allowed_tools:array<string>,forbidden_domains:array<string>,required_domains:array<string>>,
provenance struct<source_file:string,source_row:bigint,source_hash:string,extraction_version:string>, tags array<string>
"""
GOLD = """
schema_version string, task_id string, answer_type string, reference_answer string, acceptable_answers array<string>,
unacceptable_answers array<string>, temporal_scope struct<valid_as_of:string,valid_from:string,valid_until:string>
"""
SUBMISSION = """
run_id string, case_id string, attempt_id string, task_id string, track string, final_answer string,
sections array<struct<section_id:string,heading:string,text:string>>,
citations array<struct<citation_id:string,display_text:string,visible_url:string,resolved_url:string,quoted_text:string,claim_ids:array<string>,collection_status:string>>
"""
EVIDENCE = """
evidence_id string, citation_id string, requested_url string, resolved_url string, redirect_chain array<string>, retrieved_at string,
status string, http_status int, title string, publisher string, published_at string, sha256 string, error_code string
"""
SCORE = "score_id string, run_id string, case_id string, attempt_id string, metric_id string, grader_id string, grader_version string, status string, value_json string, record_uri string"
EVENT = "event_id string, run_id string, case_id string, attempt_id string, seq bigint, event_type string, payload_json string, created_at string"
CALIBRATION = "expected string, verdict struct<claim_id:string,citation_id:string,verdict:string,score:double,confidence:double>"
INFERENCE = "Question string, Answer string, eval_result array<struct<model_extracted_answer:string,model_prediction:string,is_correct:string,model_extracted_confidence:string>>"

#: Fixed values.
EVIDENCE_STATES = ["fetched", "login_required", "paywalled", "blocked", "not_found", "error"]
VERDICTS = ["supported", "partially_supported", "contradicted", "irrelevant", "insufficient_evidence", "evidence_unavailable"]
SCORE_STATES = ["scored", "not_observable", "not_applicable", "failed"]

Check = tuple[str, Column]


def present(name: str) -> Check:
    return f"{name} is missing or empty", F.coalesce(F.length(name) > 0, F.lit(False))


def one_of(name: str, values: Sequence[str]) -> Check:
    return f"{name} is not an allowed value", F.coalesce(F.col(name).isin(list(values)), F.lit(False))


def between(name: str, low: float, high: float) -> Check:
    return f"{name} is out of range", F.col(name).isNull() | F.col(name).between(low, high)


def digest(name: str) -> Check:
    return f"{name} is no sha256 digest", F.coalesce(F.col(name).rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def validate(rows: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their reasons)."""
    reasons = F.filter(F.array(*[F.when(~ok, F.lit(why)) for why, ok in checks]), lambda r: r.isNotNull())
    marked = rows.withColumn("invalid_reason", reasons)
    return marked.where(F.size("invalid_reason") == 0).drop("invalid_reason"), marked.where(F.size("invalid_reason") > 0)


def task_checks() -> list[Check]:
    return [
        present("task_id"),
        present("benchmark_id"),
        present("split"),
        ("input.prompt is empty", F.coalesce(F.length("input.prompt") > 0, F.lit(False))),
        ("timeout_seconds is not positive", F.coalesce(F.col("constraints.timeout_seconds") > 0, F.lit(False))),
    ]


def unknown_fields(raw: DataFrame, line: str, allowed: Sequence[str]) -> Column:
    """Keys of a JSON line that the schema doesn't have: reading with a schema drops them without a word."""
    return F.array_except(F.json_object_keys(line), F.array(*[F.lit(a) for a in allowed]))

"""Record types as trees of checks: one description, compiled to Column expressions over JSON text and to JSON Schema (draft 7).

A record is checked as a variant, so nested lists are walked inside the row: nothing is exploded or shuffled, and each fault
comes with its path. Whatever is no valid record has its faults in an array; nothing raises.
"""

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import let

Faults = Column  # array<string>: "path: what is wrong"
NONE = "array<string>"


def fault(path: Column, why: str | Column, wrong: Column) -> Faults:
    """One fault where the condition holds (null counts as wrong)."""
    return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.concat(path, F.lit(": "), F.lit(why) if isinstance(why, str) else why))).otherwise(F.array().cast(NONE))


def kind(v: Column) -> Column:
    """string, number, boolean, null, array or object."""
    name = F.schema_of_variant(v)
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("number")
    )


@dataclass(frozen=True)
class Node:
    """What all parts share: null may stand for a nullable one, and an optional one may be missing."""

    nullable: bool = field(default=False, kw_only=True)
    optional: bool = field(default=False, kw_only=True)

    def faults(self, v: Column, path: Column) -> Faults:
        found = self.own_faults(v, path)
        return F.when(F.is_variant_null(v), F.array().cast(NONE)).otherwise(found) if self.nullable else found

    def in_record(self, path: Column) -> Callable[[Column], Faults]:
        """The faults of a record's field, which may be missing (an SQL null)."""
        return lambda x: F.when(x.isNull(), fault(path, "missing", F.lit(not self.optional))).otherwise(self.faults(x, path))

    def schema(self) -> dict:
        own = self.own_schema()
        return {"anyOf": [own, {"type": "null"}]} if self.nullable else own


@dataclass(frozen=True)
class Anything(Node):
    def own_faults(self, v, path):
        return F.array().cast(NONE)

    def own_schema(self):
        return {}


@dataclass(frozen=True)
class Text(Node):
    least: int = 0
    pattern: str | None = None
    values: tuple[str, ...] = ()

    def own_faults(self, v, path):
        def checked(x: Column) -> Faults:
            found = [fault(path, "not a string", kind(v) != "string")]
            fine = kind(v) == "string"
            if self.least:
                found.append(fault(path, "too short", fine & (F.length(x) < self.least)))
            if self.pattern:
                found.append(fault(path, "doesn't match", fine & ~x.rlike(self.pattern)))
            if self.values:
                found.append(fault(path, "not an allowed value", fine & ~x.isin(list(self.values))))
            return F.concat(*found)

        return let(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")), checked)

    def own_schema(self):
        if len(self.values) == 1:
            return {"type": "string", "const": self.values[0]}
        return {"type": "string"} | ({"minLength": self.least} if self.least else {}) | ({"pattern": self.pattern} if self.pattern else {}) | ({"enum": list(self.values)} if self.values else {})


@dataclass(frozen=True)
class Number(Node):
    low: float | None = None
    high: float | None = None
    whole: bool = False

    def own_faults(self, v, path):
        def checked(x: Column) -> Faults:
            fine = kind(v) == "number"
            outside = (F.lit(False) if self.low is None else x < self.low) | (F.lit(False) if self.high is None else x > self.high)
            whole = [fault(path, "not a whole number", fine & (x != F.floor(x)))] if self.whole else []
            return F.concat(fault(path, "not a number", ~fine), fault(path, "out of range", fine & outside), *whole)

        return let(F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0)), checked)

    def own_schema(self):
        return {"type": "integer" if self.whole else "number"} | ({} if self.low is None else {"minimum": self.low}) | ({} if self.high is None else {"maximum": self.high})


@dataclass(frozen=True)
class Flag(Node):
    value: bool | None = None

    def own_faults(self, v, path):
        found = fault(path, "not a boolean", kind(v) != "boolean")
        if self.value is None:
            return found
        return F.concat(found, fault(path, "not an allowed value", (kind(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") != self.value)))

    def own_schema(self):
        return {"type": "boolean"} | ({} if self.value is None else {"const": self.value})


@dataclass(frozen=True)
class Scalar(Node):
    """A number, a string or a boolean."""

    def own_faults(self, v, path):
        return fault(path, "not a number, string or boolean", ~kind(v).isin("number", "string", "boolean"))

    def own_schema(self):
        return {"anyOf": [{"type": "number"}, {"type": "string"}, {"type": "boolean"}]}


@dataclass(frozen=True)
class ListOf(Node):
    item: Node = Anything()

    def own_faults(self, v, path):
        items = F.try_variant_get(v, "$", "array<variant>")
        each = lambda x, i: self.item.faults(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        inside = F.array().cast(NONE) if isinstance(self.item, Anything) else F.flatten(F.transform(items, each))
        return F.when(kind(v) == "array", inside).otherwise(fault(path, "not a list", F.lit(True)))

    def own_schema(self):
        return {"type": "array", "items": self.item.schema()}


@dataclass(frozen=True)
class MapOf(Node):
    value: Node = Anything()

    def own_faults(self, v, path):
        entries = lambda: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        each = lambda e: self.value.faults(e["value"], F.concat(path, F.lit("."), e["key"]))
        inside = F.array().cast(NONE) if isinstance(self.value, Anything) else F.flatten(F.transform(entries(), each))
        return F.when(kind(v) == "object", inside).otherwise(fault(path, "not an object", F.lit(True)))

    def own_schema(self):
        return {"type": "object", "additionalProperties": self.value.schema()}


def _strings(v: Column, where: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{where}", "array<string>"), F.array().cast(NONE))


def _items(v: Column, where: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{where}", "array<variant>"), F.array().cast("array<variant>"))


def _ids(v: Column, where: str, name: str) -> Column:
    return F.filter(F.transform(_items(v, where), lambda x: F.try_variant_get(x, f"$.{name}", "string")), lambda x: x.isNotNull())


@dataclass(frozen=True)
class NotBefore:
    """A rule of two numbers of a record: `later` is not below `earlier`."""

    later: str
    earlier: str

    def faults(self, v, path):
        number = lambda x: F.try_variant_get(v, f"$.{x}", "double")
        return fault(path, f"{self.later} comes before {self.earlier}", F.coalesce(number(self.later) < number(self.earlier), F.lit(False)))


@dataclass(frozen=True)
class Unique:
    """A rule of a list of records: no two have the same id."""

    items: str
    name: str

    def faults(self, v, path):
        twice = let(_ids(v, self.items, self.name), lambda ids: F.size(F.array_distinct(ids)) < F.size(ids))
        return fault(path, f"{self.items}.{self.name} is not unique", twice)


@dataclass(frozen=True)
class Refers:
    """A rule of two lists of records: the ids that one's records name are ids of the other's."""

    items: str
    names: str
    others: str
    name: str

    def faults(self, v, path):
        named = F.flatten(F.transform(_items(v, self.items), lambda x: _strings(x, self.names)))
        lost = F.array_sort(F.array_except(named, _ids(v, self.others, self.name)))
        return F.transform(lost, lambda x: F.concat(path, F.lit(f": {self.items}.{self.names} names no {self.others}.{self.name}: "), x))


@dataclass(frozen=True)
class Needs:
    """A rule of a record: where `name` has that value, the others are there and not empty."""

    name: str
    value: str
    needed: tuple[str, ...]

    def faults(self, v, path):
        text = lambda x: F.to_json(F.try_variant_get(v, f"$.{x}", "variant"))
        asked = F.coalesce(F.try_variant_get(v, f"$.{self.name}", "string") == self.value, F.lit(False))
        return F.concat(*[fault(path, f"{x} is required", asked & F.coalesce(text(x).isin('""', "[]", "null"), F.lit(True))) for x in self.needed])


@dataclass(frozen=True)
class Record(Node):
    fields: dict[str, Node] = field(default_factory=dict)
    rules: tuple = ()
    open: bool = False

    def own_faults(self, v, path):
        def checked(m: Column) -> Faults:
            found = []
            for name, node in self.fields.items():
                found.append(let(F.try_element_at(m, F.lit(name)), node.in_record(F.concat(path, F.lit(f".{name}")))))
            if not self.open:
                known = F.array(*[F.lit(n) for n in self.fields])
                found.append(F.transform(F.array_sort(F.array_except(F.map_keys(m), known)), lambda k: F.concat(path, F.lit(": unknown field "), k)))
            return F.concat(*found, *[r.faults(v, path) for r in self.rules])

        return F.when(kind(v) == "object", let(F.try_variant_get(v, "$", "map<string,variant>"), checked)).otherwise(fault(path, "not an object", F.lit(True)))

    def own_schema(self):
        needed = [n for n, node in self.fields.items() if not node.optional]
        out = {"type": "object", "properties": {n: node.schema() for n, node in self.fields.items()}, "required": needed} | ({} if self.open else {"additionalProperties": False})
        when = [{"if": {"properties": {r.name: {"const": r.value}}, "required": [r.name]}, "then": {"required": list(r.needed)}} for r in self.rules if isinstance(r, Needs)]
        more = [repr(r) for r in self.rules if not isinstance(r, Needs)]
        return out | ({"allOf": when} if when else {}) | ({"$comment": "; ".join(more)} if more else {})


def with_faults(rows: DataFrame, line: str, record: Node, into: str = "faults") -> DataFrame:
    """rows with the faults of the JSON text in `line`: an empty array for a valid record; null and broken text, and text with repeated keys, are no JSON."""
    parsed = F.try_parse_json(line)
    return rows.withColumn(into, let(parsed, lambda v: F.when(v.isNull(), F.array(F.lit("$: not JSON"))).otherwise(record.faults(v, F.lit("$")))))


def validate(rows: DataFrame, line: str, record: Node) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with their faults)."""
    marked = with_faults(rows, line, record)
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


def json_schema(name: str, record: Node) -> dict:
    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": name, **record.schema()}


def export_schemas(spark: SparkSession, folder: str, records: dict[str, Node] | None = None) -> list[str]:
    """Write <name>.schema.json for each record type; the paths."""
    from .sinks import write_text

    paths = []
    for name, record in (records or RECORDS).items():
        paths.append(f"{folder}/{name}.schema.json")
        write_text(spark, paths[-1], json.dumps(json_schema(name, record), ensure_ascii=False, indent=2) + "\n")
    return paths


# The record types. Field names, allowed values and ranges.
NAME, TEXT, MAYBE, COUNT, POSITIVE, SHARE = Text(1), Text(), Text(nullable=True), Number(0, whole=True), Number(1, whole=True), Number(0, 1)
DIGEST = Text(pattern="^sha256:[a-f0-9]{64}$")


def version(name: str) -> Text:
    return Text(values=(f"verdigris.{name}.v1",))


def named(*names: str) -> dict[str, Node]:
    return dict.fromkeys(names, NAME)


def one_of(*values: str) -> Text:
    return Text(values=values)


IDS = named("run_id", "case_id", "attempt_id")
TRACK = one_of("short_fact", "long_form")
CITED = one_of("collected", "product_absent", "adapter_failed", "not_observable")
FORM = Record({"answer_form": one_of("short_text", "list", "structured_json", "report"), "citation_required": Flag()})
ARTIFACT = Record({**named("artifact_id", "kind", "uri", "media_type"), "sha256": DIGEST, "size_bytes": COUNT})
MAYBE_ARTIFACT = Record(ARTIFACT.fields, nullable=True)
CITATION = Record({
    "citation_id": NAME, **dict.fromkeys(("display_text", "visible_url", "resolved_url", "quoted_text"), MAYBE), "claim_ids": ListOf(NAME),
    "collection_status": one_of("resolved", "visible_only", "product_absent", "adapter_failed", "unresolvable"),
})
CLAIM = Record({
    **named("claim_id", "text"), "source_span": Record({"start": COUNT, "end": COUNT}), "importance": one_of("major", "minor"),
    "verifiability": one_of("externally_verifiable", "opinion", "non_verifiable"), "citation_ids": ListOf(NAME),
}, rules=(NotBefore("source_span.end", "source_span.start"),))
MAYBE_COUNT = Number(0, whole=True, nullable=True)

RECORDS: dict[str, Record] = {
    "artifact_ref": ARTIFACT,
    "task": Record({
        "schema_version": version("task"), **named("task_id", "benchmark_id", "split"), "domain": one_of("research"), "track": TRACK,
        "input": Record({**named("prompt", "language"), "as_of": MAYBE, "attachments": ListOf(ARTIFACT)}), "expected_output": FORM, "required_capabilities": ListOf(NAME),
        "constraints": Record({"timeout_seconds": POSITIVE, "internet_required": Flag(), "max_attempts": POSITIVE}),
        "evaluation_profile": Record({"official_grader": MAYBE, "overlays": ListOf(one_of("citation_reliability"))}), "provenance": MapOf(),
    }),
    "research_task": Record({
        "schema_version": version("research_task"), **named("task_id", "benchmark_id", "upstream_task_id", "split", "task_family"),
        "input": Record({**named("prompt", "language"), "as_of": MAYBE, "attachments": ListOf()}, open=True), "expected_output": Record(FORM.fields, open=True),
        "constraints": Record({"internet_required": Flag(), "timeout_seconds": POSITIVE}, open=True), "provenance": MapOf(),
    }, open=True),
    "sut": Record({
        "schema_version": version("sut"), **named("sut_id", "provider", "product"), "channel": one_of("web", "api", "process", "manual", "fake"), **named("adapter_id", "adapter_version"), "account_tier": MAYBE,
        "capabilities": Record({**dict.fromkeys(("research_mode", "short_fact", "long_form", "visible_citations", "file_output"), Flag()), "citation_urls": one_of("full", "visible_only", "none")}),
        "concurrency": Record({"max_workers": POSITIVE, "account_scoped": Flag()}),
    }),
    "raw_sut_result": Record({
        "schema_version": version("raw_sut_result"), **IDS, **named("task_id", "sut_id"),
        "status": one_of("completed", "timeout", "rate_limited", "provider_error", "policy_refusal", "parse_error", "cancelled", "submission_unconfirmed", "collection_failed"),
        **dict.fromkeys(("submitted_at", "completed_at", "raw_answer_text"), MAYBE), "raw_citations": ListOf(Record({"citation_id": NAME, "url": MAYBE, "title": MAYBE}, open=True)),
        "raw_response": MAYBE_ARTIFACT, "screenshots": ListOf(ARTIFACT), "events": MAYBE_ARTIFACT,
        "usage": Record({"latency_ms": COUNT, **dict.fromkeys(("input_tokens", "output_tokens", "search_calls"), MAYBE_COUNT), "cost_usd": Number(0, nullable=True)}),
        "collection": Record({"answer_status": one_of("complete", "partial", "not_observable"), "citation_status": CITED}),
        "error": Record({**named("code", "message"), "retryable": Flag()}, nullable=True),
    }),
    "research_submission": Record({
        "schema_version": version("research_submission"), **IDS, "task_id": NAME, "track": TRACK, "final_answer": TEXT,
        "sections": ListOf(Record({"section_id": NAME, "heading": MAYBE, "text": TEXT})), "claims": ListOf(CLAIM), "citations": ListOf(CITATION), "attachments": ListOf(ARTIFACT),
        "normalization": Record({**named("normalizer_id", "normalizer_version"), "source_artifact_sha256": DIGEST, "citation_collection_status": CITED}),
    }, rules=(
        Unique("sections", "section_id"), Unique("claims", "claim_id"), Unique("citations", "citation_id"),
        Refers("claims", "citation_ids", "citations", "citation_id"), Refers("citations", "claim_ids", "claims", "claim_id"),
    )),
    "score": Record({
        "schema_version": version("score"), **IDS, "task_id": NAME, "namespace": one_of("official", "overlay"), "metric_id": NAME, "role": one_of("gate", "score", "diagnostic"), "value": Scalar(nullable=True),
        "status": one_of("scored", "failed", "not_observable", "not_applicable"), "grader": Record({**named("id", "version"), "config_hash": DIGEST}), "evidence_refs": ListOf(ARTIFACT), "detail": MapOf(),
    }),
    "gold_record": Record({
        "schema_version": version("research_gold"), **named("task_id", "answer_type"), "reference_answer": MAYBE, "acceptable_answers": ListOf(TEXT), "unacceptable_answers": ListOf(TEXT),
        "claims": ListOf(), **dict.fromkeys(("temporal_scope", "official_grader_payload", "provenance"), MapOf()),
    }, open=True),
    "judge_profile": Record({
        "schema_version": version("judge_profile"), "judge_profile_id": NAME, "transport": one_of("openai_compatible", "process"), "base_url": Text(pattern="^[A-Za-z][A-Za-z0-9+.-]*:.+", optional=True),
        "api_key_env": Text(1, optional=True), "command": ListOf(NAME, optional=True), "model": NAME, "temperature": Number(0, 2, optional=True), "seed": Number(whole=True, nullable=True, optional=True),
        "max_output_tokens": Number(1, whole=True, optional=True), "timeout_seconds": Number(1, whole=True, optional=True), "max_retries": Number(0, 5, whole=True, optional=True),
    }, rules=(Needs("transport", "openai_compatible", ("base_url", "api_key_env")), Needs("transport", "process", ("command",)))),
    "short_fact_judge_verdict": Record({"schema_version": version("short_fact_judge_verdict"), "extracted_answer": TEXT, "conclusion": one_of("correct", "incorrect"), "rationale": NAME, "confidence": Number(0, 1, nullable=True)}),
    "evidence_snapshot": Record({
        "schema_version": version("evidence_snapshot"), **named("evidence_id", "citation_id", "requested_url"), "resolved_url": MAYBE, "redirect_chain": ListOf(TEXT), "retrieved_at": NAME,
        "status": one_of("fetched", "paywalled", "login_required", "blocked", "not_found", "error"), "http_status": Number(whole=True, nullable=True), **dict.fromkeys(("title", "publisher", "published_at"), MAYBE),
        "text_artifact": MAYBE_ARTIFACT, "html_artifact": MAYBE_ARTIFACT, "sha256": MAYBE, "error_code": MAYBE,
    }),
    "citation_verdict": Record({
        "schema_version": version("citation_verdict"), **named("claim_id", "citation_id"),
        "verdict": one_of("supported", "partially_supported", "contradicted", "irrelevant", "insufficient_evidence", "evidence_unavailable"), "score": Number(0, 1, nullable=True), "confidence": SHARE,
        "evidence_spans": ListOf(Record({"artifact_id": NAME, "start": COUNT, "end": COUNT})), "rationale": NAME, "flags": ListOf(TEXT),
    }),
    "long_form_judge_verdict": Record({
        "schema_version": version("long_form_judge_verdict"), **dict.fromkeys(("coverage", "insight", "instruction_following", "clarity"), SHARE),
        "factual_claims": ListOf(Record({"claim": NAME, "verdict": one_of("supported", "unsupported", "uncertain"), "rationale": NAME})), "confidence": SHARE, "rationale": NAME,
    }),
    "official_report_verdict": Record({
        "schema_version": version("official_report_verdict"), "upstream_commit": Text(7), "quality_score": Number(0, 10), "quality_dimensions": MapOf(Number(0, 10)), "fact_ratio": Number(0, 1, nullable=True),
        **dict.fromkeys(("right_count", "wrong_count", "unknown_count"), COUNT), "raw": MapOf(),
    }),
    "judge_job": Record({
        "schema_version": version("judge_job"), "judge_job_id": NAME, **IDS, **named("grader_id", "grader_version"),
        "purpose": one_of("claim_extraction", "claim_citation_mapping", "citation_entailment", "long_form_quality", "source_classification", "adjudication", "short_fact_accuracy", "fixture_quality"),
        "input_refs": ListOf(ARTIFACT), "allowed_input_fields": ListOf(NAME),
        "judge_config": Record({**named("provider", "model"), "model_version": MAYBE, "temperature": Number(0), "seed": Number(whole=True, nullable=True), "max_output_tokens": POSITIVE, **named("prompt_id", "prompt_version"), "prompt_sha256": DIGEST, "output_schema": NAME}),
        "cache_key": NAME, "cache_source_job_id": MAYBE, "created_at": NAME,
    }),
    "fixture_judge_verdict": Record({"schema_version": version("fixture_judge_verdict"), "judge_job_id": NAME, "score": SHARE, "confidence": SHARE, "rationale": NAME}),
    "run_manifest": Record({
        "schema_version": version("run_manifest"), "run_id": Text(1, nullable=True, optional=True), "name": NAME,
        "benchmark": Record({**named("id", "version", "root", "split"), "task_selector": Record({"ids": ListOf(NAME, optional=True), "limit": Number(1, whole=True, nullable=True, optional=True), "seed": Number(whole=True, optional=True)})}),
        "sut": Record({"id": NAME, "adapter": one_of("fake", "web", "process", "http_api"), "options": MapOf(optional=True)}),
        "execution": Record({
            "worker": one_of("fake", "browser", "process"), **dict.fromkeys(("concurrency", "max_attempts"), Number(1, whole=True, optional=True)), **dict.fromkeys(("headless", "keep_worker_open"), Flag(optional=True)),
            "new_session_per_task": Flag(True), "timeout_seconds": POSITIVE,
        }),
        "evaluation": Record({
            **dict.fromkeys(("run_official", "grader_versions_locked"), Flag(optional=True)), "overlays": ListOf(one_of("citation_reliability"), optional=True), "judge_profile": Text(1, nullable=True, optional=True),
            "official_grader_command": ListOf(NAME, nullable=True, optional=True),
        }),
        "artifacts": Record({"root": Text(1, optional=True), **dict.fromkeys(("retain_raw_html", "retain_screenshots"), Flag(optional=True))}),
        "state": Record({"database": Text(1, optional=True)}, optional=True),
    }),
}

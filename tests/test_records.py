"""Record types: a valid record of each, and one invalid record for each of its rules, by expressions and by JSON Schema."""

import copy
import json
import re

import pytest

from verdigris.sources import records as r


def example(node):
    if isinstance(node, r.Record):
        return {n: example(x) for n, x in node.fields.items()}
    if isinstance(node, r.ListOf):
        return [example(node.item)]
    if isinstance(node, r.MapOf):
        return {"k": example(node.value)}
    if isinstance(node, r.Text):
        return node.values[0] if node.values else "sha256:" + "0" * 64 if node.pattern == r.DIGEST.pattern else "https://a.example" if node.pattern else "x" * max(1, node.least)
    if isinstance(node, r.Number):
        return int(node.low or 0)
    return {r.Flag: True, r.Scalar: 1.5, r.Anything: {"any": [1]}}[type(node)]


def put(record, at, value):
    """A copy of the record with the value at a path of names and numbers; `del` takes it out."""
    out = copy.deepcopy(record)
    place = out
    for step in at[:-1]:
        place = place[step]
    if value == "del":
        del place[at[-1]]
    else:
        place[at[-1]] = value
    return out


def named(at):
    return "$" + "".join(f"[{x}]" if isinstance(x, int) else f".{x}" for x in at)


def broken(node, record, at=()):
    """(record, fault) for each way in which a part can break its own rule."""
    path = named(at)
    if at and not node.nullable and not isinstance(node, r.Anything):
        yield put(record, at, None), f"{path}: not a"
    if isinstance(node, r.Record):
        for name, part in node.fields.items():
            if not part.optional:
                yield put(record, (*at, name), "del"), f"{path}.{name}: missing"
            yield from broken(part, record, (*at, name))
        if not node.open:
            yield put(record, (*at, "surplus"), 1), f"{path}: unknown field surplus"
        if at:
            yield put(record, at, [1]), f"{path}: not an object"
    elif isinstance(node, r.ListOf):
        yield put(record, at, {}), f"{path}: not a list"
        yield from broken(node.item, record, (*at, 0))
    elif isinstance(node, r.MapOf):
        yield put(record, at, "x"), f"{path}: not an object"
        yield from broken(node.value, record, (*at, "k"))
    elif isinstance(node, r.Text):
        yield put(record, at, 7), f"{path}: not a string"
        if node.least:
            yield put(record, at, "x" * (node.least - 1)), f"{path}: too short"
        if node.pattern:
            yield put(record, at, "no"), f"{path}: doesn't match"
        if node.values:
            yield put(record, at, "no"), f"{path}: not an allowed value"
    elif isinstance(node, r.Number):
        yield put(record, at, "1"), f"{path}: not a number"
        if node.low is not None:
            yield put(record, at, node.low - 1), f"{path}: out of range"
        if node.high is not None:
            yield put(record, at, node.high + 1), f"{path}: out of range"
        if node.whole:
            yield put(record, at, 1.5), f"{path}: not a whole number"
    elif isinstance(node, r.Flag):
        yield put(record, at, "true"), f"{path}: not a boolean"
        if node.value is not None:
            yield put(record, at, not node.value), f"{path}: not an allowed value"
    elif isinstance(node, r.Scalar):
        yield put(record, at, [1]), f"{path}: not a number, string or boolean"


def whole(name):
    """A valid record of a type: references agree, and what a rule needs is there."""
    out = example(r.RECORDS[name])
    if name == "research_submission":
        out["claims"][0] |= {"claim_id": "c", "citation_ids": ["s"], "source_span": {"start": 0, "end": 0}}
        out["citations"][0] |= {"citation_id": "s", "claim_ids": ["c"]}
    return out


def across(name):
    """Faults between fields."""
    good = whole(name)
    if name == "research_submission":
        yield put(good, ("claims", 0, "source_span", "start"), 9), "$.claims[0]: source_span.end comes before source_span.start"
        for many, one in (("sections", "section_id"), ("claims", "claim_id"), ("citations", "citation_id")):
            yield put(good, (many,), good[many] * 2), f"$: {many}.{one} is not unique"
        yield put(good, ("claims", 0, "citation_ids"), ["s", "t"]), "$: claims.citation_ids names no citations.citation_id: t"
        yield put(good, ("citations", 0, "claim_ids"), ["u"]), "$: citations.claim_ids names no claims.claim_id: u"
    if name == "judge_profile":
        for x in ("base_url", "api_key_env"):
            yield put(good, (x,), "del"), f"$: {x} is required"
        process = put(good, ("transport",), "process")
        yield put(process, ("command",), []), "$: command is required"
        yield put(process, ("command",), "del"), "$: command is required"


def agrees(schema, x):
    """Whether a value agrees with a schema, as far as ours use the language."""
    if "anyOf" in schema:
        return any(agrees(s, x) for s in schema["anyOf"])
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None), "array": list, "object": dict}
    kind = schema.get("type")
    if kind and (not isinstance(x, kinds[kind]) or isinstance(x, bool) and kind in ("number", "integer")):
        return False
    if "const" in schema and x != schema["const"] or "enum" in schema and x not in schema["enum"]:
        return False
    if isinstance(x, str) and (len(x) < schema.get("minLength", 0) or not re.search(schema.get("pattern", ""), x)):
        return False
    if isinstance(x, (int, float)) and not isinstance(x, bool) and not schema.get("minimum", x) <= x <= schema.get("maximum", x):
        return False
    if isinstance(x, list):
        return all(agrees(schema.get("items", {}), y) for y in x)
    if isinstance(x, dict) and kind == "object":
        known, more = schema.get("properties", {}), schema.get("additionalProperties", {})
        rest = [y for n, y in x.items() if n not in known]
        fine = all(n in x for n in schema.get("required", [])) and all(agrees(known[n], y) for n, y in x.items() if n in known)
        fine = fine and (not rest if more is False else all(agrees(more, y) for y in rest))
        return fine and all(not agrees(c["if"] | {"type": "object"}, x) or agrees(c["then"] | {"type": "object"}, x) for c in schema.get("allOf", []))
    return True


@pytest.mark.parametrize("name", sorted(r.RECORDS))
def test_every_rule_of_a_record_type(spark, name):
    record, good = r.RECORDS[name], whole(name)
    cases = list(broken(record, good))
    rules = list(across(name))
    rows = [(0, json.dumps(good))] + [(i + 1, json.dumps(x)) for i, (x, _) in enumerate(cases + rules)]
    rows += [(-1, None), (-2, "{no"), (-3, "[]"), (-4, '{"a": 1, "a": 2}')]
    found = {x.i: x.faults for x in r.with_faults(spark.createDataFrame(rows, "i int, line string"), "line", record).collect()}
    assert found[0] == []
    for i, (_, why) in enumerate(cases + rules):
        assert any(f.startswith(why) for f in found[i + 1]), (why, found[i + 1])
    assert [found[i] for i in (-1, -2, -3, -4)] == [["$: not JSON"], ["$: not JSON"], ["$: not an object"], ["$: not JSON"]]
    schema = r.json_schema(name, record)
    assert agrees(schema, good) and not any(agrees(schema, x) for x, _ in cases)
    assert len(cases) >= 2 * len(record.fields) - sum(x.optional for x in record.fields.values())


def test_valid_rows_and_export(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps(whole("score")),), ("{}",)], "line string")
    good, bad = r.validate(lines, "line", r.RECORDS["score"])
    assert good.columns == ["line"] and good.count() == 1 and bad.count() == 1
    paths = r.export_schemas(spark, str(tmp_path))
    assert len(paths) == len(r.RECORDS) >= 16
    assert json.loads((tmp_path / "score.schema.json").read_text())["properties"]["role"]["enum"] == ["gate", "score", "diagnostic"]

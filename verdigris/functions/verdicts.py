"""Parsing of what judges answer, and of inference output."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, js_trim


def _first(x: Column, pattern: str) -> Column:
    """First group of the first match, or null."""
    return F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(0))


def _field(x: Column, name: str, value: str = r"[^\n]*", flags: str = "") -> Column:
    return js_trim(_first(x, rf"{flags}{name}[{SPACE}]*[:：][{SPACE}]*({value})"))


def chinese_verdict(x: Column) -> Column:
    """struct(extracted_answer, conclusion, rationale); conclusion is null where 结论 is missing, which is an error."""
    end = _field(x, "结论", "正确|错误")
    return F.struct(
        F.coalesce(_field(x, "最终答案"), F.lit("")).alias("extracted_answer"),
        F.when(end == "正确", "correct").when(end == "错误", "incorrect").alias("conclusion"),
        F.coalesce(F.nullif(_field(x, "解释"), F.lit("")), F.lit("Official-compatible Judge response.")).alias("rationale"),
    )


def english_verdict(x: Column) -> Column:
    """The four-line form: extracted_final_answer, reasoning, correct."""
    end = F.lower(_field(x, "correct", "yes|no", "(?i)"))
    return F.struct(
        F.coalesce(_field(x, "extracted_final_answer", flags="(?i)"), F.lit("None")).alias("extracted_answer"),
        F.when(end == "yes", "correct").when(end == "no", "incorrect").alias("conclusion"),
        F.coalesce(_field(x, "reasoning", flags="(?i)"), F.lit("Official BrowseComp-ZH Judge response.")).alias("rationale"),
    )


def json_object(x: Column) -> Column:
    """The text from the first { to the last }, if it is JSON; else null."""
    found = F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def binary_score(x: Column) -> Column:
    """1 or 0: a JSON score of 0.5 or more, else the first `score =`, else the last lone 0 or 1, else 0."""
    x = F.trim(x)
    whole = F.when(x.rlike(r"(?s)^\{.*\}$"), x)  # the parser would take an object with more behind it
    stated = F.try_variant_get(F.try_parse_json(whole), "$.score", "double")
    named = _first(x, r"(?i)score\s*=\s*([01](?:\.0)?)").try_cast("double")
    lone = F.regexp_extract_all(x, F.lit(r"\b([01])\b"), F.lit(1))
    last = F.element_at(F.when(F.size(lone) > 0, lone), -1).try_cast("int")
    half = lambda v: F.when(v >= 0.5, 1).when(v.isNotNull(), 0)
    return F.coalesce(half(stated), half(named), last, F.lit(0))


def match_answer(match: Column) -> Column:
    """What follows the first colon up to the next; the whole match without a colon."""
    cut = F.split(match, ":")
    return F.trim(F.coalesce(F.get(cut, F.lit(1)), match))


def inference_parts(x: Column) -> Column:
    """struct(explanation, answer, confidence) of an answer in the asked-for form; ** around the names is allowed."""
    name = lambda n: rf"\**{n}\**\s*[:：]\**\s*"
    return F.struct(
        js_trim(_first(x, rf"(?s){name('Explanation')}(.*?)(?=\**Exact Answer|\z)")).alias("explanation"),
        js_trim(_first(x, rf"(?s){name('Exact Answer')}(.*?)(?=\**Confidence|\z)")).alias("answer"),
        js_trim(_first(x, rf"{name('Confidence')}([^\n]*)")).alias("confidence"),
    )


def response_text(payload: Column) -> Column:
    """Text of a chat completion: a string, or the joined text parts."""
    content = F.get_json_object(payload, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<text:string>>", {"mode": "PERMISSIVE"})
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.when(content.startswith("["), F.coalesce(joined, content)).otherwise(content)


def completions_url(base: Column) -> Column:
    bare = F.regexp_replace(base, r"/+$", "")
    return F.when(bare.endswith("/chat/completions"), bare).otherwise(F.concat(bare, F.lit("/chat/completions")))

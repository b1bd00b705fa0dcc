"""Text functions of grading and page cleaning, as Column expressions; a vectorized UDF only where Spark has no equivalent (NFKC)."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_batches
from .urls import let

#: White space as ECMAScript's \s has it, written so that Java's and RE2's patterns agree.
SPACE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same as characters, for functions that take no pattern.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

#: Lines of page chrome that are no part of an answer.
UI_NOISE_LINES = ["豆包", "新工作任务", "新对话", "更多", "最近", "关于豆包", "下载电脑版", "登录", "对话", "工作", "快速", "新", "PPT 生成",
                  "图像生成", "帮我写作", "视频生成", "翻译", "深入研究", "录音转写", "复制", "重新生成", "赞", "踩"]
#: Entities in the order they are resolved; amp comes before lt and gt, so `&amp;lt;` ends as `<`.
PAGE_ENTITIES = [("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">")]
#: Marks of which one behind an answer doesn't count.
CLOSING = ["，", "。", "；", ";", ",", "."]
#: Fixed value: what makes a claim look verifiable.
VERIFIABLE = (
    r"(?i)[0-9]|年|月|日|是|为|达到|增长|下降|发布|宣布|位于|成立|according|reported|was|were|is|are|percent|million|billion"
)


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None or s.isascii() or unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s))


def nfkc(x: Column, spark=None) -> Column:
    """Compatibility composition; pass the session where the workers may not have this package on their path."""
    if spark is not None:
        bounded_batches(spark)
    return _nfkc(x)


def js_trim(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def normalize_answer(x: Column, compose=nfkc) -> Column:
    """NFKC, no white space, one closing mark dropped, lower case. Workers need this package (session.bounded_batches)."""
    bare = F.translate(compose(x), BLANKS, "")
    return let(bare, lambda b: F.lower(F.when(F.right(b, F.lit(1)).isin(CLOSING), F.substring(b, 1, F.length(b) - 1)).otherwise(b)))


def last_marked_answer(x: Column) -> Column:
    """What follows the last 最终答案 on its line (or the next), trimmed; null if there is none."""
    found = F.regexp_extract_all(x, F.lit(rf"最终答案[{SPACE}]*[:：][{SPACE}]*([^\n]+)"), F.lit(1))
    return js_trim(F.element_at(F.when(F.size(found) > 0, found), -1))


def first_marked_answer(x: Column) -> Column:
    """What follows the first `Exact Answer` or 最终答案, in any case."""
    found = F.regexp_extract_all(x, F.lit(rf"(?i)(?:Exact Answer|最终答案)[{SPACE}]*[:：][{SPACE}]*([^\n]+)"), F.lit(1))
    return js_trim(F.get(found, F.lit(0)))


def page_text(x: Column) -> Column:
    """LF line ends, no blanks around lines, two line breaks at most, trimmed."""
    x = F.replace(x, F.lit("\r\n"), F.lit("\n"))
    return js_trim(F.regexp_replace(F.regexp_replace(x, r"(?m)^[ \t]+|[ \t]+$", ""), r"\n{3,}", "\n\n"))


def path_segment(x: Column, compose=nfkc) -> Column:
    """NFKC, then letters, digits and ._- in any script; up to 96 characters; `task` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(compose(x), r"[^\p{L}\p{N}._-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, 96), F.lit("")), F.lit("task"))


def safe_segment(x: Column) -> Column:
    """ASCII file name part without leading dots."""
    clean = F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9._-]", "_"), r"^\.+", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("task"))


def fallback_answer(main: Column, prompt: Column, baseline: Column) -> Column:
    """The page's lines without the prompt, the lines of the page before, and page chrome; repeated lines stay."""
    lines = lambda c: F.filter(F.transform(F.split(page_text(c), "\n"), js_trim), lambda s: s != "")
    noise = F.array(*[F.lit(s) for s in UI_NOISE_LINES])
    old, asked = lines(baseline), page_text(prompt)
    kept = F.filter(lines(main), lambda s: (s != asked) & ~F.array_contains(old, s) & ~F.array_contains(noise, s))
    return page_text(F.array_join(kept, "\n"))


def html_text(x: Column) -> Column:
    for tag in ("script", "style"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for name, char in PAGE_ENTITIES:
        x = F.regexp_replace(x, f"(?i)&{name};", char)
    return js_trim(F.regexp_replace(x, rf"[{SPACE}]+", " "))


def html_title(x: Column) -> Column:
    found = F.get(F.regexp_extract_all(x, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1)), F.lit(0))
    return js_trim(F.regexp_replace(found, rf"[{SPACE}]+", " "))


def html_published(x: Column) -> Column:
    """The content attribute that follows a publication key."""
    return F.get(F.regexp_extract_all(x, F.lit(r"""(?i)(?:article:published_time|datePublished)[^>]+content=["']([^"']+)"""), F.lit(1)), F.lit(0))


def verifiable(x: Column) -> Column:
    return x.rlike(VERIFIABLE)


def canonical_json(x: Column) -> Column:
    """JSON text with the keys of every object in order, no blanks, and numbers in one spelling (1.0 is 1); null if it is no JSON, or repeats a key.

    A number with an exponent is a double, and stays apart from the same number without.
    """
    return F.to_json(F.try_parse_json(x))


def hash_object(x: Column) -> Column:
    """The digest of JSON text, the same whoever wrote it and in whatever order."""
    return sha256_text(canonical_json(x))


def sha256_text(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


def pad_id(x: Column, width: int = 6, sanitize: bool = False) -> Column:
    """Digits are filled with zeros on the left and never cut; other ids stay, or have foreign characters replaced."""
    x = F.trim(x.cast("string"))
    other = F.regexp_replace(x, r"[^A-Za-z0-9_.-]+", "_") if sanitize else x
    filled = F.when(F.length(x) < width, F.lpad(x, width, "0")).otherwise(x)
    return F.when(x.rlike(r"^[0-9]+$"), filled).otherwise(other)


def language_of(x: Column, fallback: Column | None = None) -> Column:
    found = F.when(x.rlike(r"[\x{4e00}-\x{9fff}]"), "zh-CN").otherwise("en")
    return found if fallback is None else F.coalesce(F.nullif(fallback, F.lit("")), found)


def _cjk_date(x: Column, before: str) -> Column:
    part = lambda i, n: F.lpad(F.nullif(F.regexp_extract(x, rf"{before}(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日", i), F.lit("")), n, "0")
    return F.concat(part(1, 4), F.lit("-"), part(2, 2), F.lit("-"), part(3, 2))


def _stated(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?i)as of (\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def _latest_iso(x: Column) -> Column:
    return F.array_max(F.regexp_extract_all(x, F.lit(r"(20\d{2}-\d{2}-\d{2})"), F.lit(1)))


def as_of_chinese(x: Column) -> Column:
    """The date a prompt speaks of: `as of` date, 截至 date, first Chinese date, latest ISO date."""
    return F.coalesce(_stated(x), _cjk_date(x, r"截至\s*"), _cjk_date(x, ""), _latest_iso(x))


MONTHS = "january february march april may june july august september october november december".split()


def as_of_english(x: Column, default: str | None = None) -> Column:
    """`as of` date, latest ISO date, latest `Month YYYY` as YYYY-MM, or the default."""
    pattern = rf"(?i)(({'|'.join(MONTHS)})\s+\d{{4}})"
    hits = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    number = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS) for v in (m, f"{i + 1:02d}")])
    month = lambda h: F.element_at(number, F.lower(F.regexp_extract(h, r"^([A-Za-z]+)", 1)))
    dated = F.transform(hits, lambda h: F.concat(F.right(h, F.lit(4)), F.lit("-"), month(h)))
    return F.coalesce(_stated(x), _latest_iso(x), F.array_max(dated), F.lit(default).cast("string"))

"""Golden rows of the scalar functions."""

import base64
import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris import catalogue
from verdigris.functions import cipher, text, urls, verdicts
from verdigris.session import ARROW_BYTES
from verdigris.storage import setting


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "build, value, expected",
    [
        (lambda x: text.normalize_answer(x, text.nfkc), " Ｐａｒｉｓ。 ", "paris"),
        (lambda x: text.normalize_answer(x), "a。。", "a。"),
        (lambda x: text.normalize_answer(x), "a　 b\n", "ab"),
        (text.last_marked_answer, "最终答案: a\n最终答案：\n b \nx", "b"),
        (text.last_marked_answer, "no mark", None),
        (text.first_marked_answer, "EXACT ANSWER: a\n最终答案: b", "a"),
        (text.page_text, " a  \r\n\r\n\r\n b \n", "a\n\nb"),
        (lambda x: text.path_segment(x), "豆包 task/01?", "豆包_task_01"),
        (lambda x: text.path_segment(x), "///", "task"),
        (lambda x: text.path_segment(x), "Ｔａｓｋ ①", "Task_1"),
        (text.safe_segment, "..a/b", "a_b"),
        (text.html_text, "<p>a&amp;lt;b</p><script>x</script> c&nbsp;d", "a<b c d"),
        (text.html_title, "<title>\n A  &amp; B </title>", "A &amp; B"),
        (text.html_title, "none", None),
        (text.html_published, '<meta property="datePublished" content="2024-01-02">', "2024-01-02"),
        (text.html_published, '<meta content="2024-01-02" property="datePublished">', None),
        (text.as_of_chinese, "截至2025年3月5日", "2025-03-05"),
        (text.as_of_chinese, "As of 2024-02-03 and 2025-01-01", "2024-02-03"),
        (text.as_of_english, "March 2025 or June 2025", "2025-06"),
        (lambda x: text.as_of_english(x, "2026-02-11"), "nothing", "2026-02-11"),
        (text.language_of, "abc", "en"),
        (text.language_of, "日", "zh-CN"),
        (lambda x: text.pad_id(x), "42", "000042"),
        (lambda x: text.pad_id(x), "12345678", "12345678"),
        (lambda x: text.pad_id(x, sanitize=True), "a b", "a_b"),
        (urls.clean_url, " <https://a.b/c#d>. ", "https://a.b/c"),
        (verdicts.match_answer, "a: b :c", "b"),
        (verdicts.match_answer, "plain", "plain"),
        (verdicts.json_object, 'text ```json\n{"a": {"b": 1}}\n``` more', '{"a": {"b": 1}}'),
        (verdicts.json_object, "no braces", None),
        (verdicts.completions_url, "https://x/v1/", "https://x/v1/chat/completions"),
        (verdicts.response_text, '{"choices":[{"message":{"content":"hi"}}]}', "hi"),
        (verdicts.response_text, '{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}', "ab"),
    ],
)
def test_strings(spark, build, value, expected):
    assert one(spark, value, build) == expected


@pytest.mark.parametrize(
    "address, expected",
    [("172.15.0.1", False), ("172.16.0.1", True), ("224.0.0.1", True), ("8.8.8.8", False), ("x", True), ("fe80::1", True), ("2001:db8::1", False), ("999.1.1.1", True)],
)
def test_private(spark, address, expected):
    assert one(spark, address, urls.private_address) is expected


@pytest.mark.parametrize(
    "value, expected", [('{"score":0.5}', 1), ("score = 0", 0), ("maybe 1", 1), ("none", 0), ('{"score": 0.2} 1', 1), ("", 0)]
)
def test_binary_score(spark, value, expected):
    assert one(spark, value, verdicts.binary_score) == expected


@pytest.mark.parametrize("code, body, expected", [(401, "", "login_required"), (404, "Paywall", "paywalled"), (403, "", "blocked"), (410, "", "not_found"), (204, "", "fetched"), (500, "", "error"), (404, None, "not_found")])
def test_access(spark, code, body, expected):
    row = spark.createDataFrame([(code, body)], "c int, b string").select(urls.access_status(F.col("c"), F.col("b")).alias("y")).first()
    assert row.y == expected


def test_verdict_forms(spark):
    v = one(spark, "最终答案: a\n结论：错误", verdicts.chinese_verdict)
    assert (v.extracted_answer, v.conclusion) == ("a", "incorrect")
    assert one(spark, "最终答案: a", verdicts.chinese_verdict).conclusion is None
    v = one(spark, "Correct: YES", verdicts.english_verdict)
    assert (v.extracted_answer, v.conclusion) == ("None", "correct")
    v = one(spark, "**Explanation:** why\nnot\n**Exact Answer:** x\n**Confidence:** 85%", verdicts.inference_parts)
    assert v.answer.strip("* ") == "x" and v.confidence.startswith("85%")


def test_fallback(spark):
    row = spark.createDataFrame([("豆包\nQ?\nold\nnew\nnew\n复制", "Q?", "old")], "m string, p string, b string")
    assert row.select(text.fallback_answer(F.col("m"), F.col("p"), F.col("b")).alias("y")).first().y == "new\nnew"


def test_ciphers(spark):
    key = hashlib.sha256(b"pw").digest()
    cell = base64.b64encode(bytes(a ^ key[i % 32] for i, a in enumerate("héllo".encode()))).decode()
    frame = spark.createDataFrame([(cell, "pw"), (None, "pw"), ("not base64!", "pw")], "c string, p string")
    assert [r.y for r in frame.select(cipher.decrypt_cell(F.col("c"), F.col("p")).alias("y")).collect()][:2] == ["héllo", None]


@pytest.mark.parametrize("name", ["answer_normalize_match", "path_segments", "page_states", "short_fact_grades"])
def test_texts_reach_python_in_small_batches(spark, sf, name):
    @F.pandas_udf("long")
    def together(x):
        return pd.Series([int(x.str.len().sum())] * len(x))

    with setting(spark, spark__sql__execution__arrow__maxBytesPerBatch="1g"):
        catalogue.QUERIES[name](spark, sf)
        long = spark.range(0, 300, 1, 1).select(F.repeat(F.concat(F.lit("x"), F.col("id").cast("string")), F.lit(20_000)).alias("x"))
        assert long.select(together("x").alias("n")).agg(F.max("n")).first()[0] < 2 * ARROW_BYTES

"""Graders: exact match first, then what a judge has said; judges are plugged in as DataFrame to DataFrame functions."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import verdicts as v
from ..session import bounded_batches

Judge = Callable[[DataFrame], DataFrame]


def exact_match(answer: Column, reference: Column, last: bool, compose=t.nfkc) -> tuple[Column, Column]:
    """(candidate, whether it equals the reference). last: the last marked answer, and an empty one counts; else the first, and it doesn't."""
    candidate = t.last_marked_answer(answer) if last else t.first_marked_answer(answer)
    same = t.normalize_answer(candidate, compose) == t.normalize_answer(reference, compose)
    if not last:
        same = same & (candidate != "")
    return candidate, F.coalesce(same, F.lit(False))


def short_fact(rows: DataFrame, judge: Judge, style: str = "chinese", compose=t.nfkc) -> DataFrame:
    """Verdicts for rows (task_id, final_answer, reference_answer, ...): exact, extracted_answer, conclusion, rationale, error.

    Rows that match exactly never reach the judge: they are split off by a filter, since a UDF behind a
    condition would run for all. judge gets the others and adds `judge_text`. A row that
    cannot be graded has `error` set instead of stopping the run; strict() turns that into a failure.
    """
    bounded_batches(rows.sparkSession)
    last = style == "chinese"
    candidate, same = exact_match(F.col("final_answer"), F.col("reference_answer"), last, compose)
    missing = F.col("reference_answer").isNull() if last else (F.coalesce("reference_answer", F.lit("")) == "")
    marked = rows.where(~missing).withColumn("_candidate", candidate).withColumn("_exact", same)
    exact = marked.where("_exact").select(
        *rows.columns, F.lit(True).alias("exact"), F.col("_candidate").alias("extracted_answer"), F.lit("correct").alias("conclusion"),
        F.lit("Exact normalized match.").alias("rationale"), F.lit(None).cast("string").alias("error"),
    )
    judged = judge(marked.where("not _exact").select(rows.columns))
    parsed = judged.withColumn("_v", (v.chinese_verdict if last else v.english_verdict)(F.col("judge_text")))
    asked = parsed.select(
        *rows.columns, F.lit(False).alias("exact"), "_v.extracted_answer", "_v.conclusion", "_v.rationale",
        F.when(F.col("_v.conclusion").isNull(), "judge response has no conclusion").alias("error"),
    )
    ungraded = rows.where(missing).select(
        *rows.columns, F.lit(False).alias("exact"), *[F.lit(None).cast("string").alias(c) for c in ("extracted_answer", "conclusion", "rationale")],
        F.lit("gold has no reference answer").alias("error"),
    )
    return exact.unionByName(asked).unionByName(ungraded)


def strict(graded: DataFrame) -> DataFrame:
    """graded, or a failed job at the first row with an error."""
    fine = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(": ", "error", F.col("task_id").cast("string"))).cast("boolean"))
    return graded.where(fine)


def fixture_judge(rows: DataFrame) -> DataFrame:
    """An offline judge in the Chinese form: right if the answer contains the reference."""
    right = F.coalesce(F.col("final_answer").contains(F.col("reference_answer")), F.lit(False))
    text = F.concat(F.lit("最终答案: "), F.substring("final_answer", 1, 40), F.lit("\n解释: containment\n结论: "), F.when(right, "正确").otherwise("错误"))
    return rows.withColumn("judge_text", text)


def nonempty_score(answer: Column) -> Column:
    return F.when(F.length(t.js_trim(F.coalesce(answer, F.lit("")))) > 0, 1.0).otherwise(0.0)


def long_form_scores(verdicts: DataFrame, key: str = "task_id") -> DataFrame:
    """Two scores of a long-form verdict, kept apart: quality (0 to 10) and fact ratio; a missing ratio is not observable."""
    row = lambda name, value: F.struct(F.lit(name).alias("metric_id"), value.cast("double").alias("value"), F.when(value.isNull(), "not_observable").otherwise("scored").alias("status"))
    both = F.array(row("quality", F.col("quality")), row("fact_ratio", F.col("fact_ratio")))
    return verdicts.select(key, F.explode(both).alias("m")).select(key, "m.*")


def dispatch(rows: DataFrame, graders: dict[str, Callable[[DataFrame], DataFrame]], benchmark: str = "benchmark_id") -> DataFrame:
    """Each benchmark's rows through its grader, together again; rows that no grader is for, nulls included, have `error` set."""
    listed = F.coalesce(F.col(benchmark).isin(list(graders)), F.lit(False))
    out = rows.where(~listed).withColumn("error", F.lit("no grader for benchmark"))
    for name, grade in graders.items():
        out = out.unionByName(grade(rows.where(F.col(benchmark) == name)), allowMissingColumns=True)
    return out

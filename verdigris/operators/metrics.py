"""Aggregates of scores, judges and costs."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def metric_report(scores: DataFrame) -> DataFrame:
    """One row for each metric: rows and statuses, and the mean of numeric values that are scored. JSON strings, booleans and null don't count."""
    number = F.when((F.col("status") == "scored") & F.col("value_json").rlike(r"^-?[0-9]"), F.col("value_json").try_cast("double"))
    return scores.groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.count(number).alias("scored"),
        F.avg(number).alias("mean"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("not_observable", "not_applicable", "failed")],
    )


def case_counters(cases: DataFrame, *keys: str) -> DataFrame:
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "DONE").alias("done"),
        F.count_if(~F.col("status").isin("DONE", "READY_FOR_GRADING")).alias("system_failures"),
    )


def rate(condition: Column, among: Column | None = None) -> Column:
    """Share of rows that meet a condition, null without rows."""
    if among is None:
        return F.avg(condition.cast("double"))
    return F.try_divide(F.count_if(condition & among), F.nullif(F.count_if(among), F.lit(0)))


def kappa(pairs: DataFrame, expected: str, found: str, *keys: str, least_n: int = 30, least_kappa: float = 0.8, labels: list | None = None) -> DataFrame:
    """Cohen's kappa for each group, and whether the judge is eligible. Only the table of label pairs, small by nature, meets.

    Where labels are given, any other one, null included, fails the job. Without rows there is no group; without keys, too, that fails.
    """
    if labels is not None:
        known = F.coalesce(F.col(expected).isin(labels) & F.col(found).isin(labels), F.lit(False))
        fine = F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.concat_ws("/", F.col(expected).cast("string"), F.col(found).cast("string")))).cast("boolean"))
        pairs = pairs.where(fine)
    cells = pairs.groupBy(*keys, F.col(expected).alias("_e"), F.col(found).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    total = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_e") == F.col("_f"), F.col("_n")).otherwise(0)).alias("_same"))
    rows = cells.groupBy(*keys, F.col("_e").alias("_label")).agg(F.sum("_n").alias("_r"))
    columns = cells.groupBy(*keys, F.col("_f").alias("_label")).agg(F.sum("_n").alias("_c"))
    chance = rows.join(columns, [*keys, "_label"]).groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_c")).alias("_rc"))
    joined = total.join(chance, list(keys), "left") if keys else total.crossJoin(chance)  # two single rows
    agreement, by_chance = F.col("_same") / F.col("n"), F.coalesce("_rc", F.lit(0)) / (F.col("n") * F.col("n"))
    k = F.when(by_chance == 1, 1.0).otherwise((agreement - by_chance) / (1 - by_chance))
    if not keys:
        joined = joined.where(F.when(F.col("n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no labels to compare")).cast("boolean")))
    out = joined.select(*keys, "n", agreement.alias("agreement"), by_chance.alias("expected_agreement"), k.alias("kappa"))
    return out.withColumn("eligible", (F.col("n") >= least_n) & (F.col("kappa") >= least_kappa))


def confidence_number(x: Column) -> Column:
    """The integer before a percent sign, or 0."""
    return F.coalesce(F.trim(F.get(F.split(x, "%"), F.lit(0))).try_cast("int"), F.lit(0))


def calibration(rows: DataFrame, model: str, is_correct: str, confidence: str) -> DataFrame:
    """Accuracy and expected calibration error in percent for each model, in five bins of confidence.

    A bin is 20 wide, the last holds all from 80 up. Negative confidences count the bins from the last down (-1 to -20: the last,
    -81 to -100: the first); below -100 there is no bin, which fails the job.
    """
    conf = confidence_number(F.col(confidence))
    bucket = F.when(conf < -100, F.raise_error(F.lit("confidence is below every bin")).cast("long")).otherwise(F.pmod(F.least(F.floor(conf / 20), F.lit(4)), F.lit(5)))
    answer = F.lower(F.col(is_correct))
    bins = rows.groupBy(F.col(model), bucket.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(answer == "yes").alias("_yes"),
        F.count_if(answer == "no").alias("_no"),
        F.sum(conf).alias("_conf"),
    )
    gap = F.abs(F.col("_yes") / F.col("_n") - F.col("_conf") / F.col("_n") / 100) * F.col("_n")
    return bins.groupBy(model).agg(
        F.sum("_n").alias("total"),
        F.sum("_yes").alias("correct"),
        F.sum("_no").alias("wrong"),
        (F.sum("_n") - F.sum("_yes") - F.sum("_no")).alias("none"),
        F.round(F.sum("_yes") / F.sum("_n") * 100, 4).alias("accuracy_pct"),
        F.round(F.sum(gap) / F.sum("_n") * 100, 4).alias("calibration_error_pct"),
    )


def repeats(rows: DataFrame, question: str = "question_id") -> DataFrame:
    """Average, best of n, mean cost and mean time of repeated answers."""
    return rows.groupBy(question).agg(
        F.avg("score").alias("average"),
        F.max("score").alias("best_of_n"),
        F.round(F.avg("cost"), 6).alias("mean_cost"),
        F.round(F.avg("seconds"), 3).alias("mean_seconds"),
    )


def majority_vote(rows: DataFrame, question: str, answer: str) -> DataFrame:
    """The most frequent answer of each question; of equally frequent ones the smallest, so runs agree. share: of the question's answers."""
    counts = rows.groupBy(question, answer).agg(F.count(F.lit(1)).alias("votes"))
    best = counts.groupBy(question).agg(F.max("votes").alias("votes"), (F.max("votes") / F.sum("votes")).alias("share"), F.min_by(F.col(answer), F.struct(-F.col("votes"), F.col(answer))).alias("majority"))
    return best


def vote_score(votes: DataFrame, gold: DataFrame, question: str, answer: str) -> DataFrame:
    """majority_vote() rows with score: 1 if the majority is the right answer of gold (question, answer), else 0."""
    right = gold.select(question, F.col(answer).alias("_right"))
    return votes.join(right, question, "left").withColumn("score", F.coalesce((F.col("majority") == F.col("_right")).cast("int"), F.lit(0))).drop("_right")


def in_order(rows: DataFrame, group: str, order: list[str], values: list[str]) -> DataFrame:
    """The values of each group as lists, in order; null values keep their place."""
    log = F.array_sort(F.collect_list(F.struct(*order, *values)))
    return rows.groupBy(group).agg(log.alias("_log")).select(group, *[F.col("_log")[v].alias(v) for v in values])


def fact_ratio(rows: DataFrame, task: str, right: str = "right", statements: str = "statements") -> DataFrame:
    """Right statements of all statements of each task, to six places; null without statements."""
    return rows.groupBy(task).agg(F.round(F.try_divide(F.sum(right), F.nullif(F.sum(statements), F.lit(0))), 6).alias("fact_ratio"))


def recovery_counters(actions: DataFrame, key: str, action: str = "action") -> DataFrame:
    """What a resumed run did with the cases of each key."""
    names = {"rerun": "reset", "needs_human": "needs_human", "skip": "already_done", "skip_other": "left_alone"}
    return actions.groupBy(key).agg(F.count(F.lit(1)).alias("cases"), *[F.count_if(F.col(action) == k).alias(v) for k, v in names.items()])


def api_cost(input_tokens: Column, output_tokens: Column, input_rate: Column, output_rate: Column, exchange: float) -> Column:
    """Cost of a call by rates for a million tokens."""
    return F.round((input_tokens * input_rate * exchange + output_tokens * output_rate * exchange) / 1e6, 6)


def wide_repeats(rows: DataFrame, question: str, repeat: str, values: list[str], n: int | None = None) -> DataFrame:
    """One row for each question, with <value>_<repeat> columns for repeats 0 to n-1. n: as many as there are; a repeat beyond a given n, or a null one, fails the job."""
    if n is None:
        n = (rows.agg(F.max(repeat)).first()[0] if rows.columns else None) or 0
        n += 1
    known = F.coalesce(F.col(repeat).between(0, n - 1), F.lit(False))
    checked = rows.withColumn(repeat, F.when(known, F.col(repeat)).otherwise(F.raise_error(F.concat(F.lit(f"repeat is not in 0 to {n - 1}: "), F.coalesce(F.col(repeat).cast("string"), F.lit("null")))).cast("int")))
    return checked.groupBy(question).agg(*[F.max(F.when(F.col(repeat) == r, F.col(v))).alias(f"{v}_{r}") for r in range(n) for v in values])


#: What a results table has of each repeat, and of a question's repeats together.
REPEAT_COLUMNS = ["response", "extracted_answer", "score", "score_reason", "exceed_length", "content_filter", "error"]


def results_table(questions: DataFrame, rows: DataFrame, gold: DataFrame, question: str = "question_id", repeat: str = "repeat", n: int | None = None) -> DataFrame:
    """A row for each question with all its columns, REPEAT_COLUMNS of repeats 1 to n (<column>_<repeat>), and average, best of n, majority vote with its score, mean cost and mean time.

    rows: question, repeat (from 0), REPEAT_COLUMNS, cost, seconds. gold: question, extracted_answer. A question without rows has nulls, one repeat more than n fails the job.
    """
    wide = wide_repeats(rows, question, repeat, REPEAT_COLUMNS, n)
    renamed = wide.toDF(question, *[f"{c.rpartition('_')[0]}_{int(c.rpartition('_')[2]) + 1}" for c in wide.columns[1:]])
    votes = vote_score(majority_vote(rows, question, "extracted_answer"), gold, question, "extracted_answer")
    votes = votes.select(question, F.col("majority").alias("majority_vote_answer"), F.col("score").alias("majority_vote_score"))
    return questions.join(renamed, question, "left").join(repeats(rows, question), question, "left").join(votes, question, "left")


def poisson_table() -> np.ndarray:
    """Poisson(1) counts by 16 uniform bits."""
    chances = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    return np.searchsorted(chances, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def bootstrap_mean(rows: DataFrame, value: str, *keys: str, samples: int = 10_000, seed: int = 7) -> DataFrame:
    """95 % interval of the mean, by a Poisson bootstrap: a row's copies in each sample follow from a hash, so nothing is collected.

    Rows of a key with equal values are counted first: n of them have Poisson(n) copies together. A task adds the copies of its values into one
    vector of sample sums for each key, and only these vectors are shuffled. Null values don't count.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        rows.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_h", F.xxhash64(*keys, "_v", F.lit(seed)))
        .repartition(parts, "_h")  # few small rows, but each takes `samples` draws
        .sortWithinPartitions(*keys)
    )
    k, names = len(keys), [*keys, "_s", "_w", "_wv"]
    schema = T.StructType([*counted.select(*keys).schema.fields, T.StructField("_s", T.IntegerType()), T.StructField("_w", T.DoubleType()), T.StructField("_wv", T.DoubleType())])

    def run(batches):
        single, now, key = poisson_table(), None, []

        def sums() -> pa.RecordBatch:
            alike = pa.array(np.zeros(samples, np.int64))
            return pa.RecordBatch.from_arrays([*(c.take(alike) for c in key), pa.array(np.arange(samples, dtype=np.int32)), pa.array(weight), pa.array(total)], names=names)

        for batch in batches:
            for i, (*its, v, n, h) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if its != now:
                    if now is not None:
                        yield sums()
                    now, key = its, [batch.column(j).slice(i, 1) for j in range(k)]
                    weight, total = np.zeros(samples), np.zeros(samples)
                random = np.random.default_rng(h & ((1 << 64) - 1))
                copies = single[random.integers(0, 1 << 16, samples, np.uint16)] if n == 1 else random.poisson(n, samples)
                weight += copies
                total += copies * v
        if now is not None:
            yield sums()

    sampled = counted.mapInArrow(run, schema).groupBy(*keys, "_s").agg(F.sum("_w").alias("_w"), F.sum("_wv").alias("_wv"))
    means = sampled.select(*keys, F.try_divide("_wv", F.nullif("_w", F.lit(0.0))).alias("_m"))
    edge = lambda p: F.percentile("_m", F.lit(p))
    return means.groupBy(*keys).agg(F.avg("_m").alias("mean"), edge(0.025).alias("low"), edge(0.975).alias("high"))

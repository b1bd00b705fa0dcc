"""Claims, citation markers and the five citation metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, verifiable
from ..functions.urls import source_quality

#: Fixed values.
LEAST_CLAIM_CHARS, MAJOR_CHARS = 8, 80
CLAIM = r"([^。！？!?\n]+[。！？!?]?)"
METRICS = ["citation_validity", "citation_correctness", "citation_completeness", "source_quality", "temporal_validity"]


def claims(submissions: DataFrame, key: str, answer: str, citations: str | None = None) -> DataFrame:
    """One row for each claim of an answer: its text, piece number, importance, verifiability and the citations its markers name.

    A claim ends at 。！？!? or a line break, never at a full stop; a marker behind the
    end belongs to the next claim. Lengths count code points. The first claim that is long
    enough is major, and so is any of 80 characters.
    """
    raw = F.regexp_extract_all(answer, F.lit(CLAIM), F.lit(1))
    pieces = F.transform(raw, lambda m, i: F.struct(i.cast("long").alias("piece"), js_trim(m).alias("text")))
    kept = F.filter(pieces, lambda p: F.length(p["text"]) >= LEAST_CLAIM_CHARS)
    out = submissions.select(key, *([citations] if citations else []), F.posexplode(kept).alias("_n", "_c")).select("*", "_c.*")
    marks = F.regexp_extract_all("text", F.lit(r"(?:\[([0-9]+)\]|【[0-9]+】)"), F.lit(0))
    number = F.transform(marks, lambda m: F.regexp_replace(m, r"[^0-9]", "").try_cast("int"))
    if citations:
        ids = F.array_distinct(F.filter(F.transform(number, lambda n: F.get(F.col(citations), n - 1)), lambda c: c.isNotNull()))
    else:
        ids = F.array_distinct(number)
    return out.select(
        key,
        "piece",
        "text",
        F.when((F.length("text") >= MAJOR_CHARS) | (F.col("_n") == 0), "major").otherwise("minor").alias("importance"),
        F.when(verifiable(F.col("text")), "externally_verifiable").otherwise("non_verifiable").alias("verifiability"),
        ids.alias("citation_ids"),
    )


def overlay(submissions: DataFrame, claim_rows: DataFrame, evidence: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """The five metrics of each submission, one row each: (key, metric_id, value, status).

    submissions: key, n_citations, citation_required, as_of, citation_collection_status.
    evidence: key, status, publisher, published_at. verdicts: key, score. as_of and
    published_at are timestamps in text; an as_of that cannot be read makes no source valid.
    Each table is reduced to a row for each submission before it is joined.
    """
    major = (F.col("verifiability") == "externally_verifiable") & (F.col("importance") == "major")
    by_claim = claim_rows.groupBy(key).agg(
        F.count_if(major).alias("major"), F.count_if(major & (F.size("citation_ids") > 0)).alias("mapped")
    )
    by_verdict = verdicts.groupBy(key).agg(F.avg("score").alias("correct"))
    limit = submissions.select(key, F.col("as_of").try_cast("timestamp").alias("_limit"))
    published = F.col("published_at").try_cast("timestamp")
    fetched = F.col("status") == "fetched"
    by_source = (
        evidence.join(limit, key)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("sources"),
            F.avg(fetched.cast("double")).alias("valid"),
            F.avg(F.when(fetched, source_quality(F.col("publisher")))).alias("quality"),
            F.count(published).alias("dated"),
            F.count_if(published <= F.col("_limit")).alias("in_time"),
        )
    )
    one = submissions.join(by_claim, key, "left").join(by_verdict, key, "left").join(by_source, key, "left")
    none, status = F.col("n_citations") == 0, F.col("citation_collection_status")
    row = lambda i, value, state: F.struct(F.lit(METRICS[i]).alias("metric_id"), value.cast("double").alias("value"), state.alias("status"))
    scored = lambda v: F.when(v.isNotNull(), "scored").otherwise("not_observable")
    complete = F.try_divide(F.col("mapped"), F.nullif(F.col("major"), F.lit(0)))
    temporal = F.when(F.col("as_of").isNull(), None).otherwise(F.try_divide(F.col("in_time"), F.nullif(F.col("dated"), F.lit(0))))
    without = F.array(
        row(0, F.when(~status.isin("adapter_failed", "not_observable"), F.lit(0.0)), F.when(status == "adapter_failed", "failed").when(status == "not_observable", "not_observable").otherwise("scored")),
        row(1, F.lit(None), F.lit("not_observable")),
        row(2, F.when(F.col("citation_required"), F.lit(0.0)), F.when(F.col("citation_required"), "scored").otherwise("not_applicable")),
        row(3, F.lit(None), F.lit("not_observable")),
        row(4, F.lit(None), F.when(F.col("as_of").isNull(), "not_applicable").otherwise("not_observable")),
    )
    with_them = F.array(
        row(0, F.col("valid"), F.lit("scored")),
        row(1, F.col("correct"), scored(F.col("correct"))),
        row(2, complete, scored(complete)),
        row(3, F.col("quality"), scored(F.col("quality"))),
        row(4, temporal, F.when(F.col("as_of").isNull(), "not_applicable").otherwise(scored(temporal))),
    )
    return one.select(key, F.explode(F.when(none, without).otherwise(with_them)).alias("m")).select(key, "m.*")


def evidence_of(pages: DataFrame, code: Column) -> DataFrame:
    """Evidence snapshots of fetched pages: status, text, title, publication date, publisher, digest."""
    from ..functions import text as t
    from ..functions import urls as u

    body = t.html_text(F.coalesce("html", F.lit("")))
    return (
        pages.withColumn("text", body)
        .withColumn("status", F.when(u.url_guard(F.col("url")).isNotNull(), "error").otherwise(u.access_status(code, F.col("text"))))
        .withColumn("title", t.html_title(F.col("html")))
        .withColumn("published_at", t.html_published(F.col("html")))
        .withColumn("publisher", u.publisher(F.col("url")))
        .withColumn("sha256", t.sha256_text(F.col("text")))
        .withColumn("error_code", u.url_guard(F.col("url")))
    )

"""Evidence behind citations: redirects followed over a table of responses, and what is found at their end.

The responses are what a crawler has written; nothing is fetched here. Distinct addresses are resolved once, whoever cites them: those with a
redirect walk on by one join with the (narrow) table of redirects for each hop, and the bodies are joined at the end only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u

#: Codes that redirect, the hops that are followed, and the largest body in bytes.
REDIRECTS, MOST_REDIRECTS, MOST_BYTES = (301, 302, 303, 307, 308), 5, 5 * 1024 * 1024
#: Fixed value: the characters of a page that judges of links see.
CONTENT_CHARS = 5000
MISSING, UNREACHABLE, TOO_MANY, TOO_LARGE = "EVIDENCE_URL_MISSING", "EVIDENCE_UNREACHABLE", "EVIDENCE_TOO_MANY_REDIRECTS", "EVIDENCE_TOO_LARGE"
RESPONSE = ["status_code", "location", "content_type", "content_length", "body"]


def request_key(url: Column) -> Column:
    """What is asked for: the address without its fragment."""
    return F.regexp_replace(u.href(url), "#.*$", "")


def redirects(responses: DataFrame) -> DataFrame:
    """(key, next, next_key, refused): for each address that redirects where to, and the guard's reason against it. Of several answers of one address the least counts."""
    some = responses.where(F.col("status_code").isin(*REDIRECTS) & (F.trim("location") != ""))
    one = some.groupBy(request_key(F.col("url")).alias("key")).agg(F.min("location").alias("location"))
    target = one.select("key", u.resolved(F.col("location"), F.col("key")).alias("next"))
    checked = target.select("key", "next", u.url_guard(F.col("next")).alias("refused"))
    return checked.select("key", "next", F.when(F.col("refused").isNull(), request_key(F.col("next"))).alias("next_key"), "refused")


def followed(addresses: DataFrame, hops: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """(address, _end: the key at the end, resolved_url, redirect_chain, cycle, error_code) of the addresses (with their request key) that redirect.

    A walk ends at an address without a redirect, one that the guard refuses, one that it has been at, or after `most` redirects with one more.
    """
    edge = hops.withColumnRenamed("key", "_key")
    walk = addresses.join(edge.select("_key"), F.col("key") == F.col("_key"), "left_semi").select(
        "address", "key", F.col("address").alias("at"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("chain"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("cycle"))
    for _ in range(most + 1):
        met = walk.join(edge, F.when(F.col("error").isNull(), F.col("key")) == F.col("_key"), "left")  # a walk with an error meets nothing
        moved = F.col("_key").isNotNull()
        to = lambda now, old: F.when(moved, F.col(now)).otherwise(F.col(old))
        grown = lambda whole, x: F.when(moved, F.array_append(whole, F.col(x))).otherwise(F.col(whole))
        again = moved & F.coalesce(F.array_contains(F.array_append("seen", F.col("key")), F.col("next_key")), F.lit(False))
        error = F.when(moved, F.coalesce("refused", F.when(again, TOO_MANY))).otherwise(F.col("error"))
        walk = met.select("address", to("next_key", "key").alias("key"), to("next", "at").alias("at"), grown("seen", "key").alias("seen"), grown("chain", "at").alias("chain"), error.alias("error"), (F.col("cycle") | again).alias("cycle"))
    error = F.when(F.col("error").isNull() & (F.size("chain") > most), TOO_MANY).otherwise(F.col("error"))
    return walk.select("address", F.col("key").alias("_end"), F.col("at").alias("resolved_url"), F.col("chain").alias("redirect_chain"), "cycle", error.alias("error_code"))


def snapshots(addresses: DataFrame, responses: DataFrame) -> DataFrame:
    """What each address (a guarded, normalized URL, each once) leads to: resolved_url, redirect_chain, cycle, status, http_status, title, publisher,
    published_at, text (where fetched), sha256, error_code, and the link's record for judges: link_works, url_content, link_error."""
    addresses = addresses.withColumn("key", request_key(F.col("address")))
    walked = followed(addresses, redirects(responses))
    all_of = addresses.join(walked, "address", "left").withColumn("resolved_url", F.coalesce("resolved_url", "address"))
    answer = F.min(F.struct(*RESPONSE))
    answers = responses.groupBy(request_key(F.col("url")).alias("_key")).agg(answer.alias("_r")).select("_key", "_r.*")
    joined = all_of.withColumn("_at", F.when(F.col("error_code").isNull(), F.coalesce("_end", "key"))).join(answers, F.col("_at") == F.col("_key"), "left")
    bytes_ = F.greatest(F.coalesce("content_length", F.lit(0)), F.coalesce(F.octet_length("body"), F.lit(0)))
    error = F.coalesce("error_code", F.when(F.col("_key").isNull(), UNREACHABLE).when(bytes_ > MOST_BYTES, TOO_LARGE))
    html = F.coalesce(F.col("content_type").contains("html"), F.lit(False))
    body = F.coalesce("body", F.lit(""))
    read = joined.withColumn("error_code", error).withColumn("_text", F.when(F.col("error_code").isNull(), F.when(html, t.html_text(body)).otherwise(body)))
    read = read.withColumn("status", F.when(F.col("error_code").isNotNull(), "error").otherwise(u.access_status(F.col("status_code"), F.col("_text"))))
    fine = lambda c: F.when(F.col("error_code").isNull(), c)
    works = fine((F.col("status_code") < 400) & ~F.coalesce(F.col("body").rlike(r"(?U)^\s*\z"), F.lit(True)))
    code = F.concat(F.lit("http_"), F.col("status_code").cast("string"))
    why = F.coalesce("error_code", F.when(~works & (F.col("status_code") < 400), F.concat(code, F.lit("_or_empty"))).when(~works, code))
    return read.select(
        "address", fine(F.col("resolved_url")).alias("resolved_url"), F.coalesce(fine(F.col("redirect_chain")), F.array().cast("array<string>")).alias("redirect_chain"),
        F.coalesce("cycle", F.lit(False)).alias("cycle"), "status", fine(F.col("status_code")).cast("int").alias("http_status"),
        fine(F.when(html, t.html_title(body))).alias("title"), fine(u.publisher(F.col("resolved_url"))).alias("publisher"),
        fine(F.when(html, t.html_published(body))).alias("published_at"), F.when(F.col("status") == "fetched", F.col("_text")).alias("text"),
        t.sha256_text(F.col("_text")).alias("sha256"), "error_code", F.coalesce(works, F.lit(False)).cast("int").alias("link_works"),
        F.when(works, F.substring("body", 1, CONTENT_CHARS)).otherwise("").alias("url_content"), why.alias("link_error"),
    )


def resolve(citations: DataFrame, responses: DataFrame, url: str = "url") -> DataFrame:
    """citations with requested_url and what snapshots() says of it; a missing or refused URL has an error and nothing else.

    responses: url, status_code, location, content_type, content_length, body. Null and blank URLs are missing. Columns of citations with the
    name of one of the results are replaced. An empty table of responses makes every URL unreachable.
    """
    mine = citations.withColumn("_url", F.nullif(F.trim(F.col(url)), F.lit("")))
    refused = F.when(F.col("_url").isNull(), MISSING).otherwise(u.url_guard(F.col("_url")))
    mine = mine.withColumn("_refused", refused).withColumn("_address", F.when(F.col("_refused").isNull(), u.href(F.col("_url"))))
    found = snapshots(mine.where("_address is not null").select(F.col("_address").alias("address")).distinct(), responses)
    results = [c for c in found.columns if c != "address"]
    kept = [c for c in citations.columns if c not in {*results, "requested_url"}]
    joined = mine.select(*kept, "_url", "_refused", "_address").join(found, F.col("_address") == F.col("address"), "left")
    default = {"status": F.lit("error"), "error_code": F.col("_refused"), "link_error": F.col("_refused"), "cycle": F.lit(False), "link_works": F.lit(0), "url_content": F.lit(""), "redirect_chain": F.array().cast("array<string>")}
    return joined.select(*kept, F.col("_url").alias("requested_url"), *[F.coalesce(c, default[c]).alias(c) if c in default else F.col(c) for c in results])

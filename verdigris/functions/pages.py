"""What is read off a chat product's page: answers, links, error notes and states, without a browser."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import fallback_answer, nfkc, page_text

#: What a page says when its provider fails, and how it greets before any answer.
ERROR_NOTES = ["网络异常", "服务异常", "请求失败", "请稍后重试", "操作过于频繁"]
GREETING = "有什么我能帮你的吗"
#: Error code -> status of the execution; any other code is the provider's error.
STATUS_OF = {"TIMEOUT": "timeout", "SUBMISSION_UNCONFIRMED": "submission_unconfirmed", "RESULT_EXTRACTION_FAILED": "collection_failed"}
#: The last blocks of a page that may hold the answer, and the links looked at.
MOST_BLOCKS, MOST_LINKS, LEAST_CHARS = 100, 500, 8
LINK_POINTS, ORDER_POINTS, SPECIFIC_POINTS = 100, 2, 1_000_000


def execution_status(code: Column) -> Column:
    status = F.lit("provider_error")
    for name, meaning in STATUS_OF.items():
        status = F.when(code == name, meaning).otherwise(status)
    return status


def provider_error(page: Column) -> Column:
    """The first note of ERROR_NOTES that stands on the page, or null."""
    return F.coalesce(*[F.when(page.contains(x), x) for x in ERROR_NOTES])


def prompt_on_page(page: Column, prompt: Column, compose=nfkc) -> Column:
    """Whether the page has the prompt, whatever white space and zero-width characters stand in either."""
    bare = lambda c: F.regexp_replace(compose(c), "(?U)[\\s​-‍﻿]", "")
    return bare(F.coalesce(page, F.lit(""))).contains(bare(page_text(prompt)))


def allowed_host(host: Column, hosts: list[str]) -> Column:
    return F.coalesce(host.isin(hosts), F.lit(False))


def is_conversation_path(path: Column) -> Column:
    return F.coalesce(path.rlike("^/chat/(local_)?[^/]+"), F.lit(False))


def best_answers(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, answer): of each page's blocks (order, text, links, specific, prompt) the one with most points, of equals the first.

    Points are characters, links, order, a bonus for blocks of the answer's own kind, less the prompt where the
    block repeats it. Only the last MOST_BLOCKS blocks count; the prompt itself and texts of under LEAST_CHARS don't.
    A page without such a block, or with the greeting only, has no row.
    """
    last = Window.partitionBy(page).orderBy(F.desc("order"))
    clean = page_text(F.col("text"))
    points = (
        F.length("text") + F.col("links") * LINK_POINTS + F.col("order") * ORDER_POINTS
        + F.when(F.col("specific"), SPECIFIC_POINTS).otherwise(0)
        - F.when(F.col("text").contains(F.col("prompt")), F.length("prompt")).otherwise(0)
    )
    some = blocks.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= MOST_BLOCKS)
    fit = some.withColumn("_text", clean).where((F.length("_text") >= LEAST_CHARS) & (F.col("_text") != F.col("prompt")))
    best = fit.groupBy(page).agg(F.max_by("_text", F.struct(points.alias("points"), (-F.col("order")).alias("first"))).alias("answer"))
    return best.where(~F.col("answer").contains(GREETING))


def answers(pages: DataFrame, blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """pages (main, prompt, baseline) with the answer: the best block, else, where the page has the prompt, what is new on it, else empty."""
    joined = pages.join(best_answers(blocks, page), page, "left")
    rest = F.when(prompt_on_page(F.col("main"), F.col("prompt")), fallback_answer(F.col("main"), F.col("prompt"), F.col("baseline"))).otherwise("")
    return joined.withColumn("answer", F.coalesce("answer", rest))


def external_links(links: DataFrame, own_hosts: list[str], page: str = "page_id", order: str = "order", url: str = "url", most: int | None = MOST_LINKS) -> DataFrame:
    """links with citation_id: web links to other hosts, each URL of a page once, numbered in order. most: the first links of a page that are looked at; None for all."""
    w = Window.partitionBy(page).orderBy(order)
    if most is not None:
        links = links.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    web = links.where(F.col(url).startswith("http")).where(~allowed_host(host, own_hosts))
    once = web.withColumn("_same", F.row_number().over(Window.partitionBy(page, url).orderBy(order))).where("_same = 1").drop("_same")
    return once.withColumn("citation_id", F.concat(F.lit("src"), F.row_number().over(w).cast("string")))

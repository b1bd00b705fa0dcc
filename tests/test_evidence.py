"""Evidence over redirects: addresses, walks and what they end in."""

from pyspark.sql import functions as F

from verdigris.functions import urls
from verdigris.operators import evidence

RESPONSE = "url string, status_code int, location string, content_type string, content_length bigint, body string"


def test_addresses(spark):
    base = "https://a.example/x/y?q=1#f"
    cases = {
        "https://B.example:443/p": "https://b.example/p", "//c.example": "https://c.example/", "/z": "https://a.example/z", "z?w": "https://a.example/x/z?w",
        "../z": "https://a.example/z", "../../../z/.": "https://a.example/z/", "./": "https://a.example/x/", "?r=2": "https://a.example/x/y?r=2", "#g": "https://a.example/x/y?q=1#g",
        "": "https://a.example/x/y?q=1", "ftp://d.example/e": "ftp://d.example/e", "HTTP://E.example:80": "http://e.example/", " /t ": "https://a.example/t", "a/b/../c": "https://a.example/x/a/c",
    }
    rows = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.to for r in rows.select("x", urls.resolved(F.col("x"), F.lit(base)).alias("to")).collect()} == cases


def chain(n, host="r.example"):
    """n redirects, from /0 to /n."""
    return [(f"https://{host}/{i}", 302, f"/{i + 1}" if i % 2 else f"https://{host}/{i + 1}", None, None, None) for i in range(n)]


PAGE = "<html><title>T</title><p>some &amp; text</p></html>"


def walk(spark, cited, responses):
    citations = spark.createDataFrame([(i, x) for i, x in enumerate(cited)], "id int, url string")
    return {r.id: r for r in evidence.resolve(citations, spark.createDataFrame(responses, RESPONSE)).collect()}


def test_five_redirects_are_followed(spark):
    hosts = [f"r{n}.example" for n in range(8)]
    pages = [(f"https://{h}/{n}", 200, None, "text/html", None, PAGE) for n, h in enumerate(hosts)]
    found = walk(spark, [f"https://{h}/0" for h in hosts], [*(x for n, h in enumerate(hosts) for x in chain(n, h)), *pages])
    for n, got in found.items():
        if n <= 5:
            assert (got.status, got.resolved_url, got.text, got.title, got.http_status) == ("fetched", f"https://r{n}.example/{n}", "T some & text", "T", 200)
            assert got.redirect_chain == [f"https://r{n}.example/{i}" for i in range(n)] and not got.cycle
        else:
            assert (got.status, got.error_code, got.resolved_url, got.redirect_chain) == ("error", "EVIDENCE_TOO_MANY_REDIRECTS", None, [])


def test_cycles_guards_and_endings(spark):
    responses = [
        *[(f"https://c.example/{i}", 301, f"/{(i + 1) % 3}", None, None, None) for i in range(3)],
        ("https://own.example/", 308, "#part", None, None, None),
        ("https://in.example/", 302, "http://127.0.0.1/x", None, None, None),
        ("https://far.example/", 307, "//IN.example", None, None, None),
        ("https://file.example/", 303, "file:///etc/passwd", None, None, None),
        ("https://open.example/", 302, "", "text/plain", None, "plain"),
        ("https://big.example/", 200, None, "text/plain", 5 * 1024 * 1024 + 1, "x"),
        ("https://just.example/", 200, None, "text/plain", 5 * 1024 * 1024, "  <b>kept</b> "),
        ("https://gone.example/", 404, None, "text/html", None, "no"),
        ("https://empty.example/", 200, None, "text/html", None, " \n"),
        ("https://twice.example/", 500, None, None, None, "b"),
        ("https://twice.example/#x", 200, None, None, None, "a"),
    ]
    cited = {
        "https://c.example/1": "EVIDENCE_TOO_MANY_REDIRECTS", "https://own.example": "EVIDENCE_TOO_MANY_REDIRECTS", "https://in.example/": "EVIDENCE_PRIVATE_HOST",
        "https://far.example/": "EVIDENCE_PRIVATE_HOST", "https://file.example/": "EVIDENCE_UNSAFE_SCHEME", "https://open.example/": None, "https://big.example/": "EVIDENCE_TOO_LARGE",
        "https://just.example/#f": None, "https://gone.example/": None, "https://empty.example/": None, "https://none.example/": "EVIDENCE_UNREACHABLE", "https://twice.example/": None,
        None: "EVIDENCE_URL_MISSING", " ": "EVIDENCE_URL_MISSING", "javascript:x": "EVIDENCE_UNSAFE_SCHEME", "nonsense": "EVIDENCE_INVALID_URL",
    }
    got = walk(spark, list(cited), responses)
    by = dict(zip(cited, (got[i] for i in range(len(cited))), strict=True))
    assert {x: r.error_code for x, r in by.items()} == cited
    assert [x for x, r in by.items() if r.cycle] == ["https://c.example/1", "https://own.example"]
    assert all((r.status == "error") and not r.link_works and r.resolved_url is None for r in by.values() if r.error_code)
    shown = lambda x: (by[x].status, by[x].http_status, by[x].text, by[x].link_works, by[x].url_content, by[x].link_error)
    assert shown("https://open.example/") == ("error", 302, None, 1, "plain", None)
    assert shown("https://just.example/#f") == ("fetched", 200, "  <b>kept</b> ", 1, "  <b>kept</b> ", None)
    assert by["https://just.example/#f"].resolved_url == "https://just.example/#f"
    assert shown("https://gone.example/") == ("not_found", 404, None, 0, "", "http_404")
    assert shown("https://empty.example/") == ("fetched", 200, "", 0, "", "http_200_or_empty")
    assert by["https://twice.example/"].http_status == 200


def test_addresses_are_resolved_once(spark):
    """However many rows cite an address, walks are of distinct ones; and without any response all are unreachable."""
    responses = spark.createDataFrame([*chain(2), ("https://r.example/2", 200, None, "text/plain", None, "x" * 9000)], RESPONSE)
    citations = spark.range(500).select("id", F.lit("https://R.example:443/0").alias("url"), F.lit("mine").alias("status"))
    got = evidence.resolve(citations, responses)
    assert got.columns.count("status") == 1
    assert got.groupBy("status", "resolved_url", F.length("url_content").alias("n")).count().collect() == [("fetched", "https://r.example/2", 5000, 500)]
    assert [r.error_code for r in evidence.resolve(citations.limit(1), responses.limit(0)).collect()] == ["EVIDENCE_UNREACHABLE"]
    assert evidence.resolve(citations.limit(0), responses).count() == 0

"""URL and access predicates, without any network access."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts by source quality.
OFFICIAL = r"(?i)\.(gov|edu)(\.|$)|(who\.int|un\.org|worldbank\.org)$"
OPEN_EDIT = r"(?i)wikipedia|blogspot|medium\.com$"
#: An address of four decimal bytes.
PLAIN_V4 = r"^{0}(\.{0}){{3}}$".format(r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])")
#: Fixed value: what a paywall says.
PAYWALL = r"(?i)paywall|subscribe to continue|付费阅读|订阅后阅读"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def publisher(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def private_address(x: Column) -> Column:
    """Private and special addresses; whatever is no address counts as private."""
    quad = F.split(x, r"\.")
    a, b = F.get(quad, F.lit(0)).try_cast("int"), F.get(quad, F.lit(1)).try_cast("int")
    v4 = x.rlike(PLAIN_V4)
    private4 = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a >= 224)
    v6 = x.contains(":") & x.rlike(r"^[0-9A-Fa-f:.]+$")
    low = F.lower(x)
    private6 = low.isin("::", "::1") | low.rlike("^(fc|fd|fe8|fe9|fea|feb)")
    return F.coalesce(F.when(v4, private4).when(v6, private6).otherwise(True), F.lit(True))


def _number(x: Column) -> Column:
    """A part of a numeric host: hexadecimal behind 0x, octal behind 0, else decimal; null if it is none."""
    hexadecimal, octal = F.conv(F.substring(x, 3, 64), 16, 10), F.conv(x, 8, 10)
    return (
        F.when(x.rlike("^0x[0-9a-f]{0,12}$"), F.coalesce(hexadecimal, F.lit("0")))
        .when(x.rlike("^0[0-7]{1,15}$"), octal)
        .when(x.rlike("^[0-9]{1,15}$") & ~x.rlike("^0[0-9]"), x)
        .try_cast("long")
    )


def numeric_host(host: Column) -> Column:
    """struct(numeric, address): whether a host's last part is a number, and then its dotted address, as browsers read it; null if it has none."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    n, last = (lambda x: F.size(x)), (lambda x: F.element_at(x, -1))
    before = lambda x: F.aggregate(F.slice(x, 1, n(x) - 1), F.lit(0).cast("long"), lambda acc, y: acc * 256 + F.when(y < 256, y))
    rest = lambda x: F.get(F.array(*[F.lit(1 << (8 * i)) for i in (4, 3, 2, 1)]), n(x) - 1)  # noqa: E731  what the last part may count up to
    value = let(F.transform(parts, _number), lambda x: F.when(last(x) < rest(x), before(x) * rest(x) + last(x)))
    dotted = lambda v: F.when(v.isNotNull(), F.concat_ws(".", *[F.shiftright(v, 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in (3, 2, 1, 0)]))
    address = F.when(host.rlike(PLAIN_V4), host).otherwise(let(value, dotted))
    return F.struct(F.element_at(parts, -1).rlike("^([0-9]+|0x[0-9a-f]*)$").alias("numeric"), address.alias("address"))


def url_guard(url: Column) -> Column:
    """Null for a URL that may be fetched, else the reason; names aren't resolved.

    Hosts are read as browsers read them: lower case, and numeric ones in any notation (hexadecimal, octal, fewer parts) as addresses.
    """
    x = F.trim(url)
    authority = F.regexp_extract(x, r"^[A-Za-z]+:[/\\]*([^/\\?#]*)", 1)
    split = F.struct(F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"), authority.alias("authority"))

    def parts(s: Column) -> Column:
        host = F.lower(F.regexp_replace(F.regexp_replace(s["authority"], "^.*@", ""), ":[0-9]*$", ""))
        return F.struct(s["scheme"].alias("scheme"), F.regexp_extract(s["authority"], "^(.*)@", 1).alias("user"), host.alias("host"))

    def checked(s: Column, number: Column) -> Column:
        scheme, user, host = s["scheme"], s["user"], s["host"]
        v6 = F.regexp_extract(host, r"^\[(.*)\]$", 1)
        web, numeric = scheme.isin("http", "https"), F.coalesce(number["numeric"], F.lit(False))
        bad_host = (host == "") | (~host.startswith("[") & host.rlike(r"[\x00-\x20<>\[\]^|%:]")) | (numeric & number["address"].isNull())
        return (
            F.when((scheme == "") | (web & bad_host), "EVIDENCE_INVALID_URL")
            .when(~web, "EVIDENCE_UNSAFE_SCHEME")
            .when(~user.isin("", ":"), "EVIDENCE_URL_CREDENTIALS_FORBIDDEN")
            .when(host.rlike(r"(^|\.)localhost\.?$"), "EVIDENCE_PRIVATE_HOST")
            .when(numeric & private_address(number["address"]), "EVIDENCE_PRIVATE_HOST")
            .when((v6 != "") & private_address(v6), "EVIDENCE_PRIVATE_HOST")
        )

    # only a host whose last part starts with a digit can be a number
    number = lambda s: F.when(s["host"].rlike(r"(^|\.)[0-9][^.]*\.?$"), numeric_host(s["host"]))
    return F.when(x.isNull(), "EVIDENCE_INVALID_URL").otherwise(let(let(split, parts), lambda s: let(number(s), lambda n: checked(s, n))))


def without_dots(path: Column) -> Column:
    """A path from / on, in which . stands for its folder and .. for the one above."""
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.array_append(done, x))
    walked = lambda parts: F.aggregate(parts, F.array().cast("array<string>"), step)
    ended = lambda parts: F.concat(walked(parts), F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    shorter = let(F.split(F.substring(path, 2, 1 << 30), "/"), lambda parts: F.concat(F.lit("/"), F.array_join(ended(parts), "/")))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), shorter).otherwise(path)


def href(url: Column) -> Column:
    """A web URL as it is asked for: scheme and host in lower case, no default port, a path from / on without dots. Nothing is percent-encoded anew."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*([^/\\?#]*)([^?#]*)(.*)$"

    def split(x: Column) -> Column:
        group = lambda i: F.regexp_extract(x, pattern, i)
        path = F.when(group(3) == "", "/").otherwise(F.replace(group(3), F.lit("\\"), F.lit("/")))
        return F.struct(F.lower(group(1)).alias("scheme"), F.lower(group(2)).alias("authority"), path.alias("path"), group(4).alias("rest"))

    def whole(s: Column) -> Column:
        authority = F.when(s["scheme"] == "https", F.regexp_replace(s["authority"], ":(443)?$", "")).otherwise(F.regexp_replace(s["authority"], ":(80)?$", ""))
        return F.concat(s["scheme"], F.lit("://"), authority, without_dots(s["path"]), s["rest"])

    return let(let(F.trim(url), split), whole)


def resolved(location: Column, base: Column) -> Column:
    """Where a Location header leads from a normalized URL: absolute, or relative to its scheme, host, path or query."""
    bare = F.regexp_replace(base, "#.*$", "")
    page = F.regexp_replace(base, "[?#].*$", "")
    origin = F.regexp_extract(base, "^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    full = lambda x: (
        F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), x)
        .when(x.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z][a-z0-9+.-]*:)", 1), x))
        .when(x.startswith("/"), F.concat(origin, x))
        .when(x.startswith("?"), F.concat(page, x))
        .when(x.startswith("#"), F.concat(bare, x))
        .when(x == "", bare)
        .otherwise(F.concat(F.regexp_replace(page, "[^/]*$", ""), x))
    )
    return let(let(F.trim(location), full), lambda to: F.when(to.rlike("^(?i)https?:"), href(to)).otherwise(to))


def access_status(code: Column, text: Column) -> Column:
    """What an answer with this HTTP code and text is; a paywall's words come before 403 and 404."""
    head = F.substring(text, 1, 20_000)
    return (
        F.when(code == 401, "login_required")
        .when((code == 402) | F.coalesce(head.rlike(PAYWALL), F.lit(False)), "paywalled")
        .when(code.isin(403, 429), "blocked")
        .when(code.isin(404, 410), "not_found")
        .when(code.between(200, 299), "fetched")
        .otherwise("error")
    )


def source_quality(host: Column) -> Column:
    return F.when(host.isNull() | (host == ""), None).when(host.rlike(OFFICIAL), 1.0).when(host.rlike(OPEN_EDIT), 0.5).otherwise(0.75)


def clean_url(url: Column) -> Column:
    """Without angle brackets and closing punctuation around it, and without its fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[<>]+|[<>]+$", ""), r"^[.,);]+|[.,);]+$", "")
    return F.regexp_replace(bare, r"#.*$", "")


def is_http(url: Column) -> Column:
    return url.rlike(r"^(?i)https?://[^/?#]+")

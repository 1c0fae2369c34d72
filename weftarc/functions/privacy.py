"""What must not leave a capture: sensitive names, and URLs without their secrets, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, and pairs of words in this order, that mark an identifier as sensitive.
WORDS = ("auth", "authorization", "bearer", "credential", "credentials", "csrf", "nonce", "passcode", "passwd", "password", "secret", "signature", "token", "xsrf")
PAIRS = (("access", "key"), ("api", "key"), ("client", "key"), ("one", "time"), ("private", "key"), ("secret", "key"), ("session", "id"))
# Parameters of queries whose values are secrets; signs around the words may be -, _ and dots.
PARAMETERS = (
    "access[-_.]?token", "refresh[-_.]?token", "id[-_.]?token", "token", "jwt", "auth", "authorization", "api[-_.]?key", "apikey", "secret", "client[-_.]?secret",
    "password", "passwd", "pwd", "session", "session[-_.]?id", "sid", "signature", "sig", "credential", "code",
)
REDACTED = "REDACTED"


def is_sensitive(identifier: Column) -> Column:
    """Whether an identifier, cut at signs and before capitals, has one of the words or pairs."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(identifier, F.lit("")), "([a-z0-9])([A-Z])", "$1-$2")), "[^a-z0-9]+")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    pairs = [joined.rlike(f" {a} (.* )?{b} ") for a, b in PAIRS]
    return reduce(lambda x, y: x | y, pairs, F.arrays_overlap(words, F.array(*map(F.lit, WORDS))))


def is_secret_parameter(name: Column) -> Column:
    """Whether a query parameter's value is a secret; another rule than that for names in pages."""
    return name.rlike(rf"(?i)(?:^|[-_.])(?:{'|'.join(PARAMETERS)})(?:\z|[-_.])")


def _decoded(text: Column) -> Column:
    """A part of a query decoded as a form's: + is a blank, and a % that begins no %xx stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25")), text)


def _named(part: Column) -> tuple[Column, Column]:
    """Name and value of a parameter, both still encoded."""
    name = F.split_part(part, F.lit("="), F.lit(1))
    return name, F.substring(part, F.length(name) + 2, F.length(part))


def redacted_query(query: Column) -> Column:
    """A query (with its ?) written anew as a form's, the values of secret parameters replaced; empty parts go."""

    def one(part: Column) -> Column:
        name, value = (_decoded(p) for p in _named(part))
        return F.concat(F.url_encode(name), F.lit("="), F.when(is_secret_parameter(name), REDACTED).otherwise(F.url_encode(value)))

    parts = F.filter(F.split(F.substring(query, F.lit(2), F.length(query)), "&", -1), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(F.transform(parts, one), "&"))).otherwise(F.lit(""))


def redacted_url(u: Column, keep_fragment: bool = False) -> Column:
    """A parsed network URL without secrets; null for other schemes and for URLs with credentials.

    A fragment that is kept is replaced as a whole where one of its parameters is a secret.
    """
    port = F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise("")
    parts = F.split(F.substring(u["fragment"], F.lit(2), F.length(u["fragment"])), "[?&]", -1)
    secret = F.exists(parts, lambda p: (F.instr(p, F.lit("=")) > 1) & is_secret_parameter(_decoded(_named(p)[0])))
    fragment = F.when(F.length(u["fragment"]) <= 1, "").when(secret, f"#{REDACTED}").otherwise(u["fragment"]) if keep_fragment else F.lit("")
    return F.when(u["scheme"].isin("http", "https") & (u["userinfo"] == ""), F.concat(u["scheme"], F.lit("://"), u["host"], port, u["path"], redacted_query(u["query"]), fragment))


def result_url(u: Column) -> Column:
    """What the result of a job shows of a URL: network URLs redacted with their fragment, of others the scheme."""
    return F.when(u.isNull(), "[invalid URL]").when(u["scheme"].isin("http", "https"), redacted_url(u, keep_fragment=True)).otherwise(F.concat(u["scheme"], F.lit(":[redacted]")))


def diagnostic_url(u: Column) -> Column:
    """What a report may show of any parsed URL: network URLs redacted, of others the scheme and of blobs their origin."""
    inner = F.regexp_extract(u["path"], r"^(https?://[^/?#]+)", 1)
    blob = F.when(inner != "", F.concat(F.lit("blob:"), inner, F.lit(f"/{REDACTED}"))).otherwise(f"blob:{REDACTED}")
    network = F.coalesce(redacted_url(u), F.concat(u["scheme"], F.lit(f"://{REDACTED}")))
    return F.when(u["scheme"].isin("http", "https"), network).when(u["scheme"] == "blob", blob).otherwise(F.concat(u["scheme"], F.lit(f":{REDACTED}")))

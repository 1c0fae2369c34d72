import random

import numpy as np
import pyarrow as pa

from weftarc.llm import url_filter
from weftarc.llm.queries import URL_RULES


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = []
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, urls, rules, **params):
    array = url_filter.RuleArray(spark.createDataFrame(rules, "rule string, verdict string"), **params)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, array).collect()}


URLS = [None, "", "http://", "no scheme.com/en/", "http://EXAMPLE.com/en/", "http://notexample.com/en/", "https://a.www.example.com/en/x?y#z", "x://net", "x://net?/es/", "x://a.net/es/#", "x://net/es", "x://com/\n/", "x://ÀB.com/É/"]


def test_rules_against_brute_force(spark):
    rnd = random.Random(3)
    urls = URLS + [f"http://{'.'.join(rnd.choices(['www', 'example', 'com', 'net', 'm'], k=rnd.randint(1, 5)))}/{rnd.choice(['', 'en/', 'es/x', 'fr/?q', 'en'])}" for _ in range(300)]
    got = judged(spark, urls, list(URL_RULES))
    assert got == {i: brute(u, URL_RULES) for i, u in enumerate(urls)}


def test_many_rules_in_shards(spark):
    rnd = random.Random(4)
    names = [f"{a}.{b}" for a in "abcdef" for b in ("com", "net", "co.uk")]
    rules = list({f"{rnd.choice(names)}/{rnd.choice(['', 'x/', 'x/y', 'z'])}": rnd.choice(["allow", "block"]) for _ in range(60)}.items())
    urls = [f"http://{rnd.choice(['', 'w.', 'v.w.'])}{rnd.choice(names)}/{rnd.choice(['', 'x/', 'x/y/z', 'zz'])}" for _ in range(300)]
    assert judged(spark, urls, rules, shard_rules=7) == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_no_rules_null_rules_and_rules_given_twice(spark):
    assert judged(spark, ["http://a.com/"], [])[0] == ("a.com", "/", None, "allow")
    assert judged(spark, ["http://a.com/"], [(None, "block")])[0] == ("a.com", "/", None, "allow")
    assert judged(spark, ["http://a.com/"], [("A.com/", "allow"), ("a.com/", "block")])[0] == ("a.com", "/", "a.com/", "block")


def test_equal_keys_are_told_apart_by_their_strings():
    keys, strings = np.array([1, 5, 5, 5, 9]), pa.array(["a", "b", "c", "d", "e"])
    got = url_filter.probe(keys, strings, np.array([5, 5, 5, 9, 2, 10]), pa.array(["d", "b", "x", "e", "a", "e"]))
    assert got.tolist() == [3, 1, -1, 4, -1, -1]


def test_extra_columns_stay_and_clashing_ones_are_replaced(spark):
    array = url_filter.RuleArray(spark.createDataFrame([("com/", "block")], "rule string, verdict string"))
    r = url_filter.judge(spark.createDataFrame([("http://a.com/", "mine", "kept")], "url string, host string, note string"), array).first()
    assert (r.host, r.note, r.verdict) == ("a.com", "kept", "block")


def test_callers_columns_stay(spark):
    array = url_filter.RuleArray(spark.createDataFrame(URL_RULES, "rule string, verdict string"))
    rows = spark.createDataFrame([(1, "http://a.net/es/x", "m", "n", "o"), (2, None, None, None, None)], "page_id long, url string, match string, match_ string, __match string")
    got = {r.page_id: r for r in url_filter.judge(rows, array).collect()}
    assert tuple(got[1]) == (1, "http://a.net/es/x", "m", "n", "o", "a.net", "/es/x", "net/es/", "block") and got[2].verdict == "allow"
    assert url_filter.judge(rows.limit(0), array).count() == 0


def test_a_host_is_looked_at_before_its_paths(spark):
    """Many lengths of paths, of which each host has few; very long URLs and repeated rows."""
    rnd = random.Random(6)
    rules = [(f"h{k}.com/{'x' * k}", rnd.choice(["allow", "block"])) for k in range(1, 400)] + [("long.net/" + "y/" * 5000, "block"), ("com/", "allow")]
    urls = [f"http://a.h{rnd.randrange(1, 450)}.com/{'x' * rnd.randrange(450)}" for _ in range(400)] + ["http://long.net/" + "y/" * 5000 + "z" * 100_000, "http://long.net/" + "y/" * 4999] * 2
    assert judged(spark, urls, rules, shard_rules=100) == {i: brute(u, rules) for i, u in enumerate(urls)}

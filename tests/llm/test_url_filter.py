import random

import pytest

from textmill.llm import url_filter

PAGES = "page_id long, url string, host string, rule int"


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def canonical(url):
    host, path = cut(url)
    if not host:
        return None
    rest = url.split("://", 1)[1].split("#", 1)[0]
    asked = rest.split("?", 1)[1] if "?" in rest else ""
    name = lambda p: p.split("=", 1)[0]
    tracking = lambda p: name(p) in ("ref", "fbclid", "gclid") or (name(p).startswith("utm_"))
    kept = sorted(p for p in asked.split("&") if p and not tracking(p))
    return host + (path[:-1] if path.endswith("/") else path) + ("?" + "&".join(kept) if kept else "")


def brute_force(urls, rules, listed):
    forms = {canonical(u) for u in listed} - {None}
    out = []
    for url in urls:
        host, path = cut(url)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
        own = "block" if canonical(url) in forms else "allow"
        out.append((host, path, best and best[0] + best[1], best[2] if best else own))
    return out


def judged(spark, urls, rules, listed):
    pages = spark.createDataFrame([(i, u, "x", 5) for i, u in enumerate(urls)], PAGES).repartition(3)
    rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    listed = spark.createDataFrame([(u,) for u in listed], "url string")
    found = url_filter.judge(pages, rules, listed).orderBy("page_id").collect()
    assert [r.page_id for r in found] == list(range(len(urls)))
    return [(r.host, r.path, r.rule, r.verdict) for r in found]


def made(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        host = ".".join(rng.choice(("a", "b", "example", "WWW", "x-y", "é")) for _ in range(rng.randint(0, 4)))
        host += rng.choice((".com", ".net", ".org", "", ".COM:80", "."))
        path = "".join(rng.choice(("/", "/en", "/en/", "/es/", "x", "/f r", "%20")) for _ in range(rng.randint(0, 4)))
        end = rng.choice(("", "#top", "?a=1&b=2", "?b=2&a=1", "?utm_x=3", "?ref=1&a=1#z", "?", "/?x://y"))
        out.append(rng.choice(("http://", "https://", "", "://", "x")) + host + path + end)
    return out


def test_judging_against_brute_force(spark):
    urls = [*made(500), None, "", "://", "http://", "http:///p", "http://com", "http://com/", "http://a\nb.com/x\ny", "http://com/" + "p" * 100_000, "http://" + "a." * 2000 + "com/"]
    urls += urls[:40]
    rules = [*url_filter.RULES, ("example", "", "block"), ("b.com", "/en", "block"), ("org", "/en/en", "allow"), ("com:80", "/", "block"), ("x-y.net", "/es/x", "allow")]
    listed = [*made(60, 2), *urls[::17], None, "nothing"]
    want = brute_force(urls, rules, listed)
    assert judged(spark, urls, rules, listed) == want
    assert len({w[2] for w in want}) > 6 and 20 < sum(w[3] == "block" for w in want) < 500
    assert judged(spark, urls[:30], [], listed) == brute_force(urls[:30], [], listed)
    assert judged(spark, urls[:30], rules, []) == brute_force(urls[:30], rules, [])
    assert judged(spark, [], rules, listed) == []


def test_many_rules_and_false_positives_of_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", 2)  # nearly every key passes; the joins decide
    rng = random.Random(4)
    rules = sorted({(rng.choice(("com", "net", "example.com", "b.net")), "/" + "x" * k, rng.choice(("allow", "block"))) for k in range(300)})
    rules = list({r[:2]: r for r in rules}.values())
    urls = [f"http://{rng.choice(('q.com', 'example.com', 'b.net', 'org'))}/{'x' * rng.randint(0, 320)}/y" for _ in range(300)]
    assert judged(spark, urls, rules, urls[::3]) == brute_force(urls, rules, urls[::3])


def test_no_listed_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    bloom = url_filter.bloom_filter(keys, 20_000)
    assert url_filter.possible(keys, keys["key"], bloom).count() == 20_000
    others = spark.range(100_000).selectExpr("concat('o', id) AS key")
    assert url_filter.possible(others, others["key"], bloom).count() < 500


@pytest.mark.parametrize("verdicts", [("allow", "block"), ("block", "allow")])
def test_of_equal_rules_the_blocking_one_counts(spark, verdicts):
    rules = [("com", "/", v) for v in verdicts]
    assert judged(spark, ["http://com/"], rules, []) == [("com", "/", "com/", "block")]

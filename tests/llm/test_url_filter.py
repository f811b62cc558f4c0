import math

from briefloom.llm.registry import URL_RULES
from briefloom.llm.url_filter import MarkovModel, calibrated_threshold, filter_urls, grams


def brute_rule(url):
    text = url or ""
    rest = text.split("://", 1)[1] if "://" in text else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for action, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best


def test_rules_and_edge_urls(spark):
    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "https://example.com/de", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://b.com", "http://b.com?/x", "no scheme.com/", None, "", "://com/", "a://b://c.com/", "http://ÉCOLE.com/é", "http://org.x/\n/en/"] * 2
    df = spark.createDataFrame([(i, u, "h", 0.1) for i, u in enumerate(urls)], "page_id long, url string, host string, score double").repartition(2)
    rows = {r["page_id"]: r for r in filter_urls(df, URL_RULES).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = brute_rule(u)
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1] if best else None)
        assert r["verdict"] in ("allow", "block") and (best is None or r["verdict"] == best[0]) and (r["score"] is None) == (best is not None)


def test_model_separates_unruled_urls(spark):
    rows = [(i, f"http://shop{i % 7}.com/item/{i}") for i in range(200)] + [(1000 + i, f"http://x.net/es/casino-{i % 9}") for i in range(200)]
    asked = [(5000, "http://shop3.org/item/77"), (5001, "http://y.org/es/casino-5")]
    df = spark.createDataFrame(rows + asked, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(df, URL_RULES).where("page_id >= 5000").collect()}
    assert got == {5000: "allow", 5001: "block"}


def test_probabilities_sum_to_one():
    counts = {}
    for text in ("abab", "abc"):
        for g in grams(text, 3):
            counts[g] = counts.get(g, 0) + 1
    model = MarkovModel(counts, 3)
    for context in ("", "a", "ab", "zab", "zz"):
        known = sum(model.probability(context, chr(c)) for c in range(256))
        assert math.isclose(known, 1 - model.probability(context, "\u0100"), rel_tol=1e-9)


def test_threshold_and_empty_table(spark):
    scored = spark.createDataFrame([("allow", 1.0), ("allow", 0.5), ("block", -1.0), ("block", -0.2)], "verdict string, score double")
    assert -0.2 < calibrated_threshold(scored) <= 0.5 and calibrated_threshold(scored.where("verdict = 'allow'")) == 0.0
    none = filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES)
    assert none.count() == 0
    free = filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), URL_RULES).first()
    assert (free["verdict"], free["score"]) == ("allow", 0.0)

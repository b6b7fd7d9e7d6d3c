import re

import pytest

from reposieve.llm import queries, urls


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(spark)


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3:], re.S).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme", "https://", "http://Example.COM/en/1", "https://www.example.com/en/", "https://x.www.example.com/en/a?b#c", "http://example.com",
    "http://example.com?x=/en/", "ftp://notexample.com/en/", "https://a.net/es/1", "https://a.net/fr/x", "https://net/es/", "https://a.net/de/x#/es/",
    "x://y://z/es/", "https://ÄB.example.net/es/ü", "https://a.b\nc.net/es/\nx", "https://casino-bets.example.org/win", "https://garden.example.org/roses",
    "https://a.example.net/" + "long/" * 2000, "https://com/", "https://user@host.net:80/fr/",
]


def frame(spark, some):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(some)], "page_id long, url string, host string, rule string")


def test_rules_against_brute_force(spark, model):
    rows = sorted(urls.judge(frame(spark, URLS), model, ["page_id"]).collect())
    for r, u in zip(rows, URLS):
        host, path = parts(u)
        best = rule(host, path)
        assert (r.host, r.path, r["rule"]) == (host, path, best and best.text)
        assert r.verdict == (best.verdict if best else "block" if r.p_block >= 0.5 else "allow")
    verdict = {u: r.verdict for r, u in zip(rows, URLS)}
    assert verdict["https://casino-bets.example.org/win"] == "block" and verdict["https://garden.example.org/roses"] == "allow"


def test_probabilities_against_the_weights(spark, model):
    from math import exp

    for r in urls.judge(frame(spark, URLS), model, ["page_id", "url"]).collect():
        hit = spark.createDataFrame([(r.host, r.path)], "h string, p string").select(urls.slots(urls.F.col("h"), urls.F.col("p"))).first()[0]
        assert len(hit) == len(set(hit))
        assert abs(r.p_block - 1 / (1 + exp(-model.intercept - sum(model.weights[i] for i in hit)))) < 1e-9
        if r.page_id > 4:
            break


def test_unseen_hosts(spark, model):
    bad = [f"https://{p}{h}.example.org/de/{i}" for i, (p, h) in enumerate([("", "casino-star"), ("m.", "cheap-pills"), ("www.", "adult-tv"), ("blog.", "spam-mail")])]
    good = ["https://lake.example.org/de/1", "https://www.rathaus.example.org/de/7", "http://m.orchard.example.net/en/2?x=1"]
    rows = sorted(urls.judge(frame(spark, bad + good), model, ["page_id"]).collect())
    assert [r.verdict for r in rows] == ["block"] * 4 + ["allow"] * 3


def test_empty_table_and_plan(spark, model):
    found = urls.judge(frame(spark, URLS).filter("false"), model, ["page_id"])
    assert found.collect() == []
    plan = urls.judge(frame(spark, URLS), model, ["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.page_id: r for r in queries.QUERIES["op5_urls"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    assert len(found) == len(pages)
    for p in pages:
        r, best = found[p.page_id], rule(*parts(p.url))
        assert (r.host, r.path) == parts(p.url) and r["rule"] == (best and best.text) and (best is None or r.verdict == best.verdict)

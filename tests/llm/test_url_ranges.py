"""URL filter: ranges of small tables, hot hosts, and hosts with many rules, against one rule at a time."""

import random
from collections import Counter

from pyspark.sql import functions as F

from kithgraph.llm import url_filter

RULES = "action string, host string, path string"


def plain(url, rules):
    """The verdict by trying every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = host.lower()
    fits = [
        (len(h) + len(p), len(h), a == "block", h + p, a)
        for a, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def decided(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return url_filter.filter_urls(pages, spark.createDataFrame(rules, RULES))


def check(spark, urls, rules):
    got = {r[0]: tuple(r[1:]) for r in decided(spark, urls, rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_fewer_rows_than_ranges(spark):
    """All rows used to fall into one range then."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        urls = [f"https://h{i}.net/{i}" for i in range(20)] + [None, "no url", "https://"]
        check(spark, urls, list(url_filter.RULES))
        check(spark, ["https://example.net/en/x"], list(url_filter.RULES))
        tasks = {r[0] for r in decided(spark, urls, list(url_filter.RULES)).select(F.spark_partition_id()).collect()}
        assert len(tasks) > 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_hot_host_is_spread_evenly(spark):
    urls = [f"https://hot.org/fr/{i}" for i in range(1500)] + [f"https://w{i}.net/" for i in range(300)]
    places = decided(spark, urls, list(url_filter.RULES)).select(F.spark_partition_id()).collect()
    most = max(Counter(r[0] for r in places).values())
    assert most <= 2 * len(urls) // 8
    check(spark, urls, list(url_filter.RULES))


def test_many_nested_rules(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abc")
    hosts = [".".join(word() for _ in range(rng.randint(1, 4))) for _ in range(30)]
    paths = ["", "/"] + ["/" + "".join(word() for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(400)]
    urls = [f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', '#f', 'b'])}" for _ in range(600)]
    check(spark, urls, rules)

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tolparse.llm import mixing, queries, url_filter

URLS = [
    None, "", "no scheme", "http://", "://x.com/en/1", "http://example.com/en/7", "http://EXAMPLE.com/en/71?q", "https://a.example.com/en/8#t", "http://com/en/", "http://com/en",
    "http://notcom/en/1", "http://x.net/de/9", "http://example.net/de/8/", "http://sub.example.net/de/81", "http://badexample.net/de/8", "http://x.org/es/", "http://x.org/es", "http://x.org?/es/",
    "http://x.com/EN/1", "ftp://x.com:80/en/", "http://u@x.com/en/a://b.net/de/", "http://x.com./en/1", "http://" + "a." * 3000 + "com/en/" + "z" * 20000, "http://..com/en/1", "http://x.com/en/1", "http://x.com/en/1",
]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    rows = list(enumerate(URLS))
    df = spark.createDataFrame([(i, u, "old", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, queries.URL_RULES).collect()}
    assert got == {i: judged(u) for i, u in rows}
    assert url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}
    both = [("allow", "x.com", "/en/"), ("block", "x.com", "/en/"), ("allow", "com", "/en/"), (None, "x.net", "/"), ("block", None, "/")]
    got = {r.url: (r.rule, r.verdict) for r in url_filter.filter_urls(df, both).collect()}
    assert got["http://x.com/en/1"] == ("x.com/en/", "block") and got["http://notcom/en/1"] == (None, "allow") and got["https://a.example.com/en/8#t"] == ("com/en/", "allow")
    with pytest.raises(ValueError, match="more than 7 bytes"):
        url_filter.filter_urls(df, queries.URL_RULES, max_bytes=7)


def test_url_rules_of_the_contract(spark, tmp_path):
    spark.createDataFrame(list(enumerate(["http://x.com/en/1", "http://example.com/en/7", "http://x.net/de/9", "http://example.net/de/8", "http://x.org/es/"])), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.rule: r.verdict for r in queries.op7_url_filter(spark, str(tmp_path)).collect()}
    assert got == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_cascade_is_exact(spark):
    universe = [f"key{i}" for i in range(6000)]
    listed = random.Random(1).sample(universe, 400) + ["unseen"]
    frame = lambda k: spark.createDataFrame([(x,) for x in k], "key string")
    cascade = url_filter.Cascade(frame(listed), frame(universe))
    assert len(cascade.levels) > 1
    found = {r.key for r in frame(universe).filter(cascade.has(F.col("key"))).collect()}
    assert found == set(listed) & set(universe)
    assert len(cascade.data) < 2000


def targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    total, out, full = sum(sizes.values()), {}, set()
    while True:
        free = [n for n in names if n not in full]
        rest = total - sum(3 * sizes[n] for n in full)
        out = {n: 3.0 * sizes[n] for n in full} | {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if out[n] > 3 * sizes[n]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10}, {"a": 1, "B": 1000, None: 5, "z": 0}, {"a": 5}, {None: 7}, {"é": 3, "z": 30, "Z": 300, "a": 3000, "b": 2}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_sampling(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", None]), rng.choice([0, 1, 5, 40, 41, 300, 2000])) for i in range(3000)] + [(7, "hot", 12)] * 500 + [(None, "hot", 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size long, target string")
    first, again = (sorted(mixing.systematic_sample(d).select("doc_id", "source", "size", "copies", "target").collect(), key=repr) for d in (df, df.repartition(7)))
    assert first == again and len(first) == len(rows)
    for source in ("a", "b", "c", "hot", None):
        own = [r for r in first if r.source == source]
        assert max(r.copies for r in own) <= 3
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    assert mixing.systematic_sample(df.limit(0)).count() == 0
    assert {r.copies for r in mixing.systematic_sample(spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")).collect()} == {0}


@pytest.mark.parametrize("name", ["op7_url_filter", "op10_systematic_mix"])
def test_native_plans(spark, sf_dir, name):
    text = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", text)

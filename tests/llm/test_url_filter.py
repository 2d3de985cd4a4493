import pytest

from gridlens.llm.url_filter import RULES, url_filter


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


URLS = [None, "", "no scheme/x", "http://", "http://ORG", "http://a.ORG/", "https://x.example.org/es/1", "https://example.org/en/12?q=/es/", "http://Ünï.com/fr/", "http://notorg/",
        "http://a.com/de/#x", "http://a.com?x/de/", "ftp://b://c/d", "http://org.com/en/1", "http://x.net/a//b/", "http://h.net/" + "a/" * 500, "http://x.org\n/es/ 7", "http://example.org/es"]


def test_host_path_rule_equal_brute_force(spark):
    rows = [(i, u, "junk") for i, u in enumerate(URLS)] + [(None, "http://a.com/de/1", "x"), (3, "no scheme/x", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").selectExpr("*", "1 as n", "'k' as template", "2 as depth")
    got = url_filter(df).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, brute(u)[:3])) for i, u, _ in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    for r in got:
        fixed = brute(URLS[r.page_id])[3] if r.page_id is not None else "block"
        assert r.verdict in ("allow", "block") and (fixed is None or r.verdict == fixed)


def test_empty_table(spark):
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_carry_labels_to_urls_without_rule(spark):
    rows = [(i, f"http://h{i % 5}.com/{('fr', 'de', 'en')[i % 3]}/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://new.net/{('fr', 'de')[i % 2]}/{i}.html") for i in range(50)] + [(2000 + i, f"http://new.net/{('fr', 'de')[i % 2]}/{i}") for i in range(50)]
    got = {r.page_id: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {got[2000 + i].verdict for i in range(0, 50, 2)} == {"allow"} and {got[2000 + i].verdict for i in range(1, 50, 2)} == {"block"}


def test_variable_and_similar_segments(spark):
    rows = [(i, f"http://a.net/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/posts/{i}") for i in range(300)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.template for r in got} == {"/user/*/posts/#"}
    rows = [(i, f"http://a.org/{('x', 'y')[i % 2]}/{i}") for i in range(100)]
    assert {r.template for r in url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()} == {"/+/#"}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_given_pages_in_one_native_plan(spark, sf):
    df = url_filter(spark.read.parquet(f"{sf}/pages.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert all((r.host, r.path, r.rule) == brute(r.url)[:3] for r in df.join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect())


def test_very_long_paths_cost_as_much_as_they_are_long(spark):
    """Paths of 100,000 segments, with the tree table built once."""
    long = ["http://deep.net/" + "a/" * 100_000 + end for end in ("x", "y", "1")]
    rows = [(i, u) for i, u in enumerate(long + long[:1] + [f"http://deep.net/a/{i}" for i in range(20)])]
    df = url_filter(spark.createDataFrame(rows, "page_id long, url string"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") < 40
    got = {r.page_id: r for r in df.collect()}
    assert len(got) == len(rows) and got[0].path == "/" + "a/" * 100_000 + "x" and got[0].template == got[3].template
    assert got[2].template.count("/") == 100_001 and got[2].template.endswith(("#", "+")) and got[10].template == got[23].template

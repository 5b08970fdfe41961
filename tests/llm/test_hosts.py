import pytest

from markspark.llm import hosts

RULES = [
    hosts.Rule("com", "/", "allow"),
    hosts.Rule("example.com", "/en/", "block"),
    hosts.Rule("www.example.com", "/en/", "allow"),
    hosts.Rule("net", "/es/", "block"),
]
SCHEMA = "page_id LONG, url STRING, host STRING, path STRING, rate DOUBLE, pages STRING, id LONG"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", None, 0.1, "y", 3) for i, u in urls], SCHEMA)


def judge(spark, urls, outcomes=(), **kwargs):
    marks = spark.createDataFrame(list(outcomes), "page_id LONG, bad INT")
    return hosts.judge_urls(pages(spark, urls), marks, RULES, **kwargs).collect()


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://example.com", "example.com", "", None, "allow"),
        ("https://example.com?q=/en/", "example.com", "", None, "allow"),
        ("https://example.com#/en/", "example.com", "", None, "allow"),
        ("x://Ä.net/es/1", "Ä.net", "/es/1", "net/es/", "block"),
        ("x://a.net/EN/://b.com/", "a.net", "/EN/://b.com/", None, "allow"),
        ("://", "", "", None, "allow"),
        ("example.com/en/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule, verdict):
    r = judge(spark, [(1, url)])[0]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_hosts_are_blocked_by_their_bound(spark):
    urls = [(k, f"http://bad{k % 2}.org/x") for k in range(60)]
    urls += [(100 + k, f"http://good{k % 4}.org/x") for k in range(200)]
    urls += [(900, "http://once.org/x"), (901, "http://never.org/x")]
    outcomes = [(k, 1) for k in range(60)] + [(100 + k, int(k % 25 == 0)) for k in range(200)]
    rows = judge(spark, urls, [*outcomes, (900, 1), (5, 0), (None, 1), (7, None)])
    verdicts = {r.host: r.verdict for r in rows}
    assert verdicts["bad0.org"] == verdicts["bad1.org"] == "block"
    assert {verdicts[h] for h in ("good0.org", "never.org")} == {"allow"}
    rates = {r.host: r.bad_rate for r in rows}
    # one bad page says less than thirty, and a host without labels has its domain's rate
    assert rates["good0.org"] < rates["never.org"] < rates["once.org"] < rates["bad0.org"]
    assert all(0 <= r.bad_low <= r.bad_rate <= 1 for r in rows)


def test_rows_are_neither_lost_nor_joined(spark):
    urls = [(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/"), (None, None)]
    rows = judge(spark, urls, [(1, 1), (1, 0)])
    assert len(rows) == 4 and judge(spark, []) == []


def test_a_host_with_most_pages(spark):
    df = spark.range(3_000).selectExpr(
        "id AS page_id", "IF(id % 3 < 2, 'http://hot.org/', concat('http://h', id, '.org/')) AS url"
    )
    marks = df.selectExpr("page_id", "cast(page_id % 7 = 0 AS INT) AS bad")
    got = hosts.judge_urls(df, marks, RULES)
    assert got.count() == 3_000 and got.filter("host = 'hot.org'").count() == 2_000

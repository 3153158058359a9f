from evidora.llm import hosts
from pyspark.sql import functions as F
from tests_llm_oracle import check_query


def test_query_against_sql(spark):
    check_query(spark, "op8_url_reputation", "/root/testdata/sf0.01")


def judged(make, rows, outcomes, **options):
    pages = make(rows, "page_id long, url string")
    known = make(outcomes, "page_id long, bad boolean")
    return hosts.url_filter(pages, known, **options).collect()


def test_rules_and_parts(make):
    rows = [
        (1, None), (2, "no scheme/de/"), (3, "http://A.Example.NET/en/x?y#z"), (4, "https://example.net/eN/"), (5, "http://net"),
        (6, "http://x.net?q=/a"), (7, "https://Example.com/de/"), (8, "https://myexample.com/de/"), (9, "ftp://w.org/fr/a"),
        (10, "http://a.b://c/d"), (None, "https://b.org/x"), (3, "http://A.Example.NET/en/x?y#z"), (11, ""), (12, "http://é.org:80/fr/"),
    ]
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in judged(make, rows, []))
    assert got == [
        (0, "b.org", "/x", None, "allow"),
        (1, "", "", None, "allow"),
        (2, "", "", None, "allow"),
        (3, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (3, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (4, "example.net", "/eN/", "net/", "block"),
        (5, "net", "", None, "allow"),
        (6, "x.net", "", None, "allow"),
        (7, "example.com", "/de/", "example.com/de/", "block"),
        (8, "myexample.com", "/de/", None, "allow"),
        (9, "w.org", "/fr/a", "org/fr/", "allow"),
        (10, "a.b:", "//c/d", None, "allow"),
        (11, "", "", None, "allow"),
        (12, "é.org:80", "/fr/", None, "allow"),
    ]


def test_shrinkage(make):
    rows = [(i, f"http://h{i % 20}.{'bad' if i % 20 < 10 else 'good'}.test/{i}") for i in range(2000)]
    rows += [(5000, "http://new.bad.test/"), (5001, "http://new.good.test/"), (5002, "http://x.other.test/")]
    outcomes = [(i, i % 20 < 10) for i in range(2000)] + [(0, True), (None, True), (3, None), (77777, True)]
    got = {r.page_id: r for r in judged(make, rows, outcomes, rules=[])}
    assert got[0].verdict == "block" and got[11].verdict == "allow" and got[0].rule is None
    assert got[5001].bad_bound <= got[5002].bad_bound < got[5000].bad_bound
    assert got[5000].bad_bound < got[0].bad_bound


def test_empty(make):
    assert judged(make, [], []) == []
    assert judged(make, [], [(1, True)]) == []


def test_levels(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("a.b.example.com",), ("localhost",), ("",), ("x.org:8080",)], "host string")
    domain, suffix = hosts._levels(F.col("host"))
    assert [tuple(r) for r in df.select(domain, suffix).collect()] == [
        ("b.co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("", ""), ("x.org", "org"),
    ]

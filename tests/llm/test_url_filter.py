"""The URL filter against its SQL, and the Bloom filter against the exact join."""

import duckdb

from episodic.llm import url_filter

URLS = [None, "", "no scheme", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/q", "http://example.com/en",
        "http://notexample.com/en/", "ftp://x.net/es/1", "ftp://x.net/fr", "ftp://net/fr/?u=http://a.com/", "http://com/", "http://com", "http://.com/x",
        "a://b://c.com/d", "http://x.com:80/en/", "http://u@example.com/en/#f", "http://EXAMPLE.com?/en/", "http://ÄX.com/en/", "://net/es/ a\nb", "http://x.org/en/",
        "http://www.example.com/EN/", "http://" + "a." * 300 + "net/es/" + "p" * 5000]


def frame(spark, urls=URLS):
    rows = [(i, u, "h", "r", "b") for i, u in enumerate([*urls, urls[3], urls[3]])]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string, block string")


def test_equals_sql(spark, tmp_path):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    pages = frame(spark)
    got = sorted(tuple(r) for r in url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect())
    pages.write.parquet(str(tmp_path / "p"))
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from read_parquet('{tmp_path}/p/*.parquet')")
        assert got == sorted(map(tuple, c.execute(url_filter.ORACLES["op8_url_filter"]).fetchall()))


def test_full_filter_is_corrected_by_the_join(spark, monkeypatch):
    rules = spark.createDataFrame(url_filter.RULES + [("", "/x", "block"), (None, "/", "block"), ("org", None, "block"), ("com", "/", "block")],
                                  "host string, path string, verdict string")
    whole = sorted(map(str, url_filter.judge(frame(spark), rules).collect()))
    monkeypatch.setattr(url_filter, "_mask", lambda: url_filter.F.lit(0))  # every key passes the filter
    assert sorted(map(str, url_filter.judge(frame(spark), rules).collect())) == whole
    assert "verdict='block'" in [r for r in whole if "page_id=11," in r][0]  # block wins over the equal allow rule


def test_empty_tables(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    assert url_filter.judge(frame(spark).where("false"), rules).count() == 0
    got = url_filter.judge(frame(spark), rules.where("false"), default="block").collect()
    assert len(got) == len(URLS) + 2 and all(r.rule is None and r.verdict == "block" for r in got)


def test_no_python_in_the_plan(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    plan = url_filter.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan.split("Physical Plan")[1]

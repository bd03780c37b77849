import duckdb
import pytest
from pyspark.sql import functions as F

from itemlab.llm import url_filter

PAGES = "page_id long, url string, html string, rule string, bound int"
LABELS = "doc_id long, quality int, toxic int, host string"
RULES = "host string, path string, verdict string"


def run(spark, urls, labels=(), rules=(), **more):
    pages = spark.createDataFrame([(k, u, "x", "clash", 1) for k, u in enumerate(urls)], PAGES)
    out = url_filter.judged(pages, spark.createDataFrame(list(rules), RULES), spark.createDataFrame(list(labels), LABELS), **more)
    return {r.page_id: r for r in out.collect()}


def test_hosts_and_paths(spark):
    urls = {
        "http://Example.NET/En/x?q#f": ("example.net", "/En/x"), "https://a.b": ("a.b", ""), "x://h?q=/p": ("h", ""), "x://h#/p": ("h", ""),
        "a://b://c/d": ("b:", "//c/d"), "no scheme": ("", ""), "": ("", ""), None: ("", ""), "ÄX://ÄX.de/ß": ("Äx.de", "/ß"), "h://u@x.de:80/a\nb": ("u@x.de:80", "/a\nb"),
        "://": ("", ""), "x://" + "a" * 100_000 + "/" + "b" * 100_000: ("a" * 100_000, "/" + "b" * 100_000),
    }
    got = run(spark, list(urls))
    assert [(got[k].host, got[k].path) for k in range(len(urls))] == list(urls.values())
    assert {r.verdict for r in got.values()} == {"allow"} and got[5].bound is None


def test_longest_rule(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.net", "/en/bad", "block"), ("x.example.net", "", "allow"), (None, "/", "block"), ("org", None, "block"), ("com", "/", "allow"), ("com", "/", "block")]
    urls = ["a://net/", "a://x.net/", "a://xnet/", "a://x.net", "a://example.net/en/y", "a://w.example.net/en/bad/1", "a://x.example.net/q", "a://x.example.net/en/q", "a://o.org/", "a://o.com/x", "a://example.net/e"]
    got = run(spark, urls, rules=rules)
    assert [got[k].rule for k in range(len(urls))] == ["net/", "net/", None, None, "example.net/en/", "Example.net/en/bad".lower(), "x.example.net", "example.net/en/", None, "com/", "net/"]
    assert [got[k].verdict for k in range(len(urls))] == ["block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow", "block", "block"]


def test_domains(spark):
    names = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "www.example.net": ("example.net", "net"), "co.uk": ("co.uk", "co.uk"), "localhost": ("localhost", "localhost"),
        "u:p@x.y.de:8080": ("y.de", "de"), "10.0.0.1:80": ("10.0.0.1", ""), "[::1]": ("[::1]", ""), "x.com.": ("x.com", "com"), "com.com": ("com.com", "com"),
    }
    got = {r.host: (r.domain, r.suffix) for r in url_filter.with_domains(spark.createDataFrame([(h,) for h in names], "host string")).collect()}
    assert got == names


def test_reputation_is_shrunk_and_bounded(spark):
    urls, labels = [], []

    def add(host, n, bad, unlabelled=1):
        for k in range(n):
            labels.append((len(urls), 1 if k >= bad else 0, 0, "clash"))
            urls.append(f"http://{host}/{k}")
        urls.extend(f"http://{host}/new{k}" for k in range(unlabelled))

    for k in range(20):
        add(f"good{k}.fine.com", 30, 1)
        add(f"bad{k}.farm.net", 30, 29)
    add("one.fine.com", 1, 1)  # a single bad page in a good domain
    add("fresh.farm.net", 0, 0)  # no label in a bad domain
    add("fresh.fine.com", 0, 0)
    add("alone.org", 1, 1)
    labels += [(None, 0, 1, "c"), (0, None, None, "c"), (10**9, 0, 0, "c")]
    got = run(spark, urls, labels)
    by_host = {r.host: r for r in got.values()}
    assert by_host["bad3.farm.net"].verdict == "block" and by_host["good3.fine.com"].verdict == "allow"
    assert by_host["one.fine.com"].verdict == "allow" and by_host["one.fine.com"].bad_share < 0.3
    assert by_host["fresh.farm.net"].bad_share > 0.8 and by_host["fresh.fine.com"].bad_share < 0.2
    assert by_host["alone.org"].verdict == "allow"  # one page proves nothing
    assert all(r.bound <= r.bad_share for r in got.values())
    assert len(got) == len(urls)
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    db.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    db.executemany("INSERT INTO labels VALUES (?, ?, ?)", [r[:3] for r in labels])
    want = {r[0]: r[1:] for r in db.execute(url_filter.OP13_SQL).fetchall()}
    mine = run(spark, urls, labels, url_filter.RULES)
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in mine.items()} == want


@pytest.mark.parametrize("hot", [1.0, 0.0, 0.3])
def test_hot_keys_repeated_rows_and_conflicts(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT_SHARE", hot)
    pages = spark.createDataFrame([(1, "a://h.de/x", "", "", 1)] * 5 + [(2, "a://g.de/", "", "", 1), (None, "a://g.de/", "", "", 1), (3, None, "", "", 1)], PAGES)
    labels = spark.createDataFrame([(1, 1, 0, ""), (1, 1, 1, ""), (2, 1, None, "")], LABELS)
    rows = url_filter.judged(pages, spark.createDataFrame([("h.de", "/", "block")], RULES), labels).collect()
    assert sorted((str(r.page_id), r.verdict) for r in rows) == [("1", "block")] * 5 + [("2", "allow"), ("3", "allow"), ("None", "allow")]
    assert {r.host: r.bad_share for r in rows}["g.de"] is not None


def test_empty_tables(spark):
    empty = lambda s: spark.createDataFrame([], s)
    assert url_filter.judged(empty(PAGES), empty(RULES), empty(LABELS)).count() == 0
    assert run(spark, ["a://b.c/"])[0].verdict == "allow"


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = url_filter.op13_url_filter(spark, sf)
    assert sorted(tuple(r) for r in got.select("page_id", "host", "path", F.coalesce("rule", F.lit("")), "verdict").collect()) == sorted(
        (a, b, c, d or "", e) for a, b, c, d, e in db.execute(url_filter.OP13_SQL).fetchall()
    )

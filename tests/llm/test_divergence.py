import duckdb
import pytest

from itemlab.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, rank int, item string"


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    return sorted(db.execute(divergence.OP11_SQL).fetchall())


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_against_sql(spark, bits):
    """Ties, nulls, empty and long texts, repeated rows, groups without terms; narrow digests collide and are split."""
    words = ["apple", "Äpfel", "apple's", "x1y", "日本", "über", "É", "zebra", "Zebra"]
    rows = [(k, " ".join(words[j % 9] for j in range(k, 3 * k)), "en" if k % 3 else "de", f"s{k % 4}", 7, "z") for k in range(60)]
    rows += [(100, None, "en", "empty", 7, "z"), (101, "", "none", "a", 7, "z"), (102, "only", "none", "b", 7, "z"), (103, "one", "alone", "s", 7, "z")]
    rows += [(104, "apple " * 9, None, None, 7, "z")] * 12 + [(None, "big " * 400_000 + "apple", "en", "s1", 7, "z")] * 2
    got = result(divergence.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), bits=bits))
    want = by_sql(rows)
    assert got == want
    assert {r[0] for r in got} == {"en", "de", "none"} and ("none", "a", "pair", "b", 0, 1) in got
    assert any(r[2] == "term" and r[5] == 5 for r in got)


def test_tasks_that_give_out_early_and_long_rows_of_sources(spark, monkeypatch):
    for name, value in (("HELD", 20), ("SLICE", 30), ("ROWS", 7), ("PAIRS", 5), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(k, " ".join(chr(97 + (k * j) % 26) * (j % 4 + 1) for j in range(40)), "en", f"s{k % 13}", 7, "z") for k in range(200)]
    assert result(divergence.source_divergence(spark.createDataFrame(rows, SCHEMA))) == by_sql(rows)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_64_bits(spark):
    big = 9_000_000_000_000
    df = spark.createDataFrame([(big, 2 * big, 10)], "n long, total long, terms long").select(divergence._share("n", "total", "terms").alias("p"))
    assert df.first().p == 1 + 10**9 * (big + 2) // (2 * big + 20)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert result(divergence.op11_source_divergence(spark, sf)) == sorted(db.execute(divergence.OP11_SQL).fetchall())

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from itemlab.llm import warc
from itemlab.llm.common import scratch_path


def expected(rows, least):
    """page_id, bytes, digest, type, refers_to of each row, by its definition."""
    payload = [(h or "").encode() for _, _, h in rows]
    out = []
    for (page, _, _), raw in zip(rows, payload, strict=True):
        same = [p for (p, _, _), x in zip(rows, payload, strict=True) if x == raw and p is not None]
        first = max(same, default=None)
        revisit = len(raw) >= least and payload.count(raw) > 1 and first is not None and page != first
        out.append((page, len(raw), warc.sha1_base32(raw), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    texts = [None, "", "<p>x</p>", "é" * 3000, "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n", "\x1f\x8b\x08"]
    out = [(k, f"http://h/{k}\r\nX-Y: 1", rng.choice(texts)) for k in range(40)]
    out += [(100 + k, None, "".join(rng.choices("abc <>", k=rng.randint(0, 60_000)))) for k in range(10)]
    return [*out, (7, None, out[7][2]), (None, "u", "<p>x</p>"), (-5, "u", "only one")]


@pytest.mark.parametrize("least", [0, 1, 5000])
def test_round_trip(spark, least):
    warc.register(spark)
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "warc-test")
    warc.write_pages(df.repartition(3), path, least)
    got = warc.page_records(spark, path).collect()
    assert all(r.digest_matches for r in got if r.record_type == "response")
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows(), least)
    raw = spark.read.format("warc").load(path).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in raw} == {(h or "").encode() for _, _, h in rows()}


def test_wide_path(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    warc.register(spark)
    df = spark.createDataFrame(rows(), "page_id long, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_pages(df, path)
    assert sorted((tuple(r)[:5] for r in warc.page_records(spark, path).collect()), key=str) == expected(rows(), 0)


def test_empty_table(spark):
    warc.register(spark)
    path = scratch_path(spark, "warc-test")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(spark, path).count() == 0


def records():
    page = {"target_uri": "u", "date": "d", "refers_to": "<urn:page:1>", "payload_digest": "X"}
    return [page | {"record_type": "response", "record_id": f"<urn:page:{k}>", "payload": b"y" * n, "payload_length": n}
            for k, n in enumerate([5, 0, 100_000])] + [
            page | {"record_type": "revisit", "record_id": "<urn:page:9>", "payload": None, "payload_length": 7}]


@pytest.mark.parametrize("form", ["plain", "members", "foreign members"])
def test_forms_of_archives(spark, tmp_path, form):
    pack = {"plain": bytes, "members": warc.member, "foreign members": gzip.compress}[form]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nab:c\r\n\r\n"
    raw = b"".join(pack(x) for x in [info, *map(warc.record, records())])
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(raw)
    warc.register(spark)
    read = spark.read.format("warc")
    got = read.load(str(tmp_path)).where("record_type in ('response', 'revisit')").orderBy("record_id").collect()
    assert [r.payload_length for r in got] == [5, 0, 100_000, 7]
    assert [len(r.payload) for r in got] == [5, 0, 100_000, 0]
    heads = read.schema("record_id string, record_type string").load(str(tmp_path))
    assert heads.count() == 5
    assert [r.record_id for r in heads.where(F.col("record_id").startswith("<urn:page:9")).collect()] == ["<urn:page:9>"]


def test_unwanted_payloads_are_not_inflated():
    raw = b"".join(warc.member(warc.record(r)) for r in records())
    read = []

    class Counted(io.BytesIO):
        def read(self, n=-1):
            out = super().read(n)
            read.append(len(out))
            return out

        def size(self):
            return len(raw)

    big = warc.member(warc.record(records()[0] | {"payload": random.Random(1).randbytes(3_000_000), "payload_length": 3_000_000}))
    raw = big + raw
    found = list(warc.read_records(Counted(raw), lambda h: h["warc-type"] == "revisit", False))
    assert len(found) == 1 and sum(read) < 100_000


def test_pushed_filters(spark):
    reader = warc.WarcReader(warc.SCHEMA, {"path": "x"})
    given = [warc.EqualTo(("record_type",), "revisit"), warc.IsNotNull(("refers_to",)), warc.EqualTo(("payload_length",), 3)]
    assert list(reader.pushFilters(given)) == given[2:]
    assert not reader.wanted({"warc-type": "revisit"})
    assert reader.wanted({"warc-type": "revisit", "warc-refers-to": "x"})


def test_lengths_that_do_not_fit_are_left_out(monkeypatch):
    assert warc.member(b"x" * 500)[12:14] == b"sl" and gzip.decompress(warc.member(b"x" * 500)) == b"x" * 500
    monkeypatch.setattr(warc, "LENGTH_LIMIT", 400)
    raw = warc.member(b"x" * 500)
    assert raw[3] == 0 and gzip.decompress(raw) == b"x" * 500

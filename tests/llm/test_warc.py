import hashlib
import re

import pytest

from siltworks.llm import warc

BIG = "é" * 60
ROWS = [
    (5, "http://a/5", BIG, "x"), (3, "http://a/3", BIG, "y"), (9, None, BIG, "z"), (3, "http://a/0", BIG, "y"), (3, "http://a/0", BIG, "y"),
    (1, "http://a/1", None, "n"), (2, "http://a/2", "", "n"), (4, "http://a\r\n/4%0D", "small", "s"), (8, "", "an empty url", "s"), (4, "http://a/4", "small", "s"),
    (None, "http://a/n", BIG, "q"), (None, "http://a/m", "only null ids" * 20, "q"), (7, "http://a/7", "z" * 200_000, "q"),
]


def brute(rows):
    out, first = [], {}
    for i, (key, url, body, _) in enumerate(rows):
        data = (body or "").encode()
        rank = (key is None, key or 0, url is None, url or "", i)
        first[data] = min(first.get(data, (rank, key)), (rank, key), key=lambda x: x[0])
    for i, (key, url, body, _) in enumerate(rows):
        data = (body or "").encode()
        rank, lead = first[data]
        response = len(data) < 100 or rank[-1] == i
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "response" if response else "revisit", None if response else lead))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string").repartition(3)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == brute(ROWS)


def test_records_and_store(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")
    path = str(tmp_path / "archive")
    warc.write(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})
    found = warc.read(spark, path).collect()
    assert sorted((r.id is None, r.id or 0, r.url is None, r.url or "") for r in found) == sorted((k is None, k or 0, u is None, u or "") for k, u, *_ in ROWS)
    for r in found:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        if r.type == "response":
            assert hashlib.sha256(rest[:length]).hexdigest() == r.payload_digest and length == r.payload_bytes
        else:
            assert length == 0 and b"WARC-Refers-To: <urn:page:" in head
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        warc.write(pages, path)


def test_records_are_rebuilt(spark, tmp_path):
    """The described sizes and digests come from header and payload, joined and put together."""
    path = str(tmp_path / "archive")
    warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string"), path)
    responses, _ = warc.records(spark, path)
    described = warc.read(spark, path).where("type = 'response'").select("payload_bytes", "payload_digest")
    for frame in (responses, described):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "concat(header" in plan and "payload" in plan.split("ReadSchema", 1)[1]


@pytest.mark.parametrize(("store", "heads"), [("cast(concat(cast(payload as string), '!') as binary) payload", "*"), ("payload", "digest, type, encode(regexp_replace(decode(header, 'UTF-8'), 'Content-Length: ', 'Content-Length: 1'), 'UTF-8') header")])
def test_damage_is_found(spark, tmp_path, store, heads):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")
    path, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    warc.write(pages, path)
    spark.read.parquet(f"{path}/headers").selectExpr(*heads.split(", ", 2)).write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "first", "n", "size", store).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="differs from its header"):
        warc.read(spark, bad).select("payload_digest").collect()


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).collect() == []

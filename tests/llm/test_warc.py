"""Archives written and read back: whole, by record, and by any Zstandard tool."""

import hashlib
import io
from collections import Counter, defaultdict

import pytest
import zstandard
from pyarrow import fs

from tessera.llm import warc

PAGES = "page_id long, url string, html string"
COPY = "<p>" + "the same page, " * 10 + "</p>"


def pages():
    rows = [(i, f"http://a.org/{i}", f"<html>{'é🙂' * (i % 7)}{'x' * (i * 37 % 900)}</html>") for i in range(60)]
    rows += [(100 - i, "http://b.org/", COPY) for i in range(30)]  # of these 71 is the smallest
    rows += [(200, None, None), (201, "http://c.org/\r\nWARC-Type: odd", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 30)]
    rows += [(300, "u", "repeated " * 20)] * 3 + [(301, "u", "repeated " * 20), (None, "u", "repeated " * 20), (None, "u", "no id " * 30), (None, "v", "no id " * 30)]
    return [*rows, (400, "u", "large " * 50_000)]


def plain(rows, least=100):
    by = defaultdict(list)
    for i, _, html in rows:
        by[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in by[html or ""] if x is not None]
        first = min(ids) if ids and len(by[html or ""]) > 1 and len(data) >= least else None
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


@pytest.mark.parametrize("small", [100_000, 0])
def test_round_trip(spark, tmp_path, small):
    rows = pages()
    table = spark.createDataFrame(rows, PAGES).repartition(3)
    index = warc.write_bundles(table, str(tmp_path), frame=4000, bundle=3000, small=small)
    got = warc.read_digests(spark, str(tmp_path), index)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, got.collect())) == plain(rows)
    assert index.select("file").distinct().count() > 3 and index.where("frame > 0").count() > 0

    records = warc.read_records(spark, str(tmp_path), index).collect()
    html = {r[0]: r[2] or "" for r in rows if r[0] is not None}
    assert all(r["payload"] is None if r["record_type"] == "revisit" else r["page_id"] is None or r["payload"].decode() == html[r["page_id"]] for r in records)
    assert {r["uri"] for r in records if r["page_id"] == 201} == {"http://c.org/%0D%0AWARC-Type: odd"}

    # some records by their ids; frames without any are not touched
    some = [r["record_id"] for r in records if r["page_id"] in (5, 71, 80, 204, 400)]
    found = {r["page_id"]: r for r in warc.fetch(index, spark.createDataFrame([(x,) for x in some], "record_id string"), str(tmp_path)).collect()}
    assert set(found) == {5, 71, 80, 204, 400} and found[204]["payload"].decode() == html[204]
    assert found[80]["payload"] is None and found[80]["refers_to"] == found[71]["record_id"] and found[71]["payload"].decode() == COPY


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    index = warc.write_bundles(spark.createDataFrame(pages(), PAGES).coalesce(1), str(tmp_path), frame=2000)
    (name,) = (r["file"] for r in index.select("file").distinct().collect())
    path = tmp_path / "bundles" / name
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read()
    assert len(list(warc.parsed(whole))) == len(pages()) == index.count()
    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        table = warc.seek_table(f)
        assert b"".join(warc.read_frame(f, at, packed, check) for at, packed, _, check in table) == whole
        with pytest.raises(ValueError, match="checksum"):
            warc.read_frame(f, *table[0][:2], table[0][3] ^ 1)
    assert len(table) > 5 and max(size for _, _, size, _ in table[:-1]) <= 2000


def test_empty_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.read_digests(spark, f"{tmp_path}/none", warc.write_bundles(none, f"{tmp_path}/none")).count() == 0
    rows = pages()[:70]
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as first", "3 as n", "4 as file", "5 as refers_to")
    assert Counter(map(tuple, warc.read_digests(spark, f"{tmp_path}/x", warc.write_bundles(table, f"{tmp_path}/x")).collect())) == plain(rows)

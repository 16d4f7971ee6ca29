"""Archives: records against what was written, ranges read by the index, odd rows."""

import glob
import gzip
import hashlib
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.llm import warc
from tempora.session import materialize

LONG = "x" * 1500
SCHEMA = "page_id long, url string, html string, payload string"


def read_back(index, folder):
    return warc.read_records(index, folder).select(warc.page_of("record_id").alias("page_id"), "url", "payload_bytes", "payload_digest",
                                                   "record_type", warc.page_of("refers_to").alias("refers_to"), "payload").collect()


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) of each row, by comparing all with all."""
    out = []
    for i, _, html, _ in rows:
        p = (html or "").encode()
        ids = [j for j, _, h, _ in rows if (h or "").encode() == p and j is not None]
        kept = max(ids, default=None)
        refers = kept if len(p) >= 1000 and kept is not None and kept != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


@pytest.mark.parametrize("compressed", [True, False])
def test_pages_come_back(spark, compressed):
    rows = [(1, "http://a/", LONG, "clash"), (2, "http://a/?q= b\r\nX: y", "short", None), (3, None, None, None), (4, "http://ü/", "é" * 600, None),
            (5, "http://b/", LONG, None), (5, "http://b/", LONG, None), (6, "", "short", None), (7, "u", "", None),
            (None, "n", LONG, None), (None, None, "only " * 300, None), (None, None, "only " * 300, None),
            (8, "w", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 60, None), (9, "big", "é\u0000z" * 2_000_000, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    folder = warc.shared_folder(spark, "test")
    index = materialize(warc.write_records(warc.records_of(pages), folder, compressed=compressed), "index")
    out = read_back(index, folder)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=key) == sorted(expected(rows), key=key)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in out)
    assert {r.page_id: r.payload for r in out}[9].decode() == rows[-1][2]
    assert {r.page_id: r.url for r in out}[2] == "http://a/?q=%20b%0D%0AX:%20y"
    assert {r.page_id: r.url for r in out}[3] is None


def test_large_group_of_copies(spark):
    rows = [(i, f"http://h/{i}", LONG if i % 3 else f"{i} " * 400, None) for i in range(600)]
    index, folder = warc.archive_pages(spark.createDataFrame(rows, SCHEMA).repartition(7))
    out = read_back(index, folder)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in out) == [
        (*r[:4], r[4] or -1) for r in expected(rows)]


def test_selected_records_alone_are_read(spark, scratch):
    pages = spark.range(400).selectExpr("id page_id", "concat('http://h/', id) url", "repeat(cast(id as string), 400) html")
    index, _ = warc.archive_pages(pages, f"file://{scratch}")
    some = index.where("record_id in ('urn:page:7', 'urn:page:333')")
    assert sorted(r.page_id for r in read_back(some, f"file://{scratch}")) == [7, 333]
    assert sorted(r.page_id for r in read_back(index.where("url = 'http://h/12'"), f"file://{scratch}")) == [12]
    # the files hold one gzip member a record, side by side: any reader of archives can take them
    names = glob.glob(os.path.join(scratch, "*.warc.gz"))
    whole = b"".join(gzip.open(n).read() for n in names)
    assert whole.count(b"WARC/1.1\r\n") == 400
    for r in index.where("offset > 0").limit(5).collect():
        with open(os.path.join(scratch, r.file), "rb") as f:
            f.seek(r.offset)
            assert warc.parsed(gzip.decompress(f.read(r.length)))["record_id"] == r.record_id


def test_damage_is_noticed(spark, scratch):
    pages = spark.range(50).selectExpr("id page_id", "'u' url", "repeat('y', 2000 + cast(id as int)) html").coalesce(1)
    index, _ = warc.archive_pages(pages, f"file://{scratch}")
    name = index.first().file
    with open(os.path.join(scratch, name), "r+b") as f:
        f.truncate(100)
    with pytest.raises(Exception, match="shorter|failed|Error"):
        read_back(index, f"file://{scratch}")


def test_empty_table(spark):
    index, folder = warc.archive_pages(spark.createDataFrame([], SCHEMA))
    assert index.count() == 0 and read_back(index, folder) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 20 << 20), st.integers(1, 6 << 20)), max_size=40))
def test_reads_cover_what_is_wanted(ranges):
    ranges = sorted(ranges)
    reads = list(warc.coalesced(iter(ranges)))
    assert [(n, *g) for n, _, _, group in reads for g in group] == ranges
    for _, start, end, group in reads:
        assert start == min(o for o, _ in group) and end == max(o + n for o, n in group)
        assert end - start <= warc.READ_BYTES or len(group) == 1
        ends = [max(o + n for o, n in group[: k + 1]) for k in range(len(group))]
        assert all(o - e <= warc.GAP_BYTES for (o, _), e in zip(group[1:], ends))

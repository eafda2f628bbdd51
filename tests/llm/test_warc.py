"""Archives and their index."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duebook.llm import warc
from duebook.llm.common import new_folder
from duebook.llm.warc import index_archives, loser_tree_merge, read_records, url_key, write_archives
from tests.llm.conftest import frame

COLUMNS = "page_id long, url string, html string"


def pages():
    rng = random.Random(31)
    rows = [(i, f"http://www.Site{i % 7}.example/{rng.randrange(9)}?q=É", f"<p>{rng.randrange(40)}</p>") for i in range(200)]
    return rows + [
        (300, None, "<p>1</p>"), (301, "", None), (302, "http://a b:x/\r\nWARC/1.1", ""), (303, "https://h:443/", "\r\n\r\nWARC/1.1\r\n"),
        (304, "http://one.example/", "\r\n\r\n" * 5), (305, "http://one.example/", "é🙂" * 40_000), (None, "http://one.example/", "<p>1</p>"),
        (None, "http://one.example/", "alone"), (-7, "http://one.example/", "<p>2</p>"), (306, "http://one.example/", "twice"),
        (306, "http://one.example/", "twice")]


def wanted(rows, least=0):
    first = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = first.setdefault(raw, [])
        if i is not None:
            ids.append(i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        smallest = min(first[raw], default=None)
        response = i == smallest or len(raw) < least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if response else "revisit", None if response else smallest))
    return out


@pytest.mark.parametrize("least", [0, 9])
def test_archives_come_back(spark, least):
    rows = pages()
    path = new_folder(spark, "test-warc")
    write_archives(frame(spark, rows, COLUMNS), path, least_bytes=least, archive_bytes=20_000)
    got = index_archives(spark, path).collect()
    known = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(known, key=str) == sorted(wanted(rows, least), key=str)
    order = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in got]
    assert order == sorted(order)  # one order over all partitions
    assert len({(r.archive, r.offset) for r in got}) == len(rows)


def test_records_are_where_the_index_says(spark):
    path = new_folder(spark, "test-warc")
    write_archives(frame(spark, pages(), COLUMNS), path)
    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    for r in index_archives(spark, path).collect():
        record = files[r.archive][r.offset: r.offset + r.length]
        (offset, length, headers, _), = read_records(record)
        assert (offset, length, headers["WARC-Type"]) == (0, r.length, r.record_type)


def test_payloads_that_come_once_stay_where_they_lie(spark):
    """Before, every payload was exchanged, and an archive held pages of all partitions."""
    rows = spark.range(0, 90, numPartitions=3).selectExpr(
        "id AS page_id", "'http://a.example/' AS url", "concat('<p>', id, '</p>') AS html")
    path = new_folder(spark, "test-warc")
    write_archives(rows, path)
    found = {}
    for r in index_archives(spark, path).collect():
        found.setdefault(r.archive, set()).add(r.page_id // 30)
    assert all(len(x) == 1 for x in found.values()) and set.union(*found.values()) == {0, 1, 2}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILTER_BITS", 4)
    rows = pages()
    path = new_folder(spark, "test-warc")
    write_archives(frame(spark, rows, COLUMNS), path)
    known = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
             for r in index_archives(spark, path).collect()]
    assert sorted(known, key=str) == sorted(wanted(rows), key=str)


def test_no_pages(spark):
    path = new_folder(spark, "test-warc")
    write_archives(frame(spark, [], COLUMNS), path)
    assert index_archives(spark, path).count() == 0


def test_damage_is_noticed(spark):
    path = new_folder(spark, "test-warc")
    write_archives(frame(spark, [(1, "http://a.example/", "payload")], COLUMNS), path)
    content = next(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if r.content)
    with pytest.raises(ValueError):
        warc.run_of("x", content.replace(b"payload", b"Payload"))
    with pytest.raises(ValueError):
        list(read_records(content[:-6]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree(runs):
    merged = list(loser_tree_merge([sorted(r) for r in runs], order=lambda e: (e,)))
    assert merged == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("http://www.Example.com:80/A?b=C#d") == "com,example)/a?b=c"
    assert url_key("https://h.example:8080") == "example,h:8080)/"
    assert url_key(None) == ""

"""WARC archives of pages, and an index of them by external merge.

Writing: one record per page; of equal payloads the page with the smallest id is the response and
the others revisit it. Records are text in UTF-8 that ends with two line ends, so Spark's text
writer makes the archives, and its commit makes retried tasks harmless on any file system.

Reading: each archive gives a run of index entries sorted by URL key and time. Runs are cut at
sampled splitters into ranges, and each range merges its piece of every run in a loser tree.
Ranges in order are the histories of all captures in one global order.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.llm.common import Scratch, salted, stored

#: Bytes of payload an archive holds on average; a reader has one archive in memory.
ARCHIVE_BYTES = 16 << 20
#: Binary log of the bits in the filter of payloads that come more than once; 64 of them make a row of it.
FILTER_BITS = 24
#: The capture time of page n, where the pages have none: n seconds after this one.
FIRST_CAPTURE = 1_704_067_200

_END = "\r\n"
_INDEX = ("url_key string, captured string, page_id long, url string, record_type string, "
          "payload_bytes long, payload_digest string, refers_to long, archive string, "
          "offset long, length long")


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex; 40 bits make eight characters."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per page.

    Null html is an empty payload; payloads under `least_bytes` are never revisits. A null url
    makes a record without a target; line ends in a url are percent-encoded. Rows that share the
    smallest id of their payload are all responses; a null id comes after all others. An empty
    table makes an empty folder. Other columns are not read.

    A payload that comes once is written where it lies, so the exchange holds only payloads that
    come again, and the archives hold each of those once. A filter of FILTER_BITS bits tells them apart;
    if it fills up, more is exchanged and nothing else changes. A hot payload is cut into parts by page
    id, each with one row that says which page comes first.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), html.alias("_html"),
        F.sha1(html).alias("_sha"), salted(id_col).alias("_salt"),
    )
    # One row per payload and salt; the smallest of a payload goes back to each of its parts.
    scratch = Scratch(spark)
    parts = scratch.stored(rows.groupBy("_sha", "_salt").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_pages"),
        F.sum(F.octet_length("_html")).alias("_bytes")), "warc_payloads")
    total, count = (int(x or 0) for x in parts.agg(F.sum("_bytes"), F.sum("_pages")).first())
    repeated = parts.groupBy("_sha").agg(
        F.min("_first").alias("_first"), F.collect_list("_salt").alias("_salts"), F.sum("_pages").alias("_pages"),
    ).where("_pages > 1")
    # Repeated payloads by bits of their digests; a row holds 64 bits.
    bit = F.conv(F.substring("_sha", 1, FILTER_BITS // 4), 16, 10).cast("long")
    place, mask = F.shiftright(bit, 6), F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    bits = repeated.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_place")).agg(
        F.bit_or(mask).alias("_bits"))
    seen = rows.withColumn("_bit", bit).withColumn("_place", place).join(F.broadcast(bits), "_place", "left")
    again = F.coalesce(F.col("_bits").bitwiseAND(mask), F.lit(0)) != 0
    columns = ["_id", "_url", "_html", "_sha"]
    alone = seen.where(~again).select(*columns, F.col("_id").alias("_first"))
    firsts = repeated.withColumn("_salt", F.explode("_salts")).select("_sha", "_salt", F.col("_first").alias("_least"))
    archives = max(spark.sparkContext.defaultParallelism, -(-total // archive_bytes))
    # What only the filter took for repeated finds no row here and comes first itself.
    told = seen.where(again).select(*columns, "_salt").repartition(archives, "_sha", "_salt").join(
        firsts, ["_sha", "_salt"], "left")
    told = alone.unionByName(told.select(*columns, F.coalesce("_least", "_id").alias("_first")))

    size = F.octet_length("_html")
    revisit = (size >= least_bytes) & ~F.col("_id").eqNullSafe(F.col("_first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                    size.cast("string"), F.lit(_END * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("_html")))
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce("_id", F.lit(0))),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.replace(F.replace(F.col("_url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("_id"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("_sha")))),
        _line("WARC-Refers-To", F.when(revisit, _name(F.col("_first")))),
        _line("WARC-Profile", F.when(revisit, F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END), block,
    )
    told.select(record.alias("value")).write.option("lineSep", _END * 2).option(
        "maxRecordsPerFile", max(1, archive_bytes * count // max(1, total))).text(path)
    scratch.drop()


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host backwards, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = parts.port
    except ValueError:
        return url.lower()
    place = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        place += f":{port}"
    return (f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")).lower()


def read_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split(_END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = content[end + 4: end + 4 + size]
        if len(block) != size or content[end + 4 + size: end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        length = end + 8 + size - at
        yield at, length, headers, block
        at += length


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _order(entry: dict) -> tuple:
    return (entry["url_key"], entry["captured"], entry["page_id"] is None, entry["page_id"] or 0)


def run_of(archive: str, content: bytes) -> list[dict]:
    """The sorted index entries of one archive; payloads are held against their digests."""
    entries = []
    for offset, length, headers, block in read_records(content):
        http, payload = block.split(b"\r\n\r\n", 1)
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        if headers["WARC-Type"] == "response":
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                raise ValueError(f"the payload at byte {offset} of {archive} isn't what was written")
        url = headers.get("WARC-Target-URI")
        entries.append({
            "url_key": url_key(url), "captured": headers["WARC-Date"],
            "page_id": _page(headers["WARC-Record-ID"]), "url": url, "record_type": headers["WARC-Type"],
            "payload_bytes": size, "payload_digest": digest,
            "refers_to": _page(headers.get("WARC-Refers-To")),
            "archive": archive, "offset": offset, "length": length,
        })
    return sorted(entries, key=_order)


def loser_tree_merge(runs: list[list[dict]], order=_order) -> Iterator[dict]:
    """Merge sorted runs: each inner node keeps the loser of its match, so the next entry costs one
    match per level. Ties go to the earlier run."""
    k = len(runs)
    if not k:
        return
    at = [0] * k

    def key(r: int) -> tuple:
        """Exhausted runs lose against all others; run -1 wins, for building the tree."""
        if r < 0:
            return (0,)
        return (1, order(runs[r][at[r]]), r) if at[r] < len(runs[r]) else (2, r)

    losers = [-1] * k
    keys = [key(r) for r in range(k)]
    for start in reversed(range(k)):
        winner, node = start, (start + k) // 2
        while node:
            other = losers[node]
            if other < 0 or keys[other] < keys[winner]:
                losers[node], winner = winner, other
            if winner < 0:
                break
            node //= 2
        if winner >= 0:
            losers[0] = winner
    while keys[losers[0]][0] == 1:
        r = losers[0]
        yield runs[r][at[r]]
        at[r] += 1
        keys[r] = key(r)
        winner, node = r, (r + k) // 2
        while node:
            if keys[losers[node]] < keys[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner


def _frame(entries: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(entries, columns=[c.split()[0] for c in _INDEX.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives in one order: URL key, time, page id.

    The key has the page id in it, so a URL with any number of captures is cut like any other.
    """
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                yield _frame(run_of(archive, content))

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: dict[str, list[dict]] = {}
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            for entry in batch.to_dict("records"):
                pieces.setdefault(entry["archive"], []).append(entry)
        out = []
        for entry in loser_tree_merge(list(pieces.values())):
            out.append(entry)
            if len(out) == 10_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    # The runs are kept: the sampling of splitters then doesn't read the archives again.
    kept = stored(files.select("path", "content").mapInPandas(runs, _INDEX), "warc_runs")
    order = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_last()]
    ranges = kept.repartitionByRange(*order).sortWithinPartitions("archive", *order)
    return ranges.mapInPandas(merged, _INDEX)

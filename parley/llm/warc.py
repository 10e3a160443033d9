"""WARC archives of page captures, and the globally ordered history of what they hold.

Writing: payloads of ``REVISIT_BYTES`` or more that stand in several captures are stored once, in
the capture of the largest id; the others become revisit records. Records go out through Spark's
text sink, each a header block and a payload, so archives land on whatever store holds the
path, under the usual commit protocol. A file is gzipped as a whole; offsets count in the
uncompressed archive.

Reading: each archive file gives one run of index entries, sorted by URL key and timestamp. Ranges
of that order are cut so that each holds a bounded number of entries, runs are split at the
cuts, and a loser tree merges the parts of all runs within each range.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import join_unique, materialize, partitions_for, small_batches, work_path

REVISIT_BYTES = 1000
#: Payload bytes that one archive file aims at.
FILE_BYTES = 8 << 20
#: Index entries that one merged range aims at.
RANGE_ROWS = 50_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
CRLF = "\r\n"


def url_key(url: Column) -> Column:
    """Host labels from last to first, then the rest: ``com,example)/path``; lower case."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z][a-z0-9+.-]*://(www\\.)?", "")
    host = F.regexp_extract(bare, "(?s)^[^/?#]*", 0)
    rest = F.substr(bare, F.length(host) + 1)
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def header_value(text: Column) -> Column:
    """A value that fits a header line: line breaks and other controls become %20."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x00-\\x20\\x7F]", "%20")


def roles(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``pages`` packed as ``_row``, with id, payload, n_bytes and first: the id that holds the payload, null if it is stored here."""
    rows = pages.select(F.struct("*").alias("_row"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("bigint"))
    # Equal payloads are equal in length and SHA-256; the counts are summed before the shuffle.
    key = F.when(F.col("n_bytes") >= REVISIT_BYTES, F.concat_ws(":", F.sha2("payload", 256), "n_bytes"))
    twice = materialize(rows.select(key.alias("same"), "id").where("same is not null").groupBy("same").agg(F.count("*").alias("n"), F.max("id").alias("holder")).where("n > 1"), "payloads")
    out = join_unique(rows.withColumn("same", key), twice, "same", "n")
    return out.select("_row", "id", "payload", "n_bytes", F.when(F.col("holder").isNotNull() & ~F.col("id").eqNullSafe(F.col("holder")), F.col("holder")).alias("first"))


def records(rows: DataFrame, url_col: str) -> DataFrame:
    """One column, value: each row's record without the two line ends that close it."""
    digest = F.sha1("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    stored = F.col("first").isNull()
    block = F.when(stored, F.concat(http, F.col("payload"))).otherwise(http)
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    when = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce(F.pmod(F.col("id"), F.lit(1 << 31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = {
        "WARC-Type": F.when(stored, "response").otherwise("revisit"),
        "WARC-Record-ID": name(F.col("id")),
        "WARC-Target-URI": header_value(F.col(f"_row.{url_col}")),
        "WARC-Key": header_value(url_key(F.col(f"_row.{url_col}").cast("string"))),
        "WARC-Date": when,
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), digest),
        "Content-Type": F.lit("application/http; msgtype=response"),
        "Content-Length": F.octet_length(block).cast("string"),
    }
    more = F.when(stored, "").otherwise(F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), name(F.col("first")), F.lit(CRLF)))
    head = F.concat(F.lit("WARC/1.1" + CRLF), *[F.concat(F.lit(f"{k}: "), v, F.lit(CRLF)) for k, v in fields.items()], more, F.lit(CRLF))
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row of ``pages`` under ``path``; see :func:`capture_history` for edge cases."""
    total = pages.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    n = partitions_for(pages.sparkSession, total, file_bytes)
    out = records(roles(pages, id_col, text_col), url_col)
    out.repartition(n, F.xxhash64("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes, bytes]]:
    """(header fields, offset, length, HTTP head, payload) of each record of an archive."""
    at = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        lines = raw[at:head].split(b"\r\n")
        if lines[0] != b"WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.decode().split(": ", 1) for line in lines[1:])
        start = head + 4
        end = start + int(fields["Content-Length"])
        http, _, payload = raw[start:end].partition(b"\r\n\r\n")
        yield fields, at, end - at, http, payload
        at = end + 4


ENTRY = [("key", pa.string()), ("date", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
ENTRY_DDL = "key string, date string, id bigint, file string, offset bigint, length bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _named(urn: str) -> int | None:
    x = urn.removeprefix("<urn:capture:").removesuffix(">")
    return None if x == "none" else int(x)


def _order(entry: dict) -> tuple:
    return entry["key"], entry["date"], entry["id"] is not None, entry["id"] or 0, entry["file"], entry["offset"]


def read_runs(path: str, files: DataFrame) -> DataFrame:
    """Index entries of archive files (path, content): one run for each file, sorted; a digest that a payload belies is an error."""

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                own = []
                for fields, at, size, http, payload in parse(gzip.decompress(raw.as_py())):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    told = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != told):
                        raise ValueError(f"payload and digest differ at byte {at} of {name}")
                    own.append({"key": fields["WARC-Key"], "date": fields["WARC-Date"], "id": _named(fields["WARC-Record-ID"]), "file": name, "offset": at, "length": size, "payload_bytes": told, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _named(fields["WARC-Refers-To"]) if revisit else None})
                own.sort(key=_order)
                yield pa.RecordBatch.from_pylist(own, pa.schema(ENTRY))

    return files.mapInArrow(run, ENTRY_DDL)


class LoserTree:
    """Merges sorted iterators: the winner leaves, and its next entry plays against the losers on its way up."""

    def __init__(self, runs: Sequence[Iterator], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.loser = [-1] * self.k
        self.winner = self._build(1)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (self.key(x), a) < (self.key(y), b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.loser[node] = (a, b) if self._before(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator:
        while (entry := self.head[self.winner]) is not None:
            yield entry
            at = self.winner
            self.head[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._before(self.loser[node], at):
                    at, self.loser[node] = self.loser[node], at
                node //= 2
            self.winner = at


def merge_runs(entries: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Entries of sorted runs (one for each ``file``) in global order of key, date and id, with ``place``: (range, number in it)."""
    n = max(1, -(-rows // range_rows))
    dealt = entries.repartitionByRange(n, "key", "date", F.col("id").asc_nulls_first(), "file", "offset")

    def merge(batches):
        runs: dict[str, list[dict]] = {}
        for batch in batches:
            for e in batch.to_pylist():
                runs.setdefault(e["file"], []).append(e)
        for own in runs.values():
            own.sort(key=_order)  # the parts of a run come in order but for where the shuffle interleaved them
        held = []
        for place, e in enumerate(LoserTree([iter(r) for r in runs.values()], _order)):
            held.append(e | {"place": place})
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist(held, pa.schema([*ENTRY, ("place", pa.int64())]))
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, pa.schema([*ENTRY, ("place", pa.int64())]))

    return dealt.mapInArrow(merge, ENTRY_DDL + ", place bigint").withColumn("range", F.spark_partition_id())


def read_archives(spark, path: str) -> DataFrame:
    """The globally ordered capture history of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = materialize(read_runs(path, files), "runs")
    return merge_runs(runs, runs.count())


def capture_history(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return their history: ENTRY_DDL, place, range.

    A null payload is empty. A null URL has an empty one in the record and sorts first. A null id is
    kept as null; it is smaller than all others, and payloads held by null ids alone are all stored.
    Of rows with one id and payload that id's are all stored or all revisits, so repeated rows give
    repeated records. An empty table gives an empty history. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    path = path or work_path(pages.sparkSession, "archives")
    write_archives(pages.select(id_col, url_col, text_col), path, id_col, url_col, text_col)
    return read_archives(pages.sparkSession, path)

"""WARC archives of pages, and one global index merged from the archives' sorted runs."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .words import slices

# Revisits are broadcast (two numbers each) if they were counted and are no more than this.
BROADCAST_ROWS = 200_000
# Keys that are sampled for each range of the merge.
KEYS_PER_RANGE = 16

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_NL = b"\r\n"


@dataclass(frozen=True)
class WarcParams:
    """Records and bytes of an archive, captures of a merge task, and how many ranges there are.

    Only a record that is longer makes an archive longer. The driver parts the keys into at least
    `ranges` and at most `most_ranges`; if these hold more captures than a task should, each is parted
    again by tasks.
    """

    file_records: int = 1000
    file_bytes: int = 32 << 20
    range_captures: int = 50_000
    ranges: int = 32
    most_ranges: int = 1024
    software: str = "sextile"
    epoch: int = 1_704_067_200


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels from the top level down, then path and query in lower case; never fails."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = host.split(".")
    if labels[:1] == ["www"]:
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "")
    return (key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [payload_digest((x.as_py() or "").encode()) for x in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.string())], ["page_id", "digest"])


def record(page_id: int, url: str | None, html: str | None, refers_to: int | None, p: WarcParams) -> str:
    """One WARC/1.1 record. Pages have no capture time, so it is derived from the id."""
    payload = (html or "").encode()
    when = _time(p.epoch + page_id)
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    )
    revisit = refers_to is not None
    body = http if revisit else http + (html or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head += [
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http.encode()) if revisit else len(http) + len(payload)}",
    ]
    return "\r\n".join(head) + "\r\n\r\n" + body + "\r\n\r\n"


def _time(seconds: int) -> str:
    # Whatever the id, the year has four digits.
    when = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds % 200_000_000_000)
    return when.strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(
    pages: DataFrame, path: str, scratch: Scratch, params: WarcParams = WarcParams()
) -> None:
    """Write one record per row of `pages` (page_id, url, html) into archives under `path`.

    Of equal payloads the smallest page_id is the response and all others are revisits of it. Null
    html is an empty payload, a null url `about:blank`; rows without an id are left out, and repeated
    rows are written each. Archives have a bounded number of records and bytes, are plain text and
    hold whole records one after the other.
    """
    pages = pages.select("page_id", "url", "html").where("page_id is not null")
    digests = scratch.table(
        pages.select("page_id", "html").mapInArrow(_digested, "page_id long, digest string"),
        "digests",
    )
    groups = (
        digests.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    revisits = scratch.table(
        digests.join(groups, "digest").where("page_id > refers_to").select("page_id", "refers_to").distinct(),
        "revisits",
    )
    few = revisits.count() <= BROADCAST_ROWS
    known = pages.join(F.broadcast(revisits) if few else revisits, "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Archives of a task are numbered; the writer keeps one open at a time.
        number = count = size = 0
        for batch in slices(batches, "html"):
            texts, numbers = [], []
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to"))):
                # The writer ends every line with \n, so a record's own last one is left to it.
                text = record(*row, params)[:-1]
                # Characters of two and more bytes count as four.
                n = len(text) if text.isascii() else 4 * len(text)
                if count and (count >= params.file_records or size + n > params.file_bytes):
                    number, count, size = number + 1, 0, 0
                count, size = count + 1, size + n
                texts.append(text)
                numbers.append(number)
            yield pa.record_batch([pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["part", "value"])

    written = known.mapInArrow(run, "part int, value string").write.partitionBy("part")
    written.option("lineSep", "\n").text(path)


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and payload of every record of an archive."""
    at = 0
    while at < len(content):
        head_end = content.index(_NL * 2, at)
        lines = content[at:head_end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin = head_end + 4
        end = begin + int(headers["Content-Length"])
        body = content[begin:end]
        payload_at = body.index(_NL * 2)
        headers["http"] = body[:payload_at].decode()
        yield at, end + 4 - at, headers, body[payload_at + 4 :]
        at = end + 4


_CAPTURE = (
    "url_key string, timestamp string, page_id long, archive string, position long, length long,"
    " record_type string, payload_digest string, payload_bytes long, refers_to long"
)
_FIELDS = [(x.split()[0], x.split()[1]) for x in _CAPTURE.split(", ")]
_KEY = ("url_key", "timestamp", "page_id", "archive", "position")
_TYPES = {"string": pa.string(), "long": pa.int64()}
_ENTRY = pa.struct([(name, _TYPES[kind]) for name, kind in _FIELDS])


def _urn(value: str) -> int:
    return int(value.removeprefix("<urn:page:").removesuffix(">"))


def _entry(archive: str, at: int, length: int, headers: dict, payload: bytes) -> dict:
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"{archive} is damaged at byte {at}")
    size = re.search(r"Content-Length: (\d+)", headers["http"])[1]
    return {
        "url_key": url_key(headers["WARC-Target-URI"]),
        "timestamp": re.sub(r"\D", "", headers["WARC-Date"]),
        "page_id": _urn(headers["WARC-Record-ID"]),
        "archive": archive,
        "position": at,
        "length": length,
        "record_type": kind,
        "payload_digest": digest,
        "payload_bytes": len(payload) if kind == "response" else int(size),
        "refers_to": _urn(headers["WARC-Refers-To"]) if kind == "revisit" else None,
    }


def _order(entry: dict) -> tuple:
    """URL key, time and page; the place in the archives tells repeated rows apart."""
    return tuple(entry[name] for name in _KEY)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted index of each archive."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            archive = path.as_py()
            name = "/".join(archive.rsplit("/", 2)[-2:])
            run = sorted((_entry(name, *r) for r in records(content.as_py())), key=_order)
            yield pa.record_batch([pa.array([run], pa.list_(_ENTRY))], ["run"])


class LoserTree:
    """Merges sorted runs; each step replays one path of a tree of losers to its root."""

    def __init__(self, runs: list[list], key):
        self._runs, self._key = runs, key
        self._at = [0] * len(runs)
        self._losers = [-1] * max(1, len(runs))
        for leaf in range(len(runs)):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Run -1 comes before all others, and a run that is used up after them."""
        if a < 0 or b < 0:
            return a < b
        done_a, done_b = (self._at[x] >= len(self._runs[x]) for x in (a, b))
        if done_a or done_b:
            return done_b and not done_a
        return self._key(self._runs[a][self._at[a]]) < self._key(self._runs[b][self._at[b]])

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + len(self._runs)) // 2
        while node > 0:
            if self._less(self._losers[node], winner):
                winner, self._losers[node] = self._losers[node], winner
            node //= 2
        self._losers[0] = winner

    def __iter__(self) -> Iterator:
        if not self._runs:
            return
        while self._at[leaf := self._losers[0]] < len(self._runs[leaf]):
            yield self._runs[leaf][self._at[leaf]]
            self._at[leaf] += 1
            self._replay(leaf)


def _pieces(entries: list[dict], bounds: list[tuple]) -> Iterator[tuple[int, list[dict]]]:
    """A sorted run in pieces, one for every range of keys that it has captures in."""
    keys = [_order(e) for e in entries]
    at = 0
    while at < len(entries):
        place = bisect_right(bounds, keys[at])
        end = bisect_left(keys, bounds[place], at) if place < len(bounds) else len(entries)
        yield place, entries[at:end]
        at = end


def _quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    """Bounds that part sorted keys into ranges of about equal numbers."""
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _cut(bounds: list[tuple] | None):
    """Runs cut at the bounds: those given for all of them, or those in the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("run")
            for i in range(batch.num_rows):
                if bounds is None:
                    inner = [_order(e) for e in batch.column("bounds")[i].as_py() or ()]
                    base = batch.column("range")[i].as_py()
                    cut = [(base, n, piece) for n, piece in _pieces(runs[i].as_py(), inner)]
                else:
                    cut = [(n, 0, piece) for n, piece in _pieces(runs[i].as_py(), bounds)]
                outer, number, pieces = zip(*cut) if cut else ((), (), ())
                yield pa.record_batch(
                    [pa.array(outer, pa.int64()), pa.array(number, pa.int64()), pa.array(pieces, pa.list_(_ENTRY))],
                    ["range", "part", "run"],
                )

    return run


def _sampled(runs: DataFrame, total: int, wanted: int, *more: str) -> DataFrame:
    """About so many keys of all captures, by hash; the place in the archives spreads repeated rows."""
    entries = runs.select(*more, F.explode("run").alias("e")).select(*more, *(f"e.{k}" for k in _KEY))
    every = max(1, total // max(1, wanted))
    return entries.where(F.pmod(F.xxhash64("page_id", "archive", "position"), F.lit(every)) == 0)


def _merged(table: pa.Table) -> pa.Table:
    runs = table.column("run").to_pylist()
    merged = list(LoserTree(runs, _order))
    columns = {
        name: pa.array([e[name] for e in merged], _TYPES[kind]) for name, kind in _FIELDS
    }
    for name in ("range", "part"):
        columns[name] = pa.array([table.column(name)[0].as_py()] * len(merged), pa.int64())
    columns["place"] = pa.array(range(len(merged)), pa.int64())
    return pa.table(columns)


def capture_index(
    spark: SparkSession, path: str, scratch: Scratch, params: WarcParams = WarcParams()
) -> DataFrame:
    """Every record of the archives under `path` in the order of URL key, time and page.

    Columns: `url_key`, `timestamp` (14 digits), `page_id`, `archive`, `position` and `length` in
    bytes, `record_type`, `payload_digest`, `payload_bytes`, `refers_to`, and `range`, `part` and
    `place`: sorted by these three, the captures of each URL follow one another in order of time.

    Each archive gives one sorted run. Keys sampled by hash from all runs part the key space, also
    within one URL: first into ranges, whose number and keys on the driver are bounded, then each of
    these into parts of about `range_captures`, by keys that only its own task sees. Every run is cut at
    these bounds, and the pieces of a part are merged by a tree of losers. A folder without records
    gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    entry = "array<struct<" + ", ".join(f"{n}: {k}" for n, k in _FIELDS) + ">>"
    read = files.select("path", "content").mapInArrow(_runs, f"run {entry}")
    runs = scratch.table(read, "runs")
    total = runs.agg(F.sum(F.size("run"))).first()[0] or 0
    tasks = max(params.ranges, -(-total // params.range_captures))
    outer = min(tasks, max(1, params.most_ranges))
    sample = _sampled(runs, total, KEYS_PER_RANGE * outer).collect()
    bounds = _quantiles(sorted(map(tuple, sample)), outer)
    kind = f"range long, part long, run {entry}"
    pieces = runs.mapInArrow(_cut(bounds), kind)
    inner = -(-tasks // outer)
    if inner > 1:
        pieces = scratch.table(pieces, "pieces")
        keys = _sampled(pieces, total, KEYS_PER_RANGE * outer * inner, "range")
        found = keys.groupBy("range").agg(F.sort_array(F.collect_list(F.struct(*_KEY))).alias("keys"))
        # Every n-th of the sorted keys, so that no range has more than its parts.
        places = F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.lit(inner - 1)),
                lambda i: F.element_at("keys", (F.floor(i * F.size("keys") / inner) + 1).cast("int")),
            )
        )
        inside = found.select("range", places.alias("bounds"))
        pieces = pieces.join(inside, "range", "left").select("range", "run", "bounds")
        pieces = pieces.mapInArrow(_cut(None), kind)
    return pieces.groupBy("range", "part").applyInArrow(
        _merged, _CAPTURE + ", range long, part long, place long"
    )

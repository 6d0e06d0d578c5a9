"""WARC archives with a globally ordered capture index, by external merging.

Each task writes one archive of gzip members and one run: its captures sorted by URL key, time and page.  Runs
are merged by loser trees.  While there are more than ``FAN`` runs, groups of them become longer runs; the last
merge is done in ranges of the key, every range by a task of its own that seeks to its start in each run.
Files go to the shared folder under the name of the attempt, and only the manifest of successful tasks says
which count, so a lost executor leaves no half-written archive behind.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import buckets, new_folder, prepare, stored

LEAST_BYTES = 100
FAN = 64
MARKS = 256
_BLOCK = 1 << 16
#: Captures have no time in the input: page n was captured n seconds after this.
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return quote(url, safe="/?&=:%,.")
    query = f"?{parts.query}" if parts.query else ""
    return quote(",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query, safe="/?&=:%,.()~+*!$;@'")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _name(page) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def response_record(page, url: str, date: str, payload: bytes, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return _record([("WARC-Type", "response"), ("WARC-Record-ID", _name(page)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")], http + payload)


def revisit_record(page, url: str, date: str, digest: str, first) -> bytes:
    return _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _name(page)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(first)), ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def page_of(name: str):
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


class LoserTree:
    """Merges sorted sources: each step replays one path of about log2 k comparisons."""

    def __init__(self, sources):
        self.sources = [iter(s) for s in sources]
        k = max(1, len(self.sources))
        self.k = 1 << (k - 1).bit_length()
        self.heads = [next(s, None) for s in self.sources] + [None] * (self.k - len(self.sources))
        self.losers = [0] * self.k
        self.winner = self._play(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None) if w < len(self.sources) else None
            node = (w + self.k) >> 1
            while node:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node >>= 1
            self.winner = w


def _lines(uri: str, start: int = 0):
    """Lines of a run from an offset, read block by block."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        rest = b""
        while block := f.read(_BLOCK):
            *lines, rest = (rest + block).split(b"\n")
            yield from lines
        if rest:
            yield rest


class _RunWriter:
    """Writes a run, and remembers at most MARKS evenly spaced lines and their offsets."""

    def __init__(self, uri: str):
        self.uri, (system, path) = uri, _open(uri)
        self.out, self.at, self.n, self.step, self.marks = system.open_output_stream(path, compression=None), 0, 0, 1, []

    def write(self, line: bytes):
        if self.n % self.step == 0:
            if len(self.marks) == MARKS:
                self.marks, self.step = self.marks[::2], self.step * 2
            if self.n % self.step == 0:
                self.marks.append((line, self.at))
        self.out.write(line + b"\n")
        self.at += len(line) + 1
        self.n += 1

    def close(self):
        self.out.close()
        return self.uri, self.n, [m[0] for m in self.marks], [m[1] for m in self.marks]


_MANIFEST = "run string, captures long, keys array<binary>, offsets array<long>"
_MANIFEST_SCHEMA = pa.schema([("run", pa.string()), ("captures", pa.int64()), ("keys", pa.list_(pa.binary())), ("offsets", pa.list_(pa.int64()))])


def _manifest(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MANIFEST_SCHEMA, strict=True)], schema=_MANIFEST_SCHEMA)


def _attempt() -> str:
    task = TaskContext.get()
    return f"{task.stageId()}-{task.partitionId():06d}-{task.taskAttemptId()}"


def _write(folder: str):
    """Writes a task's pages (page_id, url, html, digest, first) as an archive, and its run."""

    def run(batches):
        name, entries, out, at = _attempt(), [], None, 0
        for batch in batches:
            for page, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    archive = f"{folder}/{name}.warc.gz"
                    system, path = _open(archive)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    raw = system.open_output_stream(path, compression=None)
                    out = io.BufferedWriter(raw, 1 << 20) if isinstance(raw, io.RawIOBase) else raw
                    head = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(head)
                    at = len(head)
                when = EPOCH + timedelta(seconds=(page or 0) % 2_000_000_000)
                date, target = when.strftime("%Y-%m-%dT%H:%M:%SZ"), quote(url, safe=":/?#[]@!$&'()*+,;=%~")
                member = response_record(page, target, date, html, digest) if first is None else revisit_record(page, target, date, digest, first)
                out.write(member)
                entries.append(b"%s %s %020d %s %d %d" % (url_key(url).encode(), when.strftime("%Y%m%d%H%M%S").encode(), (page if page is not None else -1) + 2**62, archive.rpartition("/")[2].encode(), at, len(member)))
                at += len(member)
        if out is not None:
            out.close()
            entries.sort()
            writer = _RunWriter(f"{folder}/{name}.run")
            for line in entries:
                writer.write(line)
            yield _manifest([writer.close()])

    return run


def _merge_group(folder: str):
    def run(batches):
        for batch in batches:
            for runs in batch.column(0).to_pylist():
                writer = _RunWriter(f"{folder}/{_attempt()}-{hashlib.sha256(runs[0].encode()).hexdigest()[:12]}.run")
                for line in LoserTree([_lines(r) for r in runs]):
                    writer.write(line)
                yield _manifest([writer.close()])

    return run


_ENTRY = "capture long, url_key string, captured string, archive string, offset long, length long"


def _merge_range(runs: list[tuple[str, list[bytes], list[int]]]):
    """The captures of a range [low, high) of the key, in order; capture numbers ascend over all ranges."""

    def source(run, low, high):
        name, keys, offsets = run
        start = max((o for k, o in zip(keys, offsets, strict=True) if k < low), default=0) if low else 0
        for line in _lines(name, start):
            if high is not None and line >= high:
                return
            if not low or line >= low:
                yield line

    def run(batches):
        for batch in batches:
            for number, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, at = [], 0
                for line in LoserTree([source(r, low, high) for r in runs]):
                    key, when, _, archive, offset, length = line.decode().rsplit(" ", 5)
                    rows.append((number << 40 | at, key, when, archive, int(offset), int(length)))
                    at += 1
                    if len(rows) == 10_000:
                        yield entries(rows)
                        rows = []
                if rows:
                    yield entries(rows)

    def entries(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _ENTRY.split(", ")])

    return run


def merged_index(spark, manifest: DataFrame, folder: str) -> DataFrame:
    """All captures in global order (``capture`` ascends), from the runs of a manifest."""
    parts = buckets(spark, 1)
    names = [r[0] for r in manifest.select("run").collect()]  # one a task
    while len(names) > FAN:
        groups = [(sorted(names)[i : i + FAN],) for i in range(0, len(names), FAN)]
        manifest = stored(spark.createDataFrame(groups, "runs array<string>").repartition(len(groups)).mapInArrow(_merge_group(folder), _MANIFEST), "runs")
        names = [r[0] for r in manifest.select("run").collect()]
    runs = [(r.run, [bytes(k) for k in r["keys"]], list(r.offsets)) for r in manifest.collect()]  # FAN runs, MARKS keys each
    marks = sorted(k for _, keys, _ in runs for k in keys)
    cuts = sorted({marks[i * len(marks) // parts] for i in range(1, parts)}) if marks else []
    ranges = list(zip(range(len(cuts) + 1), [None, *cuts], [*cuts, None], strict=True)) if runs else []
    return spark.createDataFrame(ranges, "number long, low binary, high binary").repartition(max(1, len(ranges)), "number").mapInArrow(_merge_range(runs), _ENTRY)


_READ = "capture long, url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _read(folder: str):
    """Reads records at their offsets; a revisit has no payload of its own."""

    def run(batches):
        name, f = None, None
        for batch in batches:
            rows = []
            for capture, key, when, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    system, path = _open(f"{folder}/{archive}")
                    name, f = archive, system.open_input_file(path)
                f.seek(offset)
                headers, block = parse_record(f.read(length))
                page, kind = page_of(headers["WARC-Record-ID"]), headers["WARC-Type"]
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest = hashlib.sha256(payload).hexdigest()
                    if headers["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"{archive} at {offset}: the payload's digest is wrong")
                    rows.append((capture, key, when, page, kind, None, len(payload), digest))
                else:
                    rows.append((capture, key, when, page, kind, page_of(headers["WARC-Refers-To"]), None, headers["WARC-Payload-Digest"].removeprefix("sha256:")))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])
        if f is not None:
            f.close()

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as archives under ``folder`` and returns the manifest of their runs.

    Of pages with equal payloads of at least 100 bytes the one of the least id is a response and the others
    revisit it.  Null texts and addresses are empty.  A null id is written as none and never comes first
    unless all are null; repeated rows of the first page are responses, too.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"))
    digests = stored(rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("n")), "payloads")
    large = digests.where(F.col("n") >= LEAST_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND first IS NOT NULL")
    again = large.join(first, "digest").where("NOT page_id <=> first").select("page_id", "digest", "first").distinct()
    told = rows.withColumn("digest", F.sha2("html", 256)).alias("r").join(again.alias("a"), F.expr("r.page_id <=> a.page_id AND r.digest = a.digest"), "left").select("r.page_id", "url", "html", "r.digest", "first")
    return stored(told.mapInArrow(_write(folder), _MANIFEST), "runs")


def read_archives(spark, manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each capture, through the merged index, with the full payload's size and digest."""
    index = merged_index(spark, manifest, folder)
    records = stored(index.repartition(buckets(spark, 1), "archive").sortWithinPartitions("archive", "offset").mapInArrow(_read(folder), _READ), "records")
    sizes = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    return (
        records.join(sizes, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes"))
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture")
    )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = new_folder(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html AND p.n >= 100
"""

"""WARC archives with revisit records, and a globally ordered capture index merged from sorted runs."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice, takewhile
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import open_fs, stored
from lectern.operators.storage import numbered

#: Runs that one merge reads; keys that a run names to divide the key space; entries per Arrow batch.
FAN, NAMED, ENTRIES = 64, 16, 2000
#: Bytes of a run that are read at once.
BLOCK = 1 << 16
#: Capture time of page 0; a page's own is page_id seconds later, within EPOCH_SECONDS.
EPOCH, EPOCH_SECONDS = datetime(2020, 1, 1, tzinfo=UTC), 250 * 10**9
_INDEX = "key string, ts string, page bigint, file string, at bigint, size bigint"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last on, then path and query, without scheme and fragment."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url, safe="/?&=,:;()")
    if not host:
        return quote(url, safe="/?&=,:;()")
    head = ",".join(reversed(host.lower().removeprefix("www.").split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return quote(f"{head}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""), safe="/?&=,:;()")


def capture_time(page: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page or 0) % EPOCH_SECONDS)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> bytes:
    """One gzip member: a response, or a revisit of page first without payload."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Target-URI: {quote(url or '', safe='/?&=,:;()#%@!$*+~')}", f"WARC-Date: {capture_time(page):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    block = b""
    if first is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        head += [f"WARC-Refers-To: {name(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record, and its payload (empty for a revisit)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else b""


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, the root the winner."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs, self.size = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.size
        for i in range(self.size):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        node = (i + self.size) // 2
        while node:
            held = self.tree[node]
            if held < 0:
                self.tree[node] = i
                return
            if self._beats(held, i):
                self.tree[node], i = i, held
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.tree[0]]) is not None:
            yield head
            i = self.tree[0]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def _write_run(system, path: str, entries: Iterable[tuple]) -> int:
    """Write entries, ENTRIES at a time, and tell how many there were."""
    n, source = 0, iter(entries)
    with system.open_output_stream(path) as f:
        while some := list(islice(source, ENTRIES)):
            f.write("".join("\t".join(map(str, e)) + "\n" for e in some).encode())
            n += len(some)
    return n


def _entry(line: bytes) -> tuple:
    key, ts, page, file, at, size = line.decode().split("\t")
    return key, ts, int(page), file, int(at), int(size)


def _seek(file, low: tuple) -> int:
    """A place in a sorted run from which less than BLOCK bytes lie before the first entry from low on."""
    begin, end = 0, file.size()
    while end - begin > BLOCK:
        middle = (begin + end) // 2
        file.seek(middle)
        some = file.read(BLOCK)
        line = some.find(b"\n") + 1
        stop = some.find(b"\n", line)
        if not line or stop < 0 or _entry(some[line:stop])[:3] >= low:
            end = middle
        else:
            begin = middle + line
    return begin


def _read_run(system, path: str, low: tuple | None = None) -> Iterator[tuple]:
    """Entries of a sorted run, from key low on."""
    with system.open_input_file(path) as f:
        f.seek(_seek(f, low) if low else 0)
        rest = b""
        while block := f.read(BLOCK):
            *lines, rest = (rest + block).split(b"\n")
            for e in map(_entry, lines):
                if low is None or e[:3] >= low:
                    yield e


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes an archive and, cut at no key yet, its sorted run; names NAMED of the run's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, path = open_fs(folder)
        out, entries, at = None, [], 0
        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first_id")), strict=True):
                page, url, payload, first = page.as_py(), url.as_py(), (html.as_py() or "").encode(), first.as_py()
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                member = record(page, url, payload, first, digest32(payload))
                out.write(member)
                entries.append((url_key(url), f"{capture_time(page):%Y%m%d%H%M%S}", -1 if page is None else page, f"{name}.warc.gz", at, len(member)))
                at += len(member)
        if out is None:
            return
        out.close()
        entries.sort()
        _write_run(system, f"{path}/{name}.run", entries)
        named = [entries[i * len(entries) // NAMED][:3] for i in range(min(NAMED, len(entries)))]
        yield pa.record_batch([pa.array([f"{name}.run"] * len(named)), *(pa.array(c) for c in zip(*named, strict=True))], ["run", "key", "ts", "page"])

    return run


def _merger(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merges the entries of some runs between two keys into one sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        for job in (x for b in batches for x in b.to_pylist()):
            low, high = (tuple(v.values()) if v else None for v in (job["low"], job["high"]))

            def within(name: str, low=low, high=high) -> Iterator[tuple]:
                return takewhile(lambda e: high is None or e[:3] < high, _read_run(system, f"{path}/{name}", low))

            system.create_dir(path, recursive=True)
            name = f"merged-{job['level']}-{job['group']:06d}-{job['part']:06d}-{TaskContext.get().taskAttemptId()}.run"
            n = _write_run(system, f"{path}/{name}", LoserTree([within(x) for x in job["runs"]]))
            yield pa.record_batch([pa.array([job["group"]]), pa.array([job["part"]]), pa.array([name]), pa.array([n])], ["group", "part", "run", "n"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write a record per row of pages (page_id, url, html) in archives under folder, and a sorted run by archive.

    Of rows whose payloads (html in UTF-8; null: empty) are equal and least bytes or longer, those with the
    smallest page_id are responses, the others revisit it. Runs are merged FAN at a time by loser trees, each
    merge over one part of the key space, until one run is left for each part; the table index names these with
    the number of entries before them. Runs, keys that divide the key space and merges are tables throughout.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", body.alias("html"), F.sha2(body, 256).alias("sha"))
    first = stored(rows.groupBy("sha").agg(F.min("page_id").alias("first")), "first-captures")  # so that the join splits a payload with many rows
    revisit = ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= least)
    marked = rows.join(first, "sha").select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("first_id"))
    named = stored(marked.mapInArrow(_writer(folder), "run string, key string, ts string, page bigint"), "named-keys")
    keys = numbered(named.select("key", "ts", "page").distinct(), ["key", "ts", "page"], "rank")
    archives = numbered(named.select("run").distinct(), ["run"], "at")
    n_keys, total = keys.count(), archives.count()
    edge = keys.select("rank", F.struct("key", "ts", "page").alias("edge"))
    # Runs of a level: grp (their place among those of their part), part (of the key space) and the file.
    made = archives.select((F.col("at") - 1).cast("bigint").alias("grp"), F.lit(0).cast("bigint").alias("part"), "run", F.lit(0).cast("bigint").alias("n"))
    n_runs, parts, level = total, 1, 0
    while n_runs > 1 or not level:
        n_runs = max(1, -(-n_runs // FAN))
        # As many merges on each level as archives at most: fewer runs, more parts of the key space.
        split = max(1, min((FAN if level else 1) if n_runs > 1 else -(-total // parts), n_keys // parts))
        parts *= split
        cuts = spark.range(parts).select(F.col("id").alias("part"), F.expr(f"id * {n_keys} div {parts} + 1").alias("from"), F.expr(f"(id + 1) * {n_keys} div {parts} + 1").alias("to"))
        cuts = cuts.join(edge.toDF("from", "low"), "from", "left").join(edge.toDF("to", "high"), "to", "left")
        cuts = cuts.select("part", F.when(F.col("part") > 0, F.col("low")).alias("low"), F.when(F.col("part") < parts - 1, F.col("high")).alias("high"))
        own = made.groupBy(F.floor(F.col("grp") / FAN).cast("bigint").alias("group"), "part").agg(F.sort_array(F.collect_list("run")).alias("runs"))
        work = own.select("group", "runs", F.explode(F.sequence(F.col("part") * split, F.col("part") * split + split - 1)).alias("part")).join(cuts, "part")
        jobs = work.select(F.lit(level).alias("level"), "group", "part", "runs", "low", "high").repartition(max(1, n_runs * parts), "group", "part")
        done = stored(jobs.mapInArrow(_merger(folder), "group bigint, part bigint, run string, n bigint"), "merged-runs")
        made, level = done.withColumnRenamed("group", "grp"), level + 1
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    made.select("part", "run", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base")).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Merged index entries with their global rank: key, ts, page, file, at, size, rank."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = open_fs(folder)
        for job in (x for b in batches for x in b.to_pylist()):
            held, rank = [], job["base"]
            for e in _read_run(source, f"{root}/{job['run']}"):
                held.append((*e, rank))
                rank += 1
                if len(held) == ENTRIES:
                    yield pa.record_batch([pa.array(c) for c in zip(*held, strict=True)], ["key", "ts", "page", "file", "at", "size", "rank"])
                    held = []
            if held:
                yield pa.record_batch([pa.array(c) for c in zip(*held, strict=True)], ["key", "ts", "page", "file", "at", "size", "rank"])

    segments = spark.read.parquet(f"{folder}/index").select("run", "base")
    return segments.repartition(max(1, segments.count())).mapInArrow(run, f"{_INDEX}, rank bigint")


def _record_reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        name, archive = None, None
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                if e["file"] != name:
                    name, archive = e["file"], system.open_input_file(f"{path}/{e['file']}")
                archive.seek(e["at"])
                fields, payload = parse(archive.read(e["size"]))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and (digest32(payload) != digest or len(payload) != int(fields["WARC-Payload-Length"])):
                    raise ValueError(f"{name} is damaged at {e['at']}")
                number = lambda x: int(v) if x and (v := x.removeprefix("<urn:page:").rstrip(">")) else None
                rows.append((number(fields["WARC-Record-ID"]), int(fields["WARC-Payload-Length"]), digest, kind, number(fields.get("WARC-Refers-To")), e["key"], e["ts"], e["rank"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_rank"])

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record, found through the merged index and verified against its digest.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, capture_rank
    (place in the global order of key, time and page). A null page_id sorts first; repeated rows stay; an
    empty table gives no rows.
    """
    entries = read_index(spark, folder).select("file", "at", "size", "key", "ts", "rank")
    near = entries.repartition("file").sortWithinPartitions("file", "at")
    return near.mapInArrow(_record_reader(folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, captured string, capture_rank bigint")

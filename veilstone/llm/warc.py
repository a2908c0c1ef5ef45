"""WARC archives of pages, with a capture index merged externally from sorted runs.

Write: every task writes the pages it holds as one ``.warc.gz`` (a gzip member per record) and a run: its
captures sorted by URL key (host reversed, then path) and timestamp. Runs lie in the shared folder in
blocks, with the first key and the place of every block in the manifest.
Merge: key ranges are cut at block keys. A task per range opens every run at the block where the range
may start and merges the runs with a loser tree, a block of each in memory, into one globally ordered
capture history. More than ``FAN_IN`` runs are first merged into fewer.
Read: the history is read in order of archive and offset; records are parsed again, digests and sizes
come from what was read.

Equal payloads of ``LEAST_BYTES`` or more become one response (that of the largest page_id) and revisits
of it. The digest table is an aggregate with a row per payload, joined by digest; where one payload has a
large share of the pages, Spark splits the join. A null html is an empty payload, a null url has the key
"". Rows with a null page_id are responses. Rows that share the largest page_id are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, files, new_path, save

LEAST_BYTES, FAN_IN, BLOCK_ROWS, SPLIT_ROWS = 1000, 256, 512, 20_000
MOST_PARTS, KEY_SAMPLE = 10_000, 100_000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
RUN = "run string, n long, keys array<string>, places array<long>"
CAPTURE = "urlkey string, ts string, page_id long, warc string, offset long, size long"
HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)")


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then ")" and path with query; lower case; no scheme, user or
    "www."."""
    m = HOST.match(url or "")
    if not m:
        return (url or "").lower()
    host = m[1].rsplit("@", 1)[-1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/").lower()


def stamp(page_id: int | None) -> str:
    """Capture time of a page: pages carry none, so a second per id from a fixed day."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(kind: str, url: str | None, page_id: int | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block, and keeps the payload's digest and length in its header."""
    body = b"" if kind == "revisit" else payload
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Target-URI": re.sub(r"[\r\n]", " ", url or ""),
        "WARC-Date": stamp(page_id),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": str(len(payload)),
        "X-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "text/html",
        "Content-Length": str(len(body)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def resolved(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to (null: a response)."""
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    long_ = made.filter(F.octet_length("payload") >= least)
    keepers = long_.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null").drop("n")
    refers = F.when((F.octet_length("payload") >= least) & (F.col("page_id") < F.col("keeper")), F.col("keeper"))
    return made.join(keepers, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


class RunWriter:
    """Writes sorted captures in blocks of JSON lines, each block compressed for itself."""

    def __init__(self, folder: str):
        self.store, root = files(folder)
        self.store.create_dir(root, recursive=True)
        self.name = f"run-{uuid.uuid4().hex}"
        self.uri, self.out = f"{folder}/{self.name}", self.store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.rows, self.keys, self.places, self.n, self.at = [], [], [0], 0, 0

    def add(self, row: list) -> None:
        self.rows.append(row)
        if len(self.rows) == BLOCK_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.rows:
            data = zlib.compress("\n".join(map(json.dumps, self.rows)).encode(), 1)
            self.out.write(data)
            self.keys.append(sort_key(self.rows[0]))
            self.at += len(data)
            self.places.append(self.at)
            self.n += len(self.rows)
            self.rows = []

    def close(self) -> dict:
        self._flush()
        self.out.close()
        return {"run": self.uri, "n": self.n, "keys": self.keys, "places": self.places}


def read_run(uri: str, blocks: list[dict], lo: str | None = None, hi: str | None = None) -> Iterator[list]:
    """Captures of a run's blocks with lo <= sort key < hi, a block at a time."""
    store, path = files(uri)
    with store.open_input_file(path) as source:
        for b in blocks:
            for line in zlib.decompress(source.read_at(b["end"] - b["at"], b["at"])).decode().split("\n"):
                row = json.loads(line)
                key = sort_key(row)
                if (lo is None or key >= lo) and (hi is None or key < hi):
                    yield row


def sort_key(row: list) -> str:
    """URL key, timestamp and page as one string; its order is the order of captures."""
    return f"{row[0]}\0{row[1]}\0{'' if row[2] is None else format(row[2], '020d')}"


def merged(runs: list[Iterator[list]]) -> Iterator[list]:
    """k-way merge by a loser tree: leaves are the runs' next captures, inner nodes hold the loser of
    their match, so a new capture plays log2(k) matches on its way up."""
    k = len(runs)
    heads: list = [None] * k

    def pull(i: int) -> None:
        row = next(runs[i], None)
        heads[i] = None if row is None else (sort_key(row), row)

    def beats(i: int, j: int) -> bool:
        if heads[i] is None or heads[j] is None:
            return heads[j] is None and (heads[i] is not None or i < j)
        return (heads[i][0], i) < (heads[j][0], j)

    for i in range(k):
        pull(i)
    losers = [-1] * max(1, k)

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        losers[node] = lose
        return win

    winner = build(1) if k > 1 else 0
    while k and heads[winner] is not None:
        yield heads[winner][1]
        pull(winner)
        node = (winner + k) // 2
        while node >= 1 and k > 1:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write archives and sorted runs; the manifest (a row per run) is returned."""
    folder = folder or new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files(folder)
        name, out, at, rows = f"{uuid.uuid4().hex}.warc.gz", None, 0, []

        def run() -> pa.RecordBatch:
            writer = RunWriter(folder)
            for row in sorted(rows, key=sort_key):
                writer.add(row)
            rows.clear()
            made = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([made["run"]]), pa.array([made["n"]], pa.int64()), pa.array([made["keys"]], pa.list_(pa.string())), pa.array([made["places"]], pa.list_(pa.int64()))], names=["run", "n", "keys", "places"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for r in batch.slice(i, 256).to_pylist():
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    data = gzip.compress(record(kind, r["url"], r["page_id"], r["digest"], r["payload"], r["refers_to"]), 4, mtime=0)
                    out.write(data)
                    rows.append([url_key(r["url"]), stamp(r["page_id"]), r["page_id"], f"{folder}/{name}", at, len(data)])
                    at += len(data)
            if len(rows) >= 200_000:
                yield run()
        if out is not None:
            out.close()
        if rows:
            yield run()

    return save(resolved(pages, least).mapInArrow(write, RUN), "warc-runs")


def range_bounds(manifest: DataFrame, parts: int) -> list[str]:
    """At most ``parts`` - 1 sort keys that cut the captures about evenly, from at most KEY_SAMPLE block
    keys (a block key stands for BLOCK_ROWS captures; the sample moves the cuts, never a result)."""
    keys = manifest.select(F.explode("keys").alias("key"))
    held = sorted(r[0] for r in keys.orderBy(F.xxhash64("key"), "key").limit(KEY_SAMPLE).collect())
    return sorted({held[len(held) * i // parts] for i in range(1, parts)}) if held else []


def capture_history(manifest: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """All captures in global order of URL key and timestamp: CAPTURE columns and ``part`` (ascending
    ranges; order inside a part is the order of its rows)."""
    spark = manifest.sparkSession
    while (runs := manifest.count()) > FAN_IN:
        manifest = _fewer_runs(manifest, runs)
    total = manifest.agg(F.sum("n")).first()[0] or 0
    bounds = range_bounds(manifest, blocks_for(total, split_rows, MOST_PARTS))
    shared = spark.sparkContext.broadcast(bounds)  # MOST_PARTS keys at most

    def parts_of(key: pd.Series, end: pd.Series) -> pd.Series:
        cut = shared.value
        return pd.Series([list(range(bisect_right(cut, k), (len(cut) if e is None else bisect_right(cut, e)) + 1)) for k, e in zip(key, end)])

    block = F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.slice("places", F.lit(1), F.size("keys")).alias("at"), F.slice("places", F.lit(2), F.size("keys")).alias("end"), F.slice(F.concat("keys", F.array(F.lit(None).cast("string"))), F.lit(2), F.size("keys")).alias("next")))
    blocks = manifest.select("run", block.alias("i", "b")).select("run", "i", "b.*")
    dealt = blocks.withColumn("part", F.explode(F.pandas_udf(parts_of, "array<int>")("key", "next")))
    dealt = dealt.groupBy("part", "run").agg(F.array_sort(F.collect_list(F.struct("i", "at", "end"))).alias("blocks"))
    # a part's block list: its captures / BLOCK_ROWS and two for each of FAN_IN runs, about
    dealt = dealt.groupBy("part").agg(F.collect_list(F.struct("run", "blocks")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = [None, *shared.value, None]
        for batch in batches:
            for r in batch.to_pylist():
                lo, hi = cut[r["part"]], cut[r["part"] + 1]
                held: list[list] = []
                for row in merged([read_run(x["run"], x["blocks"], lo, hi) for x in sorted(r["runs"], key=lambda x: x["run"])]):
                    held.append([r["part"], *row])
                    if len(held) == 4096:
                        yield _captures(held)
                        held = []
                if held:
                    yield _captures(held)

    return dealt.repartition(len(bounds) + 1, "part").mapInArrow(merge, "part int, " + CAPTURE)


def _captures(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["part", "urlkey", "ts", "page_id", "warc", "offset", "size"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _fewer_runs(manifest: DataFrame, runs: int) -> DataFrame:
    """Merge groups of at most FAN_IN runs into one run each. Hashing deals the runs to groups of half that
    number on average; a group that got more is cut."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                writer = RunWriter(r["members"][0]["run"].rsplit("/", 1)[0])
                for row in merged([read_run(x["run"], [{"at": a, "end": e} for a, e in zip(x["places"], x["places"][1:])]) for x in r["members"]]):
                    writer.add(row)
                made = writer.close()
                yield pa.RecordBatch.from_arrays([pa.array([made["run"]]), pa.array([made["n"]], pa.int64()), pa.array([made["keys"]], pa.list_(pa.string())), pa.array([made["places"]], pa.list_(pa.int64()))], names=["run", "n", "keys", "places"])

    groups = -(-runs // max(2, FAN_IN // 2))
    grouped = manifest.groupBy(F.pmod(F.xxhash64("run"), F.lit(groups)).alias("g")).agg(F.sort_array(F.collect_list(F.struct("run", "places"))).alias("members"))
    cut = F.transform(F.sequence(F.lit(1), F.size("members"), F.lit(FAN_IN)), lambda i: F.slice("members", i, FAN_IN))
    dealt = grouped.select("g", F.posexplode(cut).alias("i", "members"))
    return save(dealt.repartition(groups, "g", "i").mapInArrow(join, RUN), "warc-runs")


def read_archives(history: DataFrame, archives: int) -> DataFrame:
    """Records of a capture history, parsed again: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and whether the block read agrees with its header (``sound``). ``archives`` tasks, each
    with whole archives, read forward."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, of = None, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for r in batch.to_pylist():
                if of != r["warc"]:
                    store, path = files(r["warc"])
                    source, of = store.open_input_file(path), r["warc"]
                fields, body = parse(gzip.decompress(source.read_at(r["size"], r["offset"])))
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size, kind = int(fields["X-Payload-Length"]), fields["WARC-Type"]
                sound = kind == "revisit" or (len(body) == size and hashlib.sha1(body).hexdigest() == digest)
                if kind == "response":
                    size, digest = len(body), hashlib.sha1(body).hexdigest()
                page, refers = fields["X-Page-ID"].strip(), fields.get("X-Refers-To-Page")
                for column, value in zip(out, (int(page) if page else None, size, digest, kind, int(refers) if refers else None, sound)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"])

    ordered = history.select("warc", "offset", "size").repartition(max(1, archives), "warc").sortWithinPartitions("warc", "offset")
    return ordered.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean")

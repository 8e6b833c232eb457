"""WARC archives, written and read back by boundary-chain verification (operator 13).

Writing: of records with equal payloads, that with the largest id is a response
with its payload, the others revisit it. Tasks write files of bounded size under
names of their own attempt, and a table lists the files of tasks that ended well.

Reading: files are cut into blocks for the tasks, which can't know where records
begin: a payload may hold what looks like a record's head. So a task takes every
place in its block where a head can be read as a candidate, with the offset that
its length names for its successor, and follows these inside the block. From each
candidate this leaves one offset: where its chain leaves the block. Then pointer
jumping over blocks, from each file's start, finds the offsets that are reached;
what lies in a payload is reached by none. Each chain has to end at its file's
end, or reading raises. Last, each block's records are read from the offset at
which the chain enters it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import arrays
from siltstone.llm.columns import map_arrow, quoted
from siltstone.llm.scratch import Scratch

SLICE_BYTES = 2 << 20
FILE_BYTES = 64 << 20
BLOCK_BYTES = 16 << 20
#: Shorter payloads are always written.
LEAST_REVISIT = 1000
#: So many groups of equal payloads are broadcast at most, at about 150 bytes each.
BROADCAST_GROUPS = 200_000
#: A head is looked for in so many bytes after a block's end, and twice as many if it isn't whole there.
HEAD_BYTES = 64 << 10

# Fixed values of the format.
VERSION = b"WARC/1.1"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n:]+:[^\r\n]*\r\n)+)\r\n")
FIELD = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")
LENGTH = re.compile(rb"(?:^|\n)Content-Length:[ \t]*([0-9]{1,15})[ \t]*\r\n", re.IGNORECASE)
END = b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILES = "name string, bytes bigint, records bigint"


def _record(key: str, date: str, url: str | None, payload: bytes, digest: str, record_id: str, refers: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        *([("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace"))] if url else []),
        *([("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", SAME_PAYLOAD)] if refers else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Row-Key", key),
        ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + END


def _key(value: str | None) -> str:
    """An id as part of a URN: null is ``-``, others follow ``=``."""
    return "-" if value is None else "=" + quote(value, safe="")


def _value(key: str) -> str | None:
    return None if key == "-" else unquote(key[1:])


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """Of payloads that occur more than once: their number, the row that stays, and whether its id is there twice.

    Counted by payload and id first, so a payload of very many rows is many keys.
    """
    kinds = rows.where(F.col("size") >= least).groupBy("same", "id", "id_text").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("first"))
    groups = kinds.groupBy(F.col("same").alias("group")).agg(F.sum("c").alias("n"), F.max(F.struct("id", "c", "first", "id_text")).alias("top"))
    return groups.where("n > 1").select("group", "n", F.col("top.id_text").alias("keep_id"), F.col("top.first").alias("keep_place"), (F.col("top.c") > 1).alias("twice"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None, least_revisit: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Write a record for every row under ``path``, a URI that driver and executors share.

    Of rows with equal payloads of ``least_revisit`` bytes or more that with the
    largest id is a response, and the others revisit it; null ids are the smallest,
    and of rows that share the largest id one stays. Shorter payloads are responses
    each. A null or empty payload is an empty one; a null or empty URL is left out,
    other URLs are written percent-encoded where the format needs it. A payload of
    any length is one record. ``date`` is every record's date, by default now. Rows
    equal in all columns are records of their own; an empty table gives no file;
    other columns are not read, whatever their names. Returns the table of files
    (``name, bytes, records``), which is also written under ``path/files``.

    Payloads move through a shuffle only if more than ``broadcast_groups`` groups
    of equal ones were found. Then groups of more than a ten-thousandth of all
    rows, of which there are at most ten thousand, are broadcast, and the others
    joined by their hash, so that no group is a large part of a task.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    when = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(quoted(payload_col)).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(id_col)).cast("string").alias("id_text"), F.col(quoted(url_col)).cast("string").alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumns({"same": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    groups = scratch.keep(_groups(rows, least_revisit), "groups")
    if groups.where("twice").limit(1).count():
        # Only a row's place tells which one stays: it has to be the same in both passes.
        rows = scratch.keep(rows, "rows")
        groups = scratch.keep(_groups(rows, least_revisit), "placed-groups")
    joined = _with_groups(rows, groups, broadcast_groups)
    stays = F.col("id_text").eqNullSafe(F.col("keep_id")) & (~F.col("twice") | (F.col("place") == F.col("keep_place")))
    grouped = F.col("group").isNotNull()
    ready = joined.select("id_text", "url", "place", F.sha1("payload").alias("digest"), (grouped & stays).alias("stays"), (grouped & ~stays).alias("revisits"), "keep_id", "payload")
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        part, done, out, name, size, records = TaskContext.get().partitionId(), [], None, "", 0, 0
        try:
            for batch in arrays.slices(batches, "payload", SLICE_BYTES):
                for r in batch.to_pylist():
                    if out is None:
                        name, size, records = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc", 0, 0
                        out = fs.open_output_stream(f"{root}/{name}")
                    key, digest = _key(r["id_text"]), r["digest"]
                    # A group's response is named by id and payload; any other record by its row's place too.
                    own = f"urn:x-row:{run_id}:{key}:{digest}" + ("" if r["stays"] else f":{r['place']}")
                    refers = f"urn:x-row:{run_id}:{_key(r['keep_id'])}:{digest}" if r["revisits"] else None
                    raw = _record(key, when, r["url"], r["payload"], digest, own, refers)
                    out.write(raw)
                    size, records = size + len(raw), records + 1
                    if size >= file_bytes:
                        out.close()
                        done, out = [*done, (name, size, records)], None
        finally:
            if out is not None:
                out.close()
                done.append((name, size, records))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True) if done else [(), (), ()], (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "bytes", "records"])

    map_arrow(ready, run, _FILES).write.mode("overwrite").parquet(f"{path}/files")
    return spark.read.schema(_FILES).parquet(f"{path}/files")


def _with_groups(rows: DataFrame, groups: DataFrame, broadcast_groups: int) -> DataFrame:
    """Rows with the group of their payload, if it has one."""
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_groups:
        return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in groups.schema})
    if n_groups <= broadcast_groups:
        return rows.join(F.broadcast(groups), F.col("same") == F.col("group"), "left")
    large = F.col("n") > n_rows // 10_000  # there are at most ten thousand of these
    hot = groups.where(large)
    known = rows.join(F.broadcast(hot), F.col("same") == F.col("group"), "left")
    rest = known.where("group IS NULL").drop(*groups.columns).join(groups.where(~large), F.col("same") == F.col("group"), "left")
    return known.where("group IS NOT NULL").unionByName(rest)


def _candidates(raw: bytes, start: int, stop: int, at_end: bool) -> tuple[list[int], list[int], bool]:
    """Heads that begin before ``stop``, with their successors; whether one may go on beyond ``raw``."""
    offsets, following, cut = [], [], False
    for m in MAGIC.finditer(raw, 0, min(len(raw), stop - start + len(VERSION) + 2)):
        if m.start() >= stop - start:
            break
        head = HEAD.match(raw, m.start())
        if head is None:
            cut = cut or (not at_end and raw.find(END, m.start()) < 0)
            continue
        length = LENGTH.search(head[1])
        if length:
            offsets.append(start + m.start())
            following.append(start + head.end() + int(length[1]) + len(END))
    return offsets, following, cut


def _left_at(offsets: np.ndarray, following: np.ndarray, stop: int) -> np.ndarray:
    """Where the chain from each candidate leaves the block, by pointer jumping inside it."""
    at = np.searchsorted(offsets, following)
    known = np.append(offsets, -1)[at] == following
    jump = np.where(known & (following < stop), np.minimum(at, len(offsets) - 1), np.arange(len(offsets)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return following[jump]
        jump = further


def _blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long"))
    return files.where("bytes > 0").select("name", "bytes", F.explode(starts).alias("start"))


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """Rows over ``n`` tasks; each of them stands for a block."""
    return rows.repartition(n, F.xxhash64("name", "start"))


def chain_candidates(files: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, tasks: int | None = None) -> DataFrame:
    """All candidates of all blocks: ``name, start, at, successor, leaves``."""
    n = tasks or _tasks(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for r in (r for batch in batches for r in batch.to_pylist()):
            stop, ahead, cut = min(r["start"] + block_bytes, r["bytes"]), HEAD_BYTES, True
            with fs.open_input_file(f"{root}/{r['name']}") as f:
                while cut:
                    end = min(stop + ahead, r["bytes"])
                    raw = f.read_at(end - r["start"], r["start"])
                    offsets, following, cut = _candidates(raw, r["start"], stop, end == r["bytes"])
                    ahead *= 2
            del raw
            if offsets:
                at, then = np.array(offsets, np.int64), np.array(following, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]] * len(at)), pa.array(np.full(len(at), r["start"])), pa.array(at), pa.array(then), pa.array(_left_at(at, then, stop))], names=["name", "start", "at", "successor", "leaves"])

    return map_arrow(_dealt(_blocks(files, block_bytes), n), run, "name string, start bigint, at bigint, successor bigint, leaves bigint")


def _tasks(files: DataFrame) -> int:
    total = files.agg(F.sum("bytes")).first()[0] or 0
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))


def reached(files: DataFrame, candidates: DataFrame, scratch: Scratch, block_bytes: int) -> DataFrame:
    """The offsets at which each file's chain enters its blocks, its end too: ``name, at``.

    Raises if a chain doesn't end at its file's end.
    """
    files = files.where("bytes > 0")
    # Only where some chain enters a block can it be entered: few of the candidates.
    entered = candidates.select(F.col("name").alias("file"), F.col("leaves").alias("entry")).distinct()
    starts = files.select(F.col("name").alias("file"), F.lit(0).cast("long").alias("entry"))
    entered = entered.unionByName(starts).distinct()
    jumps = candidates.select("name", "at", "leaves").join(entered, (F.col("name") == F.col("file")) & (F.col("at") == F.col("entry")), "left_semi")
    jumps = scratch.keep(jumps, "jumps-0")
    seen = scratch.keep(files.select("name", F.lit(0).cast("long").alias("at")), "seen-0")
    blocks = -(-(files.agg(F.max("bytes")).first()[0] or 0) // block_bytes)
    for k in range(1, blocks.bit_length() + 1):
        # The offsets seen reach as many steps further as the jumps are long; the jumps double.
        step = jumps.select(F.col("name").alias("n"), F.col("at").alias("a"), F.col("leaves").alias("b"))
        further = seen.join(step, (F.col("name") == F.col("n")) & (F.col("at") == F.col("a"))).select("name", F.col("b").alias("at"))
        seen = scratch.keep(seen.unionByName(further), f"seen-{k}")
        doubled = jumps.join(step, (F.col("name") == F.col("n")) & (F.col("leaves") == F.col("a"))).select("name", "at", F.col("b").alias("leaves"))
        jumps = scratch.keep(doubled, f"jumps-{k}")
        scratch.drop(f"seen-{k - 1}", f"jumps-{k - 1}")
    ends = seen.select(F.col("name").alias("n"), F.col("at").alias("a"))
    broken = files.join(ends, (F.col("name") == F.col("n")) & (F.col("bytes") == F.col("a")), "left_anti").select("name").first()
    if broken:
        raise ValueError(f"the records of {broken['name']} don't follow each other to its end")
    return seen


def _parsed(head: bytes) -> dict[str, str]:
    return {m[1].decode().lower(): m[2].decode().strip() for m in FIELD.finditer(head)}


def _opened(fields: dict[str, str], block: bytes) -> tuple[str, int, str, str | None, bytes | None]:
    """A record's kind, payload size, digest, the key of the row it refers to, and its payload."""
    http, found, payload = block.partition(END)
    size = re.search(rb"(?:^|\n)Content-Length:[ \t]*([0-9]+)", http, re.IGNORECASE)
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if not found or not size or kind not in ("response", "revisit"):
        raise ValueError(f"record {fields.get('warc-record-id')} can't be read")
    if kind == "revisit":
        return kind, int(size[1]), digest, fields["warc-refers-to"].strip("<>").split(":")[3], None
    if len(payload) != int(size[1]) or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields.get('warc-record-id')} isn't what its record says")
    return kind, len(payload), digest, None, payload


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint", with_payload: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records under ``path``: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, file, offset`` and, if asked for, ``payload``.

    ``payload_bytes`` and ``payload_digest`` (bare hexadecimal SHA-1) are of the
    whole payload, for revisits as the record has them; ``payload`` is null there.
    ``refers_to`` is the id of the row that a revisit refers to. Payloads are held
    against their digests: a damaged archive raises. Without files there are no rows.
    """
    files = spark.read.schema(_FILES).parquet(f"{path}/files")
    scratch, tasks = Scratch(spark, "warc-read"), _tasks(files)
    candidates = scratch.keep(chain_candidates(files, path, block_bytes, tasks), "candidates")
    entries = reached(files, candidates, scratch, block_bytes)
    sized = files.select(F.col("name").alias("n"), "bytes")
    entries = entries.join(sized, (F.col("name") == F.col("n")) & (F.col("at") < F.col("bytes"))).select("name", "bytes", "at", (F.col("at") - F.col("at") % block_bytes).alias("start"))
    names = ["id_text", "url", "payload_bytes", "payload_digest", "record_type", "refers_text", "file", "offset", *["payload"] * with_payload]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        held, weight = [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for r in (r for batch in batches for r in batch.to_pylist()):
            stop, at = min(r["start"] + block_bytes, r["bytes"]), r["at"]
            with fs.open_input_file(f"{root}/{r['name']}") as f:
                raw, base = f.read_at(stop - at, at), at
                while at < stop:
                    head, ahead = HEAD.match(raw, at - base), HEAD_BYTES
                    while head is None and base + len(raw) < r["bytes"]:
                        raw, base, ahead = f.read_at(ahead, at), at, 2 * ahead
                        head = HEAD.match(raw)
                    fields = _parsed(head[1])
                    begin = base + head.end()
                    end = begin + int(fields["content-length"])
                    whole = raw[begin - base : end - base + len(END)] if end + len(END) <= base + len(raw) else f.read_at(end + len(END) - begin, begin)
                    if whole[-len(END) :] != END:
                        raise ValueError(f"record {fields.get('warc-record-id')} has no end")
                    kind, size, digest, refers, payload = _opened(fields, whole[: -len(END)])
                    held.append((_value(fields["x-row-key"]), fields.get("warc-target-uri"), size, digest, kind, refers and _value(refers), r["name"], at, *[payload] * with_payload))
                    at, weight = end + len(END), weight + (len(whole) if with_payload else 200)
                    if weight > SLICE_BYTES:
                        yield full()
                        held, weight = [], 0
        if held:
            yield full()

    schema = "id_text string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_text string, file string, offset bigint" + ", payload binary" * with_payload
    found = map_arrow(_dealt(entries, tasks), run, schema)
    ids = F.col("id_text").cast(id_type).alias("page_id"), F.col("refers_text").cast(id_type).alias("refers_to")
    return found.select(ids[0], "url", "payload_bytes", "payload_digest", "record_type", ids[1], "file", "offset", *["payload"] * with_payload)


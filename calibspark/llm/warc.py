"""WARC archives: writer with segments and revisits, reader with segment
reassembly.

Writing: every page is a record; a payload that an earlier-written rule assigns
to another page is a ``revisit`` without body.  Bodies use chunked transfer
framing, and blocks over ``segment_bytes`` are cut into a first segment and
``continuation`` records, which go to another archive file than their origin.

Reading: archives are scanned by Spark's binary file source, one row per file
of bounded size.  Records without segment number are whole; the others are
grouped by origin identifier, ordered by segment number, checked (numbers 1 to
n, each once, and the total length that the last one states), joined, and
their chunked framing is decoded.  Only segmented records are shuffled, and a
group is one record.

Recovery: a task writes files under names of its own and returns those names;
only returned names are read, so files of lost or repeated attempts don't
count.

Defined results: a null html is the empty payload, a null url has no target
URI; a null page_id never stands for its group, it revisits the largest id of
an equal payload, and is a response where there is none; rows that repeat the
largest page_id of a group are all responses; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibspark.llm.scratch import materialise, scratch_folder

#: Block bytes of a segment, payload bytes of a transfer chunk, archive bytes of a file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 16_384, 4_096, 8 << 20
#: Bytes of blocks in one batch between Python and Spark.
BATCH_BYTES = 4 << 20

RECORDS = ("record_id string, record_type string, page_id long, refers_to long, payload_digest string, "
           "segment_number int, origin_id string, total_length long, content_length long, block binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(payload[i:i + chunk_bytes]), payload[i:i + chunk_bytes])
           for i in range(0, len(payload), chunk_bytes)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes | None:
    """Payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        if n < 0 or body[end + 2 + n:end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2:end + 2 + n])
        at = end + 4 + n


def http_payload(block: bytes) -> bytes | None:
    """Payload of an HTTP response block; None if it can't be decoded."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def record_bytes(kind: str, record_id: str, block: bytes, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2024-01-01T00:00:00Z", **more,
            "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 1, mtime=0)


def page_records(page_id, url, html, refers_to, hex_digest, segment_bytes: int, chunk_bytes: int):
    """(records, continuations) of one page, compressed."""
    more = {} if page_id is None else {"WARC-Page-Id": str(page_id)}
    if url is not None:
        more["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    digest = base64.b32encode(bytes.fromhex(hex_digest)).decode()
    more["WARC-Payload-Digest"] = f"sha1:{digest}"
    record_id = f"urn:uuid:{uuid.uuid4()}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        more |= {"WARC-Refers-To-Page-Id": str(refers_to), "Content-Type": "application/http; msgtype=response",
                 "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [record_bytes("revisit", record_id, http + b"\r\n", more)], []
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked((html or "").encode("utf-8"), chunk_bytes)
    more["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment_bytes:
        return [record_bytes("response", record_id, block, more)], []
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = record_bytes("response", record_id, parts[0], more | {"WARC-Segment-Number": "1"})
    rest = []
    for n, part in enumerate(parts[1:], 2):
        head = {"WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": str(n)}
        if n == len(parts):
            head["WARC-Segment-Total-Length"] = str(len(block))
        rest.append(record_bytes("continuation", f"urn:uuid:{uuid.uuid4()}", part, head))
    return [first], rest


def put_file(folder: str, data: bytes) -> str:
    """Write one archive in the shared folder and return its name."""
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    name = f"{uuid.uuid4().hex}.warc.gz"
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return name


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) and return the written
    table (file, records) of their names.

    Equal payloads: one digest is kept per group with more than one row, and
    joined back to the rows; a hot payload is counted with partial aggregation
    and its rows are split by the adaptive skew join.
    """
    rows = pages.selectExpr("CAST(page_id AS long) AS page_id", "CAST(url AS string) AS url", "html",
                            "sha1(coalesce(html, '')) AS digest")
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialise(groups.select("digest", "first"), "payloads")
    rows = rows.join(groups, "digest", "left")
    rows = rows.withColumn("refers_to", F.expr("CASE WHEN page_id IS NULL OR page_id < first THEN first END"))
    rows = rows.withColumn("html", F.expr("CASE WHEN refers_to IS NULL THEN html END"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_files: list[list] = [[], []]  # records, continuations

        def flush(parts: list, least: int) -> Iterator[pd.DataFrame]:
            if parts and sum(map(len, parts)) >= least:
                yield pd.DataFrame({"file": [put_file(folder, b"".join(parts))], "records": [len(parts)]})
                parts.clear()

        size = 0
        for b in batches:
            for page_id, url, html, refers_to, digest in zip(b["page_id"], b["url"], b["html"], b["refers_to"], b["digest"]):
                got = page_records(None if pd.isna(page_id) else int(page_id), url, html,
                                   None if pd.isna(refers_to) else int(refers_to), digest, segment_bytes, chunk_bytes)
                for parts, new in zip(open_files, got):
                    parts += new
                    size += sum(map(len, new))
                if size >= file_bytes:
                    for parts in open_files:
                        yield from flush(parts, file_bytes // 4)
                    size = sum(sum(map(len, parts)) for parts in open_files)
        for parts in open_files:
            yield from flush(parts, 0)

    return materialise(rows.select("page_id", "url", "html", "refers_to", "digest")
                       .mapInPandas(run, "file string, records long"), "manifest")


def parse_archive(content: bytes) -> Iterator[dict]:
    """Records of one archive, compressed by record or not at all.  A file
    that ends within a record yields it with what is there."""
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while (line := stream.readline().strip()):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        number = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
        length = number("content-length") or 0
        block = stream.read(length)
        yield {"record_id": head.get("warc-record-id", "").strip("<>"), "record_type": head.get("warc-type"),
               "page_id": number("warc-page-id"), "refers_to": number("warc-refers-to-page-id"),
               "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
               "segment_number": number("warc-segment-number"),
               "origin_id": head["warc-segment-origin-id"].strip("<>") if "warc-segment-origin-id" in head else None,
               "total_length": number("warc-segment-total-length"), "content_length": length, "block": block}


def frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for c in ("page_id", "refers_to", "segment_number", "total_length"):
        out[c] = out[c].astype("Int64")
    return out


def read_records(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """All records of the archives in ``folder``; with ``manifest``, of the files that it names."""
    if manifest is not None and manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("file"), "content")
    if manifest is not None:
        files = files.join(manifest.select("file"), "file", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows, held = [], 0
                for r in parse_archive(content):
                    rows.append(r)
                    held += len(r["block"])
                    if held >= BATCH_BYTES:
                        yield frame(rows)
                        rows, held = [], 0
                if rows:
                    yield frame(rows)

    return files.select("content").mapInPandas(run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, record_type, page_id, refers_to, payload_digest, block,
    complete): one row per logical record.  ``complete`` is false where a
    segment is missing or repeated with another content, or a length is off."""
    keep = ["record_id", "record_type", "page_id", "refers_to", "payload_digest"]
    whole = (records.where("segment_number IS NULL")
             .select(*keep, "block", (F.length("block") == F.col("content_length")).alias("complete")))
    parts = (records.where("segment_number IS NOT NULL")
             .withColumn("origin", F.coalesce("origin_id", "record_id")))
    first = F.when(F.col("segment_number") == 1, F.struct(*keep))
    grouped = parts.groupBy("origin").agg(
        F.array_distinct(F.sort_array(F.collect_list(F.struct("segment_number", "block")))).alias("parts"),
        F.max("total_length").alias("total"), F.max(first).alias("head"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["block"]))
    numbers = F.transform("parts", lambda p: p["segment_number"])
    grouped = grouped.withColumn("block", joined)
    ordered = numbers == F.sequence(F.lit(1), F.size("parts"))
    segmented = grouped.select(
        F.coalesce("head.record_id", "origin").alias("record_id"),
        *[F.col(f"head.{c}").alias(c) for c in keep[1:]], "block",
        (ordered & (F.length("block") == F.col("total")) & F.col("total").isNotNull()).alias("complete"))
    return whole.unionByName(segmented)


def decode_payloads(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Decode the HTTP framing of reassembled records: (record_id, record_type,
    page_id, refers_to, stated_digest, complete, payload_bytes, payload_digest
    [, payload]).  Payload columns are null for other records than complete
    responses."""
    schema = ("record_id string, record_type string, page_id long, refers_to long, stated_digest string, "
              "complete boolean, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [http_payload(x) if ok and kind == "response" else None
                   for x, ok, kind in zip(b["block"], b["complete"], b["record_type"])]
            out = pd.DataFrame({
                "record_id": b["record_id"], "record_type": b["record_type"], "page_id": b["page_id"].astype("Int64"),
                "refers_to": b["refers_to"].astype("Int64"), "stated_digest": b["payload_digest"],
                "complete": [bool(ok) and (kind != "response" or p is not None)
                             for p, ok, kind in zip(got, b["complete"], b["record_type"])],
                "payload_bytes": pd.array([None if p is None else len(p) for p in got], dtype="Int64"),
                "payload_digest": [None if p is None else base32_sha1(p) for p in got]})
            if with_payload:
                out["payload"] = got
            yield out

    return records.mapInPandas(run, schema)


def resolve_revisits(decoded: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a
    revisit takes length and digest from the response that it refers to.
    The response side is one row per id and digest; many revisits of one
    response are split by the adaptive skew join."""
    rows = materialise(decoded.select("page_id", "record_type", "refers_to", "stated_digest", "payload_bytes", "payload_digest"),
                       "records")
    response = rows.where("record_type = 'response'")
    target = materialise(response.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"))
                         .agg(F.max("payload_bytes").alias("of_bytes")), "responses")
    revisit = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    revisit = revisit.join(target, ["refers_to", "stated_digest"], "left").select(
        "page_id", F.col("of_bytes").alias("payload_bytes"),
        F.expr("CASE WHEN of_bytes IS NOT NULL THEN stated_digest END").alias("payload_digest"), "record_type", "refers_to")
    return response.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(revisit)


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "archives")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = read_records(spark, folder, manifest)
    return resolve_revisits(decode_payloads(reassemble(records), with_payload=False))


def oracle() -> str:
    """The contract in DuckDB: base32 by five hex digits (20 bits) at a time."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = "CAST('0x' || substr(h, i * 5 + 1, 5) AS BIGINT)"
    letters = " || ".join(f"substr('{alphabet}', CAST(({group} >> {shift}) & 31 AS INTEGER) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: {letters}), '') AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to FROM g"""

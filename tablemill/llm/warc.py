"""WARC archives: a deterministic sharded writer with a two-step commit, and a verifying reader."""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import Scratch, spread_join

#: Payloads shorter than this are always written whole.
REVISIT_BYTES = 100
#: About so many keys are sampled for each shard to place the range boundaries.
KEYS_PER_SHARD = 200
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, part int, records long, bytes long, digest string, first_key long, last_key long, temp string"
RECORDS = (
    "key long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, "
    "file string, record_offset long"
)


def store(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a folder URI; a plain path means the default local one."""
    return arrow_fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """One row for each page: key, uri, payload, payload_bytes, payload_digest; a null body is an empty payload."""
    payload = F.coalesce(F.col(body).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).cast("string").alias("uri"), payload.alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))


def revisits(recs: DataFrame) -> DataFrame:
    """(key, payload_digest, refers_to) of the records that only revisit another.

    Of equal payloads of at least ``REVISIT_BYTES`` the record with the smallest key is the response and the
    others revisit it; records that repeat the smallest key are responses too. Null keys never are referred
    to; they revisit the smallest key with their payload, if there is one. Payloads are not moved for this.
    """
    large = recs.filter(F.col("payload_bytes") >= REVISIT_BYTES).select("key", "payload_digest", F.xxhash64("uri").alias("u"))
    twins = large.groupBy("payload_digest").agg(F.min("key").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    twins = Scratch(recs.sparkSession).settle(twins, "twins")
    found = spread_join(large, twins, "payload_digest", "n", ["key", "u"]).filter("key is null and refers_to is not null or key <> refers_to")
    return found.select("key", "payload_digest", "refers_to").distinct()


def boundaries(rows: DataFrame, shards: int, total: int) -> np.ndarray:
    """Keys at which shards begin, from keys sampled by their hash: the same rows give the same boundaries."""
    one_in = max(1, total // (KEYS_PER_SHARD * shards))
    picked = rows.filter(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0)).select("key")
    keys = np.sort(np.array([r[0] for r in picked.collect()], dtype=np.int64))  # about KEYS_PER_SHARD for each shard
    if not len(keys) or shards < 2:
        return np.empty(0, np.int64)
    return np.unique(keys[(np.arange(1, shards) * len(keys)) // shards])


def head(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record: version, header lines, block."""
    lines = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def base32_sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def encode(key: int | None, uri: str | None, refers_to: int | None, payload: bytes, digest: str, date: str) -> bytes:
    """The compressed member of one page; the payload is left out of a revisit."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{k}:{digest}')}>"
    fields = [("WARC-Record-ID", name(key)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
    if uri is not None:
        fields.append(("WARC-Target-URI", quote(uri, safe="!#$&'()*+,/:;=?@[]~%")))
        if quote(uri, safe="!#$&'()*+,/:;=?@[]~%") != uri:
            fields.append(("X-Exact-URI", quote(uri, safe="")))
    if key is not None:
        fields.append(("X-Key", str(key)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    block = http if kind == "revisit" else http + payload
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Key", str(refers_to))]
    fields.append(("WARC-Block-Digest", base32_sha256(block)))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head(kind, fields, block)) + packer.flush()


def write(recs: DataFrame, folder: str, *, shard_bytes: int = 64 << 20, file_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the result of ``records`` as ``folder``/warc-SSSSS-PPPPP.warc.gz and return the manifest.

    Records are ranged by key into shards of about ``shard_bytes`` of payload, sorted inside by key, and a new
    file is begun once the compressed size would pass ``file_bytes``, so the same records always give the same
    files. Every attempt of a task writes under a temporary name of its own. The rows that the successful
    attempts return are settled first; a second job then renames exactly those files, and the manifest, written
    last, says that the archive is whole. A lost executor costs a repeated task in either job: a file that
    already has its final name is left as it is. Tasks hold one record and one file's write buffer.
    """
    spark = recs.sparkSession
    scratch = Scratch(spark)
    total, size = recs.agg(F.count("*"), F.sum("payload_bytes")).first()
    shards = max(1, math.ceil((size or 0) / shard_bytes))
    cuts = boundaries(recs, shards, total)

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        return pd.Series(np.where(known, np.searchsorted(cuts, keys.fillna(0).astype("int64"), "right"), 0)).astype("int32")

    # what is revisited travels with the records, in front of those it is about, so that payloads move once
    notes = revisits(recs).select("key", F.lit(None).cast("string").alias("uri"), F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("long").alias("payload_bytes"), "payload_digest", "refers_to")
    both = recs.withColumn("refers_to", F.lit(None).cast("long")).unionByName(notes).withColumn("shard", shard_of("key"))
    dealt = both.repartitionById(len(cuts) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "payload_digest", F.col("refers_to").isNull(), "uri")

    def store_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, root = store(folder)
        disk.create_dir(f"{root}/_temporary", recursive=True)
        task = TaskContext.get()
        attempt = f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, info, hasher, done = None, None, None, []
        note = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                info["digest"] = hasher.hexdigest()
                done.append(info)
                out = None

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key = None if pd.isna(r.key) else int(r.key)
                if not pd.isna(r.refers_to):
                    note = (key, r.payload_digest, int(r.refers_to))
                    continue
                target = note[2] if note is not None and note[:2] == (key, r.payload_digest) else None
                member = encode(key, r.uri, target, r.payload, r.payload_digest, date)
                if out is None or info["shard"] != r.shard or info["bytes"] + len(member) > file_bytes:
                    part = info["part"] + 1 if info is not None and info["shard"] == r.shard else 0
                    close()
                    temp = f"_temporary/{attempt}-{r.shard}-{part}"
                    first = encode_info(r.shard, part, date)
                    info = {"file": f"warc-{r.shard:05d}-{part:05d}.warc.gz", "shard": r.shard, "part": part, "records": 0, "bytes": len(first), "first_key": key, "temp": temp}
                    out, hasher = disk.open_output_stream(f"{root}/{temp}", compression=None), hashlib.sha256(first)
                    out.write(first)
                out.write(member)
                hasher.update(member)
                info |= {"records": info["records"] + 1, "bytes": info["bytes"] + len(member), "last_key": key}
            if done:
                yield manifest_rows(done)
                done.clear()
        close()
        if done:
            yield manifest_rows(done)

    files = scratch.settle(dealt.mapInPandas(store_records, MANIFEST), "files")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, root = store(folder)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if disk.get_file_info(f"{root}/{r.temp}").type == arrow_fs.FileType.File:
                    disk.move(f"{root}/{r.temp}", f"{root}/{r.file}")
                there = disk.get_file_info(f"{root}/{r.file}")
                if there.type != arrow_fs.FileType.File or there.size != r.bytes:
                    raise OSError(f"{r.file}: {there.size} bytes are there, {r.bytes} were written")
            yield pdf

    files.mapInPandas(commit, MANIFEST).drop("temp").write.parquet(f"{folder}/manifest")
    disk, root = store(folder)
    if disk.get_file_info(f"{root}/_temporary").type == arrow_fs.FileType.Directory:
        disk.delete_dir(f"{root}/_temporary")  # what lost attempts left
    scratch.drop(files)
    return spark.read.schema(MANIFEST.rpartition(",")[0]).parquet(f"{folder}/manifest")


def manifest_rows(done: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(done)
    return frame.astype({"first_key": "Int64", "last_key": "Int64"})[[c.split()[0] for c in MANIFEST.split(", ")]]


def encode_info(shard: int, part: int, date: str) -> bytes:
    """The warcinfo record that begins every file."""
    body = b"software: tablemill\r\nformat: WARC File Format 1.1\r\n"
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'info:{shard}:{part}')}>"
    fields = [("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("WARC-Filename", f"warc-{shard:05d}-{part:05d}.warc.gz")]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head("warcinfo", fields, body)) + packer.flush()


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, holding one member at a time."""
    at, start, unpacker, parts = 0, 0, zlib.decompressobj(31), []
    data = stream.read(chunk)
    while data:
        parts.append(unpacker.decompress(data))
        at += len(data) - len(unpacker.unused_data)
        if unpacker.eof:
            yield start, b"".join(parts)
            data, start, parts = unpacker.unused_data, at, []
            unpacker = zlib.decompressobj(31)
            if data:
                continue
        data = stream.read(chunk)
    if parts:
        raise ValueError(f"the archive ends inside the record at {start}")


def decode(record: bytes) -> dict | None:
    """Fields of one record, its digests verified; None for what is not a page."""
    top, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not version.startswith("WARC/") or fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    if base32_sha256(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the block does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    from urllib.parse import unquote

    uri = unquote(fields["X-Exact-URI"]) if "X-Exact-URI" in fields else fields.get("WARC-Target-URI")
    return {
        "key": number("X-Key"), "uri": uri, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Key"),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records of a committed archive, one row for each page; every file that the manifest names is streamed.

    Block and payload digests are verified, as is the number of records of each file. ``payload`` False
    leaves the payloads (null) out of the result. An archive without files gives an empty result.
    """
    manifest = spark.read.schema(MANIFEST.rpartition(",")[0]).parquet(f"{folder}/manifest")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, root = store(folder)
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                rows, held, seen = [], 0, 0
                with disk.open_input_stream(f"{root}/{f.file}", compression=None) as stream:
                    for offset, content in members(stream):
                        row = decode(content)
                        if row is None:
                            continue
                        seen += 1
                        if not payload:
                            row["payload"] = None
                        rows.append(row | {"file": f.file, "record_offset": offset})
                        held += len(row["payload"] or b"") + 200
                        if held > 8 << 20:
                            yield record_rows(rows)
                            rows, held = [], 0
                if seen != f.records:
                    raise ValueError(f"{f.file}: {seen} records, the manifest has {f.records}")
                if rows:
                    yield record_rows(rows)

    files = manifest.select("file", "records")
    count = files.count()
    return files.repartition(max(1, min(count, 1000)), "file").mapInPandas(parse, RECORDS)


def record_rows(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    return frame.astype({"key": "Int64", "refers_to": "Int64"})

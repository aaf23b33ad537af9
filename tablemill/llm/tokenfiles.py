"""Token ids as raw binary files with a minimal perfect hash index from document keys to places in them.

An archive is a folder: ``ids-SSSSS.bin`` holds the little-endian ids of one shard and nothing else, in ascending
order of keys; ``index-IIIII.npz`` holds one bucket of the index. A bucket is a minimal perfect hash function of its
keys (bit arrays in levels: a key sits in the first level where no other key has its bit; the number of bits set
before it is its slot) and, by slot, a fingerprint of the key, the shard, the offset and the number of ids. Looking
a key up reads a constant number of bits and one slot, whatever the size of the corpus. ``manifest`` (Parquet, one
row for each shard) is written last and says that the archive is whole.
"""

from __future__ import annotations

import array
import functools
import io
import json
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import Scratch
from tablemill.llm.warc import store
from tablemill.skew import running

#: Text bytes of one shard, and keys of one bucket of the index.
SHARD_BYTES = 64 << 20
BUCKET_KEYS = 1 << 18
#: Bits of a level for each key that reaches it, and levels at most; a key left after the last has a twin hash.
GAMMA, LEVELS = 2.0, 64
#: Pieces whose ids a Python worker remembers (some 200 bytes each), and their longest.
KNOWN_PIECES, PIECE_CHARS = 1_000_000, 32


# --- tokens ---


#: Where a byte-level tokenizer always begins a new unit: a space before a visible ASCII sign, letter, digit or underscore.
SPACE = re.compile(r" (?=[!-~\w])")
SIGNS = frozenset([chr(c) for c in range(32, 127) if not chr(c).isalpha()] + ["\n", "\r", "\t"])
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: The same inside a piece: after a letter ahead of another ASCII sign, after such a sign ahead of white space, after a single line end or tab ahead of a letter.
INSIDE = re.compile(f"(?<=[{LATIN}])(?=[ -@[-`{{-~\n\r\t])|(?<=[!-/:-@[-`{{-~])(?=[ \n\r\t])|(?<=\\S[\n\r\t])(?=[{LATIN}])")
#: One unit by itself.
WORD = re.compile(f" ?[{LATIN}]+")


class Known(dict):
    """Ids of pieces, made when first asked for; long pieces are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= PIECE_CHARS:
            self[piece] = ids
        return ids


class Pieces:
    """Ids of texts, little-endian, from one tokenizer file; texts are cut where its pre-tokenizer always cuts.

    Pieces repeat and are encoded once; a single word goes to the tokenizer's model directly. Only byte-level
    tokenizers are cut, others get whole texts.
    """

    def __init__(self, file: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(file), np.dtype(dtype)
        before = self.tokenizer.pre_tokenizer
        state = json.loads(before.__getstate__()) if before is not None else {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.cut = (
            state.get("type") == "ByteLevel" and state.get("use_regex") and not state.get("add_prefix_space") and self.tokenizer.normalizer is None
            and not any(a.lstrip or a.rstrip or SPACE.search(a.content) for a in added)
        )
        self.added = [a.content for a in added]
        if self.cut:
            self.model, self.code = self.tokenizer.model, "HI"[self.dtype.itemsize == 4]
            letters = [chr(c) for c in range(0x250) if re.fullmatch(f"[{LATIN}]", chr(c))]
            self.signs = str.maketrans({c: before.pre_tokenize_str(c)[0][0] for c in letters} | {" ": before.pre_tokenize_str(" a")[0][0][:-1]})
        self.first, self.later = Known(self.piece), Known(lambda p: self.piece(" " + p))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        return array.array(self.code, [t.id for t in self.model.tokenize(word.translate(self.signs))]).tobytes()

    def piece(self, piece: str) -> bytes:
        start = WORD.match(piece)
        if start:
            end = start.end()
            if end == len(piece):
                return self.word(piece)
            if piece[end] in SIGNS:  # the word is a unit, what follows it stands by itself
                return self.word(piece[:end]) + self.first[piece[end:]]
        if any(a in piece for a in self.added):
            return self.whole(piece)
        parts = INSIDE.split(piece)
        return b"".join([self.first[p] for p in parts]) if len(parts) > 1 else self.whole(piece)

    def encode(self, text: str) -> bytes:
        if not self.cut:
            return self.whole(text)
        if len(self.first) + len(self.later) > KNOWN_PIECES:
            self.first.clear()
            self.later.clear()
        parts = SPACE.split(text)
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))


@functools.cache
def tokenizer(file: str, dtype: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(file, dtype)


# --- minimal perfect hashing ---


def mixed(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes for one level."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) + b.view(np.uint64) * np.uint64(2 * turn + 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Bits of all levels behind each other (packed), and where each level begins."""

    bits: np.ndarray
    begin: np.ndarray

    def __post_init__(self):
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.below = np.cumsum(ones) - ones  # set bits before each byte

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number below the number of keys for each key of the set, each its own; -1 or any such number for others."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (low, high) in enumerate(zip(self.begin[:-1].tolist(), self.begin[1:].tolist())):
            spot = low + (mixed(a[left], b[left], level) % np.uint64(high - low)).astype(np.int64)
            byte, bit = self.bits[spot >> 3], (spot & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            out[left[hit]] = (self.below[spot >> 3] + np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1))))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def perfect_hash(a: np.ndarray, b: np.ndarray) -> PerfectHash:
    """Levels until every key has a bit of its own; keys are pairs of hashes and must differ."""
    left, parts, begin = np.arange(len(a)), [], [0]
    for level in range(LEVELS):
        if not len(left):
            break
        size = -(-max(64, int(GAMMA * len(left))) // 8) * 8
        spot = (mixed(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(spot, minlength=size) == 1
        parts.append(np.packbits(alone, bitorder="little"))
        begin.append(begin[-1] + size)
        left = left[~alone[spot]]
    if len(left):
        raise ValueError("two keys have the same hashes")
    return PerfectHash(np.concatenate([*parts, np.empty(0, np.uint8)]), np.array(begin))


# --- files ---


def put(folder: str, name: str, data: list[bytes] | bytes) -> None:
    """Write a file whole or not at all: under a name of this attempt's own, then renamed."""
    disk, root = store(folder)
    disk.create_dir(f"{root}/_temporary", recursive=True)
    temp = f"{root}/_temporary/{name}-{uuid.uuid4().hex}"
    with disk.open_output_stream(temp) as out:
        for part in [data] if isinstance(data, bytes) else data:
            out.write(part)
    disk.move(temp, f"{root}/{name}")


def key_hashes(key: str | Column, turn: str | Column) -> list[Column]:
    """Two independent hashes of a key and its number among the documents that repeat it."""
    key, turn = (F.col(c) if isinstance(c, str) else c for c in (key, turn))
    return [F.xxhash64(F.lit(seed), key.isNull(), key, turn) for seed in ("a", "b")]


def write(docs: DataFrame, folder: str, file: str, key: str = "doc_id", text: str = "text", end: int = 0, shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> None:
    """Tokenize all texts into the archive ``folder``, in ascending order of keys (null keys last).

    Every text, null as empty, is encoded without added special tokens and closed by the id ``end``. Documents
    that repeat a key all stay; their order is that of the rows in the given files, and a turn 0, 1, ... joins the
    key in the index. Rows are ranged by key and position into shards of about ``shard_bytes`` of text, so a key
    with a third of all rows spans many shards. Texts move once. A file is renamed into place when it is whole and
    a repeated task writes the same bytes again, so lost executors leave no trace but temporary files. An empty
    table gives an empty manifest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    dtype = width(file, end)
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))
    order = [F.col("key").asc_nulls_last(), F.col("row")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("shard", T.IntegerType()), rows.schema["key"], T.StructField("turn", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("n", T.IntegerType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, at, last, turn = tokenizer(file, dtype), TaskContext.get().partitionId(), 0, object(), 0
        tail = np.array([end], dtype).tobytes()
        disk, root = store(folder)
        disk.create_dir(f"{root}/_temporary", recursive=True)
        temp, out = f"{root}/_temporary/ids-{shard:05d}-{uuid.uuid4().hex}", None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or disk.open_output_stream(temp)
            sizes = []
            for text in batch.column("text"):
                data = words.encode(text.as_py())
                out.write(data)
                out.write(tail)
                sizes.append((len(data) + len(tail)) // len(tail))
            turns = []
            for k in batch.column("key").to_pylist():
                turn, last = turn + 1 if k == last else 0, k
                turns.append(turn)
            sizes = np.array(sizes, np.int64)
            offsets = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), shard, np.int32)), batch.column("key"), pa.array(turns, pa.int64()), pa.array(offsets), pa.array(sizes.astype(np.int32))], schema.names)
        if out is not None:
            out.close()
            disk.move(temp, f"{root}/ids-{shard:05d}.bin")

    entries = scratch.settle(ranged.mapInArrow(encode, schema), "entries")
    found = entries.groupBy("shard").agg(
        F.count("*").alias("docs"), F.sum("n").cast("long").alias("tokens"), F.min_by(F.struct("key"), "offset").alias("first"),
        F.max_by(F.struct("key", "turn"), "offset").alias("last"),
    )
    found = scratch.settle(found, "shards")
    # where a shard begins, and how many documents before it repeat its first key: sums over one row a shard
    placed = running(found, [], ["shard"], {"upto": ("sum", F.col("tokens"))}).withColumn("start", F.col("upto") - F.col("tokens"))
    edges = found.select("shard", F.lit(0).alias("kind"), F.col("first.key").alias("key"), F.lit(0).cast("long").alias("more")).unionByName(
        found.select("shard", F.lit(1).alias("kind"), F.col("last.key").alias("key"), (F.col("last.turn") + 1).alias("more"))
    )
    repeats = running(edges, ["key"], ["shard", "kind"], {"repeats": ("sum", F.col("more"))}).filter("kind = 0")
    manifest = placed.select("shard", "docs", "tokens", "start", F.col("first.key").alias("first_key"), F.lit(dtype).alias("dtype"))
    manifest = scratch.settle(manifest.join(repeats.select("shard", "repeats"), "shard"), "manifest")

    total = manifest.agg(F.sum("docs")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_keys))
    placed = entries.join(manifest.select("shard", "first_key", "repeats"), "shard")
    turn = F.col("turn") + F.when(F.col("key").eqNullSafe(F.col("first_key")), F.col("repeats")).otherwise(0)
    placed = placed.select("shard", "offset", "n", *[h.alias(n) for h, n in zip(key_hashes("key", turn), "ab")])
    dealt = placed.repartitionById(buckets, F.pmod("a", F.lit(buckets)).cast("int"))
    done = scratch.settle(dealt.mapInArrow(functools.partial(build_bucket, folder), "bucket int, keys long"), "buckets")
    if done.agg(F.sum("keys")).first()[0] != (total or None):
        raise RuntimeError("the index does not hold all documents")
    manifest.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/manifest")
    scratch.drop(entries, found, manifest, done)


def width(file: str, end: int) -> str:
    """Type of the stored ids: two bytes where the vocabulary allows it."""
    from tokenizers import Tokenizer

    largest = max([end, *Tokenizer.from_file(file).get_vocab(with_added_tokens=True).values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def build_bucket(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the bucket of a task's keys; about ``bucket_keys`` rows of five numbers are held."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    a, b, shard, offset, n = (rows.column(c).to_numpy() for c in ("a", "b", "shard", "offset", "n"))
    mph = perfect_hash(a, b)
    slot = np.argsort(mph.slots(a, b))
    file, bucket = io.BytesIO(), TaskContext.get().partitionId()
    np.savez(file, bits=mph.bits, begin=mph.begin, fingerprint=fingerprints(a, b)[slot], shard=shard[slot], offset=offset[slot], n=n[slot])
    put(folder, f"index-{bucket:05d}.npz", file.getvalue())
    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(a)], pa.int64())], ["bucket", "keys"])


def fingerprints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(b, a, LEVELS) >> np.uint64(32)).astype(np.uint32)


def keys_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, turn): a row for each document, the turns of those that repeat a key counted from 0.

    The documents of a repeated key are counted first and told apart again in pieces, never held together.
    """
    piece = 1 << 16
    counted = docs.groupBy(key).agg(F.count("*").alias("__n"))
    cut = counted.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / piece))))
    return cut.select(key, F.explode(F.sequence(F.col("__p") * piece, F.least(F.col("__n") - 1, F.col("__p") * piece + (piece - 1)))).alias("turn"))


def read_file(folder: str, name: str) -> bytes:
    disk, root = store(folder)
    with disk.open_input_file(f"{root}/{name}") as file:
        return file.read()


def lookup(folder: str, keys: DataFrame, key: str = "doc_id", turn: str | None = None) -> DataFrame:
    """Places of keys in the archive: the given columns and shard, offset, n, start (ids of all documents before).

    ``turn`` names the column that tells documents of one key apart (without one: the first). A key that the
    archive does not hold gets nulls, but for the one in four thousand million whose fingerprint fits by chance.
    A task holds one bucket of the index at a time.
    """
    spark = keys.sparkSession
    manifest = spark.read.parquet(f"{folder}/manifest")
    first = manifest.select("buckets").first()
    names = list(dict.fromkeys(c for c in keys.columns if c not in ("shard", "offset", "n", "start")))
    out = T.StructType([*keys.select(*names).schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("n", T.IntegerType())])
    if first is None:
        return keys.select(*names, *[F.lit(None).cast(t).alias(c) for c, t in (("shard", "int"), ("offset", "long"), ("n", "int"), ("start", "long"))])
    hashes = key_hashes(key, turn if turn else F.lit(0).cast("long"))
    bucket = F.pmod(F.col("__a"), F.lit(first[0])).cast("int")
    asked = keys.select(*names, hashes[0].alias("__a"), hashes[1].alias("__b")).withColumn("__bucket", bucket)
    asked = asked.repartition(F.col("__bucket")).sortWithinPartitions("__bucket")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, mph = -1, {}, None
        for batch in batches:
            buckets, a, b = (batch.column(c).to_numpy() for c in ("__bucket", "__a", "__b"))
            cells = [np.zeros(len(a), np.int64) for _ in range(3)]
            known = np.zeros(len(a), bool)
            for low, high in zip(*stretches_of(buckets)):
                if buckets[low] != now:
                    now = int(buckets[low])
                    held = bucket_arrays(folder, now)
                    mph = PerfectHash(held["bits"], held["begin"]) if held else None
                if mph is None:
                    continue
                slot = mph.slots(a[low:high], b[low:high])
                ok = slot >= 0
                ok[ok] = held["fingerprint"][slot[ok]] == fingerprints(a[low:high], b[low:high])[ok]
                known[low:high] = ok
                for cell, name in zip(cells, ("shard", "offset", "n")):
                    cell[low:high][ok] = held[name][slot[ok]]
            found = [pa.array(c, mask=~known).cast(t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *found], [*names, "shard", "offset", "n"])

    places = asked.mapInArrow(find, out)
    starts = manifest.select("shard", F.col("start").alias("__start"))
    return places.join(starts, "shard", "left").withColumn("start", F.col("__start") + F.col("offset")).select(*names, "shard", "offset", "n", "start")


def stretches_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of equal values."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
    return (edge[:-1], edge[1:]) if len(values) else (edge[:0], edge[:0])


def bucket_arrays(folder: str, bucket: int) -> dict[str, np.ndarray]:
    """A bucket of the index; empty if no key fell into it."""
    try:
        data = read_file(folder, f"index-{bucket:05d}.npz")
    except FileNotFoundError:
        return {}
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def fetch(folder: str, places: DataFrame) -> DataFrame:
    """Add ``ids`` (array<long>) to rows of ``lookup``; null for keys the archive does not hold."""
    return payloads(folder, places, "ids", T.ArrayType(T.LongType()), lambda ids: ids.astype(np.int64).tolist())


def checksums(folder: str, places: DataFrame) -> DataFrame:
    """Add ``ids_crc32``, the unsigned crc32 of the ids as little-endian 32-bit integers, to rows of ``lookup``."""
    return payloads(folder, places, "ids_crc32", T.LongType(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


#: Bytes read at once; documents that lie behind each other share a read.
READ_BYTES = 8 << 20


def payloads(folder: str, places: DataFrame, name: str, kind: T.DataType, of) -> DataFrame:
    spark = places.sparkSession
    first = spark.read.parquet(f"{folder}/manifest").select("dtype").first()
    dtype = np.dtype(first[0] if first else "<u4")
    rest = [c for c in places.columns if c != name]
    # a shard is read by several tasks, each a range of it
    simple = [f.name for f in places.schema.fields if isinstance(f.dataType, T.AtomicType)]
    piece = F.coalesce(F.floor(F.col("offset") * dtype.itemsize / READ_BYTES), F.pmod(F.xxhash64(*simple), F.lit(1024)))  # keys not held are spread
    dealt = places.select(*rest).withColumn("__piece", piece).repartition(F.col("shard"), F.col("__piece")).sortWithinPartitions("shard", "offset")
    schema = T.StructType([*places.select(*rest).schema.fields, T.StructField(name, kind)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = store(folder)
        now, file, low, data = None, None, 0, b""
        for batch in batches:
            got = []
            for shard, offset, n in zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "n")]):
                if shard is None:
                    got.append(None)
                    continue
                if shard != now:
                    file, now, low, data = disk.open_input_file(f"{root}/ids-{shard:05d}.bin"), shard, 0, b""
                begin, size = offset * dtype.itemsize, n * dtype.itemsize
                if not low <= begin or begin + size > low + len(data):
                    low, data = begin, file.read_at(min(max(size, READ_BYTES), file.size() - begin), begin)
                got.append(of(np.frombuffer(data, dtype, n, begin - low)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(got, pa.list_(pa.int64()) if isinstance(kind, T.ArrayType) else pa.int64())], [*rest, name])

    return dealt.mapInArrow(read, schema)

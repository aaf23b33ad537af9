"""Benchmark decontamination by Wu-Manber search for word windows of the test items."""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import Scratch

#: ASCII letters in lower case and digits stay, other ASCII becomes a space; bytes above are parts of words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Patterns are searched together with others of similar length, as the shortest limits the shifts.
LENGTHS = [1, 8, 16, 32]


def normal(text: str | None) -> bytes:
    """Words of a text, lower case, with one space before, between and after; one space when there is none."""
    if not text:
        return b" "
    words = text.encode("utf-8", "surrogatepass").translate(TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def windows(text: str | None, words: int) -> set[bytes]:
    """Windows of an item: runs of ``words`` words, or all of them when there are fewer."""
    w = normal(text).split()
    return {b" " + b" ".join(w[i : i + words]) + b" " for i in range(max(1, len(w) - words + 1))} if w else set()


class WuManber:
    """Multi-pattern search: block shift tables, suffix-hash buckets, direct comparison."""

    def __init__(self, patterns: dict[bytes, list]):
        self.least = min(map(len, patterns))
        m = self.least
        # long blocks keep shifts long when there are many patterns
        self.block = b = max(1, min(8, m // 2))
        self.most = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(b, m + 1):
                piece, distance = p[end - b : end], m - end
                if distance < self.shift.get(piece, self.most):
                    self.shift[piece] = distance
            self.buckets[p[m - b : m]].append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of every occurrence."""
        b, m, shift, most, buckets = self.block, self.least, self.shift.get, self.most, self.buckets
        end, n = m, len(text)
        while end <= n:
            block = text[end - b : end]
            step = shift(block, most)
            if step:
                end += step
                continue
            at = end - m
            for p in buckets.get(block, ()):
                if text.startswith(p, at):
                    yield at, p
            end += 1


class Index:
    """Searchers for one block of patterns; ``owners`` tells which items have a window."""

    def __init__(self, items: Iterable[tuple], words: int):
        self.owners: dict[bytes, list] = defaultdict(list)
        for item, text in items:
            for w in windows(text, words):
                self.owners[w].append(item)
        classes: dict[int, dict[bytes, list]] = defaultdict(dict)
        for w, ids in self.owners.items():
            classes[bisect_right(LENGTHS, len(w))][w] = ids
        self.searchers = [WuManber(c) for c in classes.values()]

    def match(self, text: bytes) -> tuple[list[list[int]], set]:
        """Merged word intervals that windows cover, and the items whose windows occur."""
        hits, items = [], set()
        for s in self.searchers:
            for at, p in s.find(text):
                hits.append((at, at + len(p)))
                items.update(self.owners[p])
        out: list[list[int]] = []
        word, place = 0, 0
        for a, z in sorted(set(hits)):
            word += text.count(b" ", place, a)  # spaces before a, which is the index of the word after it
            place = a
            last = word + text.count(b" ", a, z) - 1
            if out and word <= out[-1][1]:
                out[-1][1] = max(out[-1][1], last)
            else:
                out.append([word, last])
        return out, items


RESULT = "n_words long, ranges array<struct<start:long,end:long>>, items array<string>"


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(r) for r in out]


def overlaps(
    docs: DataFrame, benchmark: DataFrame, out: str = "overlap", *, text: str = "text", item: str = "item_id", item_text: str = "text",
    words: int = 10, block_bytes: int = 16 << 20,
) -> DataFrame:
    """Add the struct ``out``: n_words, ranges (word intervals inside a window, end exclusive), items (ids as text).

    The items are read in blocks of about ``block_bytes`` of text, so what a task holds has a fixed bound; each
    further block is one more pass over the documents, whose partitions do not move. An item longer than a
    block is a block of its own. Null documents have no words; null items have no windows; an item that occurs
    twice counts once; a null item id hits but is not listed. ``out`` replaces a column of that name.
    """
    scratch = Scratch(docs.sparkSession)
    sized = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    blocks = max(1, -(-(sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    rows, done = docs, None
    for k in range(blocks):
        mine = sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        held = docs.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in mine.collect()])  # one block, see above

        search = searcher(held, words)
        rows = rows.withColumn(out if done is None else "__more", search(F.col(text)))
        if done is not None:
            rows = scratch.settle(rows, "overlaps").withColumn(out, join_results(F.col(out), F.col("__more"))).drop("__more")
        done = k
    return rows


def searcher(held, words: int):
    """The search for one block of items."""

    @F.pandas_udf(RESULT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(held.value, words)
        for texts in batches:
            found = []
            for t in texts:
                b = normal(t)
                ranges, items = index.match(b) if len(b) > 1 else ([], set())
                found.append((b.count(b" ") - 1, [{"start": a, "end": z} for a, z in ranges], sorted(i for i in items if i is not None)))
            yield pd.DataFrame(found, columns=["n_words", "ranges", "items"])

    return search.asNondeterministic()


def join_results(a, b):
    """Two results of the same document: intervals merged, items united."""

    @F.pandas_udf(RESULT)
    def unite(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs = [merge([(r["start"], r["end"]) for r in [*x, *y]]) for x, y in zip(left["ranges"], right["ranges"])]
        return pd.DataFrame({
            "n_words": left["n_words"], "ranges": [[{"start": s, "end": e} for s, e in p] for p in pairs],
            "items": [sorted({*x, *y}) for x, y in zip(left["items"], right["items"])],
        })

    return unite(a, b)

"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words in which words ``period`` apart are equal, for its smallest such period,
at least ``LEAST`` words and two periods long, and not extendable. Every word of a run occurs at least twice in it,
so words that occur once in a segment cannot be in any run inside it: they split the segment. Pieces that are too
short are given up, the others are counted anew, until nothing splits any more. Surviving segments are scanned lag
by lag. Texts are read where they lie; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words a run has at least.
LEAST = 12
#: Words compared at once; a run repeats so many words in a row at least LEAST - LEAST // 2 - GRAM + 1 times.
GRAM = 4
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    return codes.astype(np.int16) if len(known) < 1 << 15 else codes  # short numbers are sorted by their digits


def neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the previous (-1: none) and next (n: none) occurrence of the same number."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def segments(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches in which every word occurs at least twice, which hold all runs."""
    before, after = neighbours(codes)
    todo, stable = [(0, len(codes))], []
    while todo:
        low, high = todo.pop()
        if high - low < LEAST:
            continue
        # a word occurs again inside the segment if its nearest occurrence on either side lies there
        often = (before[low:high] >= low) | (after[low:high] < high)
        if often.all():
            stable.append((low, high))
        else:
            begin, end = stretches(often)
            long = end - begin >= LEAST
            todo += zip((begin[long] + low).tolist(), (end[long] + low).tolist())
    return sorted(stable)


def scan(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment, smallest periods first.

    At lag q a run has at least ``s = max(LEAST, 2 q) - q`` equal pairs of words in a row, so every ``s``-th place
    is looked at, by groups of ``GRAM`` words. These groups all occur again later, which bounds the lags that need
    a look. A multiple of a run's period shows the same stretch once more; the smallest period came first.
    """
    n = len(codes)
    grams = np.zeros(n - GRAM + 1, np.int64)
    for i in range(GRAM):
        grams = np.unique(grams * (int(codes.max()) + 1) + codes[i : n - GRAM + 1 + i], return_inverse=True)[1].astype(np.int64)
    begin, end = stretches(neighbours(grams)[1] < len(grams))
    if not len(begin):
        return []
    most = int((end - begin).max()) + GRAM - 1  # equal pairs in a row at any lag
    spans = np.zeros((16, 3), np.int64)  # start, end, period of the runs found
    known: set[tuple[int, int]] = set()
    cover = np.full(n, -1)  # the longest of them at each word
    for q in range(1, min(n // 2, most) + 1):
        s = max(LEAST, 2 * q) - q
        if s > most:
            continue
        step = s - GRAM + 1
        hits = np.flatnonzero(grams[: len(grams) - q : step] == grams[q::step]) * step
        if not len(hits):
            continue
        run = spans[cover[hits]]
        again = (cover[hits] >= 0) & (q % np.maximum(run[:, 2], 1) == 0) & (hits + GRAM + q <= run[:, 1])
        high = 0
        for i in hits[~again].tolist():
            if i < high:
                continue
            low, high = i - equal_before(codes, i, q), i + equal_after(codes, i, q)
            if high - low < s or (low, high + q) in known:
                continue
            if len(known) + 1 == len(spans):
                spans = np.vstack([spans, np.zeros_like(spans)])
            spans[len(known)] = low, high + q, q
            mine = cover[low : high + q]
            mine[(mine < 0) | (spans[mine, 1] - spans[mine, 0] < high + q - low)] = len(known)
            known.add((low, high + q))
            if high + q - low == n:  # two runs share fewer words than their periods have together, so none is left
                return [(a, b - a, q) for a, b, q in spans[: len(known)].tolist()]
    return [(a, b - a, q) for a, b, q in spans[: len(known)].tolist()]


def equal_after(codes: np.ndarray, i: int, q: int) -> int:
    """Number of equal pairs in a row from (i, i + q) on."""
    n, done, width = len(codes) - q, 0, 32
    while i + done < n:
        stop = min(i + done + width, n)
        other = np.flatnonzero(codes[i + done : stop] != codes[i + done + q : stop + q])
        if len(other):
            return done + int(other[0])
        done, width = stop - i, width * 2
    return done


def equal_before(codes: np.ndarray, i: int, q: int) -> int:
    """Number of equal pairs in a row that end before (i, i + q)."""
    done, width = 0, 32
    while done < i:
        low = max(i - done - width, 0)
        other = np.flatnonzero(codes[low : i - done] != codes[low + q : i - done + q])
        if len(other):
            return done + (i - done - low) - 1 - int(other[-1])
        done, width = i - low, width * 2
    return done


def periodic_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    if len(words) < LEAST:
        return []
    codes = numbered(words)
    out = []
    for low, high in segments(codes):
        out += [(low + start, length, period) for start, length, period in scan(codes[low:high])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def collapse(docs: DataFrame, text: str = "text", loop: str | None = None) -> DataFrame:
    """Add ``runs`` (start, length, period in words, by start and then period) and ``collapsed`` (text) to all rows.

    Words are maximal stretches of other characters than space, tab, line feed, vertical tab, form feed and
    carriage return; ``collapsed`` holds the kept ones joined by one space. ``loop`` may name a struct (start,
    period): the words from ``start`` on are then replaced by repetitions of the ``period`` words that begin
    there, before runs are sought. Null and empty texts have no runs and collapse to an empty text; ids play no
    part, so rows may repeat. Added columns replace others of their names.
    """
    rest = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    given = docs.select(*rest, F.col(text).cast("binary").alias("__text"), (F.col(loop) if loop else F.lit(None)).cast("struct<start:long,period:long>").alias("__loop"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for data, again in zip(batch.column("__text"), batch.column("__loop").to_pylist()):
                words = (data.as_py() or b"").split()  # bytes are split at exactly these characters
                if again and again["period"]:
                    a, p = again["start"], again["period"]
                    part = words[a : a + p]
                    words = words[:a] + (part * ((len(words) - a) // p + 1))[: len(words) - a]
                runs = periodic_runs(words)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(found, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), pa.array(kept, pa.binary()).cast(pa.string())],
                [*rest, "runs", "collapsed"],
            )

    return given.mapInArrow(work, schema)

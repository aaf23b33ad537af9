"""Language spans: script ranges narrow the candidates, Viterbi over word scores labels runs of words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First code points of blocks of letters and the script they belong to (Unicode).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
STARTS = np.array([s for s, _ in SCRIPTS], dtype=np.uint32)
NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))
SCRIPT_OF = np.array([NAMES.index(n) for _, n in SCRIPTS], dtype=np.int64)

#: Three-letter runs of a word with its edges are counted in so many buckets.
BUCKETS = 1 << 16
#: Texts are scored in pieces of about so many characters, which bounds the memory of a task.
PIECE = 1 << 20
#: Of each language at most so many labelled texts are learned from, the first in a seeded order.
EXAMPLES = 2000
#: A switch of language costs as much as this many nats of word score.
PENALTY = 12.0
#: A script counts for a language when it makes up at least this share of its letters.
SCRIPT_SHARE = 0.005


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def lower(text: str) -> str:
    out = text.lower()
    return out if len(out) == len(text) else "".join(c if len(d := c.lower()) != 1 else d for c in text)


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """Cut a text into pieces of about PIECE characters, where a non-letter allows it."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while at < end < len(text) and end < at + 2 * PIECE and text[end].isalpha():
            end += 1
        yield at, text[at:end]
        at = end


class Words:
    """Words (runs of letters of one script) of many texts at once, and the buckets of their letter runs."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(lower(joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        alpha = letters()[code]
        script = SCRIPT_OF[np.searchsorted(STARTS, code, "right") - 1] if (code > 0x36F).any() else np.zeros(len(code), np.int64)
        script = np.where(alpha, script, -1)
        new = alpha.copy()
        new[1:] &= script[1:] != script[:-1]
        self.start = np.flatnonzero(new)
        last = alpha.copy()
        last[:-1] &= script[:-1] != script[1:]
        self.end = np.flatnonzero(last) + 1
        self.script = script[self.start]
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.doc = np.searchsorted(begins, self.start, "right") - 1
        self.offset = begins[self.doc]
        # each letter makes a run with its two neighbours inside the word, edges included
        at = np.flatnonzero(alpha)
        c = code.astype(np.uint64)
        left = np.where(new[at], 0, c[at - 1])
        right = np.where(last[at], 0, c[np.minimum(at + 1, len(c) - 1)])
        h = left * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + right * np.uint64(0x165667B19E3779F9)
        self.bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
        self.first = np.searchsorted(at, self.start)


def counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over the learned texts; script counts follow at BUCKETS and above."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, t in zip(pdf["lang"], pdf["text"]):
                total = sums.setdefault(name, np.zeros(BUCKETS + len(NAMES), np.int64))
                for _, piece in pieces(t):
                    w = Words([piece])
                    total[:BUCKETS] += np.bincount(w.bucket, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(w.script, weights=w.end - w.start, minlength=len(NAMES)).astype(np.int64)
            if len(sums) > 32:
                yield from flush(sums)
        yield from flush(sums)

    def flush(sums: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": total[at]})
        sums.clear()

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of letter-run buckets by language, and the scripts each language uses."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs = langs
        runs, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
        smooth = 0.3
        with np.errstate(divide="ignore", invalid="ignore"):
            p = (runs + smooth) / (runs.sum(1, keepdims=True) + smooth * BUCKETS)
            share = np.nan_to_num(scripts / scripts.sum(1, keepdims=True))
        self.logs = np.ascontiguousarray(np.log(p).T.astype(np.float32)) if langs else np.zeros((BUCKETS, 0), np.float32)
        self.uses = share.T >= SCRIPT_SHARE if langs else np.zeros((len(NAMES), 0), bool)

    def score(self, w: Words) -> np.ndarray:
        """Score of every word in every language, relative to the best; scripts exclude languages."""
        if not len(w.start):
            return np.zeros((0, len(self.langs)))
        raw = np.add.reduceat(self.logs[w.bucket], w.first, axis=0).astype(np.float64)
        usable = self.uses[w.script]
        known = usable.any(1)  # a word whose script no language uses says nothing
        raw = np.where(usable, raw, -np.inf)
        best = raw.max(1, keepdims=True)
        out = np.where(usable, raw - np.where(known[:, None], best, 0), -4 * PENALTY)
        return np.where(known[:, None], np.maximum(out, -4 * PENALTY), 0.0)


def constant_path(scores: np.ndarray, doc: np.ndarray, docs: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The best single language of each text, and whether no path with switches can beat it.

    A path that leaves the language for k stretches in a row pays at least k penalties and one more unless it
    stays away to an end. So if no stretch of words gains more than one penalty in any other language, staying
    is best. The largest gain of a stretch is a running sum less its running minimum.
    """
    total = np.zeros((docs, scores.shape[1]))
    np.add.at(total, doc, scores)
    best = total.argmax(1)
    stays = np.ones(docs, bool)
    own = scores[np.arange(len(scores)), best[doc]]
    bound = np.abs(scores).sum() + penalty + 1
    for lang in range(scores.shape[1]):
        run = np.cumsum(scores[:, lang] - own)
        gain = run - (scores[:, lang] - own)  # the sum before each word
        low = np.minimum.accumulate(gain - doc * 2 * bound) + doc * 2 * bound
        worst = np.full(docs, -np.inf)
        np.maximum.at(worst, doc, run - low)
        stays &= worst <= penalty
    return best, stays


def viterbi(parts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best language of every word of each text, all texts one step at a time; ties stay, then the first."""
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    lengths = np.array([len(parts[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(parts)
    if not order or not lengths[0]:
        return out
    langs = parts[order[0]].shape[1]
    padded = np.zeros((lengths[0], len(order), langs))
    for j, i in enumerate(order):
        padded[: len(parts[i]), j] = parts[i]
    back = np.zeros((lengths[0], len(order)), np.int16)
    stay = np.zeros((lengths[0], len(order), langs), bool)
    value = padded[0].copy()
    finals = np.zeros(len(order), np.int16)
    live = len(order)
    for t in range(1, lengths[0] + 1):
        keep = int(np.searchsorted(-lengths, -t, "left"))  # texts longer than t words
        finals[keep:live] = value[keep:live].argmax(1)
        live = keep
        if not live:
            break
        v = value[:live]
        top = v.argmax(1)
        switch = v[np.arange(live), top] - penalty
        stay[t, :live] = v >= switch[:, None]
        back[t, :live] = top
        value[:live] = np.maximum(v, switch[:, None]) + padded[t, :live]
    for j, i in enumerate(order):
        path = np.zeros(lengths[j], np.int16)
        if lengths[j]:
            now = finals[j]
            for t in range(lengths[j] - 1, -1, -1):
                path[t] = now
                if t and not stay[t, j, now]:
                    now = back[t, j]
        out[i] = path
    return out


def label(texts: list[str], model: Model, penalty: float = PENALTY) -> list[list[tuple[int, int, int, int]]]:
    """Spans (start, end, language, letters) of each text, neighbours of one language joined."""
    if not model.langs:
        return [[] for _ in texts]
    scores, starts, ends, doc = [], [], [], []
    group, index, held = [], [], 0

    def score_group() -> None:
        nonlocal group, index, held
        if group:
            w = Words([p for _, p in group])
            base = np.array([a for a, _ in group], np.int64)
            scores.append(model.score(w))
            starts.append(w.start - w.offset + base[w.doc])
            ends.append(w.end - w.offset + base[w.doc])
            doc.append(np.array(index, np.int64)[w.doc])
        group, index, held = [], [], 0

    for i, text in enumerate(texts):
        for at, piece in pieces(text):
            group.append((at, piece))
            index.append(i)
            held += len(piece)
            if held >= PIECE:
                score_group()
    score_group()
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not scores:
        return out
    score, start, end, of = np.concatenate(scores), np.concatenate(starts), np.concatenate(ends), np.concatenate(doc)
    best, stays = constant_path(score, of, len(texts), penalty)
    path = best[of].astype(np.int16)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    hard = [i for i in np.flatnonzero(~stays)]
    while hard:  # so many at once that the tables stay small
        take, cells = [], 0
        longest = max(edges[i + 1] - edges[i] for i in hard)
        while hard and (not take or cells + longest < 400_000):
            take.append(hard.pop())
            cells += longest
        for i, p in zip(take, viterbi([score[edges[i] : edges[i + 1]] for i in take], penalty)):
            path[edges[i] : edges[i + 1]] = p
    if len(of):
        cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (path[1:] != path[:-1])]))
        last = np.concatenate([cut[1:], [len(of)]]) - 1
        n = np.add.reduceat(end - start, cut)
        for a, z, k in zip(cut, last, n):
            out[of[a]].append((int(start[a]), int(end[z]), int(path[a]), int(k)))
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", examples: int = EXAMPLES, seed: int = 3) -> Model:
    """Learn from at most ``examples`` texts of each language, the first by a seeded hash of ``order``.

    Rows without text or language are not learned from. The model has a fixed size for each language.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    keys = rows.select(F.col(lang).alias("l"), F.col(order).alias("k")).withColumn("h", F.xxhash64(F.lit(seed), "k"))
    # only keys with a small hash can be among the first: of each language half as many again as are wanted are ranked
    share = F.least(F.lit(1.0), F.lit(1.5 * examples + 200) / F.count("*"))
    below = keys.groupBy("l").agg((share * 2.0**64 - 2.0**63).cast("long").alias("most")).withColumnRenamed("l", "__l")
    near = keys.join(F.broadcast(below), F.col("l") == F.col("__l")).filter("h <= most")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))).filter(F.col("r") <= examples)
    # ``examples`` keys of each language: few, so that the texts need not be moved
    limits = first.groupBy("l").agg(F.max(F.struct("h", "k")).alias("top"))
    cut = F.broadcast(limits.withColumnRenamed("l", "__l"))
    rows = rows.withColumn("__at", F.struct(F.xxhash64(F.lit(seed), F.col(order)).alias("h"), F.col(order).alias("k")))
    learned = rows.join(cut, F.col(lang) == F.col("__l")).filter("__at <= top")
    found = counts(learned, text, lang).toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + len(NAMES)))
    table[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"]
    return Model(langs, table)


RESULT = "lang string, score double, spans array<struct<start:int,end:int,lang:string>>"


def language(spark: SparkSession, text: str | Column, model: Model, penalty: float = PENALTY) -> Column:
    """Struct of the language with the most letters, the share of letters it has, and the spans of all languages.

    Null texts, texts without letters, and all texts under a model that learned nothing are ``und`` with score
    0 and no spans; ties go to the language first by name. Texts are read whole, in pieces.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts in batches:
            langs, shares, all_spans = [], [], []
            values = [t or "" for t in texts]
            at = 0
            while at < len(values):
                end, held_chars = at, 0
                while end < len(values) and (end == at or held_chars < 2 * PIECE):
                    held_chars += len(values[end])
                    end += 1
                for spans in label(values[at:end], m, penalty):
                    n = np.zeros(len(m.langs))
                    for _, _, k, letters_in in spans:
                        n[k] += letters_in
                    top = int(n.argmax()) if n.sum() else -1
                    langs.append(m.langs[top] if top >= 0 else "und")
                    shares.append(float(n[top] / n.sum()) if top >= 0 else 0.0)
                    all_spans.append([{"start": a, "end": z, "lang": m.langs[k]} for a, z, k, _ in spans])
                at = end
            yield pd.DataFrame({"lang": langs, "score": shares, "spans": all_spans})

    return identify.asNondeterministic()(text)

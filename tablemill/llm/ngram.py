"""Jaccard join of word shingle sets: universe-partition pigeonhole with one-deletion neighbourhoods, verified exactly."""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.common import HOT_ROWS, HOT_SHARE, Scratch, components, spread_join

#: Bands whose pairs differ in at most so many shingles use one-deletion neighbourhoods: there, segments that must be
#: equal would hold one or two shingles each and cost more pairs than the further signatures cost rows.
DELETIONS = 9
#: Most bits of the narrow parity map of a set, in longs of 64. Wide maps take about as many bits as the set has shingles.
LONGS = 32
#: Columns of the parity maps in the set's own band and in the band below.
NARROW, WIDE = ("bits", "lower"), ("wide", "wide_lower")
#: Signatures handed over at a time.
BATCH = 200_000
#: Signatures are matched in so many rounds, by hash: the shuffle of one round is gone before the next one's is written.
ROUNDS = 3
#: Most pairs of one class that are tried before all pairs of a signature are, and the most such trials.
TRIED, TRIALS = 8, 6
#: With so few pairs in a trial the groups left are small enough for all their pairs.
FEW_PAIRS = 1000
#: Trials end when fewer than one pair in so many links: then most pairs have to be compared anyway.
POOR = 32
#: One document in so many is looked at to find hot signatures.
SAMPLE = 64

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd factor between the words of a shingle; its powers are far apart in their low bits too.
STEP = np.uint64(0xD1342543DE82EF95)


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (splitmix64)."""
    x = x + MIX
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; of all words when there are fewer."""
    # on bytes, lower() and split() know A-Z and \x20, \x09-\x0D only, as the words are defined
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(w, dtype=object), categorize=False)
    n = min(words, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        total *= STEP
        total += h[k : len(w) - n + 1 + k]
    total = scramble(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def mixes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each shingle, which all bands share: one deals shingles to parts, the other is summed."""
    return scramble(tokens), scramble(tokens ^ np.uint64(0x51ED270B0A1F39C1))


@dataclass(frozen=True)
class Band:
    """How sets of sizes ``low`` to ``high`` are cut against equal or larger ones."""

    number: int
    low: int
    high: int
    differ: int  # largest symmetric difference of a linked pair whose smaller set is in the band
    segments: int
    deletions: bool
    spare: int  # segments a set may leave out; with deletions, units of two a segment


def band_of(size: int, percent: int) -> Band:
    """The band of a set size. Bands widen by the factor that links allow, so partners are in the same or the next one."""
    number, low = 0, 1
    while True:
        high = max(low, low * 100 // percent)
        if size <= high:
            break
        number, low = number + 1, high + 1
    # |r| = l and |s| <= l / t give |r xor s| = |r| + |s| - 2 |r and s| <= |s| - |r| * (2 t - 1) ... <= (1 - t) / t * l
    differ = high * (100 - percent) // percent
    if differ <= DELETIONS:
        # few shingles: a few large segments and their one-deletion neighbourhoods; units beyond differ + 1 are spare
        segments = differ // 2 + 2 if differ else 1
        return Band(number, low, high, differ, segments, differ > 0, 2 * segments - differ - 1 if differ else 0)
    spare = max(4, math.ceil(0.3 * (differ + 1)))
    return Band(number, low, high, differ, differ + 1 + spare, False, spare)


def parities(tokens: np.ndarray, band: Band, mixed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of the buckets of a band holds an odd number of the shingles, as longs: a narrow and a wide map.

    A shingle in one of two sets alone turns one bit, so their maps differ in no more bits than the sets in shingles.
    The wide map has the power of two next to the band's size; folded to ``LONGS`` longs it is the narrow one.
    """
    bits = 64 << max(0, math.ceil(band.high / 64) - 1).bit_length()
    mixed = mixed or mixes(tokens)
    odd = np.bincount((mixed[0] & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    wide = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return (np.bitwise_xor.reduce(wide.reshape(-1, LONGS)) if len(wide) > LONGS else wide), wide


class Bands:
    """Bands by number, made as they are needed."""

    def __init__(self, percent: int):
        self.percent, self.all = percent, []

    def at(self, number: int) -> Band:
        while len(self.all) <= number:
            self.all.append(band_of(self.all[-1].high + 1 if self.all else 1, self.percent))
        return self.all[number]

    def of(self, size: int) -> Band:
        while not self.all or self.all[-1].high < size:
            self.at(len(self.all))
        return self.all[bisect.bisect_left(self.all, size, key=lambda band: band.high)]


@functools.lru_cache(maxsize=4096)
def names(band: Band) -> np.ndarray:
    """One hash for each segment of a band."""
    return scramble(np.uint64(band.number << 32) + np.arange(band.segments, dtype=np.uint64))


def segments(tokens: np.ndarray, band: Band, mixed: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the segments of a set in a band and their tags; the universe is cut into ``segments`` parts by hash.

    A linked pair differs in at most ``differ`` shingles. A unit spent on a segment finds pairs that agree in it, two
    units also those that differ in one shingle of it; a pair found by none of the units of a set differs in as many
    shingles, so ``differ + 1`` units find every link. Which segments get them, ``allocated`` chooses by their cost.
    * With deletions each segment is there whole and with any one shingle left out. The tag is negative and holds
      segment, whether a shingle is left out, and the spare units.
    * Without, segments are there whole, and the tag is the number that may still be left out: empty segments are left
      out here, the first ones where there are more of them than spare ones, as every set does alike.
    """
    if not len(tokens):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    dealt, value = mixed or mixes(tokens)
    part = (dealt % np.uint64(band.segments)).view(np.int64)
    size = np.bincount(part, minlength=band.segments)
    sums = np.zeros(band.segments, np.uint64)
    np.add.at(sums, part, value)
    whole = scramble(sums) ^ names(band)
    if band.deletions:
        less = scramble(sums[part] - value) ^ names(band)[part]
        tags = np.concatenate([np.arange(band.segments) << 3, (part << 3) | 4])
        return np.concatenate([whole, less]), (-1 - (tags | band.spare)).astype(np.int32)
    empty = np.flatnonzero(size == 0)[: band.spare]
    return whole if not len(empty) else np.delete(whole, empty), np.array([band.spare - len(empty)], np.int32)


def signatures(tokens: np.ndarray, band: Band) -> np.ndarray:
    """The hashes of ``segments``: any two linked sets share one."""
    return segments(tokens, band)[0]


def sets(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """``id``, the size ``n`` of each set, a digest of it, its ``band``, its ``parities`` and its signatures.

    32 hexadecimal digits tell different sets apart. ``own`` are the signatures in the set's own band, ``other`` those
    in the band below, as a partner of smaller sets; ``NARROW`` and ``WIDE`` are the parity maps for the two. Bands whose
linked sets are equal need no signatures. ``own_tags`` and ``other_tags`` hold one tag for each signature or for all.
    Of equal sets that one task meets only the first gets maps and signatures, and none under a null id.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        nothing, untagged = np.zeros(0, np.int64), np.zeros(0, np.int32)
        seen: set[bytes] = set()

        def cut(tokens: np.ndarray, band: Band, mixed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            if not band.differ:
                return nothing, untagged
            signs, tags = segments(tokens, band, mixed)
            return signs.view(np.int64), tags

        for pdf in batches:
            rows, held = [], 0
            for i, t in zip(pdf["id"], pdf["text"]):
                tokens = shingles(t, words)
                own = other = (nothing, untagged)
                maps = below_maps = (nothing, nothing)
                number = -1
                sign = hashlib.md5(tokens.tobytes())
                if len(tokens):
                    band = bands.of(len(tokens))
                    number = band.number
                if len(tokens) and not pd.isna(i) and sign.digest() not in seen:
                    seen.add(sign.digest())
                    mixed = mixes(tokens)
                    own, maps = cut(tokens, band, mixed), parities(tokens, band, mixed)
                    # the smallest partner decides whether the band below is needed
                    if number and bands.at(number - 1).high * 100 >= percent * len(tokens):
                        below = bands.at(number - 1)
                        other, below_maps = cut(tokens, below, mixed), parities(tokens, below, mixed)
                rows.append((i, len(tokens), sign.hexdigest(), number, maps[0], below_maps[0], maps[1], below_maps[1], *own, *other))
                held += len(own[0]) + len(other[0])
                if held > BATCH:
                    yield frame(rows)
                    rows, held = [], 0
            if rows:
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "n", "digest", "band", *NARROW, *WIDE, "own", "own_tags", "other", "other_tags"]).astype({"id": "Int64"})

    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    longs = ", ".join(f"{c} array<long>" for c in (*NARROW, *WIDE))
    signs = ", ".join(f"{c} array<long>, {c}_tags array<int>" for c in ("own", "other"))
    return named.mapInPandas(sign, f"id long, n long, digest string, band int, {longs}, {signs}")


def index(found: DataFrame) -> DataFrame:
    """(sig, id, own, tag): one row for each signature of ``sets``."""

    def listed(column: str) -> DataFrame:
        tags = F.col(f"{column}_tags")
        rows = found.select("id", tags, F.posexplode(column).alias("i", "sig"))
        return rows.select("sig", "id", F.lit(column == "own").alias("own"), F.get(tags, F.when(F.size(tags) == 1, 0).otherwise(F.col("i"))).alias("tag"))

    return listed("own").union(listed("other"))


def less(tag: Column) -> Column:
    """1 for a segment without one of its shingles, 0 for a whole one."""
    return F.when(tag < 0, F.shiftright(-1 - tag, 2).bitwiseAND(1)).otherwise(0)


def units(tags: Iterable[int], whole: Iterable[int], short: Iterable[int]) -> list[int]:
    """How many units (0 to 2) the segment of each tag gets, so that the sets met are fewest and the spare units go.

    ``whole`` and ``short`` count the rows of each signature. One unit meets the sets whose whole segment is the same,
    two also those with one shingle more or less.
    """
    one, two = {}, {}
    spare = 0
    for tag, w, d in zip(tags, whole, short):
        code = -1 - int(tag)
        spare, part = code & 3, code >> 3
        if not code & 4:
            one[part] = one.get(part, 0) + int(w) - 1
        two[part] = two.get(part, 0) + (int(w) if code & 4 else int(w) - 1 + int(d))
    # the most that can be saved with each number of units left out, and how
    best = [(0, {})] + [(-1, {})] * spare
    for part in sorted(two):
        for left in range(spare, 0, -1):
            for cut in (1, 2):
                if cut <= left and best[left - cut][0] >= 0:
                    saved = best[left - cut][0] + (two[part] if cut == 2 else two[part] - one.get(part, 0))
                    if saved > best[left][0]:
                        best[left] = (saved, {**best[left - cut][1], part: cut})
    out = max(best, key=lambda b: b[0])[1]
    return [2 - out.get((-1 - int(tag)) >> 3, 0) for tag in tags]


def allocated(shared: DataFrame, several: DataFrame) -> DataFrame:
    """``shared`` with the ``units`` spent on each row; rows that no set has to look at are left out.

    * Without deletions all sets rank signatures alike, by the rows that bear them, and leave out the most frequent
      ones, as many as the tag says. Of the equal segments of a linked pair (more than either may leave out) the rarest
      is left out by neither.
    * With deletions ``units`` chooses; a set looks at all rows of its signatures, whatever the others chose.
    ``several`` are ids with several texts; they leave out nothing. Other groups hold one set's segments.
    """

    @F.pandas_udf("array<int>")
    def chosen(tags: pd.Series, whole: pd.Series, short: pd.Series) -> pd.Series:
        return pd.Series([units(*row) for row in zip(tags, whole, short)], dtype=object)

    plain = shared.join(several, "id", "left_anti")
    rarest_last = Window.partitionBy("id", "own").orderBy(F.desc("whole"), "sig")
    exact = plain.filter("tag >= 0").withColumn("rank", F.row_number().over(rarest_last)).filter("rank > tag").drop("rank")
    columns = ["sig", "tag", "whole", "short", "lead", "parted"]
    lists = plain.filter("tag < 0").groupBy("id", "own").agg(F.collect_list(F.struct(*columns)).alias("r"))
    lists = lists.withColumn("units", chosen("r.tag", "r.whole", "r.short"))
    near = lists.select("id", "own", F.explode(F.arrays_zip("r", "units")).alias("z")).select("id", "own", "z.r.*", "z.units")
    rest = shared.join(several, "id", "left_semi")
    order = ["sig", "id", "own", "tag", "lead", "parted", "units"]
    both = exact.unionByName(rest).withColumn("units", F.lit(2))
    return both.select(order).union(near.select(order)).withColumn("less", less(F.col("tag"))).drop("tag")


def fits(na: Column, nb: Column, ma: Column, mb: Column, percent: int) -> Column:
    """Whether sizes and the parity maps of one band leave room for a link; never false for a similar pair.

    Pairs link when (100 + percent) * |a xor b| <= (100 - percent) * (|a| + |b|), and neither the difference of the
    sizes nor that of the maps exceeds |a xor b|. A null map rules out nothing.
    """
    room = (100 - percent) * (na + nb)
    turned = F.aggregate(F.zip_with(ma, mb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return ma.isNull() | mb.isNull() | (((100 + percent) * F.abs(na - nb) <= room) & ((100 + percent) * F.coalesce(turned, F.lit(0)) <= room))


def plausible(pairs: DataFrame, found: DataFrame, percent: int, maps: tuple[str, str]) -> DataFrame:
    """The pairs (a, b) that fit by ``maps``; of sets in neighbouring bands the larger is seen as one of the lower band."""
    own, lower = maps
    for side in ("a", "b"):
        uses = pairs.groupBy(side).agg(F.count("*").alias("uses"))
        named = found.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "band", own, lower)])
        pairs = spread_join(pairs, named.join(uses, side), side, "uses", ["b" if side == "a" else "a"])
    seen = [F.when(F.col(f"band_{x}") > F.col(f"band_{y}"), F.col(f"{lower}_{x}")).otherwise(F.col(f"{own}_{x}")).alias(f"m_{x}") for x, y in ("ab", "ba")]
    pairs = pairs.select("a", "b", "n_a", "n_b", *seen)
    return pairs.filter(fits(*(F.col(c) for c in ("n_a", "n_b", "m_a", "m_b")), percent)).select("a", "b")


def neighbours(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) for a trial: of the ``rows`` of a signature those next to each other by some bits of their maps.

    Sets that differ in few shingles come together where none of these bits differs; every turn looks at others. No more than ``TRIED`` for each a. What the signature leaves out does not matter for a trial. Frequent signatures are cut at random into parts of about ``HOT_ROWS`` rows.
    """
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("rows") / HOT_ROWS)))
    some_bits = F.transform("m", lambda x, i: x.bitwiseAND(F.xxhash64(F.lit(turn), i)).bitwiseAND(F.xxhash64(i, F.lit(turn))))
    beside = Window.partitionBy("sig", "part").orderBy(some_bits, F.xxhash64("comp", F.lit(turn)), "id")
    columns = ["id", "own", "comp", "n", "m"]
    ahead = F.lead(F.struct(*columns)).over(beside).alias("y")
    pairs = rows.select(*columns, ahead).filter("y.comp <> comp and (own or y.own)")
    pairs = pairs.filter(fits(*(F.col(c) for c in ("n", "y.n", "m", "y.m")), percent))
    pairs = pairs.select(F.least("id", "y.id").alias("a"), F.greatest("id", "y.id").alias("b")).distinct()
    some = Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(turn)), "b")
    return pairs.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= TRIED).drop("rank")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by exact intersection; ``texts`` has texts that may be of the set ``id``."""
    scratch = Scratch(texts.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                sets = [shingles(t, words) for t in part["text"]]
                digests = [hashlib.md5(s.tobytes()).hexdigest() for s in sets]
                yield pd.DataFrame({"id": part["id"], "digest": digests, "s": [s.view(np.int64) for s in sets]})

    built = texts.distinct().mapInPandas(build, "id long, digest string, s array<long>")
    # the document that names a class may hold other texts too
    found = scratch.settle(built.filter(F.col("id") == set_class()).select("id", "s"), "sets")
    left = pairs.groupBy("a").agg(F.count("*").alias("n"))
    ready = found.join(left.withColumnRenamed("a", "id"), "id").select(F.col("id").alias("a"), F.col("s").alias("sa"), "n")
    second = found.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    rights = pairs.groupBy("b").agg(F.count("*").alias("n"))
    half = spread_join(pairs, second.join(rights, "b"), "b", "n", ["a"])
    both = spread_join(half, ready, "a", "n", ["b"])
    shared = F.size(F.array_intersect("sa", "sb"))
    links = both.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b").distinct()
    links = scratch.settle(links, "links")
    scratch.drop(found)
    return links


def set_class() -> Column:
    """Number of the class of equal sets."""
    return F.xxhash64("digest")


def linked_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """Sets of word shingles and the components of the graph of similar ones: id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union|. One row for each distinct id.
    * Equal sets form a class by digest and are never compared. Signatures, maps and pairs are those of classes, so
      no table of sets is joined to find its copies; at the end a class is named by its smallest id.
    * A signature that two sets share makes them candidates. The rows of each signature are counted, and every set
      spends its units on the segments that cost least (``allocated``), so that a passage of many unlike documents
      makes no candidates where their own shingles suffice.
    * First only the smallest class of each signature is compared with the others of it, which joins nearly all
      members of a group of copies in one step.
    * While many classes of a signature are in different components, each is tried with a few of the others, so that
      a large group of near copies joins by a few pairs for each member (``neighbours``), not by all pairs.
    * Then every pair of classes of a signature whose components still differ is compared: whatever was not
      joined yet is, so no link between components is missed. Signatures whose classes all joined drop out.
    Frequent signatures are cut into salted parts before their smallest class is found, and joined in blocks.
    Documents without words (or null) have size 0 and link with nothing; a null id is a row of its own without
    component; an id that repeats is one document with the union of the links of its texts.
    """
    scratch = Scratch(docs.sparkSession)

    def checked(pairs: DataFrame, *rounds: tuple[str, str]) -> DataFrame:
        ids = scratch.settle(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "use")
        maps = scratch.settle(maps_of.join(ids, "id", "left_semi"), "few")
        likely = pairs
        for columns in rounds:
            before, likely = likely, scratch.settle(plausible(likely, maps, percent, columns), "likely")
            if before is not pairs:
                scratch.drop(before)
        scratch.drop(ids, maps)
        ids = scratch.settle(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "use")
        bearers = scratch.settle(ids.join(classes, "id").select("id", F.col("class").alias("doc")), "bearers")
        texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).join(bearers, "doc").select("id", "text")
        out = verified(likely, texts, words, percent)
        scratch.drop(likely, ids, bearers)
        return out

    signed = scratch.settle(sets(docs, key, text, words, percent), "sets")
    meta = scratch.settle(signed.select("id", "n", set_class().alias("class")), "meta")
    sizes = meta.groupBy("id").agg(F.max("n").alias("n_shingles"))
    known = meta.filter("n > 0 and id is not null").select(F.col("id").alias("doc"), F.col("class").alias("id"))
    classes = scratch.settle(known.groupBy("id").agg(F.min("doc").alias("class"), F.count("*").alias("n")), "classes")
    member = spread_join(known, classes.filter("n > 1"), "id", "n", ["doc"]).filter("doc <> class").select("class", F.col("doc").alias("id"))
    member = scratch.settle(member.distinct(), "member")

    single = signed.withColumn("id", set_class()).filter((F.size("own") > 0) | (F.size("other") > 0))
    maps_of = scratch.settle(single.select("id", "n", "band", *NARROW, *WIDE).dropDuplicates(["id"]), "maps")
    total = meta.count()
    limit = max(HOT_ROWS, int(total * HOT_SHARE) + 1)
    # a signature of a large group is hot; a sample shows which, and its rows are spread over parts by id. The list
    # has at most (mean signatures of a document) / HOT_SHARE rows. Its counts stand for all rows of the signature.
    few = index(single.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)).distinct()
    removed = less(F.col("tag"))
    hot = few.groupBy("sig").agg(F.count("*").alias("n"), F.sum(removed).alias("hot_short")).filter(F.col("n") * SAMPLE > limit)
    hot = hot.select("sig", F.ceil(F.col("n") * SAMPLE / limit).cast("int").alias("cuts"), *[(c * SAMPLE).alias(a) for c, a in ((F.col("n") - F.col("hot_short"), "hot_whole"), (F.col("hot_short"), "hot_short"))])
    hot = scratch.settle(hot, "hot")
    every = Window.partitionBy("sig", "part")
    least_own = F.min(F.when(F.col("own"), F.col("id")))
    matched = []
    for turn in range(ROUNDS):
        rows = index(single).filter(F.pmod("sig", F.lit(ROUNDS)) == turn).join(F.broadcast(hot.select("sig", "cuts")), "sig", "left")
        rows = rows.withColumn("part", F.when(F.col("cuts").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), "cuts")).cast("int")).drop("cuts")
        # equal sets of several tasks meet here
        rows = rows.repartition("sig", "part").dropDuplicates(["sig", "part", "id", "own", "tag"])
        counts = {"whole": F.count(F.when(removed == 0, 1)), "short": F.count(F.when(removed == 1, 1)), "lead": least_own}
        rows = rows.withColumns({name: count.over(every) for name, count in counts.items()})
        meets = F.when(removed == 1, F.col("whole") > 0).otherwise((F.col("whole") > 1) | (F.col("short") > 0))
        rows = rows.filter((meets & F.col("lead").isNotNull()) | (F.col("part") >= 0)).join(F.broadcast(hot.drop("cuts")), "sig", "left")
        counted = [F.coalesce(f"hot_{c}", c).alias(c) for c in ("whole", "short")]
        matched.append(scratch.settle(rows.select("sig", "id", "own", "tag", *counted, "lead", (F.col("part") >= 0).alias("parted")), "shared"))
    # a class has one set, so none holds several
    shared = scratch.settle(allocated(functools.reduce(DataFrame.union, matched), classes.filter("false").select("id")), "allocated")
    scratch.drop(signed, hot, *matched)
    # the parts of a hot signature have a lead each; the list of hot signatures bounds this table
    leads = scratch.settle(shared.filter("parted").groupBy("sig").agg(least_own.alias("first")), "leads")
    first = shared.join(F.broadcast(leads), "sig", "left").withColumn("lead", F.when(F.col("parted"), F.col("first")).otherwise(F.col("lead")))
    first = first.filter("id <> lead and units > less").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    first = scratch.settle(first, "pairs")
    links = checked(first, NARROW, WIDE)
    scratch.drop(leads)

    def still_open(links: DataFrame, rows: DataFrame) -> DataFrame:
        """``rows`` with their components under the links so far, of signatures that several components bear."""
        joined = scratch.settle(components(links, "a", "b"), "joined")
        placed = rows.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        borne = placed.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).filter("x < y")
        placed = scratch.settle(placed.join(borne.drop("x", "y"), "sig"), "open")
        scratch.drop(joined)
        return placed

    placed = still_open(links, shared.select("sig", "id", "own", "units", "less"))
    scratch.drop(shared)
    # a signature stands for one band, so its rows carry the maps of that band and pairs are ruled out where they meet
    seen = F.when(F.col("own"), F.col("bits")).otherwise(F.col("lower")).alias("m")
    tried, found_links = [first], [links]
    for turn in range(TRIALS):
        carried = placed.join(maps_of, "id").select("sig", "id", "own", "comp", "rows", "n", seen)
        some = neighbours(carried, turn, percent).join(functools.reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
        some = scratch.settle(some, "pairs")
        size = some.count()
        if size <= FEW_PAIRS:
            scratch.drop(some)
            break
        tried.append(some)
        found_links.append(checked(some, WIDE))
        before, placed = placed, still_open(functools.reduce(DataFrame.union, found_links), placed.drop("comp", "rows"))
        scratch.drop(before)
        if POOR * found_links[-1].count() < size:
            break
    mapped = placed.join(maps_of, "id").select("sig", "id", "own", "comp", "units", "less", "n", seen)
    one, two = mapped.filter("units > less").alias("p"), mapped.alias("q")
    found_by = (F.col("p.less") + F.col("q.less") <= 1) & (F.col("p.units") > F.col("p.less") + F.col("q.less"))
    rest = one.join(two, (F.col("p.sig") == F.col("q.sig")) & (F.col("p.id") < F.col("q.id")) & (F.col("p.comp") != F.col("q.comp")) & (F.col("p.own") | F.col("q.own")) & found_by)
    rest = rest.filter(fits(*(F.col(c) for c in ("p.n", "q.n", "p.m", "q.m")), percent))
    rest = rest.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct().join(functools.reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
    rest = scratch.settle(rest, "pairs")
    scratch.drop(placed, *tried)
    more = checked(rest, WIDE)
    scratch.drop(rest, maps_of)
    found = functools.reduce(DataFrame.union, [*found_links, more])
    for side in ("a", "b"):
        found = found.join(classes.select(F.col("id").alias(side), F.col("class").alias(f"name_{side}")), side)
    found = found.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).union(member.select(F.col("class").alias("a"), F.col("id").alias("b")))
    final = components(found, "a", "b")
    out = sizes.join(final.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))

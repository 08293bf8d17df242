"""Jaccard self-join of word shingles by grouped prefixes, and the components of its links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import Words, components, mix, read, table, text_slices

#: Frequent shingles and words that order the others: at most this many of each (16 bytes each are broadcast). Any order gives
#: the same links.
MOST_FREQUENT = 500_000
#: Tokens that a task counts at once; beyond them those seen once go.
MOST_COUNTED = 1 << 20
#: Documents of a task that must hold a token for it to be reported as frequent.
OFTEN = 3
#: Rows of keys (24 bytes each) up to which they are broadcast.
MOST_BROADCAST = 200_000
#: Classes that a task remembers, so that copies carry no prefix.
MOST_SEEN = 100_000
#: Classes that a class is compared with before the full join, and leads of its own that each list of CROWD groups has.
LEADS = 2
OWN_LEADS = 4
CROWD = 16
#: Tokens before one in its group's prefix that go with it, so that a pair isn't made again at each token it shares.
BEFORE = 4
#: Longs of a set's parity bitmap, at most, and of those, how many go with each shingle of a prefix.
BITMAP, BESIDE = 256, 8
_NO_ID = -(1 << 63)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """Runs of whole texts of a few MB: (first row, rows, their words, the words' hashes). All work goes run by run, so memory
    follows a run and the longest text, not the rows of a batch."""
    for row, n, data, offsets in text_slices(column, most=2 << 20):
        words = Words(data, offsets)
        yield row, n, words, words.hashes()


def _sets_of(n: int, words: Words, h: np.ndarray, width: int, weight: np.ndarray | None = None) -> Iterator:
    """Each text's distinct shingle hashes, sorted. A text of fewer words than ``width``, but not none, is one shingle.

    With ``weight`` (of each word) also the sum of the weights of each shingle's words.
    """
    many = max(0, len(h) - width + 1)
    joined, heavy = np.zeros(many, np.uint64), np.zeros(many, np.float32)
    for k in range(width):
        joined = mix(joined * _P2 + h[k : many + k] * _P1 + np.uint64(k))
        if weight is not None:
            heavy += weight[k : many + k]
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= width:
            if weight is None:
                yield np.unique(joined[a : b - width + 1])
            else:
                own, at = np.unique(joined[a : b - width + 1], return_index=True)
                yield own, heavy[a + at]
        else:
            short = np.zeros(0, np.uint64)
            if b > a:
                short = _P3 * np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    short = mix(short * _P2 + h[k : k + 1] * _P1)
            yield short if weight is None else (short, np.zeros(len(short), np.float32))


def parity(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Longs, a power of two of them; a bit is set if an odd number of the hashes falls on it.

    There are enough that sets of this size that are somewhat less alike than ``percent`` differ in more bits than it allows elements.
    """
    apart = 2 * len(hashes) * (100 - percent) / (100 + percent)
    longs = 2
    while longs < BITMAP and 32 * longs < 4 * apart + 20:
        longs *= 2
    odd = np.bincount((hashes & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near_enough(x: str, y: str, apart: Column, percent: int) -> Column:
    """Whether sets with sizes ``n`` of the frames named x and y that differ in at least ``apart`` elements may be alike enough."""
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    return F.coalesce((100 + percent) * (n - apart) >= 2 * percent * n, F.lit(True))


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sets with columns ``n`` and ``bits`` of the frames named x and y may be alike enough.

    Two sets differ in at least as many elements as their parity bitmaps in bits, so no link is lost. Without a bitmap, or
    with bitmaps of different lengths: yes.
    """
    bits = F.zip_with(f"{x}.bits", f"{y}.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("long"))
    return _near_enough(x, y, F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s + b), percent)


def may_link_early(x: str, y: str, percent: int) -> Column:
    """The same by the first BESIDE longs alone, term by term: it stays within generated code."""
    apart = reduce(add, (F.coalesce(F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseXOR(F.get(f"{y}.bits", F.lit(i)))), F.lit(0)) for i in range(BESIDE)))
    return F.when(F.col(f"{x}.longs") == F.col(f"{y}.longs"), _near_enough(x, y, apart, percent)).otherwise(F.lit(True))


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list for each array."""
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def frequent(docs: DataFrame, width: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Common shingles (hashes, sorted, and ranks, rare to frequent) and common words (hashes, sorted, and logarithms of counts).

    Every text is counted. A task sums its counts before anything is shuffled; what fewer than OFTEN of its documents hold is
    not reported, and beyond MOST_COUNTED tokens those counted once so far are dropped. The two lists only put shingles in an
    order in which prefixes are rare ones, by their words, but common shingles last; any order gives the same links.
    """

    def merged(token: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        new, m = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        token, place = np.unique(np.concatenate((token, new)), return_inverse=True)
        n = np.bincount(place, np.concatenate((n, m)), len(token)).astype(np.int64)
        if len(token) > MOST_COUNTED:
            token, n = token[n > 1], n[n > 1]
        return token, n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {size: (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for size in (width, 1)}
        for batch in batches:
            for _, n, words, h in _slices(batch.column(0)):
                for size in seen:
                    seen[size] = merged(*seen[size], list(_sets_of(n, words, h, size)))
        for kind, size in (("shingle", width), ("word", 1)):
            token, n = seen[size]
            token, n = token[n >= OFTEN].view(np.int64), n[n >= OFTEN]
            yield pa.record_batch([pa.array([kind] * len(token), pa.string()), pa.array(token), pa.array(n)], names=["kind", "token", "n"])

    counted = table(docs.select("text").mapInArrow(count, "kind string, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")))
    lists = []
    for kind in ("shingle", "word"):
        top = counted.where(F.col("kind") == kind).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token", "n").toArrow()
        token, n = top.column("token").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
        order = np.argsort(token)
        value = np.arange(len(token), 0, -1, dtype=np.uint64) if kind == "shingle" else np.log2(n + 1.0).astype(np.float32)
        lists.append((token[order], value[order]))
    return lists[0], lists[1]


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, cid, gid, prefix, common, bits) of each row: a set's size and digest, the digest of prefix and
    size, the prefix, how many of the prefix, at its end, are common shingles, and the parity bitmap.

    Of the rows of a task with equal sets, up to MOST_SEEN sets, only the first has prefix and bitmap; the others have null.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))
    names = ["doc_id", "text_hash", "n", "cid", "gid", "prefix", "common", "bits"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, ranks), (ordinary, rarity) = known.value
        seen: set[bytes] = set()
        for batch in batches:
            for row, rows, words, h in _slices(batch.column(1)):
                weight = np.zeros(len(h), np.float32)
                if len(ordinary) and len(h):
                    at = np.minimum(np.searchsorted(ordinary, h), len(ordinary) - 1)
                    weight = np.where(ordinary[at] == h, rarity[at], 0).astype(np.float32)
                n, cid, gid, prefixes, common, bits, again = [], [], [], [], [], [], []
                for s, heavy in _sets_of(rows, words, h, width, weight):
                    keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    place = heavy.astype(np.float64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        place = np.where(often[at] == s, 1e6 + ranks[at], place)
                    order = np.argsort(place, kind="stable")[:keep]  # equal places by hash
                    digest = _digest(s.tobytes())
                    n.append(len(s))
                    cid.append(digest)
                    gid.append(int.from_bytes(_digest(len(s).to_bytes(8, "little"), s[order].tobytes())[:8], "little", signed=True))
                    again.append(digest in seen)
                    prefixes.append(s[:0].view(np.int64) if again[-1] else s[order].view(np.int64))
                    common.append(int((place[order] >= 1e6).sum()))
                    bits.append(np.zeros(0, np.int64) if again[-1] else parity(s, percent))
                    if len(seen) < MOST_SEEN:
                        seen.add(digest)
                empty = pa.array(again)
                own = batch.slice(row, rows)
                blank = lambda lists, empty=empty: pc.if_else(empty, pa.scalar(None, lists.type), lists)
                yield pa.record_batch(
                    [own.column(0), own.column(2), pa.array(n, pa.int32()), pa.array(cid, pa.binary()), pa.array(gid, pa.int64()),
                     blank(_lists(prefixes, pa.int64())), pa.array(common, pa.int32()), blank(_lists(bits, pa.int64()))],
                    names=names,
                )

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(sign, "doc_id long, text_hash long, n int, cid binary, gid long, prefix array<long>, common int, bits array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, set) of the classes ``wanted`` (cid, label, text_hash); label and text_hash are those of a row that has the set.

    A class whose row is repeated comes more than once.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, words, h in _slices(batch.column(0)):
                sets = list(_sets_of(n, words, h, width))
                yield pa.record_batch([pa.array([_digest(s.tobytes()) for s in sets], pa.binary()), _lists([s.view(np.int64) for s in sets], pa.int64())], names=["cid", "set"])

    keys = wanted.select(F.coalesce("label", F.lit(_NO_ID)).alias("key"), "text_hash").distinct()
    if wanted.count() <= MOST_BROADCAST:
        keys = F.broadcast(keys)
    own = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), "text", F.xxhash64("text").alias("text_hash")).join(keys, ["key", "text_hash"], "left_semi")
    return own.select("text").mapInArrow(build, "cid binary, set array<long>")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that their bitmaps allow to link."""
    of = lambda name, end: classes.select(F.col("cid").alias(end), F.struct("n", "bits").alias(name))
    return pairs.join(of("x", "a"), "a").join(of("y", "b"), "b").where(may_link("x", "y", percent)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b, ...) of classes whose sets are at least ``percent`` alike."""
    pairs = table(pairs.distinct())
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    built = table(_sets(docs, table(ids.join(classes.select("cid", "label", "text_hash"), "cid")), width))
    sets = built.dropDuplicates(["cid"])  # its partitioning is the joins'
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return table(both.where((100 + percent) * common >= percent * (F.size("set_a") + F.size("set_b"))).select(pairs["*"]))


def _lists_of_two(tokens: DataFrame, percent: int) -> DataFrame:
    """The distinct ``tokens`` (token, gid, n, early, common) that more than one group holds, with the length of the list (df) and
    the group (lead) that has the least gid.

    Lists of one are the most by far and go first. With them go, from lists of rare shingles, groups with no other of a size
    that allows a link beside them: if neither the next smaller nor the next larger size does, none does. A common shingle's list may be long: its lead comes from partial
    aggregates and is broadcast (there are at most MOST_FREQUENT of them), so its rows stay where they are.
    """
    within = Window.partitionBy("token")
    ends = {"lead": F.min(F.struct("gid", "n")), "last": F.max("gid"), "df": F.count("*")}
    by_size = within.orderBy("n")
    rare = tokens.where("not common").select("*", F.lag("n").over(by_size).alias("below"), F.lead("n").over(by_size).alias("above"))
    rare = rare.select("*", *(f.over(within).alias(a) for a, f in ends.items()))
    rare = rare.where((F.col("below") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("above") * percent)).drop("below", "above")
    usual = tokens.where("common")
    usual = usual.join(F.broadcast(usual.groupBy("token").agg(*(f.alias(a) for a, f in ends.items()))), "token")
    # each part for itself: the first is dealt by token already
    several = lambda rows: rows.where("lead.gid <> last").drop("last").dropDuplicates(["token", "gid"])
    return several(rare).unionByName(several(usual))


def _led(placed: DataFrame, percent: int) -> DataFrame:
    """(ga, gb): each group of a list with OWN_LEADS groups of it, drawn for each list anew, if sizes and bitmaps allow a link.

    Very many near copies share many lists, so that each of them meets many others, though no list has more pairs than rows.
    """
    side = ["gid", "n", "bits", "longs"]
    within = Window.partitionBy("token")
    lead = [F.min(F.struct(F.xxhash64("gid", "token", F.lit(k)).alias("drawn"), *side)) for k in range(OWN_LEADS)]
    usual = placed.where("common")
    rows = (
        placed.where("not common")
        .select(F.struct(*side).alias("x"), F.array(*(f.over(within) for f in lead)).alias("leads"))
        .unionByName(usual.join(usual.groupBy("token").agg(F.array(*lead).alias("leads")), "token").select(F.struct(*side).alias("x"), "leads"))
    )
    alike = (F.col("y.n") * 100 >= F.col("x.n") * percent) & (F.col("x.n") * 100 >= F.col("y.n") * percent)
    met = rows.select("x", F.explode("leads").alias("y")).where((F.col("x.gid") != F.col("y.gid")) & alike & may_link_early("x", "y", percent))
    return met.select(F.greatest("x.gid", "y.gid").alias("ga"), F.least("x.gid", "y.gid").alias("gb")).distinct()


def _meetings(placed: DataFrame, percent: int) -> DataFrame:
    """(ga, gb), some more than once, of groups of different components, or without one, that share a shingle of ``placed``, if sizes and bitmaps allow a link.

    Of each list, the rows of its largest component are paired only with the other rows: among themselves none can link
    what is not linked yet, so a component of very many near copies costs no pairs of its own.

    A pair is left to an earlier token if both groups have one among the BEFORE tokens before this one, early ones first: there
    the same conditions hold, so each pair is made at the first of its shared tokens and, of those after it, at few.
    """
    own = Window.partitionBy("gid").orderBy(F.desc("early"), "token").rowsBetween(-BEFORE, -1)
    placed = placed.withColumn("before", F.collect_list("token").over(own))
    within = Window.partitionBy("token")
    top = F.max(F.struct("grown", "comp"))
    rare = placed.where("not common").withColumn("top", top.over(within).getField("comp"))
    usual = table(placed.where("common"))
    tops = usual.groupBy("token").agg(top.getField("comp").alias("top"))
    usual = usual.join(F.broadcast(tops), "token")
    found = []
    for rows in (rare, usual):
        rest = F.col("comp").isNull() | F.col("top").isNull() | (F.col("comp") != F.col("top"))
        rows = rows.withColumn("rest", rest)
        x, y = rows.alias("x"), rows.where("rest").alias("y")
        once = ~F.col("x.rest") | (F.col("x.gid") > F.col("y.gid"))
        apart = F.col("x.comp").isNull() | F.col("y.comp").isNull() | (F.col("x.comp") != F.col("y.comp"))
        # the smaller set's first common shingle is early enough for all that must follow, also if the sizes are equal
        lower = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.gid") < F.col("y.gid")))
        early = F.when(lower, F.col("x.early")).otherwise(F.col("y.early"))
        alike = (F.col("y.n") * 100 >= F.col("x.n") * percent) & (F.col("x.n") * 100 >= F.col("y.n") * percent)
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & once & apart & early & alike & ~F.arrays_overlap("x.before", "y.before") & may_link_early("x", "y", percent))
        found.append(met.select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")))
    return found[0].unionByName(found[1])


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, cid, component, component_id) for every row of ``docs`` (doc_id, text).

    Two documents link when their sets of ``width``-word shingles are at least ``percent`` percent alike; component_id is the
    smallest doc_id reachable by links, and ``component`` names the component. Sets are of 64-bit hashes; texts without words
    link with nothing and have neither class nor component name.

    Equal sets are one class. Classes of equal size and equal prefix (the rarest shingles, of which two linked sets share
    at least one) are one group. Groups that share a prefix shingle are paired if their sizes and parity bitmaps allow a link. Pairs
    expand to their classes, of which those that the bitmaps allow are verified on the whole sets.

    A shingle list or group of thousands of near copies would give all its pairs. So each list first links its members to
    its first one alone, a long list also to a few drawn ones, and what that connects is verified. The full join then takes only pairs of classes that are still in
    different components, for which no link is lost: within a component none can change the result.

    Defined results: null text has no words (n_shingles 0, component_id its own doc_id); a null doc_id has its component's
    smallest doc_id, or null if there is none; repeated rows are rows of their own; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = table(signatures(docs, width, percent))
    worded = signed.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    classes = table(
        worded.groupBy("cid")
        .agg(first.alias("at"), F.first("n").alias("n"), F.first("gid").alias("gid"), F.first("bits", True).alias("bits"))
        .select("cid", F.col("at.doc_id").alias("label"), F.col("at.text_hash").alias("text_hash"), "n", "gid", "bits")
    )
    members = classes.select("gid", "cid", "n", "bits")
    groups = classes.groupBy("gid").agg(F.first("n").alias("n"), F.min("cid").alias("cid"), F.count("*").alias("m"))
    # copies in other tasks bring a prefix again: those go where lists are formed
    tokens = worded.where("prefix is not null").select("gid", "n", (F.size("prefix") - F.col("common")).alias("rare"), F.posexplode("prefix").alias("pos", "token"))
    early = F.col("pos") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent))
    live = table(_lists_of_two(tokens.select("token", "gid", "n", early.alias("early"), (F.col("pos") >= F.col("rare")).alias("common")), percent))

    alike = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)  # noqa: E731  sizes that allow a link
    stars = live.where((F.col("gid") != F.col("lead.gid")) & alike(F.col("n"), F.col("lead.n")))
    stars = stars.groupBy(F.col("lead.gid").alias("ga"), F.col("gid").alias("gb")).agg(F.count("*").alias("c"), F.first("n").alias("n")).where("c * 40 >= n")
    # of a class's leads, those that share most of its prefix
    stars = stars.groupBy("gb").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "ga")), asc=False), 1, LEADS).alias("leads"))
    first_of = groups.select("gid", "cid")
    # a group of one class has its bitmap
    lone = classes.groupBy("gid").agg(F.when(F.count("*") == 1, F.first("bits")).alias("bits"))
    crowd = live.where(F.col("df") >= CROWD).select("token", "gid", "n", "common").join(lone.select("gid", F.slice("bits", 1, BESIDE).alias("bits"), F.size("bits").alias("longs")), "gid")
    stars = (
        stars.select(F.explode("leads.ga").alias("ga"), "gb")
        .union(_led(crowd, percent))
        .distinct()
        .join(first_of.select(F.col("gid").alias("ga"), F.col("cid").alias("a")), "ga")
        .join(first_of.select(F.col("gid").alias("gb"), F.col("cid").alias("b")), "gb")
    )
    crowded = groups.where("m > 1").select("gid", F.col("cid").alias("a"))
    inside = members.join(crowded, "gid").select("a", F.col("cid").alias("b")).where("a <> b")
    first_links = _verified(_possible(table(stars.select("a", "b").union(inside)), classes, percent), docs, classes, width, percent)
    found = components(first_links)
    of_class = table(members.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("gid", "cid", "n", "bits", F.coalesce("component", "cid").alias("comp")))
    # a group whose classes are in several components has none; such groups are paired with all. A group of one class has its bitmap
    sizes = found.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("grown"))
    of_group = of_class.groupBy("gid").agg(
        F.when(F.min("comp") == F.max("comp"), F.min("comp")).alias("comp"), F.when(F.count("*") == 1, F.first("bits")).alias("bits")
    )
    # 64 bits of a component's name are enough to tell two apart
    of_group = table(
        of_group.join(sizes, "comp", "left").select(
            "gid", F.when(F.col("comp").isNotNull(), F.xxhash64("comp")).alias("comp"), F.coalesce("grown", F.lit(1)).alias("grown"), F.slice("bits", 1, BESIDE).alias("bits"), F.size("bits").alias("longs")
        )
    )

    group_pairs = table(_meetings(live.drop("lead", "df").join(of_group, "gid"), percent).distinct())
    own = of_group.where("comp is null").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    ca = of_class.select(F.col("gid").alias("ga"), F.col("cid").alias("a"), F.col("comp").alias("comp_a"), F.struct("n", "bits").alias("p"))
    cb = of_class.select(F.col("gid").alias("gb2"), F.col("cid").alias("b"), F.col("comp").alias("comp_b"), F.struct("n", "bits").alias("q"))
    # the bitmaps decide inside the join, so that what can't link is never a row
    differ = (F.col("gb") == F.col("gb2")) & (F.col("comp_a") != F.col("comp_b")) & ((F.col("ga") != F.col("gb")) | (F.col("a") < F.col("b")))
    pairs = group_pairs.union(own).join(ca, "ga").join(cb, differ & may_link("p", "q", percent)).select("a", "b", "comp_a", "comp_b")
    more = _verified(pairs, docs, classes, width, percent)

    # what the second round links are components of the first
    wider = components(more.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    component = of_class.join(wider.select(F.col("node").alias("comp"), "component"), "comp", "left").select("cid", F.coalesce("component", "comp").alias("component"))
    labelled = classes.select("cid", "label").join(component, "cid")
    least = labelled.groupBy("component").agg(F.min("label").alias("component_id"))
    own_least = labelled.select("cid", "component").join(least, "component")
    return (
        signed.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
        .join(own_least, "cid", "left")
        .select("doc_id", "text_hash", "n_shingles", "cid", "component", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of ``similar``: its smallest doc_id, of equal ones the smallest text hash, of
    rows equal in both the one whose digest of all columns is smallest.

    Texts without words all stay. A null doc_id comes after all others. The rows that go are joined against the documents,
    broadcast up to MOST_BROADCAST of them.
    """
    found = table(similar(docs, width, percent).where("n_shingles > 0").select("doc_id", "text_hash", "component"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    first = found.groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    keys = found.join(first, "component").groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).alias("stays")
    )
    gone = table(keys.where("not stays or n > 1"))
    side = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    name = "_text_hash"
    while name in docs.columns:
        name += "_"
    hashed = docs.withColumn(name, F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{name}") == F.col("g.text_hash"))
    rest = hashed.join(side.alias("g"), same, "left_anti").drop(name)
    # of repeated rows one stays; which one is told by all that it holds, so that reruns agree
    told = F.xxhash64(F.lit(0), *[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = hashed.join(side.where("stays").alias("g"), same, "left_semi").groupBy("doc_id", name).agg(F.min_by(row, told).alias("row"))
    return rest.unionByName(again.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return similar(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")

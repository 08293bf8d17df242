"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping shards and searched from medoids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import components, mix, read, table

#: Vectors of a shard that are aimed at; a shard of more than twice as many is split again.
SHARD = 1_000
FAN = 64
#: A vector also goes to shards that it is this much less like than the nearest one, over all splits, at most so many in all.
MARGIN = 0.06
OVERLAP = 3
#: Centres of all splits, which are broadcast; where they call for more, shards grow instead.
MOST_CENTRES = 1 << 17
DEGREE = 24
ALPHA = 1.2
BEAM = 24
#: Classes with copies up to which they are broadcast to find their rows.
MOST_COPIED = 100_000
#: Times the vectors of a shard that a block holds where all are compared with all.
BLOCK = 8
AUDITED = 64
#: Classes without a found link that are audited for each one with links: a lost link shows there, and few of them have one.
AUDITED_BARE = 8
LEAST_RECALL = 0.95


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _digests(cids: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(np.asarray(cids, object), categorize=False)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cid) of all rows, cid null where nothing can link; (cid, shard, vec, m, least) of the distinct label and vector.

    Neither is written: whoever uses them reads ``vectors`` again. Of the vectors only those that have copies are grouped.
    """
    size = F.size("embedding")
    top, low = F.array_max("embedding"), F.array_min("embedding")
    good = (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull())
        & (top < float("inf"))  # NaN is above
        & (low > float("-inf"))
        & ((top != 0) | (low != 0))
    )
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("label", "embedding"), F.xxhash64("embedding", "label", F.lit(1)))]
    digest = F.substring(F.base64(F.unhex(F.concat(*halves))), 1, 22)
    keyed = vectors.select("vec_id", "label", "embedding").withColumn("cid", F.when(F.coalesce(good, F.lit(False)), digest))
    rows = keyed.where("cid is not null").select(
        "cid", F.concat_ws(":", F.col("label").cast("string"), size.cast("string")).alias("shard"), F.col("embedding").alias("vec"), "vec_id"
    )
    several = table(rows.groupBy("cid").agg(F.count("*").alias("m"), F.min("vec_id").alias("least")).where("m > 1"))
    if several.count() <= MOST_COPIED:
        known = F.broadcast(several)
        alone = rows.join(known, "cid", "left_anti").select("cid", "shard", "vec", F.lit(1).cast("long").alias("m"), F.col("vec_id").alias("least"))
        copied = rows.join(known.select("cid"), "cid")
    else:
        alone, copied = None, rows
    one = copied.groupBy("cid").agg(F.first("shard").alias("shard"), F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    return keyed.select("vec_id", "cid"), table(one) if alone is None else alone.unionByName(one)


class Tree:
    """Splits of shards, by number: ``roots`` are labels' shards by name, ``splits`` has each one's first part's number and its centres."""

    def __init__(self, overlap: int, margin: float):
        self.overlap, self.margin = overlap, margin
        self.roots: dict[str, int] = {}
        self.splits: dict[int, tuple[int, np.ndarray]] = {}
        self.numbers = self.centres = 0

    def number(self, shards: list[str]) -> list[int]:
        self.roots |= {s: self.numbers + i for i, s in enumerate(shards)}
        self.numbers += len(shards)
        return [self.roots[s] for s in shards]

    def split(self, shard: int, centres: np.ndarray) -> None:
        self.splits[shard] = self.numbers, centres
        self.numbers += len(centres)
        self.centres += len(centres)

    def places(self, root: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the unit vectors ``x`` and the shards they go to, by row, the nearest first.

        What a vector lacks to the nearest centre, summed over the splits on its way, is at most the margin, and the shards that
        it goes to are ``overlap`` in all, however many splits there are.
        """
        who, node, lack = np.arange(len(x)), np.full(len(x), root), np.zeros(len(x))
        while True:
            found = []
            for shard in np.unique(node):
                at = np.flatnonzero(node == shard)
                if shard not in self.splits:
                    found.append((who[at], node[at], lack[at], np.zeros(len(at), bool)))
                    continue
                first, centres = self.splits[shard]
                near = x[who[at]] @ _unit(centres.astype(float)).T
                order = np.argsort(-near, axis=1, kind="stable")[:, : self.overlap]
                value = np.take_along_axis(near, order, 1)
                lacks = lack[at, None] + value[:, :1] - value
                r, c = np.nonzero(lacks <= self.margin)
                found.append((who[at[r]], first + order[r, c], lacks[r, c], np.ones(len(r), bool)))
            who, node, lack, moved = (np.concatenate(p) for p in zip(*found, strict=True))
            order = np.lexsort((node, lack, who))
            rank = np.arange(len(who)) - np.searchsorted(who[order], who[order])
            kept = order[rank < self.overlap]
            who, node, lack = who[kept], node[kept], lack[kept]
            if not moved.any():
                return who, node


def _placed(batch: pa.RecordBatch, tree: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, shards) of the labels that are split."""
    names = batch.column("shard").to_pandas()
    for name, at in names[names.isin(list(tree.roots))].groupby(names).groups.items():
        at = np.asarray(at)
        who, node = tree.places(tree.roots[name], _unit(_matrix(batch.column("vec").take(pa.array(at)))))
        yield at[who], node


def shards_of(classes: DataFrame, target: int, overlap: int, margin: float = MARGIN, most: int | None = None) -> DataFrame | None:
    """(cid, shard, vec, own, m, homes): each class in one or more shards of about ``target``, in one of them as its owner.

    ``homes`` names its shards, the owner first, where there are several. None once there are more than ``most`` rows.

    Shards begin as the labels. One that is too large is split by centres drawn from it, FAN at most, again and again. The
    centres, about one for ``target`` classes and MOST_CENTRES at most, are broadcast; so classes are dealt where they are
    read, at all splits at once, and no vector is written or shuffled before its shards are known.
    """
    spark = classes.sparkSession
    tree = Tree(overlap, margin)
    sizes = table(classes.groupBy("shard").count())
    n = sizes.agg(F.sum("count")).first()[0] or 0
    target = max(target, -(-n // MOST_CENTRES))
    roots = sizes.where(F.col("count") > 2 * target).toPandas()
    rest = n - int(roots["count"].sum())
    big = dict(zip(tree.number(roots["shard"].tolist()), roots["count"].tolist(), strict=True))
    total = n
    for _ in range(8):
        if not big:
            break
        known = spark.sparkContext.broadcast((tree, {k: (min(FAN, -(-c // target)), c) for k, c in big.items()}))

        def draw(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            """About four times as many as needed pass, so that no shard is ranked whole."""
            tree, wanted = known.value
            share = pd.Series({k: 4 * m / c for k, (m, c) in wanted.items()})
            for batch in batches:
                digest = _digests(batch.column("cid").to_pandas().to_numpy())
                for at, node in _placed(batch, tree):
                    lot = (mix(digest[at] ^ mix(node.astype(np.uint64) + np.uint64(1))) >> np.uint64(11)).astype(float) / (1 << 53)
                    goes = lot < share.reindex(node).fillna(0).to_numpy()
                    part = batch.take(pa.array(at[goes]))
                    yield pa.record_batch([pa.array(node[goes], pa.int64()), pa.array(lot[goes]), part.column("cid"), part.column("vec")], names=["shard", "lot", "cid", "vec"])

        kind = classes.schema["vec"].dataType.simpleString()
        drawn = classes.select("cid", "shard", "vec").mapInArrow(draw, f"shard long, lot double, cid string, vec {kind}")
        wanted = spark.createDataFrame([(k, m) for k, (m, _) in known.value[1].items()], "shard long, k int")
        ranked = drawn.selectExpr("*", "row_number() over (partition by shard order by lot, cid) as r").where(F.col("r") <= FAN)
        centres = ranked.join(F.broadcast(wanted), "shard").where("r <= k").select("shard", "r", "vec").toPandas()
        known.unpersist()
        for shard, own in centres.sort_values(["shard", "r"]).groupby("shard"):
            if len(own) > 1:
                tree.split(int(shard), np.stack(own.vec.to_numpy()))
        known = spark.sparkContext.broadcast(tree)

        def count(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, node in _placed(batch, known.value):
                    shard, n = np.unique(node, return_counts=True)
                    yield pa.record_batch([pa.array(shard, pa.int64()), pa.array(n, pa.int64())], names=["shard", "n"])

        held = table(classes.select("cid", "shard", "vec").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")))
        known.unpersist()
        total = rest + (held.agg(F.sum("n")).first()[0] or 0)
        if most is not None and total > most:
            return None
        big = dict(map(tuple, held.where(F.col("n") > 2 * target).collect())) if tree.centres < MOST_CENTRES else {}
    known = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("shard").to_pandas()
            parts = [(at := np.flatnonzero(~names.isin(list(known.value.roots))), names.to_numpy()[at], np.ones(len(at), bool), np.full(len(at), None))]
            for at, node in _placed(batch, known.value):
                text = node.astype(str).astype(object)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
                n = np.diff(np.r_[first, len(at)])
                homes = np.array([" ".join(text[f : f + k]) if k > 1 else None for f, k in zip(first, n, strict=True)], object)
                parts.append((at, text, np.isin(np.arange(len(at)), first), np.repeat(homes, n)))
            at, shard, own, homes = (np.concatenate(p) for p in zip(*parts, strict=True))
            part = batch.take(pa.array(at))
            yield pa.record_batch(
                [part.column("cid"), pa.array(shard, pa.string()), part.column("vec"), pa.array(own.astype(bool)), part.column("m"), pa.array(homes, pa.string())],
                names=["cid", "shard", "vec", "own", "m", "homes"],
            )

    kind = classes.schema["vec"].dataType.simpleString()
    return classes.select("cid", "shard", "vec", "m").mapInArrow(deal, f"cid string, shard string, vec {kind}, own boolean, m long, homes string")


def robust_prune(like: np.ndarray, among: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Which candidates of each row stay: the nearest ones without those that a kept one is nearer to by the factor alpha, in squared distance.

    ``like``: candidates' falling similarities, a row each; ``among``: their similarities to each other, a matrix each.
    """
    alive, kept, far = np.ones(like.shape, bool), np.zeros(like.shape, bool), 2 - 2 * like
    for i in range(like.shape[1]):
        rows = np.flatnonzero(alive[:, i])
        kept[rows, i] = True
        alive[rows] &= alpha * (2 - 2 * among[rows, i]) > far[rows]
        alive[rows[kept[rows].sum(1) == degree]] = False
    return kept


def build(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of a shard: pruned candidates of each vector, edges both ways."""
    n = len(x)
    k = min(n - 1, 3 * DEGREE)
    edges = [np.zeros(0, np.int64)]
    for a in range(0, n if k > 0 else 0, 128):
        near = x[a : a + 128] @ x.T
        rows = np.arange(len(near))[:, None]
        near[rows[:, 0], rows[:, 0] + a] = -2
        best = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
        best = best[rows, np.argsort(-near[rows, best], axis=1, kind="stable")]
        own = x[best]
        r, c = np.nonzero(robust_prune(near[rows, best], own @ own.transpose(0, 2, 1), ALPHA, DEGREE))
        edges += [(r + a) * n + best[r, c], best[r, c] * n + r + a]
    return _lists(np.concatenate(edges), n)


def _lists(edges: np.ndarray, n: int) -> list[np.ndarray]:
    """Lists by first end of edges a * n + b."""
    edges = np.unique(edges)
    return np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))


def search(x: np.ndarray, norms: np.ndarray, adjacency: list[np.ndarray], queries: np.ndarray, least: float) -> list[np.ndarray]:
    """For each query's place, the places found of vectors at least ``least`` like it, but for itself.

    Greedy beam search from the medoid, all queries of a block in step; then the range is expanded: neighbours of what lies
    within it are looked at until no new ones do. What is found is verified with the cosine in double precision.
    """
    n = len(x)
    width = max((len(a) for a in adjacency), default=0)
    table_ = np.full((n, max(1, width)), -1, np.int64)
    for i, a in enumerate(adjacency):
        table_[i, : len(a)] = a
    medoid = int(np.argmax(x @ x.mean(0)))
    found: list[np.ndarray] = []
    for a in range(0, len(queries), 64):
        q = queries[a : a + 64]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), bool)
        like = np.full((len(q), n), -2.0)
        ranked = np.full((len(q), n), -3.0)  # of places that are open
        start = np.full(len(q), medoid)
        # a query is in the graph itself: its own place is one more entry
        for first in (start, q):
            seen[rows, first] = True
            like[rows, first] = ranked[rows, first] = (x[q] * x[first]).sum(1)
        for step in range(4 * n):
            pick = ranked.argmax(1)
            best = ranked[rows, pick]
            if step < BEAM:
                go = best > -3
            else:
                go = best >= least - 0.05
            if not go.any():
                break
            live = rows[go]
            ranked[live, pick[go]] = -3
            near = table_[pick[go]]
            r, c = np.nonzero(near >= 0)
            place, who = near[r, c], live[r]
            new = ~seen[who, place]
            who, place = who[new], place[new]
            seen[who, place] = True
            like[who, place] = ranked[who, place] = np.einsum("ij,ij->i", x[q[who]], x[place])
        for i in range(len(q)):
            near = np.flatnonzero(like[i] >= least - 1e-6)
            near = near[near != q[i]]
            found.append(near)
    return found


def near_duplicates(vectors: DataFrame, least: float = 0.98, target: int = SHARD, overlap: int = OVERLAP, audited: int = AUDITED) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine, in double precision, is at least ``least``. Equal vectors of a
    label are one class. Each shard of classes builds a graph; the lists of a class from all its shards are united; each shard
    then searches, with the united lists, for its own classes' neighbours, and takes links of other members that their own shards
    do not hold. The links leave a shard as counts and as links to the
    smallest class of a local component, never as all pairs. A sample of all classes, with links or not, is compared with every
    class; if fewer than 0.95 of its links were found, shards are made again with twice the overlap and twice the margin. Where
    that does not help, or would hold more rows than blocks of all with all, every class is compared with every other.
    ``vectors`` is read several times, and only a vector's copies in shards are shuffled.

    Defined results: vectors that are null, zero or hold a null or non-finite component, and those without a label, have no
    links; vectors of different length never link; repeated rows are vectors of their own; a null vec_id has its component's
    smallest, or null; an empty table gives no rows.
    """
    keyed, classes = classes_of(vectors)
    margin = MARGIN
    copies = lambda n: F.sum(F.col("count") * F.ceil(F.col("count") / n))
    most, blocks, n = (x or 0 for x in classes.groupBy("shard").count().agg(copies(target), copies(BLOCK * target), F.sum("count")).first())
    while True:
        members = shards_of(classes, target, overlap, margin, most)
        if members is None:
            recall = 0.0
        else:
            of_class, counts = _linked(classes, _searched(classes, members, least))
            recall = _audit(classes, counts, least, audited)
        if recall >= LEAST_RECALL:
            break
        if members is None or overlap >= 32 or blocks <= 2 * overlap * n:
            of_class, _ = _linked(classes, _compared(classes, least, BLOCK * target))
            recall = 1.0
            break
        overlap, margin = 2 * overlap, 2 * margin
    near_duplicates.recall = recall
    several = classes.where("m > 1").select("cid", "m", "least")
    result = of_class.join(several, "cid", "full_outer").select(
        "cid", (F.coalesce("found", F.lit(0)) + F.coalesce("m", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    return keyed.join(result, "cid", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def _joined(cids: np.ndarray, m: np.ndarray, of: np.ndarray, found: list[np.ndarray]) -> pd.DataFrame:
    """(a, b, found, pairs): of each place of ``of`` its rows and classes found; a and b of each place in a component, its smallest."""
    parent = np.arange(len(cids))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    counts = np.zeros((2, len(cids)), np.int64)
    for q, near in zip(of, found, strict=True):
        counts[0, q] += m[near].sum()
        counts[1, q] += len(near)
        for j in near:
            a, b = root(q), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    top = np.array([root(i) for i in range(len(cids))], np.int64)
    told = np.union1d(of, np.flatnonzero(top != np.arange(len(cids)))).astype(np.int64)
    return pd.DataFrame({"a": cids[told], "b": cids[top[told]], "found": counts[0, told], "pairs": counts[1, told]})


LINKS = "a string, b string, found long, pairs long"


def _with_homes(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Members with their class's rows and shards, as shards_of gives them."""
    shards = members.groupBy("cid").agg(F.max(F.when(F.col("own"), F.col("shard"))).alias("home"), F.array_sort(F.collect_list("shard")).alias("all"))
    homes = F.when(F.size("all") > 1, F.concat_ws(" ", F.array("home"), F.array_remove("all", F.col("home"))))
    return members.join(shards.select("cid", homes.alias("homes")), "cid").join(classes.select("cid", "m"), "cid")


def _kinds(pdf: pd.DataFrame) -> tuple[np.ndarray, list[tuple[str, frozenset[str]]]]:
    """Which of the kinds each member is of, and the kinds: owner and all shards."""
    here = pdf["shard"].iloc[0]
    kind, names = pd.factorize(pdf.homes.fillna(""))
    return kind, [((all_ := n.split(" "))[0], frozenset(all_)) if n else (here, frozenset([here])) for n in names]


def _edges(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The edges of lists that go both ways, once each, by their smaller end."""
    a = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    b = np.concatenate(lists)
    return a[a < b], b[a < b]


def _searched(classes: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(a, b, found, pairs) of classes, by the graphs of shards.

    Each shard's graph is one row of places, and its edges between classes that meet in other shards too go there as digests,
    so that lists are united without vectors or names. The shard that owns a class then searches for its links. Those to classes
    that are not there are taken in the first other shard that holds both, by comparing all; so each pair that meets in any
    shard counts once, and no pairs leave a shard. Both passes take the members from one shuffle.
    """
    if "homes" not in members.columns:
        members = _with_homes(classes, members)
    members = members.select("cid", "shard", "vec", "own", "m", "homes")

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        here, cids = pdf["shard"].iloc[0], pdf.cid.to_numpy()
        a, b = _edges(build(_unit(np.stack(pdf.vec.to_numpy()).astype(float))))
        digest = _digests(cids)
        held = np.concatenate((np.bincount(a, minlength=len(cids)), b)).astype(_places(len(cids)))
        rows = [(here, int(digest.sum().astype(np.int64)), held.tobytes())]
        kind, known = _kinds(pdf)
        pair, which = np.unique(kind[a] * len(known) + kind[b], return_inverse=True)
        to: dict[str, list[int]] = {}
        for i, p in enumerate(pair):
            for shard in (known[p // len(known)][1] & known[p % len(known)][1]) - {here}:
                to.setdefault(shard, []).append(i)
        for shard, own in to.items():
            goes = np.isin(which, own)
            rows.append((shard, None, np.concatenate((digest[a[goes]], digest[b[goes]])).astype("<u8").tobytes()))
        return pd.DataFrame(rows, columns=["shard", "told", "edges"]).astype({"told": "Int64"})

    def find(pdf: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        raw = np.stack(pdf.vec.to_numpy()).astype(float)
        norms = np.sqrt((raw * raw).sum(1))
        x = raw / norms[:, None]
        adjacency = _united(pdf.cid.to_numpy(), x, lists)
        own = np.flatnonzero(pdf.own.to_numpy())
        found = search(x, norms, adjacency, own, least)
        found = [near[raw[near] @ raw[q] / (norms[near] * norms[q]) >= least] for q, near in zip(own, found, strict=True)]
        of, more = _leaving(pdf, raw, norms, least)
        return _joined(pdf.cid.to_numpy(), pdf.m.to_numpy(), np.concatenate((own, of)), found + more)

    lists = members.groupBy("shard").applyInPandas(graph, "shard string, told long, edges binary")
    return members.groupBy("shard").cogroup(lists.groupBy("shard")).applyInPandas(find, LINKS)


def _places(n: int) -> str:
    return "<u2" if n < 1 << 16 else "<u4"


def _united(cids: np.ndarray, x: np.ndarray, lists: pd.DataFrame) -> list[np.ndarray]:
    """Adjacency of a shard's members: its own graph's edges and those that other shards found between them."""
    n, digest = len(cids), _digests(cids)
    own = lists[lists.told.notna()]
    if len(own) == 1 and int(own.told.iloc[0]) == int(digest.sum().astype(np.int64)):
        held = np.frombuffer(own.edges.iloc[0], _places(n)).astype(np.int64)
        ends = [(np.repeat(np.arange(n), held[:n]), held[n:])]
    else:  # the members are not those that the graph was built on
        ends = [_edges(build(x))]
    order = np.argsort(digest)
    for told in lists.edges[lists.told.isna()]:
        both = np.frombuffer(told, "<u8").reshape(2, -1)
        at = np.minimum(np.searchsorted(digest[order], both), n - 1)
        here = (digest[order][at] == both).all(0)
        ends.append((order[at[0, here]], order[at[1, here]]))
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    return _lists(np.concatenate((a * n + b, b * n + a)), n)


def _leaving(pdf: pd.DataFrame, raw: np.ndarray, norms: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places that other shards own, and for each the places of links that its owner does not hold and no earlier shard takes."""
    here = pdf["shard"].iloc[0]
    guests = np.flatnonzero(~pdf.own.to_numpy())
    kind, known = _kinds(pdf)
    found = []
    for a in range(0, len(guests), 256):
        q = guests[a : a + 256]
        met = raw[q] @ raw.T / (norms[q, None] * norms) >= least
        met[np.arange(len(q)), q] = False
        r, c = np.nonzero(met)
        pair, which = np.unique(kind[q[r]] * len(known) + kind[c], return_inverse=True)
        taken = np.zeros(len(pair), bool)
        for i, p in enumerate(pair):
            (home, shards), (_, others) = known[p // len(known)], known[p % len(known)]
            taken[i] = home not in others and min(shards & others) == here
        met[r, c] = taken[which]
        found += [np.flatnonzero(x) for x in met]
    return guests, found


def _compared(classes: DataFrame, least: float, target: int) -> DataFrame:
    """(a, b, found, pairs) of classes, by comparing all of a shard with all, a pair of blocks of about ``target`` at a time."""
    blocks = classes.groupBy("shard").agg(F.ceil(F.count("*") / target).cast("int").alias("k"))
    block = F.pmod(F.xxhash64("cid", F.lit(2)), F.col("k")).cast("int")
    dealt = classes.join(blocks, "shard").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("cid", "vec", "m", "shard", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        raw = np.stack(pdf.vec.to_numpy()).astype(float)
        norms = np.sqrt((raw * raw).sum(1))
        within = pdf.i.iloc[0] == pdf.j.iloc[0]
        of = pdf.block.to_numpy()
        found = []
        for a in range(0, len(raw), 256):
            met = raw[a : a + 256] @ raw.T / (norms[a : a + 256, None] * norms) >= least
            met[np.arange(len(met)), np.arange(a, a + len(met))] = False
            if not within:
                met &= of[a : a + 256, None] != of
            found += [np.flatnonzero(r) for r in met]
        return _joined(pdf.cid.to_numpy(), pdf.m.to_numpy(), np.arange(len(raw)), found)

    return dealt.groupBy("shard", "i", "j").applyInPandas(compare, LINKS)


def _linked(classes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, found, component_id) and (cid, found, pairs) of the classes that have links."""
    links = table(links.where("pairs > 0 or a <> b"))
    counts = links.groupBy(F.col("a").alias("cid")).agg(F.sum("found").alias("found"), F.sum("pairs").alias("pairs"))
    found = components(links.select("a", "b"))
    labelled = found.select(F.col("node").alias("cid"), "component").join(classes.select("cid", "least"), "cid")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = counts.select("cid", "found").join(labelled.join(smallest, "component").select("cid", "component_id"), "cid", "left")
    return table(of_class), counts


def _audit(classes: DataFrame, counts: DataFrame, least: float, audited: int) -> float:
    """The share found of the links of some classes to any others; every class is compared with them, in blocks.

    Classes are drawn by digest among those with found links and among those without, and weigh as many as they were drawn
    from. A link is one between two classes, whatever their copies. The share of all links and the mean share of a class that
    has links are estimated; the lower one counts.
    """
    spark = classes.sparkSession
    linked = table(counts.where("pairs > 0").select("cid", "pairs"))
    n_linked = linked.count()
    bare = classes.select("cid").join(linked, "cid", "left_anti").select("cid", F.lit(0).cast("long").alias("pairs"))
    drawn, weight = [], {}
    for has, own, n, of in ((True, linked, audited, n_linked), (False, bare, AUDITED_BARE * audited, classes.count() - n_linked)):
        part = own.orderBy(F.xxhash64("cid"), "cid").limit(n).toPandas()
        weight[has] = of / max(1, len(part))
        drawn.append(part)
    drawn = pd.concat(drawn)
    if not len(drawn):
        return 1.0
    keys = spark.createDataFrame(drawn.astype({"cid": str, "pairs": int}), "cid string, pairs long")
    queries = classes.join(F.broadcast(keys), "cid").select("cid", "shard", "vec", "pairs").toPandas()
    known = spark.sparkContext.broadcast(queries)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = known.value
        own = {shard: (g.cid.to_numpy(), np.stack(g.vec.to_numpy()).astype(float)) for shard, g in q.groupby("shard")}
        true = dict.fromkeys(q.cid, 0)
        for batch in batches:
            for shard, g in batch.to_pandas().groupby("shard"):
                if shard in own:
                    cids, y = own[shard]
                    x = np.stack(g.vec.to_numpy()).astype(float)
                    met = (y @ x.T) / (np.sqrt((y * y).sum(1))[:, None] * np.sqrt((x * x).sum(1))) >= least
                    met &= cids[:, None] != g.cid.to_numpy()
                    for c, n in zip(cids, met.sum(1), strict=True):
                        true[c] += int(n)
        yield pa.record_batch([pa.array(list(true)), pa.array(list(true.values()), pa.int64())], names=["cid", "n"])

    true = classes.select("cid", "shard", "vec").mapInArrow(compare, "cid string, n long").groupBy("cid").agg(F.sum("n").alias("n")).toPandas()
    met = queries.merge(true, on="cid")
    met = met[met.n > 0]
    w = np.where(met.pairs > 0, weight[True], weight[False])
    if not len(met):
        return 1.0
    hit = np.minimum(met.pairs, met.n)
    return float(min((w * hit).sum() / (w * met.n).sum(), (w * hit / met.n).sum() / w.sum()))


def op5_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))

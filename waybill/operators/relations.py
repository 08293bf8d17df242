"""Matching rows of two sides: cascades, multisets, scores, chains of keys, relational division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators import rounds


def holders_of_all(df: DataFrame, owner: str, item: str, wanted: list) -> DataFrame:
    """Owners that have every wanted item."""
    return df.where(F.col(item).isin(wanted)).groupBy(owner).agg(F.count_distinct(item).alias("n")).where(F.col("n") == len(set(wanted))).select(owner)


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def multiset_match(old: DataFrame, new: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(keys, old_id, new_id, kind): the k-th of equal rows with the k-th; what is left was removed or added."""
    a = numbered(old.select(*keys, id_), keys, [id_]).withColumnRenamed(id_, "old_id")
    b = numbered(new.select(*keys, id_), keys, [id_]).withColumnRenamed(id_, "new_id")
    kind = F.when(F.col("new_id").isNull(), "removed").when(F.col("old_id").isNull(), "added").otherwise("matched")
    same = F.col("a._k") == F.col("b._k")
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), same, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "old_id", "new_id", kind.alias("kind"))


def cascade(old: DataFrame, new: DataFrame, id_: str, stages: list[tuple[str, list[str]]]) -> DataFrame:
    """(old_id, new_id, stage): each stage pairs, in order of id within equal keys, what the stages before left.

    What no stage pairs has a null on the other side. The joins are merges by hint: none sends a side to the driver to broadcast it.
    """
    left, right, out = old, new, None
    for name, keys in stages:
        a = numbered(left, keys, [id_]).select(*keys, "_k", F.col(id_).alias("old_id"))
        b = numbered(right, keys, [id_]).select(*keys, "_k", F.col(id_).alias("new_id"))
        same = F.col("a._k") == F.col("b._k")
        for k in keys:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        found = rounds.settled(a.alias("a").join(b.hint("merge").alias("b"), same).select("old_id", "new_id", F.lit(name).alias("stage")))
        out = found if out is None else out.union(found)
        left = left.join(found.select(F.col("old_id").alias(id_)).hint("merge"), id_, "left_anti")
        right = right.join(found.select(F.col("new_id").alias(id_)).hint("merge"), id_, "left_anti")
    rest = left.select(F.col(id_).alias("old_id"), F.lit(None).cast("long").alias("new_id"), F.lit("removed").alias("stage"))
    more = right.select(F.lit(None).cast("long").alias("old_id"), F.col(id_).alias("new_id"), F.lit("added").alias("stage"))
    return out.union(rest).union(more)


def keyed_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, kind, changed): insert, delete or update with the changed columns' names; equal rows are left out."""
    a = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(1).alias("_old"))
    b = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(1).alias("_new"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")), c) for c in columns]))
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.size(names) > 0, "update")
    joined = a.join(b, key, "full").withColumn("kind", kind).where("kind is not null")
    return joined.select(key, "kind", F.when(F.col("kind") == "update", F.array_join(names, ",")).otherwise("").alias("changed"))


def apply_patches(base: DataFrame, patches: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """``base`` with ``new`` for ``expected`` in a column, where they agree, and the patches that met no such row."""
    p = patches.select(key, F.col("expected").alias("_e"), F.col("new").alias("_n"), F.lit(True).alias("_p"))
    joined = base.join(p, key, "left")
    fits = F.col("_p") & F.col(column).eqNullSafe(F.col("_e"))
    done = joined.select(*[F.when(fits, F.col("_n")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in base.columns])
    met = joined.where(fits).select(key)
    return done, patches.join(met, key, "left_anti")


def upsert_plan(old: DataFrame, new: DataFrame, part: str, key: str, columns: list[str]) -> DataFrame:
    """(part, action): which parts of a table partitioned by ``part`` are to be written, deleted or left.

    Parts are compared by count and an order-free sum of row hashes, so one aggregate a side decides.
    """
    digest = lambda df, name: df.groupBy(part).agg(F.struct(F.count("*"), F.sum(F.xxhash64(key, *columns).cast("decimal(38,0)"))).alias(name))
    both = digest(old, "o").join(digest(new, "n"), part, "full")
    action = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "vanished").when(F.col("o") == F.col("n"), "same").otherwise("changed")
    return both.select(part, action.alias("action"))


def roots(df: DataFrame, id_: str, parent: str, most_rounds: int = 40) -> DataFrame:
    """(id, root, steps) by pointer doubling: each round doubles how far an id sees, so a chain of n takes log2(n) joins.

    Rounds are written to shared storage and go on until none moves a root. A ring of parents has no root: an error.
    """
    at = df.select(F.col(id_).alias("id"), F.coalesce(parent, id_).alias("root"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("steps"))
    at = rounds.settled(at)
    for _ in range(most_rounds):
        nxt = at.select(F.col("id").alias("root"), F.col("root").alias("_far"), F.col("steps").alias("_more"))
        step = F.coalesce("_more", F.lit(0))
        at = rounds.settled(at.join(nxt, "root", "left").select("id", F.coalesce("_far", "root").alias("root"), (F.col("steps") + step).alias("steps"), (step > 0).alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
    raise ValueError(f"some parents form a ring, or a chain is longer than 2 ** {most_rounds}")


def alike_sets(df: DataFrame, owner: str, item: str, share: int, of: int) -> DataFrame:
    """(a, b, common, nx, ny) of owners a < b whose sets share at least ``share`` / ``of`` of the larger one's items.

    Sets that must share two items or more share two of their rarest: these meet by pairs of them, so neither a common item
    nor one that is rare only within its set brings pairs by itself. Sets for which one item may do meet by each of their items as well.
    """
    own = df.select(F.col(owner).alias("k"), F.col(item).alias("i")).where("k is not null and i is not null").distinct()
    ranked = own.join(own.groupBy("i").agg(F.count("*").alias("df")), "i")
    sets = ranked.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "i"))).alias("s")).select("k", F.col("s.i").alias("s"), F.size("s").alias("n"))
    need = F.ceil(F.lit(share) * F.col("n") / F.lit(of))
    lead = F.slice("s", 1, F.least(F.col("n"), F.col("n") - F.greatest(need, F.lit(2)) + 2).cast("int"))
    two = F.flatten(F.transform(lead, lambda x, p: F.transform(F.slice(lead, p + 2, F.size(lead)), lambda y: F.struct(x.alias("i"), y.alias("j")))))
    one = F.when(need <= 1, F.transform("s", lambda x: F.struct(x.alias("i"), F.lit(None).cast(own.schema["i"].dataType).alias("j"))))
    rare = sets.select("k", "s", "n", F.explode(F.concat(two, F.coalesce(one, F.slice(two, 1, 0)))).alias("c")).select("k", "s", "n", "c.i", "c.j")
    x, y = rare.alias("x"), rare.alias("y")
    met = x.join(y, (F.col("x.i") == F.col("y.i")) & F.col("x.j").eqNullSafe(F.col("y.j")) & (F.col("x.k") < F.col("y.k")) & (F.least("x.n", "y.n") * of >= F.greatest("x.n", "y.n") * share))
    common = F.size(F.array_intersect("x.s", "y.s")).cast("long")
    both = met.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), common.alias("common"), F.col("x.n").alias("nx"), F.col("y.n").alias("ny")).where(F.col("common") * of >= F.greatest("nx", "ny") * share)
    return both.distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the least node that links reach.

    Each round gives a node, and the node that is its label, the least label among its neighbours; then labels take their
    own label's, which doubles the distance. So rounds grow with the logarithm of a component. Neighbours' labels are
    aggregated before the shuffle. Rounds are written to shared storage until none changes a label.
    """
    both = rounds.settled(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    at = rounds.settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        low = both.join(at.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        own = at.join(low, "node").select("node", "component", F.least("component", "c").alias("c"))
        hook = own.groupBy(F.col("component").alias("node")).agg(F.min("c").alias("h"))
        own = rounds.settled(own.join(hook, "node", "left").select("node", "component", F.least("c", F.coalesce("h", "c")).alias("c")))
        far = own.select(F.col("node").alias("c"), F.col("c").alias("f"))
        new = own.join(far, "c").select("node", F.col("f").alias("to"), "component").select("node", F.col("to").alias("component"), (F.col("to") < F.col("component")).alias("moved"))
        at = rounds.settled(new)
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def scored(df: DataFrame, keys: list[str], points: list[tuple[int, Column]], least: int, id_: str) -> DataFrame:
    """(keys, status, best, score) from candidates: unmatched below ``least``, ambiguous if two share the best score."""
    score = sum((F.when(rule, p).otherwise(0) for p, rule in points), F.lit(0))
    own = df.withColumn("score", score)
    top = own.groupBy(*keys).agg(F.max("score").alias("score"))
    tied = own.join(top, [*keys, "score"]).groupBy(*keys, "score").agg(F.count("*").alias("n"), F.min(id_).alias("best"))
    status = F.when(F.col("score") < least, "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("possible")
    return tied.select(*keys, status.alias("status"), F.when(status == "possible", F.col("best")).alias("best"), "score")


def unique_members(df: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(keys, member): the only member of each group, null where there are several."""
    return df.groupBy(*keys).agg(F.when(F.count("*") == 1, F.min(id_)).alias("member"))


def unique_names(df: DataFrame, name: str, order: list) -> DataFrame:
    """``unique``: the name, then name-2, name-3 in order; numbers whose result is a name already are passed over."""
    first = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    numbered = df.withColumn("_nth", first)
    # numbers that names of the form name-number take from their stem
    stem = F.regexp_extract(name, "^(.*)-([0-9]{1,9})$", 1)
    number = F.regexp_extract(name, "^(.*)-([1-9][0-9]{0,8})$", 2).try_cast("int")
    taken = df.where(number >= 2).select(stem.alias(name), number.alias("_x")).groupBy(name).agg(F.sort_array(F.collect_set("_x")).alias("_taken"))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_nth"), lambda k, x: F.when(x <= k, k + 1).otherwise(k))
    joined = numbered.join(taken, name, "left")
    return joined.withColumn("unique", F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat_ws("-", F.col(name), free.cast("string")))).drop("_nth", "_taken")

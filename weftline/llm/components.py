"""Connected components of a link table by a distributed union-find, and of ids that share buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, stored

#: A test of two ids' traits that every link passes.
Close = Callable[[Column, Column], Column]

MAX_ROUNDS = 60
#: Buckets of so many members or fewer, if still mixed, pair all members of different components.
FEW = 32
#: Turns in which larger buckets pair their members with some of them, before they too pair all.
TURNS = 2
#: About so many components of a large bucket give a member that the others are paired with in the first turn, as many more in each later one.
HUBS = 8
#: Of ids in so many buckets or fewer, a pair comes out in one of those that it shares.
LISTED = 64
#: Members of a large bucket that one row's block is paired with.
BLOCK = 1000
#: Bits of the filter that tells which values are wanted. It has this size for any input; rows that it lets through needlessly cost time only.
FILTER_BITS = 1 << 24


def passing(rows: DataFrame, wanted: DataFrame, key: str, made: list[DataFrame] | None = None) -> DataFrame:
    """The ``rows`` whose ``key`` (a hash) may be one of ``wanted``, all that are and few others, found without dealing rows out.

    FILTER_BITS bits, in which those of all wanted keys are set, go to every task as one array. ``made`` gets
    the stored table that has them, to be deleted when the rows were read.
    """
    word, bit = F.shiftright(F.pmod(key, F.lit(FILTER_BITS)), 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    some = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = rows.sparkSession.range(FILTER_BITS // 64).withColumnRenamed("id", "word").join(some, "word", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    bits = stored(listed.select(F.col("all.bits").alias("filter_bits")), "filter")
    if made is not None:
        made.append(bits)
    return rows.join(F.broadcast(bits), F.get("filter_bits", word.cast("int")).bitwiseAND(bit) != 0, "left_semi")


def _rooted(parents: DataFrame) -> DataFrame:
    """``u, p`` of a forest given by parents, with every parent replaced by its root (pointer jumping)."""
    for _ in range(MAX_ROUNDS):
        up = parents.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jumped = stored(parents.join(up, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "roots")
        moved = not jumped.where("moved").isEmpty()
        discard(parents)
        parents = jumped
        if not moved:
            return parents
    raise RuntimeError("a forest of links did not settle")


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``id, component`` for every id that has a link to another id; component is the smallest id reachable.

    Links may repeat, point either way or join an id to itself; null ends are left out. In every round
    each id hooks to its smallest neighbour (partial minima come first, so that an id with very many
    links is no bottleneck), trees are flattened, and links are contracted to those between their roots.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stored(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    forest = None
    for _ in range(MAX_ROUNDS):
        if forest is not None and e.isEmpty():
            discard(e)
            return forest
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = _rooted(stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "hooks"))
        of = roots.select("u", "p")
        moved = e.join(of, "u").select(F.col("v").alias("u"), F.col("p").alias("x")).join(of, "u").where(F.col("x") != F.col("p"))
        e = stored(moved.select(F.greatest("x", "p").alias("u"), F.least("x", "p").alias("v")).distinct(), "links", e)
        if forest is None:
            forest = stored(roots.select(F.col("u").alias("id"), F.col("p").alias("component")), "forest", roots)
        else:
            up = roots.select(F.col("u").alias("component"), F.col("p").alias("q"))
            forest = stored(forest.join(up, "component", "left").select("id", F.coalesce("q", "component").alias("component")), "forest", forest, roots)
    raise RuntimeError("connected components did not settle")


def _joined(forest: DataFrame, new: DataFrame) -> DataFrame:
    """``forest`` with the links ``new`` between any ids."""
    own = forest.select("id", "component")
    ends = new
    for x in "ab":
        ends = ends.join(own.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")), x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
    more = components(ends, "c_a", "c_b")
    up = more.select(F.col("id").alias("component"), F.col("component").alias("q"))
    known = own.join(up, "component", "left").select("id", F.coalesce("q", "component").alias("component"))
    fresh = more.join(own.select("id"), "id", "left_anti").select("id", "component")
    return stored(known.unionByName(fresh), "forest", forest, more)


def _all_pairs(members: DataFrame, close: Close | None, hubs: DataFrame | None = None) -> DataFrame:
    """Pairs of members of different components of each bucket, or of members and ``hubs``; those of a large one are dealt to tasks by blocks.

    Members that share several buckets are a pair in that of the smallest key alone, so that buckets of much the same members
    don't repeat each other's pairs. Only of ids in more than LISTED buckets a pair may come out again, before ``distinct``.
    """
    if hubs is None:
        lists = members.groupBy("id").agg(F.collect_set("key").alias("keys")).where(F.size("keys").between(2, LISTED))
        members = members.join(lists, "id", "left")
    else:
        members = members.withColumn("keys", F.lit(None).cast("array<long>"))
        hubs = hubs.withColumn("keys", F.lit(None).cast("array<long>"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    named = lambda x, c: [F.col("id").alias(x), F.col("component").alias(f"c_{x}"), F.col("excess").alias(f"e_{x}"), F.col("keys").alias(f"k_{x}"), *([F.col("trait").alias(f"t_{x}")] if close else []), c.alias("block")]
    x = members.select("key", *named("a", F.pmod(F.xxhash64("id"), blocks).cast("int")))
    y = (members if hubs is None else hubs).select("key", *named("b", F.explode(F.sequence(F.lit(0), blocks - 1))))
    pairs = x.join(y, ["key", "block"]).where(("a < b and " if hubs is None else "") + "c_a != c_b and e_a + e_b <= 0")
    pairs = pairs.where(close(F.col("t_a"), F.col("t_b"))) if close else pairs
    if hubs is None:
        pairs = pairs.where("k_a is null or k_b is null or array_min(array_intersect(k_a, k_b)) = key")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hubs(members: DataFrame, turn: int) -> DataFrame:
    """A member of each of about HUBS components of every bucket (times the turn), chosen by hash."""
    of = members.groupBy("key", "component").agg(F.min_by(F.struct("*"), F.xxhash64("id", F.lit(turn))).alias("x"))
    some = of.groupBy("key").count()
    dealt = F.pmod(F.xxhash64("component", "key", F.lit(turn)), F.ceil(F.col("count") / F.lit(HUBS * turn)))
    return of.join(some, "key").where(dealt == 0).select("x.*")


def _close_pairs(pairs: DataFrame, traits: DataFrame | None, close: Close | None) -> DataFrame:
    """The pairs ``a, b`` whose traits are close."""
    if close is None:
        return pairs
    x, y = (traits.select(F.col("id").alias(i), F.col("trait").alias(f"t_{i}")) for i in "ab")
    return pairs.join(x, "a").join(y, "b").where(close(F.col("t_a"), F.col("t_b"))).select("a", "b")


def _buckets(spread: DataFrame) -> DataFrame | None:
    """``key, n, hub, id`` of every bucket with more than one member; buckets of the same members are one. None without any."""
    if "excess" not in spread.columns:
        spread = spread.withColumn("excess", F.lit(0).cast("long"))
    # singles go first, by as few columns as that takes: they are by far the most
    ends = spread.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub < far")
    ends = stored(ends.select("key", "hub"), "keys")
    bits: list[DataFrame] = []
    members = passing(spread, ends, "key", bits).join(ends, "key").select("key", "hub", "id", "excess").distinct()
    members = stored(members, "buckets", ends, *bits)
    same = members.groupBy("key", "hub").agg(F.count("*").alias("n"), F.max("id").alias("far"), F.bit_xor(F.xxhash64("id")).alias("all"))
    keys = stored(same.groupBy("hub", "n", "far", "all").agg(F.min("key").alias("key")).select("key", "n"), "keys")
    if keys.isEmpty():
        discard(keys, members)
        return None
    return stored(members.join(keys, "key").select("key", "n", "hub", "id", "excess"), "buckets", keys, members)


def rare_members(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``key, id, excess`` of sets (``id, set``, distinct values): keys are values of which any two sets share one whose
    Jaccard similarity is ``num`` / ``den`` or more.

    Of two sets so similar, one can lack at most so many of the other's values: they share one of as many
    and one more, by any order. The order is that of rarity, so that common values are the last to be
    keys. What a set has alone makes it differ from all: excesses add up to more than 0 where that is too much.
    """
    size = F.size("set")
    has = sets.select("id", size.alias("size"), (size - F.ceil(size * num / F.lit(den)) + 1).alias("first"), F.explode("set").alias("key"))
    common = stored(has.groupBy("key").count().where("count > 1"), "common")
    has = has.join(common, "key", "left").withColumn("count", F.coalesce("count", F.lit(1)))
    own = Window.partitionBy("id")
    has = has.withColumn("rank", F.row_number().over(own.orderBy("count", "key"))).withColumn("alone", F.count_if(F.col("count") == 1).over(own))
    excess = F.col("alone") * (den + num) - F.col("size") * (den - num)
    return stored(has.where("rank <= first and count > 1").select("key", "id", excess.alias("excess")), "rare", sets, common)


def _mixed(buckets: DataFrame, forest: DataFrame, traits: DataFrame | None) -> DataFrame | None:
    """``key, n, id, excess, component`` and the trait of members of buckets (replaced) that hold several components; None without any."""
    own = forest.select("id", "component")
    members = stored(buckets.join(own, "id", "left").select("key", "n", "id", "excess", F.coalesce("component", "id").alias("component")), "members", buckets)
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("excess").alias("least")).where("lo < hi")
    mixed = stored(mixed.select("key", "least"), "mixed")
    if mixed.isEmpty():
        discard(mixed, members)
        return None
    known = members.join(mixed, "key").where("excess + least <= 0").drop("least")
    return stored(known.join(traits.select("id", "trait"), "id") if traits is not None else known, "members", members, mixed)


def bucket_components(
    spread: DataFrame,
    linked: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame], DataFrame | None] | None = None,
    traits_of: Callable[[DataFrame], DataFrame] | None = None,
    close: Close | None = None,
) -> DataFrame | None:
    """``id, component`` of ids that share a bucket and are linked; None without any bucket.

    ``spread`` has rows ``key, id``, which may repeat; ``linked`` takes candidate pairs
    ``a, b`` and gives a stored table of those that are links. In each bucket the members pair with
    one member. Buckets whose members are then not in one component are taken up again: with FEW
    members all those of different components pair. In larger ones they pair with members of some
    components, for some turns, and in the end with all. After the first of these turns, ``refine(members)`` may split those that
    are mixed still into buckets ``key, id, excess`` (a stored table) that hold all of their links; None leaves them as they are.
    Members whose excesses add up to more than 0 are no link, nor are those whose traits are not ``close``:
    ``traits_of`` gives a stored table ``id, trait`` of ids that share a bucket. Traits go with the members,
    so that pairs which are not close are never written or shuffled. So a bucket of n similar members costs n pairs, and no link
    between different components is lost.
    """
    buckets = _buckets(spread)
    if buckets is None:
        return None
    traits = traits_of(buckets.select("id").distinct()) if traits_of else None
    known = traits if close else None
    pairs = buckets.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = stored(_close_pairs(pairs, traits, close), "pairs")
    new = linked(pairs)
    forest = components(new, "a", "b")
    discard(pairs, new)
    for turn in range(1, TURNS + 2):
        members = _mixed(buckets, forest, known)
        if turn == 2 and members is not None and refine:
            finer = refine(members.select("key", "id"))
            if finer is not None:
                discard(members)
                buckets = _buckets(finer)
                discard(finer)
                members = _mixed(buckets, forest, known) if buckets is not None else None
        if members is None:
            break
        large = members.where(F.col("n") > FEW)
        pairs = _all_pairs(members if turn > TURNS else members.where(F.col("n") <= FEW), close)
        if turn <= TURNS:
            pairs = pairs.unionByName(_all_pairs(large, close, _hubs(large, turn))).distinct()
        pairs = stored(pairs, "pairs")
        new = linked(pairs)
        forest = _joined(forest, new)
        discard(pairs, new)
        if turn > TURNS or large.isEmpty():
            discard(members)
            break
        buckets = stored(large.select("key", "n", "id", "excess"), "buckets", members)
    if traits is not None:
        discard(traits)
    return forest

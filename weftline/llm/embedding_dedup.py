"""Near-duplicate embeddings by cover trees traversed in pairs.

Vectors of one label and one length are compared as points of the unit sphere, where a cosine of at
least ``c`` is a distance of at most ``sqrt(2 - 2c)``. Equal vectors are one point with a count.

The points of each label are dealt to cells around centers (from a bounded sample of all points: at
most CENTERS; every point goes to its nearest center, so the sample changes the work, not the result), and
a cell of more than CELL points into several. A cover tree of nested levels with halving radii is
built in each cell. Pairs of cells, then pairs of nodes from the top level down, are pruned where
the distance of their centers exceeds both covering radii and the threshold; pairs of points that
remain are decided by their cosine in double precision. A pair of cells gives out the number of links of
each point, and links that join its components, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from .components import components
from .scratch import stored

CENTERS, CELL = 1024, 1024
TOP_RADIUS, LEVELS = 1.0, 5
#: Bounds are kept this much wider than computed, more than rounding can take away.
SLACK = 1e-6
POINTS = "vec_id long, point string, label long, dim int, embedding array<double>"
CELLED = "point string, n long, label long, dim int, center int, part int, embedding array<double>"
CELLS = "cell long, label long, dim int, center array<double>, radius double, n int, points array<string>, copies array<long>, vectors binary, tree binary"
FOUND = "point string, n_links long, other string"


def label_key(kind: DataType) -> Column:
    """Labels of any type as numbers: integers as they are, others by their 64-bit hash; null stays null."""
    label = F.col("label")
    return label.cast("long") if isinstance(kind, IntegralType) else F.when(label.isNotNull(), F.xxhash64(label))


def points(rows: DataFrame) -> DataFrame:
    """``vec_id, point, label, dim, embedding``; point is null for a vector that links with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            point, dim = [], []
            for v, label in zip(batch.column(1), batch.column(2).to_pylist()):
                x = None if v.as_py() is None or label is None or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                good = x is not None and len(x) and np.isfinite(x).all() and x.any()
                point.append(hashlib.blake2b((x + 0.0).tobytes() + str(label).encode(), digest_size=16).hexdigest() if good else None)
                dim.append(len(x) if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(point, pa.string()), batch.column(2), pa.array(dim, pa.int32()), batch.column(1)], ["vec_id", "point", "label", "dim", "embedding"])

    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), label_key(rows.schema["label"].dataType).alias("label"))
    return rows.mapInArrow(read, POINTS)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that make their largest component about one: the cosine stays, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cover(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of a cover tree of unit vectors: each node's center, its covering radius, and its parent.

    Centers of a level with radius r cover its points within r and keep r apart inside one parent; the
    radii halve from level to level. The last level's nodes are the points.
    """
    owner, levels = np.zeros(len(x), np.int64), []
    for level in range(LEVELS):
        r = TOP_RADIUS / 2**level
        center, parent, node = [], [], np.full(len(x), -1, np.int64)
        for p in range(int(owner.max()) + 1):
            own = np.flatnonzero(owner == p)
            if len(own) == 1:
                node[own[0]] = len(center)
                center.append(own[0])
                parent.append(p)
                continue
            near = distances(x[own], x[own]) <= r
            free = np.ones(len(own), bool)
            for k in range(len(own)):
                if free[k]:
                    mine = free & near[k]
                    mine[k] = True
                    node[own[mine]] = len(center)
                    free &= ~mine
                    center.append(own[k])
                    parent.append(p)
        center = np.array(center, np.int64)
        radius = np.zeros(len(center))
        np.maximum.at(radius, node, np.sqrt(((x - x[center[node]]) ** 2).sum(1)))
        levels.append((center, radius, np.array(parent, np.int64)))
        owner = node
    levels.append((np.arange(len(x)), np.zeros(len(x)), owner))
    return levels


def close_pairs(x: np.ndarray, tx: list, y: np.ndarray, ty: list, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of two trees that may be within ``reach``, by a traversal of both from the top."""
    a = b = None
    for (ca, ra, pa_), (cb, rb, pb) in zip(tx, ty, strict=True):
        if a is None:
            d = distances(x[ca], y[cb])
            a, b = np.nonzero(d <= ra[:, None] + rb[None, :] + reach + SLACK)
            continue
        # children of the pairs that are left
        oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
        na, nb = np.bincount(pa_, minlength=int(a.max(initial=-1)) + 1), np.bincount(pb, minlength=int(b.max(initial=-1)) + 1)
        fa, fb = np.cumsum(na) - na, np.cumsum(nb) - nb
        n = na[a] * nb[b]
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ia, ib = oa[fa[a[pair]] + k // nb[b[pair]]], ob[fb[b[pair]] + k % nb[b[pair]]]
        keep = np.zeros(len(ia), bool)
        for s in range(0, len(ia), 200_000):
            u, v = ia[s : s + 200_000], ib[s : s + 200_000]
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x[ca[u]], y[cb[v]]), 0))
            keep[s : s + 200_000] = d <= ra[u] + rb[v] + reach + SLACK
        a, b = ia[keep], ib[keep]
    return a, b


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            return low


def sample_centers(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Centers for each label and length: unit vectors of a sample, thinned so that they keep TOP_RADIUS / 2 apart."""
    number = min(CENTERS, 1 + classes.count() // (CELL // 2))
    picked = classes.orderBy(F.xxhash64("point"), "point").limit(number)
    out: dict[tuple[int, int], list] = {}
    for label, dim, v in picked.select("label", "dim", "embedding").collect():
        out.setdefault((label, dim), []).append(v)
    centers = {}
    for key, rows in out.items():
        x = unit(np.array(rows, np.float64))
        keep: list[int] = []
        for k in range(len(x)):
            if not keep or distances(x[k : k + 1], x[keep]).min() > TOP_RADIUS / 2:
                keep.append(k)
        centers[key] = x[keep]
    return centers


def dealt(classes: DataFrame, centers: dict) -> DataFrame:
    """Every point with its nearest center; -1 where its label has no center."""
    sent = classes.sparkSession.sparkContext.broadcast(centers)  # CENTERS vectors at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = (np.array(batch.column(k).to_pylist(), np.int64) for k in (2, 3))
            nearest = np.full(batch.num_rows, -1, np.int32)
            lists = batch.column(4)
            for key in set(zip(label.tolist(), dim.tolist())):
                own = np.flatnonzero((label == key[0]) & (dim == key[1]))
                c = sent.value.get(key)
                if c is not None:
                    x = unit(lists.take(pa.array(own)).flatten().to_numpy().reshape(len(own), key[1]))
                    nearest[own] = np.argmax(x @ c.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(nearest), pa.array(np.zeros(batch.num_rows, np.int32)), lists], ["point", "n", "label", "dim", "center", "part", "embedding"])

    out = classes.select("point", "n", "label", "dim", "embedding").mapInArrow(deal, CELLED)
    sizes = out.groupBy("label", "dim", "center").agg(F.ceil(F.count("*") / F.lit(CELL)).alias("parts"))
    out = out.drop("part").join(sizes, ["label", "dim", "center"])
    return out.withColumn("part", F.pmod(F.xxhash64("point", F.lit(3)), F.col("parts")).cast("int"))


def cells(points_in: DataFrame) -> DataFrame:
    """A row for each cell, with its points and its cover tree."""
    import pickle

    def build(group: pa.Table) -> pa.Table:
        x = group["embedding"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        order = np.argsort(np.array(group["point"].to_pylist()))
        x, u = x[order], unit(x[order])
        middle = u.mean(axis=0)
        middle = middle / np.sqrt((middle**2).sum()) if (middle**2).sum() > 1e-12 else u[0]
        label, dim, center, part = (group[c][0].as_py() for c in ("label", "dim", "center", "part"))
        number = int.from_bytes(hashlib.blake2b(f"{label} {dim} {center} {part}".encode(), digest_size=7).digest(), "big")
        radius = float(np.sqrt(((u - middle) ** 2).sum(1)).max())
        row = {
            "cell": number, "label": label, "dim": dim, "center": middle.tolist(), "radius": radius, "n": len(x),
            "points": group["point"].take(pa.array(order)).to_pylist(), "copies": group["n"].take(pa.array(order)).to_pylist(), "vectors": x.tobytes(), "tree": pickle.dumps(cover(u)),
        }
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    return points_in.groupBy("label", "dim", "center", "part").applyInArrow(build, CELLS)


def links_of_cells(table: DataFrame, cosine: float) -> DataFrame:
    """``point, n_links, other`` from every pair of cells that the covering radii don't prune."""
    import pickle

    reach = float(np.sqrt(2 - 2 * cosine))
    head = table.select("cell", "label", "dim", "center", "radius")
    x, y = (head.select("label", "dim", *(F.col(c).alias(f"{c}_{i}") for c in ("cell", "center", "radius"))) for i in "ab")
    apart = F.sqrt(F.aggregate(F.zip_with("center_a", "center_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    pairs = x.join(y, ["label", "dim"]).where(F.col("cell_a") <= F.col("cell_b")).where(apart <= F.col("radius_a") + F.col("radius_b") + F.lit(reach + SLACK)).select("cell_a", "cell_b")
    a, b = (table.select(*(F.col(c).alias(f"{c}_{i}") for c in ("cell", "points", "copies", "vectors", "tree"))) for i in "ab")
    work = pairs.join(a, "cell_a").join(b, "cell_b")
    work = work.select("cell_a", "points_a", "copies_a", "vectors_a", "tree_a", "cell_b", "points_b", "copies_b", "vectors_b", "tree_b")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(k)[r].as_py() for k, c in enumerate(batch.schema.names)}
                side = []
                for i in "ab":
                    v = scaled(np.frombuffer(row[f"vectors_{i}"]).reshape(len(row[f"points_{i}"]), -1))
                    side.append((v, unit(v), pickle.loads(row[f"tree_{i}"])))
                (v, u, t), (w, z, s) = side
                i, j = close_pairs(u, t, z, s, reach)
                same = row["cell_a"] == row["cell_b"]
                if same:
                    i, j = i[i < j], j[i < j]
                exact = np.zeros(len(i), bool)
                for k in range(0, len(i), 200_000):
                    p, q = v[i[k : k + 200_000]], w[j[k : k + 200_000]]
                    dot = lambda g, h: np.einsum("ij,ij->i", g, h)
                    exact[k : k + 200_000] = dot(p, q) / (np.sqrt(dot(p, p)) * np.sqrt(dot(q, q))) >= cosine
                i, j = i[exact], j[exact]
                if not len(i):
                    continue
                n = len(v)
                names = row["points_a"] + ([] if same else row["points_b"])
                copies = np.array(row["copies_a"] + ([] if same else row["copies_b"]), np.float64)
                j = j if same else j + n
                count = (np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))).astype(np.int64)
                low = smallest_reachable(len(names), i, j)
                own = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in own]), pa.array(count[own]), pa.array([names[k] for k in low[own]])], ["point", "n_links", "other"])

    return work.mapInArrow(find, FOUND)


def near_duplicates(rows: DataFrame, cosine: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``rows`` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine in
    double precision is ``cosine`` or more; other columns are ignored. Vectors that are null, empty or zero or
    hold null or non-finite numbers link with nothing. Rows that repeat a vec_id are vectors of
    their own with that id; a null id is never the smallest, and kept only where its component has no
    other. An empty table gives no rows.
    """
    found = stored(points(rows), "vectors")
    classes = found.where("point is not null").groupBy("point").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("embedding").alias("embedding"))
    classes = stored(classes, "points")
    table = stored(cells(dealt(classes, sample_centers(classes))), "cells")
    links = stored(links_of_cells(table, cosine), "links")
    own = classes.select("point", "least", "n")
    count = links.groupBy("point").agg(F.sum("n_links").alias("others"))
    joined = components(links, "point", "other").withColumnRenamed("id", "point")
    own = own.join(count, "point", "left").join(joined, "point", "left").withColumn("component", F.coalesce("component", "point"))
    own = stored(own, "own")
    # stored, so that the join below is one of two plain exchanges, in which Spark may split a large component
    smallest = stored(own.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    own = own.join(smallest, "component").select("point", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = found.select("vec_id", "point").join(own, "point", "left")
    component = F.when(F.col("point").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: links and components of all embeddings at a cosine of 0.93."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op5_embedding_near_dedup": query}
ORACLE_SQL = {
    "op5_embedding_near_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
), n as (
  select *, coalesce(label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0, false) as good from v
), l as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where a.good and b.good and list_cosine_similarity(a.e, b.e) >= 0.93
), r as (
  select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a
), c as (select a, min(b) as component_id from r group by a),
k as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v join c on c.a = vec_id left join k on k.a = vec_id
"""
}

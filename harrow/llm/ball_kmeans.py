"""Centroid clustering: ball k-means, in whole numbers.

A cluster is a ball: its centroid, and a radius within which its members lie. Only centroids nearer than twice the radius are its neighbours. Members nearer to their centroid than half the way to the nearest neighbour are the stable core, which is compared with nothing else; the rings between half-ways are compared with the neighbours whose half-way they pass, and no others. Distances are squared and whole, so nothing is rounded and ties are ties.

Vectors stay in their partitions: a round reads them with the clusters that the round before gave them, and only sums a cluster and task are shuffled. Centroids, their distances, radii and neighbours (k of each) are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.llm.shared import discard, stash

#: Components below this size have squared distances that fit 64 bits, up to 128 components; larger ones are Python's numbers.
SMALL = 1 << 27
_STATS = "cluster int, n long, inertia decimal(38,0), farthest long, sums array<decimal(38,0)>"


def whole(embedding: Column, dims: int, scale: int) -> Column:
    """The components as floor(scale * x); null unless there are dims of them, none null or non-finite."""
    x = F.transform(embedding, lambda e: e.cast("double"))
    odd = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when((F.size(embedding) == dims) & ~odd, F.transform(x, lambda e: F.floor(e * scale)))


class Balls:
    """Centroids with what an assignment needs to know of them. radius: a bound of the members' distance, None if there is none yet."""

    def __init__(self, centroids: list[list[int]], radius: list[int | None]) -> None:
        self.small = all(abs(x) < SMALL for c in centroids for x in c)
        c = np.array(centroids, np.int64 if self.small else object).reshape(len(centroids), -1)
        self.centroids = c
        self.apart = [((c - own) ** 2).sum(axis=1) for own in c]  # squared distances between centroids
        self.neighbours = []
        for i, r in enumerate(radius):
            near = [j for j in range(len(c)) if j != i and (r is None or self.apart[i][j] <= 4 * r * r)]
            self.neighbours.append(sorted(near, key=lambda j: (self.apart[i][j], j)))

    def assign(self, v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row of v and its squared distance; ties go to the smaller number. own: the cluster that each is a member of."""
        if not self.small or (v.size and np.abs(v).max() >= SMALL):
            v = v.astype(object)
        cluster, distance = own.copy(), np.zeros(len(v), v.dtype)
        for i in np.unique(own).tolist():
            at = np.flatnonzero(own == i)
            d = ((v[at] - self.centroids[i]) ** 2).sum(axis=1)
            order = np.argsort(d, kind="stable")
            at, d = at[order], d[order]
            best, least = np.full(len(at), i), d.copy()
            for j in self.neighbours[i]:
                # members within half the way to j cannot be nearer to it; neighbours come by distance, so the rest have smaller rings still
                first = int(np.searchsorted(4 * d, self.apart[i][j]))
                if first == len(d):
                    break
                e = ((v[at[first:]] - self.centroids[j]) ** 2).sum(axis=1)
                nearer = (e < least[first:]) | ((e == least[first:]) & (j < best[first:]))
                best[first:] = np.where(nearer, j, best[first:])
                least[first:] = np.where(nearer, e, least[first:])
            cluster[at], distance[at] = best, least
        return cluster, distance


def _rows(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)


def assigned(vectors: DataFrame, balls: Balls, dims: int) -> DataFrame:
    """vectors (vec_id, v, cluster, ...) with the nearest cluster and the squared distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(balls)
    shape = StructType([vectors.schema["vec_id"], vectors.schema["v"], *StructType.fromDDL("cluster int, distance long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, distance = shared.value.assign(_rows(b, dims), b.column("cluster").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster.tolist(), pa.int32()), pa.array(distance.tolist(), pa.int64())], shape.names)

    return vectors.mapInArrow(run, shape)


def _stats(vectors: DataFrame, dims: int) -> dict[int, dict]:
    """For each cluster: n, inertia, farthest (all of squared distances) and sums of components. Tasks add up their own rows; at most dims rows a cluster reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            v, own, d = _rows(b, dims), b.column("cluster").to_numpy(), b.column("distance").to_numpy().astype(object)
            if v.size and np.abs(v).max() >= SMALL:
                v = v.astype(object)
            for i in np.unique(own).tolist():
                rows = own == i
                n, inertia, farthest, sums = held.get(i, (0, 0, 0, [0] * dims))
                held[i] = [n + int(rows.sum()), inertia + int(d[rows].sum()), max(farthest, int(d[rows].max())), [x + int(y) for x, y in zip(sums, v[rows].sum(axis=0))]]
        if held:
            n, inertia, farthest, sums = zip(*held.values())
            wide = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(n, pa.int64()), pa.array(inertia, wide), pa.array(farthest, pa.int64()), pa.array(sums, pa.list_(wide))], ["cluster", "n", "inertia", "farthest", "sums"])

    parts = stash(vectors.select("v", "cluster", "distance").mapInArrow(run, _STATS), "sums")
    by = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.max("farthest").alias("farthest"))
    out = {r["cluster"]: {"n": r["n"], "inertia": int(r["inertia"]), "farthest": r["farthest"], "sums": [0] * dims} for r in by.collect()}
    each = parts.select("cluster", F.posexplode("sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"))
    for r in each.collect():
        out[r["cluster"]]["sums"][r["pos"]] = int(r["x"])
    discard(parts)
    return out


def _root(x: int) -> int:
    """The square root, rounded up."""
    return isqrt(x) + (isqrt(x) ** 2 < x)


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of embeddings (vec_id, embedding) with dims components, none null or non-finite; other rows are left out.

    The k vectors of smallest sha256(salt + vec_id) are the first centroids; a vector without vec_id is never one, rows that share a vec_id stand in the order of their components. With fewer vectors there are fewer centroids. Repeated rows are vectors of their own; an empty table gives no rows; other columns are not read. A squared distance beyond 64 bits raises.
    """
    spark = embeddings.sparkSession
    d = embeddings.select("vec_id", whole(F.col("embedding"), dims, scale).alias("v")).where("v is not null").withColumn("cluster", F.lit(0))
    now = stash(d, "vectors")
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = now.where("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = [list(r["v"]) for r in first] or [[0] * dims]
    radius: list[int | None] = [None] * len(centroids)
    for at in range(rounds + 1):
        before, now = now, stash(assigned(now, Balls(centroids, radius), dims), "vectors")
        discard(before)
        stats = _stats(now, dims)
        if at == rounds:
            break
        for i, s in stats.items():
            moved = [x // s["n"] for x in s["sums"]]
            shift = sum((x - y) ** 2 for x, y in zip(moved, centroids[i]))
            centroids[i], radius[i] = moved, _root(s["farthest"]) + _root(shift)
        for i in range(len(centroids)):
            if i not in stats:
                radius[i] = 0  # a ball without members
    total = sum(s["inertia"] for s in stats.values())
    rows = [(i, s["inertia"], total, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, s in stats.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same by comparing every vector with every centroid."""
    steps = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "e as materialized (select r, unnest(range(1, len(v) + 1)) as pos, unnest(v) as x from v)",
        f"first as (select row_number() over (order by sha256('{salt}' || vec_id), v) - 1 as c, v from v where vec_id is not null qualify c < {k})",
        "c0 as materialized (select c, unnest(range(1, len(v) + 1)) as pos, unnest(v) as x from first)",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} as (select e.r, c.c, sum((e.x - c.x) * (e.x - c.x))::bigint as d from e join c{n} c on e.pos = c.pos group by e.r, c.c)")
        steps.append(f"a{n} as materialized (select r, c, d from d{n} qualify row_number() over (partition by r order by d, c) = 1)")
        if n < rounds:
            steps.append(f"s{n} as (select a.c, e.pos, sum(e.x) as x, count(*) as n from e join a{n} a on e.r = a.r group by a.c, e.pos)")
            steps.append(f"c{n + 1} as materialized (select c.c, c.pos, case when s.n is null then c.x else ((s.x - ((s.x % s.n) + s.n) % s.n) // s.n)::bigint end as x from c{n} c left join s{n} s on c.c = s.c and c.pos = s.pos)")
    return f"""with {", ".join(steps)}, h as (select c, sha256(string_agg(x::varchar, ',' order by pos)) as centroid_sha256 from c{rounds} group by c)
select v.vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, h.centroid_sha256
from a{rounds} a join v on v.r = a.r join h on h.c = a.c"""

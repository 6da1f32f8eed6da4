"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so a cosine of c is a distance of sqrt(2 - 2c). Each of ``TABLES`` tables rounds
``DEPTH`` Gaussian projections, shifted at random, to a grid of step ``STEP``; vectors with the same cell in a
table meet there (Datar et al.). At cosine 0.9 two vectors meet in one table with probability 0.82 ** DEPTH and
in some table with 0.97; closer ones nearly always; unrelated ones (cosine 0) with 0.0007 a table.

Vectors that meet are compared in double precision in blocks of ``BLOCK``; larger buckets are dealt out as block
pairs. A pair counts in the first table in which it meets, which both vectors' cells tell, so links are counted
once without listing them; each block pair returns link counts and a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut
from plinthwork.operators.components import connected_components

COSINE, TABLES, DEPTH, STEP, BLOCK, SEED = 0.9, 24, 10, 2.0, 1024, 5


def _normal(v) -> np.ndarray | None:
    """Unit vector in double precision; None for null, zero, empty or non-finite ones."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _fold(grid: np.ndarray) -> np.ndarray:
    h = np.full(len(grid), 1469598103934665603, np.uint64)
    for j in range(grid.shape[1]):
        h = (h ^ grid[:, j].astype(np.uint64)) * np.uint64(1099511628211)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(16)).astype(np.uint32).view(np.int32)


def _hash(tables, depth, step, seed):
    made: dict[int, tuple] = {}

    def run(batches):
        for batch in batches:
            ids, copies, units, cells = [], [], [], []
            for i, n, v in zip(*(c.to_pylist() for c in batch.columns)):
                x = _normal(v)
                if x is not None:
                    if len(x) not in made:
                        rng = np.random.default_rng([seed, len(x)])
                        made[len(x)] = rng.standard_normal((tables * depth, len(x))), rng.uniform(0, step, tables * depth)
                    a, b = made[len(x)]
                    ids.append(i)
                    copies.append(n)
                    units.append(x.tobytes())
                    cells.append(_fold(np.floor((a @ x + b) / step).astype(np.int64).reshape(tables, depth)))
            flat = pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * tables, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(units, pa.binary()), lists], ["node", "copies", "unit", "cells"])

    return run


def _compare(cosine: float):
    def flush(rows):
        """Link counts and forest edges of one block pair; a vector with copies counts as often."""
        t, pair = rows[0][1], rows[0][2]
        node, copies = np.array([r[4] for r in rows]), np.array([r[7] for r in rows])
        counts, edges = np.zeros(len(rows), np.int64), []
        sizes = np.array([len(r[5]) for r in rows])
        for size in np.unique(sizes):  # vectors of other lengths never meet
            at = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join(rows[i][5] for i in at), np.float64).reshape(len(at), -1)
            cells = np.array([rows[i][6] for i in at], np.int32)
            side = np.array([rows[i][3] for i in at])
            top = np.arange(len(at)) if not pair else np.flatnonzero(side == 0)
            other = np.arange(len(at)) if not pair else np.flatnonzero(side == 1)
            label = np.arange(len(at))
            for lo in range(0, len(top), 256):
                a = top[lo : lo + 256]
                near = x[a] @ x[other].T >= cosine
                if not pair:
                    near &= other[None, :] > a[:, None]
                i, j = np.nonzero(near)
                i, j = a[i], other[j]
                for c in range(t):
                    if not len(i):
                        break
                    fresh = cells[i, c] != cells[j, c]
                    i, j = i[fresh], j[fresh]
                np.add.at(counts, at[i], copies[at[j]])
                np.add.at(counts, at[j], copies[at[i]])
                while len(i):  # merge labels; one link a merge is kept
                    p, q = label[i], label[j]
                    open_ = p != q
                    i, j, p, q = i[open_], j[open_], p[open_], q[open_]
                    if not len(i):
                        break
                    big, first = np.unique(np.maximum(p, q), return_index=True)
                    small = np.minimum(p, q)[first]
                    edges += list(zip(node[at[i[first]]].tolist(), node[at[j[first]]].tolist()))
                    to = np.arange(len(at))
                    to[big] = small
                    while (to[to] != to).any():
                        to = to[to]
                    label = to[label]
        hit = np.flatnonzero(counts)
        return [(int(node[i]), None, int(counts[i])) for i in hit] + [(a, b, 0) for a, b in edges]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["a", "b", "n"])

    def run(batches):
        held, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out += flush(held) if len(held) > 1 else []
                    held = []
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out = []
                held.append(row)
        out += flush(held) if len(held) > 1 else []
        if out:
            yield batch_of(out)

    return run


def vector_components(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, tables: int = TABLES, depth: int = DEPTH, step: float = STEP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Rows that
    repeat an id are vectors of their own and link with each other if they are near. A row with a null id links
    with nothing. No rows: no rows.
    """
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    node = F.xxhash64("v").alias("node")
    kinds = cut(base.where("id is not null and v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("low")).select(node, "copies", "low", "v"), "vectors")
    hashed = cut(kinds.select("node", "copies", "v").mapInArrow(_hash(tables, depth, step, seed), "node bigint, copies bigint, unit binary, cells array<int>"), "cells")
    met = hashed.select("node", F.posexplode("cells").alias("t", "cell"))
    sizes = met.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = met.join(sizes, ["t", "cell"]).withColumn("k", F.ceil(F.col("n") / block).cast("int"))
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("node"), F.col("k").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    group = F.xxhash64("t", "cell", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("node", "t", group.alias("g"), (F.col("own") != F.col("other")).cast("int").alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    rows = dealt.join(hashed, "node").select("g", "t", "pair", "side", "node", "unit", "cells", "copies")
    ran = cut(rows.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(cosine), "a bigint, b bigint, n bigint"), "links")
    counts = ran.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(ran.where("b is not null").select("a", "b"))
    # Copies of one vector link with each other; a vector that links with nothing has no row in hashed.
    named = hashed.select("node", "copies").join(kinds.select("node", "low"), "node").join(counts, "node", "left").join(parts, "node", "left")
    named = named.select("node", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("label"))
    named = cut(named, "labels")
    lows = cut(named.groupBy("label").agg(F.min("low").alias("component_id")), "lows")  # written: the join on a hot label can be split
    linked = named.join(lows, "label").select("node", "n", "component_id")
    keyed = base.select("id", F.when(F.col("id").isNotNull(), F.xxhash64("v")).alias("node"))
    out = keyed.join(linked, "node", "left").select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(False)))

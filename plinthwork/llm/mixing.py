"""Mixing sources to target weights by the cube method (Deville and Tille, "Efficient balanced sampling").

A source's target over its size gives each of its documents whole copies and one fractional inclusion
probability. The flight phase moves the probabilities of three documents at a time along the null space of two
constraints, the document total and the word total, until one of them is 0 or 1. Documents fly in hashed blocks
of their source; the two or so that each block leaves over fly again in blocks of blocks, so that a source with
a third of all rows is spread over many tasks. What is left at the top, two documents a source, is landed by
trying all their outcomes for the nearest word total, and by swaps that make up the rest.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinthwork.functions.storage import cut

WEIGHTS, SHARE, CEILING, BLOCK, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 4096, 17
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, ceiling=CEILING) -> dict:
    """Target of each source. Sources go by code point, null last; the excess over a ceiling is reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, open_ = share * sum(size.values()), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if part[s] > ceiling * size[s]]
        if not full:
            return out | part
        out |= {s: ceiling * size[s] for s in full}
        left -= sum(ceiling * size[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def fly(p: list[float], size: list[int], seed: int) -> list[float]:
    """Move fractional p to 0 or 1, keeping the sums of p and of p * size, until no three or equal two remain."""
    rng, active = random.Random(seed), []
    waiting = iter([i for i, x in enumerate(p) if 0 < x < 1])
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = (c - b, a - c, b - a) if not a == b == c else (1, -1, 0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1, -1)
        else:
            return p
        up = min((((1 - p[i]) if d > 0 else p[i]) / abs(d), k) for k, (i, d) in enumerate(zip(active, u)) if d)
        down = min(((p[i] if d > 0 else (1 - p[i])) / abs(d), k) for k, (i, d) in enumerate(zip(active, u)) if d)
        (step, hit), sign = (up, 1) if rng.random() * (up[0] + down[0]) < down[0] else (down, -1)
        for k, (i, d) in enumerate(zip(active, u)):
            x = p[i] + sign * step * d
            p[i] = round(x) if k == hit or x < 1e-9 or x > 1 - 1e-9 else x
        active = [i for i in active if 0 < p[i] < 1]


def land(p: list[float], size: list[int], before: list[float], swaps: int = 8) -> list[float]:
    """Round the few p still between 0 and 1 to the outcome with the nearest word total, then document total.

    What the rounding leaves of the word total is made up by swapping drawn for undrawn documents, the pair
    that brings it nearest each time; the document total stays. ``before`` has the probabilities to start with.
    """
    rest = [i for i, x in enumerate(p) if 0 < x < 1]
    if not rest:
        return p

    def off(outcome):
        moved = [o - p[i] for o, i in zip(outcome, rest)]
        return abs(sum(m * size[i] for m, i in zip(moved, rest))), abs(sum(moved)), outcome

    for i, o in zip(rest, min(itertools.product((0, 1), repeat=len(rest)), key=off)):
        p[i] = o
    lack = sum(b * s for b, s in zip(before, size)) - sum(x * s for x, s in zip(p, size))
    free = [i for i, b in enumerate(before) if 0 < b < 1]
    for _ in range(swaps):
        drawn = [i for i in free if p[i] == 1]
        spare = sorted((size[i], i) for i in free if p[i] == 0)
        best = None
        for i in drawn:
            at = bisect.bisect_left(spare, (size[i] + lack, -1))
            for s, j in spare[max(0, at - 1) : at + 1]:
                off_by = abs(lack - (s - size[i]))
                if best is None or (off_by, i, j) < best:
                    best = (off_by, i, j)
        if best is None or best[0] >= abs(lack):
            break
        _, i, j = best
        p[i], p[j], lack = 0, 1, lack - (size[j] - size[i])
    return p


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), weights=WEIGHTS, share=SHARE, ceiling=CEILING, block: int = BLOCK) -> DataFrame:
    """``doc_id, *keep, size, source_size, target, copies, taken`` for each row of ``docs``.

    Size is the number of words, 0 for a null text. A null source is a source of its own, last in order. A
    source without words has target 0 and nothing taken. Repeated rows are drawn one by one. Equal input gives
    equal output. One row a source goes to the driver.
    """
    spark = docs.sparkSession
    sized = cut(docs.select(F.col(doc_id).alias("__id"), *[F.col(c).alias(f"__k_{c}") for c in keep], F.col(source).cast("string").alias("__source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("__size")), "sizes")
    totals = sized.groupBy("__source").agg(F.sum("__size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    target = targets([(r["__source"], r["s"]) for r in totals], weights, share, ceiling)
    plan = []
    for r in totals:
        ratio = target[r["__source"]] / r["s"] if r["s"] else 0.0
        plan.append((r["__source"], r["s"], float(target[r["__source"]]), int(math.floor(ratio)), ratio - math.floor(ratio), max(1, math.ceil(r["n"] / block))))
    table = spark.createDataFrame(plan, "__src string, __total long, __target double, __base int, __p double, __blocks int")
    schema = T.StructType([*(f for f in sized.schema.fields if f.name != "__source"), *table.schema.fields, T.StructField("__more", T.IntegerType())])
    units = sized.join(F.broadcast(table), F.col("__source").eqNullSafe(F.col("__src")))  # of unknown size to Spark, which would broadcast the documents instead
    order = F.xxhash64(F.lit(SEED), "__id", "__size", *[f"__k_{c}" for c in keep])
    units = units.select(*schema.names[:-1], order.alias("__order"))
    schema = T.StructType([*schema.fields[:-1], T.StructField("__order", T.LongType()), schema.fields[-1]])

    def flight(last):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["__size", "__order", "__id"], ascending=[False, True, True], kind="stable", ignore_index=True)
            size, seed = pdf["__size"].tolist(), int(pdf["__order"].iloc[0]) & 0x7FFFFFFF  # short documents last: they are left over
            before = pdf["__p"].tolist()
            p = fly(list(before), size, seed)
            p = land(p, size, before) if last else p
            pdf["__p"] = p
            pdf["__more"] = [int(x) if x in (0, 1) else -1 for x in p]
            return pdf[schema.names]

        return run

    settled = units.where("__p = 0").withColumn("__more", F.lit(0))
    flying, blocks = units.where("__p > 0"), {r[0]: r[5] for r in plan}
    while True:
        last = max(blocks.values(), default=1) == 1
        ran = cut(flying.withColumn("__block", F.pmod("__order", F.col("__blocks").cast("long"))).groupBy("__src", "__block").applyInPandas(flight(last), schema), "flight")
        settled = settled.unionByName(ran.where("__more >= 0"))
        if last:
            break
        blocks = {s: max(1, math.ceil(2 * n / block)) for s, n in blocks.items()}
        flying = ran.where("__more < 0").drop("__more").withColumn("__blocks", F.greatest(F.lit(1), F.ceil(F.col("__blocks") * 2 / block)).cast("int")).select(*schema.names[:-1])
    copies = F.col("__base") + F.col("__more")
    return settled.select(F.col("__id").alias(doc_id), *[F.col(f"__k_{c}").alias(c) for c in keep], F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it; all columns stay as they are."""
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("__k1"), F.xxhash64(text, source).alias("__k2")]
    keyed = docs.select("*", *key)
    taken = mix(keyed, doc_id, text, source, keep=("__k1", "__k2")).groupBy("__k1", "__k2").agg(F.sum("copies").cast("int").alias("__n"), F.count(F.lit(1)).alias("__rows")).where("__n > 0")
    once = keyed.hint("merge").join(taken, ["__k1", "__k2"])  # either side has about a row a document: neither is broadcast, however small its file
    each = once.where("__rows = 1").unionByName(once.where("__rows > 1").dropDuplicates(["__k1", "__k2"]))
    return each.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)

"""Deduplication of master records in phases, and the identity graph of several registers.

A phase blocks the surviving records by a key. The best ranked record of a block absorbs each other one that is like
enough, but never one protected record another. Survivors carry what they absorbed into the next phase. All joins
are against one winner a block, so work is linear in the records, whatever the size of a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinthwork.functions import similarity as sim
from plinthwork.functions.storage import cut, drop
from plinthwork.operators.components import connected_components

# Rank of a record's origin, and of the origin of its number of employees.
ORIGINS = {"f7": 0, "sam": 1, "mergent": 2, "bmf": 3, "sec": 4, "990": 5, "gleif": 6}
EMPLOYEE_ORIGINS = {"f7": 0, "mergent": 1, "sam": 2, "bmf": 3, "990": 4}
LAST = 99
TEXTS = ("name", "city", "state", "zip", "naics", "ein")
FLAGS = ("is_union", "is_public", "is_contractor", "is_nonprofit")


def _rank(column: Column, ranks: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(column, F.lit("")))), F.lit(LAST))


def _given(x: str) -> Column:
    return F.nullif(F.trim(F.col(x)), F.lit(""))


@dataclass(frozen=True)
class Phase:
    """``keys`` make a block (a null or blank one: none), of at most ``largest`` records; ``likeness`` is the least
    token-sort similarity to the winner, ``or_state`` lets an equal state do instead, ``where`` says who takes part."""

    name: str
    keys: tuple[str, ...]
    likeness: float | None = None
    largest: int | None = None
    or_state: bool = False
    where: str = "true"


# Keys, similarities and largest blocks of the phases. A larger block is no evidence and is left alone.
PHASES = (
    Phase("ein", ("nullif(trim(ein), '')",), 0.70, or_state=True),
    Phase("name_state_exact", ("nullif(trim(name), '')", "state")),
    Phase("name_geo_3a", ("left(nullif(trim(zip), ''), 5)",), 0.82, 500, where="nullif(trim(name), '') is not null"),
    Phase("name_geo_3b", ("nullif(trim(city), '')", "state"), 0.85, 500, where="nullif(trim(name), '') is not null"),
    Phase("name_geo_3c", ("state", "left(nullif(trim(name), ''), 8)"), 0.85, 200, where="nullif(trim(city), '') is null and nullif(trim(zip), '') is null"),
)


def merges_of(records: DataFrame, phase: Phase) -> DataFrame:
    """``loser, winner, phase, similarity, confidence`` of one phase; a winner is no loser of the same phase."""
    keyed = records.where(phase.where).select("*", *[F.expr(k).alias(f"__k{i}") for i, k in enumerate(phase.keys)])
    names = [f"__k{i}" for i in range(len(phase.keys))]
    keyed = keyed.where(" and ".join(f"{n} is not null" for n in names)).withColumn("__rank", F.struct((~F.col("protected")).cast("int").alias("a"), _rank(F.col("origin"), ORIGINS).alias("b"), "id"))
    seen = ["id", "name", "state", "protected"]
    best = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*seen), "__rank").alias("w")).where(F.col("n").between(2, phase.largest or (1 << 62)))
    best = cut(best.select(*names, "w"), "winners")  # written: the join on a block with very many records can be split
    pairs = keyed.select(*names, *seen).join(best, names).where((F.col("id") != F.col("w.id")) & ~(F.col("protected") & F.col("w.protected")))
    like = F.when(F.length("name") * F.length("w.name") > 0, sim.token_sort_col(F.col("name"), F.col("w.name")) / 100).otherwise(F.lit(0.0))
    scored = pairs.select(F.col("id").alias("loser"), F.col("w.id").alias("winner"), F.coalesce(like, F.lit(0.0)).alias("similarity"), (F.coalesce(_given("state") == F.nullif(F.trim("w.state"), F.lit("")), F.lit(False))).alias("same"))
    if phase.likeness is not None:
        scored = scored.where((F.col("similarity") >= phase.likeness) | (F.col("same") & phase.or_state))
    return scored.select("loser", "winner", F.lit(phase.name).alias("phase"), "similarity", F.least(F.lit(0.99), F.greatest(F.lit(0.60), F.col("similarity"))).alias("confidence"))


def absorbed(records: DataFrame, merges: DataFrame) -> DataFrame:
    """The records without the losers; winners take the longest text of each field, all flags and sources, and the best known employees.

    A winner's own text stays unless a loser's is longer (of equals, the one of the smallest id); order of the merges does not matter.
    """
    losers = records.withColumnRenamed("id", "loser").join(merges.select("loser", "winner"), "loser")
    longest = [F.max_by(_given(c), F.when(_given(c).isNotNull(), F.struct(F.length(_given(c)), -F.col("loser")))).alias(f"__{c}") for c in TEXTS]
    known = F.when(F.col("employees").isNotNull(), F.struct(_rank(F.coalesce("employees_source", "origin"), EMPLOYEE_ORIGINS).alias("r"), F.col("loser")))
    count = F.min_by(F.struct("employees", F.coalesce("employees_source", "origin").alias("source"), _rank(F.coalesce("employees_source", "origin"), EMPLOYEE_ORIGINS).alias("r")), known).alias("__count")
    gained = losers.groupBy(F.col("winner").alias("id")).agg(*longest, count, *[F.bool_or(c).alias(f"__{c}") for c in FLAGS], F.array_distinct(F.flatten(F.collect_list("sources"))).alias("__sources"))
    left = records.join(merges.select(F.col("loser").alias("id")), "id", "left_anti").join(gained, "id", "left")
    own_rank = _rank(F.coalesce("employees_source", "origin"), EMPLOYEE_ORIGINS)
    take = F.col("__count.employees").isNotNull() & (F.col("employees").isNull() | (F.col("__count.r") < own_rank))
    new = {c: F.when(_given(c).isNull() | (F.length(f"__{c}") > F.length(_given(c))), F.coalesce(F.col(f"__{c}"), _given(c))).otherwise(_given(c)) for c in TEXTS}
    new |= {"employees": F.when(take, F.col("__count.employees")).otherwise(F.col("employees")), "employees_source": F.when(take, F.col("__count.source")).otherwise(F.col("employees_source"))}
    new |= {c: F.col(c) | F.coalesce(F.col(f"__{c}"), F.lit(False)) for c in FLAGS}
    new |= {"sources": F.array_distinct(F.concat("sources", F.coalesce("__sources", F.array().cast("array<string>"))))}
    return left.select(*[new.get(c, F.col(c)).alias(c) for c in records.columns])


def quality(record_sources: Column) -> Column:
    """20 to 100 by the number of sources and how complete a record is."""
    n, placed = F.size(record_sources), _given("city").isNotNull() & _given("state").isNotNull()
    any_, all_ = F.col("employees").isNotNull() | F.col("naics").isNotNull(), F.col("employees").isNotNull() & F.col("naics").isNotNull()
    full = placed & all_
    return F.when((n >= 5) | (n >= 4) & full, 100).when((n >= 4) | (n >= 3) & full, 80).when((n >= 3) | (n >= 2) & placed & any_, 60).when(placed & any_, 40).otherwise(20)


def dedup_masters(records: DataFrame, phases: tuple[Phase, ...] = PHASES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Masters with ``quality``, the log of merges, and ``id, master`` of every record; each phase is written.

    Records have ``id, name, city, state, zip, naics, ein, employees, employees_source, origin, protected, sources``
    (array of distinct strings) and the flags; further columns stay as the winner has them. A null id is left out.
    """
    now, logs = cut(records.where("id is not null").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("protected", *FLAGS)} | {"sources": F.coalesce("sources", F.array().cast("array<string>"))}), "masters"), []
    members = now.select("id", F.col("id").alias("master"))
    for phase in phases:
        merges = cut(merges_of(now, phase), "merges")
        logs.append(merges)
        before, now = now, cut(absorbed(now, merges), "masters")
        drop(before) if len(logs) > 1 else None
        step = merges.select(F.col("loser").alias("master"), F.col("winner").alias("__to"))
        members = members.join(step, "master", "left").select("id", F.coalesce("__to", "master").alias("master"))
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    return now.withColumn("quality", quality(F.col("sources"))), log, members


# Identity graph


def crosswalk(nodes: DataFrame, edges: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """``node, family, tier`` from edges ``a, b, tier``, with no family of two conflicting identifiers.

    ``nodes`` are ``node, identifier`` (null: unknown). Edges are added tier by tier, surest first (``tiers`` maps
    their names to ranks). Where a tier would join families that know different identifiers, its edges in that
    cluster of families that touch a family with an identifier are left out, those between families without one
    stay; so nothing that a surer tier has joined is parted, and what is ambiguous stays apart. ``tier`` is the
    tier that first put the node into a family of two or more.
    """
    state = cut(nodes.select("node", F.col("node").alias("family"), "identifier", F.lit(None).cast("string").alias("tier")), "families")
    for name, _ in sorted(tiers.items(), key=lambda t: t[1]):
        known = state.groupBy("family").agg(F.max("identifier").alias("known"))
        side = lambda c: state.select(F.col("node").alias(c), F.col("family").alias(f"f{c}"))
        new = edges.where(F.col("tier") == name).join(side("a"), "a").join(side("b"), "b").where("fa <> fb").select(F.least("fa", "fb").alias("x"), F.greatest("fa", "fb").alias("y")).distinct()
        new = cut(new.join(known.select(F.col("family").alias("x"), F.col("known").alias("kx")), "x").join(known.select(F.col("family").alias("y"), F.col("known").alias("ky")), "y"), "edges")
        fine = new.where("kx is null or ky is null or kx = ky")  # a conflict between the two ends is never joined
        parts = connected_components(fine, "x", "y")
        members = cut(parts.join(known, F.col("node") == F.col("family")).select("family", "component", "known"), "joined")
        bad = members.groupBy("component").agg((F.count_distinct("known") > 1).alias("bad"))
        # Parts of a conflicting component: only what has no identifier on either side stays joined.
        rest = fine.join(members.select(F.col("family").alias("x"), "component"), "x").join(bad.where("bad"), "component").where("kx is null and ky is null")
        again = connected_components(rest.select("x", "y"), "x", "y")
        good = members.join(bad.where("not bad"), "component").select("family", F.col("component").alias("to"))
        moved = good.unionByName(again.select(F.col("node").alias("family"), F.col("component").alias("to")))
        state = cut(
            state.join(moved, "family", "left").select("node", F.coalesce("to", "family").alias("family"), "identifier", F.coalesce("tier", F.when(F.col("to").isNotNull(), F.lit(name))).alias("tier")), "families"
        )
    size = F.count(F.lit(1)).over(Window.partitionBy("family"))
    return state.select("node", "family", F.when(size > 1, F.col("tier")).alias("tier"))

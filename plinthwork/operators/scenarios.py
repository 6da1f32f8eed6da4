"""Matching by configuration: tiers are rows of key expressions, laid out on both sides and met in one join; orphans matched anew.

A tier never runs a scan of its own: each record lists its keys of all tiers, and all tiers meet in one equi-join.
Tiers that compare names look only at pairs whose key they share. The surest tier wins, then the higher score, then the smallest id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinthwork.functions import similarity as sim
from plinthwork.functions.storage import cut
from plinthwork.operators.matching import classify_pairs
from plinthwork.operators.relational import first_by


@dataclass(frozen=True)
class Tier:
    """``source`` and ``target`` are SQL of the parts of a key, all of which have to be known; ``likeness`` is the least
    trigram similarity of the names in ``name``, which then is the score."""

    number: int
    method: str
    score: float
    source: tuple[str, ...]
    target: tuple[str, ...] | None = None
    likeness: float | None = None
    confidence: str = "HIGH"

    def key(self, side: str) -> Column:
        parts = self.source if side == "source" or self.target is None else self.target
        values = [F.nullif(F.trim(F.expr(p).cast("string")), F.lit("")) for p in parts]
        return F.concat(F.lit(f"{self.number}|"), *[x for i, v in enumerate(values) for x in ([F.lit("|"), v] if i else [v])])  # null where a part is


# Tiers, scores and confidences of the scenarios, and of matching orphans anew.
ADDRESS_LIKENESS, FUZZY_LIKENESS = 0.4, 0.70
SCENARIO = (
    Tier(1, "EIN", 1.0, ("ein",)), Tier(2, "NORMALIZED", 1.0, ("name_standard", "state")), Tier(3, "ADDRESS", 0.0, ("street_no", "city", "state"), likeness=ADDRESS_LIKENESS),
    Tier(4, "AGGRESSIVE", 0.95, ("name_aggressive", "state"), confidence="MEDIUM"), Tier(5, "FUZZY", 0.0, ("state", "left(name_aggressive, 3)"), likeness=FUZZY_LIKENESS, confidence="LOW"),
)
ORPHAN_TIERS = (
    Tier(1, "NAME_STANDARD_STATE_ZIP_EXACT", 1.00, ("name_standard", "state", "zip"), ("lower(name_norm)", "state", "zip")), Tier(2, "NAME_STANDARD_STATE_EXACT", 0.98, ("name_standard", "state"), ("lower(name_norm)", "state")),
    Tier(3, "NAME_AGGRESSIVE_STATE_EXACT", 0.92, ("name_aggressive", "state"), ("lower(name_norm)", "state")),
)
ORPHAN_SOURCES = ("osha", "whd", "990", "sam")
CONFIRMED, PROBABLE = 0.96, 0.91


def _pairs(sources: DataFrame, targets: DataFrame, tiers: tuple[Tier, ...], left: list[str], right: list[str], firsts: bool = False) -> DataFrame:
    """``id, target_id, number, *left columns, *right columns`` of all pairs that share a key of a tier.

    With ``firsts``, targets with one key and one name, the only right column, are met as one, the smallest id, and have the name's trigrams ``target___g``.
    """
    keyed = []
    for df, side, names, id in ((sources, "source", left, "id"), (targets, "target", right, "target_id")):
        keys = F.array_compact(F.array(*[F.when(t.key(side).isNotNull(), F.struct(F.lit(t.number).alias("number"), t.key(side).alias("key"))) for t in tiers]))
        keyed.append(df.select(F.col("id").alias(id), *[F.col(c).alias(f"{side}_{c}") for c in names], F.explode(keys).alias("__k")).select("*", "__k.*").drop("__k"))
    if firsts:
        keyed[1] = keyed[1].groupBy("number", "key", f"target_{right[0]}").agg(F.min("target_id").alias("target_id")).withColumn("target___g", sim.trigrams(f"target_{right[0]}"))
    return keyed[0].join(keyed[1], ["number", "key"]).drop("key")


def scenario_match(sources: DataFrame, targets: DataFrame, tiers: tuple[Tier, ...] = SCENARIO, name: str = "name_standard") -> DataFrame:
    """``id, target_id, tier, method, score, confidence``: the best match of each source; none for a source without any."""
    # A score is the names' alone: of the targets of one key and name, the smallest id stands for all. Grams are made once a name and key.
    rare = _pairs(sources.withColumn("__g", sim.trigrams(name)), targets, tiers, ["__g"], [name], firsts=True)
    by = {t.number: F.struct(F.lit(t.method).alias("method"), F.lit(float(t.score)).alias("score"), F.lit(t.likeness).cast("double").alias("likeness"), F.lit(t.confidence).alias("confidence")) for t in tiers}
    told = F.create_map(*[x for n, v in by.items() for x in (F.lit(n), v)])
    judged = rare.withColumn("t", F.try_element_at(told, F.col("number"))).withColumn("score", F.when(F.col("t.likeness").isNull(), F.col("t.score")).otherwise(sim.jaccard("source___g", "target___g")))
    fine = judged.where(F.col("t.likeness").isNull() | (F.col("score") >= F.col("t.likeness")))
    best = first_by(fine, ["id"], [F.asc("number"), F.desc("score"), F.asc("target_id")])
    return best.select("id", "target_id", F.col("number").alias("tier"), "t.method", "score", "t.confidence")


def rematch_orphans(orphans: DataFrame, records: DataFrame, tiers: tuple[Tier, ...] = ORPHAN_TIERS, order: tuple[str, ...] = ORPHAN_SOURCES) -> tuple[DataFrame, DataFrame]:
    """The best new match of each orphan, and all matches that ask for review.

    ``orphans`` have ``id, name, name_standard, name_aggressive, state, zip, city``, ``records`` ``id, source, name,
    name_norm, state, zip, city, ein``. Exact tiers make pairs, the duplicate rules judge them: a series or another person drops a
    pair, a confirmed one lifts its score. Ties go by the order of the sources, then by id.
    """
    fields = ["name", "state", "zip", "city"]
    met = _pairs(orphans, records, tiers, fields, [*fields, "source", "ein"])
    by = {t.number: (t.method, t.score) for t in tiers}
    method = F.create_map(*[F.lit(x) for n, (m, _) in by.items() for x in (n, m)])[F.col("number")]
    score = F.create_map(*[F.lit(x) for n, (_, s) in by.items() for x in (n, s)])[F.col("number")]
    standard = F.when(F.startswith(method, F.lit("NAME_STANDARD")), 1.0).otherwise(0.85)
    pairs = met.select(
        "id", "target_id", method.alias("method"), score.alias("base"), F.col("source_name").alias("name_1"), F.col("target_name").alias("name_2"), F.lit("f7").alias("source_1"), F.col("target_source").alias("source_2"), F.col("source_zip").alias("zip_1"), F.col("target_zip").alias("zip_2"),
        F.col("source_city").alias("city_1"), F.col("target_city").alias("city_2"), F.lit(None).cast("string").alias("ein_1"), F.col("target_ein").alias("ein_2"), F.greatest(standard, F.lit(1.0)).alias("sim"),
    )
    # Written on both sides of the rules: each rule reads its inputs, and what follows its tier, more than once.
    judged = cut(classify_pairs(cut(pairs, "orphan-pairs")), "orphans-judged").where("tier <> 'tier_series_demoted'")
    lifted = F.when(F.col("tier") == "tier_A_auto_merge", F.greatest("base", F.lit(CONFIRMED))).when(F.col("tier") == "tier_B_high_conf", F.greatest("base", F.lit(PROBABLE))).otherwise(F.col("base"))
    scored = judged.select("id", "target_id", F.col("source_2").alias("source"), "method", lifted.alias("score"), "tier", "rule")
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source")), F.lit(0)), F.lit(len(order) + 1))
    best = first_by(scored.withColumn("__place", place), ["id"], [F.desc("score"), F.asc("__place"), F.asc("target_id"), F.asc("method")]).drop("__place")
    return best, scored.where("tier = 'tier_C_review'")

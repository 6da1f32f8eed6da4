"""Probabilistic record linkage (Fellegi and Sunter): comparison levels, m and u by counts of patterns, scored pairs.

Records that share a blocking key are dealt to tiles of some ``TILE`` by ``TILE`` records. A tile compares its
distinct values once, turns every pair into the number of its pattern of comparison levels, and gives out either the
number of pairs a pattern (for training) or the pairs above a probability (for prediction), so that the pairs of a
block never become rows. There are only as many patterns as products of levels: expectation maximisation runs on that
table of counts on the driver. Levels of all pairs of records (u) follow from the counts of each column's values.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinthwork.functions import similarity as sim
from plinthwork.functions.storage import cut

TILE = 4096
#: Pairs of a tile that are held at a time.
CHUNK = 1 << 19
#: Chance that two random records match, and the probabilities of acceptance and review.
PRIOR, ACCEPT, REVIEW = 1e-4, 0.85, 0.70
#: Start of the training: chance of a match within a block, and of the best level among matches.
START_MATCH, START_BEST, LEAST = 0.1, 0.95, 1e-6


@dataclass(frozen=True)
class Comparison:
    """Levels of agreement of one column: equal, then each threshold from the strictest on, else 0; null on either side: -1.

    ``kind`` is exact, jaro_winkler (thresholds are least similarities) or levenshtein (most edits). ``frequency``
    replaces u of equal values by the share of records with that value.
    """

    column: str
    kind: str = "exact"
    at: tuple = ()
    frequency: bool = False

    @property
    def levels(self) -> int:
        return len(self.at) + 2

    def level(self, a: str, b: str) -> int:
        if a == b:
            return self.levels - 1
        if self.kind == "levenshtein" and abs(len(a) - len(b)) <= self.at[-1]:
            d = _edits(a, b)
            return next((len(self.at) - i for i, t in enumerate(self.at) if d <= t), 0)
        return 0

    def grid(self, a: list[str], b: list[str]) -> np.ndarray:
        """Levels of all pairs of two lists of distinct values."""
        if self.kind == "levenshtein":
            return np.array([[self.level(x, y) for y in b] for x in a], np.int8).reshape(len(a), len(b))
        out = np.zeros((len(a), len(b)), np.int8)
        if self.kind == "jaro_winkler":
            for lo in range(0, len(a), 256):
                near = sim.jaro_winkler_grid(a[lo : lo + 256], b)
                for t in self.at:
                    out[lo : lo + 256] += near >= t
        known = {v: k for k, v in enumerate(b)}
        equal = [(i, known[v]) for i, v in enumerate(a) if v in known]
        if equal:
            out[tuple(np.array(equal).T)] = self.levels - 1
        return out


@dataclass(frozen=True)
class Rule:
    """A blocking rule: the columns that it makes agree, and its key; records with a null key are in no block."""

    columns: tuple[str, ...]
    key: Callable[[], Column]


@dataclass
class Model:
    """m and u of every comparison's levels, with the prior; ``score`` weighs a pattern."""

    comparisons: tuple[Comparison, ...]
    m: dict[str, list[float]]
    u: dict[str, list[float]]
    prior: float = PRIOR
    sessions: list[dict] = field(default_factory=list)

    def weights(self) -> list[np.ndarray]:
        """log2 Bayes factor of each level, the last entry for nulls (index -1)."""
        return [np.array([math.log2(max(a, LEAST) / max(b, LEAST)) for a, b in zip(self.m[c.column], self.u[c.column])] + [0.0]) for c in self.comparisons]

    def base(self) -> float:
        return math.log2(self.prior / (1 - self.prior))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _coded(values: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """Distinct values and the place of each row's value among them; -1 for null."""
    coded = pc.dictionary_encode(values.combine_chunks())
    return coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _sizes(comparisons) -> list[int]:
    return [c.levels + 1 for c in comparisons]


def _unpacked(code, sizes: list[int]) -> list:
    """Levels of a pattern's number, or of an array of them."""
    out = []
    for size in reversed(sizes):
        code, level = divmod(code, size)
        out.append(level - 1)
    return out[::-1]


def _patterns_of(left: pa.Table, right: pa.Table, comparisons):
    """``first row, numbers``: the pattern's number of every pair of a tile, some rows at a time; distinct values are compared once."""
    sizes, parts, place = _sizes(comparisons), [], 1
    kind = np.int16 if np.prod(sizes) < 1 << 15 else np.int64
    for c, size in list(zip(comparisons, sizes))[::-1]:
        (a, i), (b, j) = _coded(left[c.column]), _coded(right[c.column])
        table = np.zeros((len(a) + 1, len(b) + 1), kind)  # the last row and column stand for null: level -1
        table[:-1, :-1] = c.grid(a, b)
        table[:-1, :-1] += kind(1)
        table *= kind(place)
        parts.append((table, i, j))
        place *= size
    step = max(1, CHUNK // max(1, right.num_rows))
    for lo in range(0, left.num_rows, step):
        code = np.zeros((min(step, left.num_rows - lo), right.num_rows), kind)
        for table, i, j in parts:
            code += np.take(table[i[lo : lo + step]], j, axis=1)
        yield lo, code


def _ids(t: pa.Table) -> np.ndarray:
    return np.array(t["__id"].to_pylist(), object)


def _counting(left: pa.Table, right: pa.Table, rules: int, dedupe: bool):
    """Whether pairs of rows count in this tile, and not under a rule before; a function of their places."""
    before = []
    for r in range(min(left["__rule"][0].as_py(), rules)):
        (a, i), (b, j) = _coded(left[f"__key{r}"]), _coded(right[f"__key{r}"])
        known = {v: k for k, v in enumerate(a)}
        before.append((i, np.array([known.get(v, -2) for v in b] + [-3], np.int64)[j]))
    ids = (_ids(left), _ids(right)) if dedupe else None

    def counts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        for a, b in before:
            out &= a[i] != b[j]
        return out & (ids[0][i] < ids[1][j]).astype(bool) if dedupe else out

    return counts


def _tiles(left: DataFrame, right: DataFrame, rules: tuple[Rule, ...], comparisons: tuple[Comparison, ...], more: list[str], tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their rule, key and tile; only keys of both sides stay.

    Rows with one value of the first column whose likeness is computed go to one tile of their block, so that few
    distinct values meet in it; a value that would fill a tile is dealt to several.
    """
    columns = [*dict.fromkeys(c.column for c in comparisons), *more]
    dear = F.coalesce(F.col(next((c.column for c in comparisons if c.kind == "jaro_winkler"), comparisons[0].column)).cast("string"), F.lit(""))
    sides = []
    for df in (left, right):
        keyed = df.withColumns({f"__key{i}": F.nullif(r.key().cast("string"), F.lit("")) for i, r in enumerate(rules)})
        entries = F.array(*[F.struct(F.lit(i).alias("__rule"), F.col(f"__key{i}").alias("__key")) for i in range(len(rules))])
        names = [F.col("id").alias("__id"), *columns, *[f"__key{i}" for i in range(len(rules))]]
        sides.append(cut(keyed.select(*names, F.explode(F.filter(entries, lambda e: e["__key"].isNotNull())).alias("__e")).select("*", "__e.*").drop("__e").withColumn("__value", F.xxhash64(dear)), "blocks"))
    values = [cut(s.groupBy("__rule", "__key", "__value").agg(F.count(F.lit(1)).alias("__n")), "values") for s in sides]
    counts = [v.groupBy("__rule", "__key").agg(F.ceil(F.sum("__n") / tile).alias(f"__n{i}")) for i, v in enumerate(values)]
    both = cut(counts[0].join(counts[1], ["__rule", "__key"]), "block-sizes")  # written, so that a hot key's join can be split
    sides = [s.join(v.where(F.col("__n") > tile).select("__rule", "__key", "__value", F.ceil(F.col("__n") / tile).alias("__parts")), ["__rule", "__key", "__value"], "left") for s, v in zip(sides, values)]
    dealt = []
    for i, s in enumerate(sides):
        own = F.pmod(F.xxhash64("__value", F.pmod(F.xxhash64("__id"), F.coalesce("__parts", F.lit(1).cast("long")))), F.col(f"__n{i}"))
        j = s.join(both, ["__rule", "__key"]).withColumn("__own", own)
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__n{1 - i}") - 1))
        j = j.withColumn("__other", other)
        x, y = ("__own", "__other") if i == 0 else ("__other", "__own")
        dealt.append(j.withColumns({"__x": F.col(x), "__y": F.col(y)}).drop("__own", "__other", "__n0", "__n1", "__parts", "__value"))
    return dealt[0], dealt[1]


def pattern_counts(left: DataFrame, right: DataFrame, rule: Rule, comparisons: tuple[Comparison, ...], dedupe: bool = False, tile: int = TILE) -> dict[tuple[int, ...], int]:
    """Number of pairs of each pattern of levels among the pairs that share the rule's key."""
    sizes = _sizes(comparisons)
    every = int(np.prod(sizes))

    def count(l: pa.Table, r: pa.Table) -> pa.Table:
        n = np.zeros(every, np.int64)
        if l.num_rows and r.num_rows:
            ids = (_ids(l), _ids(r)) if dedupe else None
            for lo, code in _patterns_of(l, r, comparisons):
                kept = code[(ids[0][lo : lo + len(code), None] < ids[1][None, :]).astype(bool)] if dedupe else code.ravel()
                n += np.bincount(kept, minlength=every)
        code = np.nonzero(n)[0]
        return pa.table({"code": code, "n": n[code]})

    a, b = _tiles(left, right, (rule,), comparisons, [], tile)
    by = ["__rule", "__key", "__x", "__y"]
    counted = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {tuple(_unpacked(r["code"], sizes)): r["n"] for r in counted.collect()}  # at most the product of the numbers of levels


def level_totals(left: DataFrame, right: DataFrame, comparison: Comparison, tile: int = TILE) -> list[int]:
    """Number of all pairs of records at each level of one comparison, those with a null left out.

    Records are first counted by their value; only distinct values are compared, in tiles, and not at all where the
    level is a matter of equality.
    """
    c = comparison
    sides = [df.where(F.col(c.column).isNotNull()).groupBy(F.col(c.column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")) for df in (left, right)]
    if c.kind == "exact":
        totals = [s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] for s in sides]
        same = sides[0].join(sides[1].withColumnRenamed("n", "k"), "v").agg(F.coalesce(F.sum(F.col("n") * F.col("k")), F.lit(0)).alias("n")).first()["n"]
        return [totals[0] * totals[1] - same, same]
    sides = [cut(s, "values") for s in sides]
    parts = [max(1, -(-s.count() // tile)) for s in sides]
    dealt = []
    for k, s in enumerate(sides):
        own, other = F.pmod(F.xxhash64("v"), F.lit(parts[k])), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[1 - k] - 1).cast("long")))
        dealt.append(s.select("v", "n", own.alias("x" if k == 0 else "y"), other.alias("y" if k == 0 else "x")))

    def count(l: pa.Table, r: pa.Table) -> pa.Table:
        n = [0] * c.levels
        if l.num_rows and r.num_rows:
            grid, a, b = c.grid(l["v"].to_pylist(), r["v"].to_pylist()), *(np.array(t["n"], np.int64) for t in (l, r))
            n = [int(a @ ((grid == k) @ b)) for k in range(c.levels)]
        return pa.table({"level": pa.array(range(c.levels), pa.int64()), "n": pa.array(n, pa.int64())})

    counted = dealt[0].groupBy("x", "y").cogroup(dealt[1].groupBy("x", "y")).applyInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    told = {r["level"]: r["n"] for r in counted.collect()}  # one row a level
    return [told.get(k, 0) for k in range(c.levels)]


def level_shares(patterns: dict[tuple[int, ...], int], comparisons: tuple[Comparison, ...]) -> dict[str, list[float]]:
    """Share of each level among the pairs without a null."""
    out = {}
    for k, c in enumerate(comparisons):
        n = [0] * c.levels
        for pattern, times in patterns.items():
            if pattern[k] >= 0:
                n[pattern[k]] += times
        out[c.column] = [x / max(1, sum(n)) for x in n]
    return out


def maximise(patterns: dict[tuple[int, ...], int], comparisons: tuple[Comparison, ...], u: dict[str, list[float]], fixed: tuple[str, ...] = (), rounds: int = 25, tolerance: float = 1e-4) -> dict:
    """m by expectation maximisation over counts of patterns with u kept; columns of the blocking rule are left out."""
    used = [(k, c) for k, c in enumerate(comparisons) if c.column not in fixed]
    m = {c.column: [(1 - START_BEST) / (c.levels - 1)] * (c.levels - 1) + [START_BEST] for _, c in used}
    match = START_MATCH
    total = sum(patterns.values())
    for r in range(rounds):
        sums, seen, matched = {c.column: [0.0] * c.levels for _, c in used}, defaultdict(float), 0.0
        for pattern, n in sorted(patterns.items()):
            odds = match / (1 - match)
            for k, c in used:
                if pattern[k] >= 0:
                    odds *= max(m[c.column][pattern[k]], LEAST) / max(u[c.column][pattern[k]], LEAST)
            share = n * odds / (1 + odds)
            matched += share
            for k, c in used:
                if pattern[k] >= 0:
                    sums[c.column][pattern[k]] += share
                    seen[c.column] += share
        after = {col: [x / seen[col] for x in xs] if seen[col] else m[col] for col, xs in sums.items()}
        moved = max((abs(x - y) for col in after for x, y in zip(after[col], m[col])), default=0.0)
        m, match = after, min(1 - LEAST, max(LEAST, matched / total)) if total else match
        if moved < tolerance:
            break
    return {"m": m, "match": match, "rounds": r + 1, "pairs": total}


def train(left: DataFrame, right: DataFrame, comparisons: tuple[Comparison, ...], sessions: tuple[Rule, ...], prior: float = PRIOR, rounds: int = 25, tolerance: float = 1e-4, dedupe: bool = False) -> Model:
    """u from all pairs of records, m as the mean over one session for each blocking rule.

    A session says nothing of the columns that its rule makes agree; a column that no session tells of keeps the
    start values. With ``dedupe`` both sides are one table, whose pairs are compared in tiles, as a pair's order is its ids'.
    """
    if dedupe:
        u = level_shares(pattern_counts(left, right, Rule((), lambda: F.lit("*")), comparisons, dedupe), comparisons)
    else:
        totals = {c.column: level_totals(left, right, c) for c in comparisons}
        u = {column: [x / max(1, sum(n)) for x in n] for column, n in totals.items()}
    learned = [maximise(pattern_counts(left, right, rule, comparisons, dedupe), comparisons, u, rule.columns, rounds, tolerance) for rule in sessions]
    m = {}
    for c in comparisons:
        told = [s["m"][c.column] for s in learned if c.column in s["m"] and s["pairs"]]
        m[c.column] = [sum(x) / len(told) for x in zip(*told)] if told else [(1 - START_BEST) / (c.levels - 1)] * (c.levels - 1) + [START_BEST]
    return Model(comparisons, m, u, prior, learned)


def _with_frequencies(left: DataFrame, right: DataFrame, comparisons: tuple[Comparison, ...], dedupe: bool) -> list[DataFrame]:
    """Both sides with ``__tf_<column>``: the share of all records that have the row's value."""
    sides = [left, right]
    for c in comparisons:
        if c.frequency:
            every = left.select(c.column) if dedupe else left.select(c.column).unionByName(right.select(c.column))
            counts = every.where(F.col(c.column).isNotNull()).groupBy(c.column).agg(F.count(F.lit(1)).alias("__n"))
            total = counts.agg(F.sum("__n").alias("__all"))
            shares = cut(counts.crossJoin(F.broadcast(total)).select(c.column, (F.col("__n") / F.col("__all")).alias(f"__tf_{c.column}")), "frequencies")  # one row
            sides = [s.join(shares, c.column, "left") for s in sides]
    return sides


def link(left: DataFrame, right: DataFrame, model: Model, rules: tuple[Rule, ...], least: float = REVIEW, dedupe: bool = False, tile: int = TILE) -> DataFrame:
    """``a, b, weight, probability, levels, band, status`` of all pairs in a common block with a probability of ``least`` or more.

    ``levels`` maps columns to comparison levels. Each pair comes once, however many rules it meets. With
    ``dedupe`` both sides are one table, and a is before b. Null ids are left out.
    """
    comparisons, weights, base = model.comparisons, model.weights(), model.base()
    frequent = [c.column for c in comparisons if c.frequency]
    left, right = (s.where("id is not null") for s in _with_frequencies(left, right, comparisons, dedupe))
    kinds = left.schema["id"].dataType, right.schema["id"].dataType
    u_best = {c.column: max(model.u[c.column][-1], LEAST) for c in comparisons}
    rule_count = len(rules)

    sizes = _sizes(comparisons)
    plain = base + np.sum([np.append(w[-1], w[:-1])[np.array(level) + 1] for level, w in zip(_unpacked(np.arange(int(np.prod(sizes))), sizes), weights)], axis=0)

    def score(l: pa.Table, r: pa.Table) -> pa.Table:
        found = []
        if l.num_rows and r.num_rows:
            counts, tf, most = _counting(l, r, rule_count, dedupe), {}, plain
            for c, level in zip(comparisons, _unpacked(np.arange(len(plain)), sizes)):
                if c.frequency:
                    tf[c.column] = x, y = [t[f"__tf_{c.column}"].to_numpy().astype(float) for t in (l, r)]
                    rarest = np.nanmin(np.concatenate([x, y, [1.0]]))
                    most = most + np.where(level == c.levels - 1, max(0.0, np.log2(u_best[c.column]) - np.log2(max(rarest, 1e-300))), 0.0)
            hopeful = 1 / (1 + np.exp2(-np.clip(most + 1e-6, -1000, 1000))) >= least  # patterns that the rarest value can lift over the bar
            for lo, code in _patterns_of(l, r, comparisons):
                i, j = np.nonzero(hopeful[code])
                levels = _unpacked(code[i, j].astype(np.int64), sizes)
                i = i + lo
                weight = np.full(len(i), base)
                for c, level, w in zip(comparisons, levels, weights):
                    weight += w[level]
                    if c.frequency:
                        best = np.fmax(tf[c.column][0][i], tf[c.column][1][j])
                        weight += np.where(level == c.levels - 1, np.log2(u_best[c.column]) - np.log2(np.fmax(best, 1e-300)), 0.0)
                chance = 1 / (1 + np.exp2(-np.clip(weight, -1000, 1000)))
                kept = np.nonzero(chance >= least)[0]
                kept = kept[counts(i[kept], j[kept])]
                found.append((i[kept], j[kept], weight[kept], chance[kept], *[level[kept] for level in levels]))
        none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2 + [np.zeros(0, np.int64)] * len(comparisons)
        i, j, weight, chance, *levels = [np.concatenate(x) for x in zip(none, *found)]
        ids = [t["__id"].take(pa.array(k)) for t, k in ((l, i), (r, j))]
        return pa.table({"a": ids[0], "b": ids[1], "weight": weight, "probability": chance, **{f"l{k}": level.astype(np.int32) for k, level in enumerate(levels)}})

    a, b = _tiles(left, right, rules, comparisons, [f"__tf_{c}" for c in frequent], tile)
    by = ["__rule", "__key", "__x", "__y"]
    schema = ", ".join([f"a {kinds[0].simpleString()}, b {kinds[1].simpleString()}, weight double, probability double", *[f"l{k} int" for k in range(len(comparisons))]])
    found = a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(score, schema)
    levels = F.create_map(*[x for k, c in enumerate(comparisons) for x in (F.lit(c.column), F.col(f"l{k}"))])
    return found.select("a", "b", "weight", "probability", levels.alias("levels")).withColumns(classed(F.col("probability")))


def classed(probability: Column) -> dict[str, Column]:
    """Band and status of a probability."""
    high, medium = probability >= ACCEPT, probability >= REVIEW
    return {"band": F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"), "status": F.when(high, "auto_accept").when(medium, "needs_review").otherwise("rejected")}


def pair_weight(model: Model, levels: dict[str, Column]) -> Column:
    """Match weight of a pair from columns of levels, without frequencies; for few pairs that are rows already."""
    parts = []
    for c, w in zip(model.comparisons, model.weights()):
        if c.column in levels:
            parts.append(reduce(lambda x, k: x.when(levels[c.column] == k, F.lit(float(w[k]))), range(1, c.levels), F.when(levels[c.column] == 0, F.lit(float(w[0])))).otherwise(F.lit(0.0)))
    return reduce(Column.__add__, parts, F.lit(model.base()))


def level_of(comparison: Comparison, a: Column, b: Column) -> Column:
    """The comparison's level as a column; null on either side: -1."""
    if comparison.kind == "jaro_winkler":
        s = sim.jaro_winkler_col(a, b)
        tests = [s >= t for t in comparison.at]
    elif comparison.kind == "levenshtein":
        s = F.levenshtein(a, b)
        tests = [s <= t for t in comparison.at]
    else:
        tests = []
    out = F.when(a.isNull() | b.isNull(), -1).when(a == b, comparison.levels - 1)
    for i, t in enumerate(tests):
        out = out.when(t, len(comparison.at) - i)
    return out.otherwise(0)


def clear_winner(scored: DataFrame, by: list[str], probability: str, item: str, lead: float = 0.10) -> DataFrame:
    """The most probable row of each group if it leads the second by ``lead`` or is alone; else none."""
    w = Window.partitionBy(*by).orderBy(F.desc(probability), F.asc(item))
    ranked = scored.withColumns({"__place": F.row_number().over(w), "__next": F.lead(probability).over(w)})
    return ranked.where((F.col("__place") == 1) & (F.col("__next").isNull() | (F.col(probability) - F.col("__next") >= lead))).drop("__place", "__next")

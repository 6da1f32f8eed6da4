"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Every block of 2**k words gets a name such that equal names are equal blocks: a name of level k + 1 is the rank of
a pair of names of level k. Blocks that occur once in their text need no rank, so levels shrink fast, and naming ends
at the first level without a repeated block. The longest common extension of two places is then read off by going
down the levels, one comparison each.

A run of period q and length 2q or more holds two neighbouring places of the grid 0, q, 2q, ...; so for each q only
those pairs are candidates, n log n in all. One comparison of names refuses nearly all of them (either side of the
pair has to match over half of what is missing), the others are extended to both sides. A stretch found under
several multiples of its period keeps the smallest one, which is its smallest period by the theorem of Fine and Wilf.

Texts never meet: each is read by one task, and nothing is hashed, sorted by suffix, or shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Words that are named together (a longer text alone), and candidates that are held at a time (one period's at least).
WORDS, PAIRS = 1 << 17, 1 << 19
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Names:
    """Names of all blocks of 2**k items, for all k at which some block repeats; -1 - i marks a block that does not."""

    def __init__(self, items: np.ndarray):
        place = np.arange(len(items), dtype=np.int64)
        names, repeats, levels = items, place, []
        while True:
            half = (1 << len(levels)) >> 1
            if half:
                repeats = repeats[repeats + half < len(items)]
                repeats = repeats[(names[repeats] >= 0) & (names[repeats + half] >= 0)]
                keys = names[repeats].astype(np.int64) << 32 | names[repeats + half]
            else:
                keys = items
            _, rank, times = np.unique(keys, return_inverse=True, return_counts=True)
            often = times[rank] > 1
            if not often.any():
                break
            names = (-1 - place).astype(np.int32)
            repeats, rank = repeats[often], rank[often]
            names[repeats] = rank
            levels.append(names)
        self.levels = np.stack(levels) if levels else np.zeros((0, len(items)), np.int32)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal items from i and from j on; items end in one that does not repeat."""
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            names = self.levels[k]
            got += (names[i + got] == names[j + got]).astype(np.int64) << k
        return got

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal items right before i and right before j; items begin with one that does not repeat."""
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            names, a = self.levels[k], i - got - (1 << k)
            got += ((a >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(j - got - (1 << k), 0)])).astype(np.int64) << k
        return got


def runs_of(texts: list[list], least: int = LEAST, pairs: int = PAIRS) -> list[np.ndarray]:
    """For each list of words its runs as rows (start, length, period), by start, then period.

    A run is a stretch of smallest period q, at least max(least, 2q) words long, that cannot be extended.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(np.concatenate(([0], sizes + 1)))  # each text is preceded by a mark, and a mark ends all
    known: dict = {}
    items = np.full(int(at[-1]) + 1, -1, np.int64)
    for a, words in zip(at.tolist(), texts):
        items[a + 1 : a + 1 + len(words)] = [known.setdefault(w, len(known)) for w in words]
    text_of = np.repeat(np.arange(len(sizes)), sizes + 1)
    marks = items < 0
    items[:-1] += text_of * max(1, len(known))  # equal words of two texts are different items
    items[marks] = len(known) * len(sizes) + np.arange(int(marks.sum()))
    names = Names(items)

    repeated = [np.unique(text_of[np.flatnonzero(level >= 0)]) for level in names.levels]
    deepest = np.full(len(sizes), -1, np.int64)
    for k, found in enumerate(repeated):
        deepest[found] = k
    # Half of what a candidate lacks is a repeated block, so it is below 2 ** (deepest + 1).
    most = np.where((deepest >= 0) & (sizes >= least), np.minimum(sizes // 2, 4 << np.maximum(deepest, 0)), 0)
    owner = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (sizes[owner] - 1) // period
    found = []
    ends = np.cumsum(count)
    low = 0
    while low < len(owner):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + pairs, "right")))
        n = count[low:high]
        q = np.repeat(period[low:high], n)
        step = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(at[owner[low:high]] + 1, n) + step * q
        found.append(_extended(names, i, q, least))
        low = high
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]  # the smallest period of each stretch
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], at)
    return [rows[a:b] - np.array([start + 1, 0, 0]) for a, b, start in zip(cuts, cuts[1:], at.tolist())]


def _extended(names: Names, i: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of the candidates i, i + q that make a run."""
    lacks = np.maximum(q, least - q)
    k = np.frexp((lacks + 1) // 2)[1] - 1  # 2 ** k is at most half of what is missing
    fits = k < len(names.levels)
    i, q, k, lacks = i[fits], q[fits], k[fits], lacks[fits]
    before = i - (1 << k.astype(np.int64))
    some = names.levels[k, i] == names.levels[k, i + q]
    some |= (before >= 0) & (names.levels[k, np.maximum(before, 0)] == names.levels[k, np.maximum(before + q, 0)])
    i, q, lacks = i[some], q[some], lacks[some]
    after, before = names.ahead(i, i + q), names.behind(i, i + q)
    whole = after + before >= lacks
    return np.column_stack((i - before, before + after + q, q))[whole]


def collapsed_words(words: list, runs: np.ndarray) -> list:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """``doc_id, *keep, runs, collapsed`` for each row: its runs of words (between ASCII white space), and its text without their repeats.

    ``runs`` holds (start, length, period) by start, then period; ``collapsed`` joins the words that stay by one
    space. A null text counts as empty: no runs and an empty text. Repeated rows stay and agree, a null id stays,
    no rows give no rows. Texts of any length are taken whole.
    """
    names = (doc_id, *keep)

    def run(batches):
        for batch in batches:
            bodies, low = batch.column(0), 0
            while low < batch.num_rows:
                texts, total, high = [], 0, low
                while high < batch.num_rows and (total < WORDS or not texts):
                    texts.append((bodies[high].as_py() or b"").split())
                    total += len(texts[-1])
                    high += 1
                found = runs_of(texts, least)
                rows = np.concatenate(found)
                parts = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), parts)
                left = pa.array([b" ".join(collapsed_words(w, r)) for w, r in zip(texts, found)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[1:]), lists, left], [*batch.schema.names[1:], "runs", "collapsed"])
                low = high

    given = docs.select(F.col(text).cast("binary").alias("__body"), *names)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), f"runs {_RUNS}, collapsed binary"])
    return given.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(runs):
    """The longest run of a ``runs`` column, the first of equals; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a known period planted into the texts of every tenth hash of the id.

    Let h be the CRC-32 of the decimal id and g a tenth of it: where 10 divides h, word i of n becomes word
    a + (i - a) % p from a = g % n on, with p = 1 + (n - a) div (3 + g % 8). A null id leaves its text alone.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, turned(w)))[0]  # the words are taken once
    return docs.withColumn(text, F.coalesce(F.when(h % 10 == 0, planted), F.col(text)))

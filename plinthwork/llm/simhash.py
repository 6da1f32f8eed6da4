"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Every fingerprint bit i gets a code word m(i) of ``radius + 1`` bits. For each non-zero v of that many bits,
table v keeps the fingerprint bits with odd parity of m(i) & v. The code words of ``radius`` differing bits
span less than the whole space, so some v is orthogonal to all of them: every pair within the radius agrees on
all bits of at least one table (Pagh, "Coverable functions"). Recall is therefore exactly one.

Work is over distinct fingerprints. A bucket is compared in blocks of ``BLOCK`` fingerprints, larger ones as
pairs of blocks in tasks of their own, and each block pair emits a spanning forest of the links it holds, so
output is linear in the bucket and no pair of fingerprints is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut
from plinthwork.operators.components import connected_components

RADIUS, BITS, SHINGLE, SEED, BLOCK = 4, 64, 4, 42, 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def fingerprint(body: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 bytes: bit set where over half of the shingles' hashes have it; no words: 0."""
    words = (body or b"").translate(_LOWER).split()
    if not words:
        return 0
    text, n = b" ".join(words), max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        cuts = zip(starts[at : at + _CHUNK].tolist(), ends[shingle - 1 :][at : at + _CHUNK].tolist())
        h = np.fromiter((digest(text[s:e], SEED) for s, e in cuts), np.uint64, min(_CHUNK, n - at))
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp`` (signed long) of each row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view(np.int64))], [*batch.schema.names[1:], "fp"])

    given = docs.select(F.col(text).cast("binary").alias("__body"), *keep)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp bigint"])
    return given.mapInArrow(run, schema)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector of radius + 1 bits; each keeps about half of the bits."""
    words = np.random.default_rng(radius).permutation(bits) % (1 << (radius + 1))
    return [sum(1 << i for i in range(bits) if bin(int(words[i]) & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all fingerprints of a block which chains of links inside it join."""
    rest, out = np.unique(fp), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            found = rest[near]
            out += [(x, y) for y in found]
            queue += list(found)
            rest = rest[~near]
    return out


def _links(radius: int):
    def flush(g: np.ndarray, fp: np.ndarray):
        cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        sizes = np.diff(np.append(cuts, len(g)))
        left, right = [], []
        size_at = np.repeat(sizes, sizes)
        for d in range(1, 8):
            if len(g) <= d:
                break
            same = (g[d:] == g[:-d]) & (size_at[:-d] <= 8)
            at = np.flatnonzero(same)
            at = at[(np.bitwise_count(fp[at] ^ fp[at + d]) <= radius) & (fp[at] != fp[at + d])]
            left.append(fp[at])
            right.append(fp[at + d])
        for at, n in zip(cuts[sizes > 8], sizes[sizes > 8]):
            found = _forest(fp[at : at + n], radius)
            if found:
                x, y = np.array(found, np.uint64).T
                left.append(x)
                right.append(y)
        if not left:
            return np.zeros((0, 2), np.uint64)
        return np.unique(np.column_stack((np.concatenate(left), np.concatenate(right))), axis=0)

    def run(batches):
        g0, f0 = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            g = np.concatenate((g0, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((f0, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(g):
                continue
            last = int(np.searchsorted(g, g[-1]))  # the last run may go on in the next batch
            out = flush(g[:last], f[:last]) if last else np.zeros((0, 2), np.uint64)
            g0, f0 = g[last:], f[last:]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, i].view(np.int64)) for i in (0, 1)], ["a", "b"])
        if len(g0):
            out = flush(g0, f0)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` at ``radius`` or fewer differing bits.

    All such links are found; within a block pair of one bucket only a spanning forest of them is returned.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    keys = [F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(m))) for v, m in enumerate(signed)]
    buckets = fps.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Planned by its own hint: the estimate of exploded rows is that of the rows before, which would have them all broadcast.
    sized = buckets.hint("merge").join(sizes, "bucket").withColumn("k", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("k").cast("long")).cast("int")
    dealt = sized.withColumn("own", own).select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    grouped = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp")
    ran = grouped.repartition("g").sortWithinPartitions("g").mapInArrow(_links(radius), "a bigint, b bigint")
    return ran.distinct()


def _grouped(docs: DataFrame, doc_id: str, text: str, radius: int, keep: tuple[str, ...]) -> DataFrame:
    """``doc_id, *keep, fp, label, component_id``; ``label`` is one fingerprint of the row's group.

    Every row finds its match, so left joins give what inner ones would, and never broadcast the left side: rows of
    copies take some five bytes each in a file, by which a join is planned, and twenty times that in memory.
    """
    printed = cut(fingerprints(docs, text, (doc_id, *keep)), "fingerprints")
    fps = printed.groupBy("fp").agg(F.min(doc_id).alias("low"))
    parts = connected_components(links(fps.select("fp"), radius))
    labelled = cut(fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("label")), "labels")
    lows = cut(labelled.groupBy("label").agg(F.min("low").alias("component_id")), "lows")  # written: the join on a hot label can be split
    return printed.join(labelled.join(lows, "label", "left").select("fp", "label", "component_id"), "fp", "left")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *keep, fingerprint, component_id`` for each row of ``docs``.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest id reachable by links. Rows with equal
    fingerprints are linked. Null or blank texts have fingerprint zero and link like any other. A null id is
    never a component's id unless the component holds no other. Repeated rows stay. No rows: no rows.
    """
    return _grouped(docs, doc_id, text, radius, keep).select(doc_id, *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the smallest id, nulls last."""
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("__k1"), F.xxhash64(text).alias("__k2")]
    keyed = docs.select("*", *key)
    rows = _grouped(keyed, doc_id, text, radius, ("__k1", "__k2")).groupBy("label", "__k1", "__k2").agg(F.count(F.lit(1)).alias("n"), F.max(F.col(doc_id).isNull()).alias("unnamed"))
    best = rows.groupBy("label").agg(F.min(F.struct("unnamed", "__k1", "__k2", "n")).alias("w")).select("w.__k1", "w.__k2", F.col("w.n").alias("__n"))
    once, more = (keyed.join(best.where(n), ["__k1", "__k2"], "left_semi") for n in ("__n = 1", "__n > 1"))  # texts are never the side that is broadcast
    return once.unionByName(more.dropDuplicates(["__k1", "__k2"])).select(*docs.columns)

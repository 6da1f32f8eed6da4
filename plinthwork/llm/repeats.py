"""Removal of long repeated byte strings by run-length compressed indexes (r-index).

An index holds the Burrows-Wheeler transform of its text as runs, with a sampled text position at each run's
first and last row. At those rows, and only there, the length of the match with the neighbouring suffix is
computed; everywhere else it is one less than at the position before (Kasai et al.; Gagie, Navarro and Prezza),
so the matching statistics of a text against the rest of the collection stream off the samples from left to
right. A position whose statistic reaches ``length`` starts a string that also starts elsewhere.

One index over a corpus would not fit anywhere, so texts are dealt to indexes by content. Each window of
``length`` bytes goes to its anchor, the ``gram``-byte string in it with the lowest hash, leftmost first; equal
windows have equal anchors. A segment is a maximal run of windows with one anchor. Only segments whose anchor
occurs twice are kept, equal ones are counted before anything moves, and each distinct segment is indexed once,
carrying its count; a segment with a count above one is a match as a whole. An anchor with over ``GROUP``
distinct segments (a passage in many texts, with different text around it) does not fit an index: its windows
are dealt again to longer anchors, which take in more of what surrounds the passage, until every anchor fits. An
anchor as long as the window holds one segment, so this ends.

Two lengths can be asked for at once. Then windows of the shorter one deal both: segments reach as far to the
right as the longer one needs, and pieces of one text that overlap are indexed as one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut

LENGTH, GRAM, GROUP, DEEPER = 400, 64, 1024, 6
#: A length that passages of over 50 words reach: the shortest of them have some 270 bytes.
PASSAGE = 256
_SPAN, _SHARD, _POS = 1 << 17, 1 << 21, np.uint64((1 << 21) - 1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_SEPARATOR = 0xFF  # no UTF-8 text holds this byte


class RunIndex:
    """Run-length compressed suffix index of a byte text with samples at the ends of runs."""

    def __init__(self, text: bytes):
        t = np.frombuffer(text, np.uint8)
        self.size = n = len(t)
        if not n:
            self.n_runs, self.statistics = 0, np.zeros(0, np.int64)
            return
        order = suffix_order(t)
        bwt = np.where(order > 0, t[order - 1].astype(np.int16), 256)  # 256: before the text
        heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        tails = np.append(heads[1:] - 1, n - 1)
        self.n_runs, self.run_byte, self.run_head = len(heads), bwt[heads], heads
        self.head_sample, self.tail_sample = order[heads], order[tails]
        before, after = np.zeros(len(heads), np.int64), np.zeros(len(tails), np.int64)
        before[1:] = common_prefix(t, order[heads[1:]], order[heads[1:] - 1])
        after[:-1] = common_prefix(t, order[tails[:-1]], order[tails[:-1] + 1])
        self.statistics = np.maximum(self._stream(self.head_sample, before), self._stream(self.tail_sample, after))

    def _stream(self, samples: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Match length at every position, carried from the last sample on its left."""
        reach = np.zeros(self.size, np.int64)
        reach[samples] = samples + lengths
        return np.maximum(np.maximum.accumulate(reach) - np.arange(self.size), 0)


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Suffix array by prefix tripling from eight bytes; only rows that are still tied are sorted again."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + n]
    order = np.argsort(key)
    slots, at, key, h = np.arange(n), order, key[order], 8
    rank = np.concatenate((np.empty(n, np.int64), -np.arange(17)))  # past the end: of suffixes tied by the zeros after them the shorter one is less
    wide = n + 20
    while True:
        same = key[1:] == key[:-1]
        new = np.concatenate(([True], ~same))
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(tied):
            return order
        slots, at = slots[tied], at[tied]
        key = np.cumsum(new[tied])  # the number of the group of ties
        thrice = (int(key[-1]) + 1) * wide * wide < 1 << 63
        for k in (1, 2)[: 1 + thrice]:
            key = key * wide + rank[np.minimum(at + k * h, n + 16)] + 18
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        h *= 2 + thrice


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, eight bytes at a time."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(16, np.uint8)))
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), strides=(1,))
    out, live, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    a, b = a.copy(), b.copy()
    while len(live):
        diff = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        room = n - np.maximum(a, b)
        got = np.minimum(np.where(diff == 0, 8, low), room)
        out[live] += got
        more = (got == 8) & (room > 8)
        live, a, b = live[more], a[more] + 8, b[more] + 8
    return out


def segments(bodies: list[bytes], length: int = LENGTH, gram: int = GRAM, reach: int = 0):
    """(row, start, size, span, times, base, anchor, content) arrays of the segments of some texts.

    ``base`` counts the windows of a segment; its bytes go on to ``reach`` bytes (``length`` at least) from the
    last one's start, or to the text's end. Equal segments next to each other, as in text with a short period,
    are one entry: ``times`` of them, from ``start`` over ``span`` bytes.
    """
    out: list[list[np.ndarray]] = [[] for _ in range(8)]
    group, held, step = [], 0, _SPAN - length
    for i, body in enumerate(bodies):
        if len(body) < length:
            continue
        if len(body) > _SPAN:  # very long texts in overlapping spans
            for at in range(0, len(body) - length + 1, step):
                _segments([(i, at, min(len(body), at + step + length - 1))], bodies, length, gram, max(length, reach), out)
            continue
        if held + len(body) > _SPAN:
            _segments(group, bodies, length, gram, max(length, reach), out)
            group, held = [], 0
        group.append((i, 0, len(body)))
        held += len(body)
    if group:
        _segments(group, bodies, length, gram, max(length, reach), out)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _segments(group, bodies, length, gram, far, out):
    text = b"".join(bodies[i][a:b] for i, a, b in group)
    n, sizes = len(text), np.array([b - a for _, a, b in group])
    offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    windows, wide = n - length + 1, length - gram + 1
    h = np.ndarray((n - 7,), "<u8", text, strides=(1,)) * _M[0]
    h ^= h >> np.uint64(32)
    wide_of, eight = 8, h
    while wide_of * 2 <= gram:
        h = h[:-wide_of] * _M[1] + h[wide_of:]
        h ^= h >> np.uint64(29)
        h *= _M[2]
        wide_of *= 2
        eight = h
    if wide_of < gram:
        h = eight[: n - gram + 1] * _M[3] + eight[gram - wide_of : n - wide_of + 1]
    h = h ^ (h >> np.uint64(31))
    h *= _M[4]
    h ^= h >> np.uint64(33)
    m = len(h)
    key = (h & ~_POS) | np.arange(m, dtype=np.uint64)
    full = -(-m // wide) * wide
    key = np.concatenate((key, np.full(full - m, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, wide)
    head = np.minimum.accumulate(key, axis=1).ravel()
    tail = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(tail[:windows], head[wide - 1 : wide - 1 + windows]) & _POS
    del key, head, tail
    owner = np.repeat(np.arange(len(group)), sizes)[:windows]
    inside = np.arange(windows) <= (offsets + sizes - length)[owner]
    at = np.flatnonzero(inside)
    low, owner = low[at].astype(np.int64), owner[at]
    first = np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])))
    begin = np.flatnonzero(first)
    end = np.append(begin[1:] - 1, len(at) - 1)
    own, anchor = owner[begin], h[low[begin]].view(np.int64)
    ids, shift = np.array([g[0] for g in group]), np.array([g[1] for g in group])
    starts, base = at[begin] - offsets[own] + shift[own], at[end] - at[begin] + 1  # from here on in the texts' own places
    stops = np.minimum(starts + base - 1 + far, np.array([len(bodies[i]) for i in ids.tolist()])[own])
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(bodies[i][a:b]) for i, a, b in zip(ids[own].tolist(), starts.tolist(), stops.tolist())), np.uint64, len(starts)).view(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))))
    times = np.diff(np.append(new, len(own)))
    span = stops[new + times - 1] - starts[new]
    for x, y in zip(out, (ids[own[new]], starts[new], stops[new] - starts[new], span, times, base[new], anchor[new], content[new])):
        x.append(y)


def _find(length, gram, reach):
    def run(batches):
        for batch in batches:
            bodies = [b or b"" for b in batch.column(2).to_pylist()]
            row, *rest = segments(bodies, length, gram, reach)
            row = pa.array(row, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *map(pa.array, rest, kinds)], ["k1", "k2", "start", "size", "span", "times", "base", "anchor", "content"])

    return run


def _pack(batches):
    """Texts (the first column) by zstd: they travel twice."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(b) for b in batch.column(0).to_pylist()], pa.binary()), *batch.columns[1:]], batch.schema.names)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


_PIECE = "g bigint, a bigint, c bigint, at int, k1 bigint, k2 bigint, start int, base int, n bigint, crowded boolean, piece binary"


def _fetch(batches):
    """Pieces of texts, asked for as lists of segments; rows as in ``_PIECE``."""
    names, kinds = zip(*(x.split() for x in _PIECE.split(", ")))
    types = [{"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[k] for k in kinds]
    for batch in batches:
        out, held = [], 0
        for k1, k2, asked, packed in zip(*(c.to_pylist() for c in batch.columns)):
            body = _unpack(packed)
            for s in asked:
                out.append((s["anchor"], s["anchor"], s["content"], 0, k1, k2, s["start"], s["base"], s["n"], s["crowded"], body[s["start"] : s["start"] + s["size"]]))
                held += s["size"]
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], list(names))
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], list(names))


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_MARK = "a bigint, c bigint, kind int, spans array<int>"


def _index(length, reach):
    """Whole anchor groups, gathered into shards; spans of each segment that occur elsewhere in its shard.

    Rows come as (g, a, c, at, k1, k2, start, base, n, piece), sorted by g. Segments that occur once and overlap
    in their text go on one from the other, so that no byte meets itself; those with copies may overlap any.
    """
    def flush(rows):
        text, size, places, last = [], 0, [], None
        if reach > length:
            rows = sorted(rows, key=lambda r: (r[8] > 1, r[4:7]))
        for r in rows:
            start, n, piece = r[6], r[8], r[9]
            if reach > length and last and n == 1 and last[0] == r[4:6] and start + length <= last[1]:
                places.append(size - 1 - (last[1] - start))  # goes on where the piece before ends: no byte is indexed twice
                more = piece[last[1] - start :]
                text[-1:] = [more, bytes([_SEPARATOR])]
                size += len(more)
                last = (r[4:6], max(last[1], start + len(piece)))
                continue
            places.append(size)
            text += [piece, bytes([_SEPARATOR])]
            size += len(piece) + 1
            last = (r[4:6], start + len(piece)) if n == 1 else None
        statistics, found = RunIndex(b"".join(text)).statistics, []
        for kind, far in enumerate((length, reach) if reach > length else (length,), 1):
            begin = np.array(places)
            end = begin + np.array([max(0, min(r[7], len(r[9]) - far + 1)) if r[8] == 1 else 0 for r in rows])
            hits = np.concatenate(([0], np.cumsum(statistics >= far)))
            for row in np.flatnonzero(hits[end] > hits[begin]).tolist():
                _, a, c, at, *_ = rows[row]
                found.append((a, c, kind, [at + x for i, j in _runs(statistics[begin[row] : end[row]] >= far) for x in (i, j - 1 + far)]))
        return _marks(found)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= _SHARD and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield flush(held)

    return run


def _marks(found):
    types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], ["a", "c", "kind", "spans"])


def _indexed(pieces: DataFrame, length: int, reach: int) -> DataFrame:
    columns = [x.split()[0] for x in _PIECE.split(", ") if "crowded" not in x]
    dealt = pieces.select(*columns).repartition("g").sortWithinPartitions("g", "a", "c", "at")
    return dealt.mapInArrow(_index(length, reach), _MARK)


def _deal(length, gram):
    """Segments of the windows that pieces (a, c, at, base, n, piece) stand for, with their bytes."""
    def run(batches):
        for batch in batches:
            a, c, at, base, n, pieces = (batch.column(i) for i in range(6))
            bodies = [p[: b - 1 + length] for p, b in zip(pieces.to_pylist(), base.to_pylist())]
            row, start, size, span, times, inner, anchor, content = segments(bodies, length, gram)
            parts = [bodies[r][s : s + z] for r, s, z in zip(row.tolist(), start.tolist(), size.tolist())]
            row = pa.array(row, pa.int64())
            place = pa.array(at.take(row).to_numpy() + start, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(content, pa.int64()), a.take(row), c.take(row), place, pa.array(span, pa.int32()), pa.array(inner, pa.int32()), pa.array(times, pa.int64()), n.take(row), pa.array(parts, pa.binary())], ["g", "content", "a", "c", "at", "span", "base", "times", "n", "piece"])

    return run


def _again(crowded: DataFrame, length: int, gram: int, group: int, kind: int) -> DataFrame:
    """Marks of the windows of crowded anchors, dealt to longer and longer anchors until every one fits."""
    spark, marks = crowded.sparkSession, []
    rows = crowded.select("a", "c", "at", "base", "n", "piece")
    while gram < length and not rows.isEmpty():
        gram = length - (length - gram) // DEEPER
        every = cut(rows.mapInArrow(_deal(length, gram), "g bigint, content bigint, a bigint, c bigint, at int, span int, base int, times bigint, n bigint, piece binary"), "deeper")
        distinct = cut(every.groupBy("g", "content").agg(F.sum(F.col("n") * F.col("times")).alias("n"), *[F.first(x).alias(x) for x in ("a", "c", "at", "base", "piece")]), "deeper-distinct")
        again = every.where("n = 1").join(distinct.where("n > 1").select("g", "content"), ["g", "content"])
        marks.append(again.select("a", "c", F.lit(kind).alias("kind"), F.array("at", F.col("at") + F.col("span")).alias("spans")))
        crowd = cut(distinct.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "deeper-crowds")
        kinds = distinct.join(crowd, "g").select("g", "a", "c", "at", F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.lit(0).alias("start"), "base", "n", "piece", "kinds")
        marks.append(_indexed(kinds.where(F.col("kinds") <= group), length, length).withColumn("kind", F.lit(kind)))
        rows = kinds.where(F.col("kinds") > group).select("a", "c", "at", "base", "n", "piece")
    out = spark.createDataFrame([], _MARK)
    for m in marks:
        out = out.unionByName(m)
    return out


def spans(keyed: DataFrame, packed: DataFrame, length: int = LENGTH, reach: int = 0, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``k1, k2, found`` for texts (``k1, k2, body``) with a string of ``length`` bytes that starts twice.

    ``packed`` has the same texts as ``k1, k2, pack``. ``found`` is an array of (start, kind, spans): places of
    segments and the spans to remove, relative to them, for ``length`` (kind 1), for ``reach`` (2) or for both (0).
    """
    reach = max(length, reach)
    every = cut(keyed.select("k1", "k2", "body").mapInArrow(_find(length, gram, reach), "k1 bigint, k2 bigint, start int, size int, span int, times int, base int, anchor bigint, content bigint"), "segments")
    # Sums are written before they are joined: then both sides are plain shuffles, whose hot parts can be split.
    twice = cut(every.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "anchors")
    repeated = cut(every.join(twice, "anchor"), "repeated")
    places = [F.first(x).alias(x) for x in ("k1", "k2", "start", "size", "base")]
    distinct = cut(repeated.groupBy("anchor", "content").agg(F.sum("times").alias("n"), *places), "distinct")
    crowd = cut(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").withColumn("crowded", F.col("kinds") > group), "crowds")
    asked = distinct.join(crowd, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "content", "start", "size", "base", "n", "crowded")).alias("asked"))
    pieces = cut(asked.join(packed.select("k1", "k2", "pack"), ["k1", "k2"]).mapInArrow(_fetch, _PIECE), "pieces")
    whole = distinct.where("n > 1").select(F.col("anchor").alias("a"), F.col("content").alias("c"), F.when(F.col("size") >= reach, 0).otherwise(1).alias("kind"), F.lit(None).cast("array<int>").alias("spans"))
    marks = whole.unionByName(_indexed(pieces.where("not crowded"), length, reach)).unionByName(_again(pieces.where("crowded"), length, gram, group, 1))
    if reach > length:
        marks = marks.unionByName(_again(pieces.where("crowded"), reach, gram, group, 2))
    marks = cut(marks, "marks")
    marked = repeated.withColumnsRenamed({"anchor": "a", "content": "c"}).join(marks, ["a", "c"]).select("k1", "k2", F.struct("start", "kind", F.coalesce("spans", F.array(F.lit(0), F.col("span"))).alias("spans")).alias("found"))
    return marked.groupBy("k1", "k2").agg(F.collect_list("found").alias("found"))


def _cut_out(body: bytes, found, kind: int) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and maximal removed runs."""
    cover = [(f["start"] + a, f["start"] + b) for f in found or () if f["kind"] in (0, kind) for a, b in zip(f["spans"][::2], f["spans"][1::2])]
    if not cover:
        return body, 0, 0
    cover = np.array(cover)
    cover = cover[np.argsort(cover[:, 0])]
    reach = np.maximum.accumulate(cover[:, 1])
    new = np.concatenate(([True], cover[1:, 0] > reach[:-1]))
    starts, ends = cover[new, 0], np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])
    left, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        left.append(body[at:a])
        at = b
    left.append(body[at:])
    return b"".join(left), int((ends - starts).sum()), len(starts)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), length: int = LENGTH, passage: int | None = None, gram: int = GRAM, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """``doc_id, *keep, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``; ``kept`` on request.

    Every byte under a string of ``length`` bytes that also starts elsewhere in the input is removed, its other
    place in the same text included; strings are judged on the input. A null text counts as empty. Repeated
    rows are copies of each other. No rows: no rows. ``kept`` is the text without repeated strings of ``passage``
    bytes, at most ``length``, which it is by default; bytes of characters cut in two are left out of it.
    """
    short = min(passage or length, length)
    key = [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2")]
    whole = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("pack"), *key, F.struct(F.col(doc_id).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"))
    kind = whole.schema["row"].dataType.simpleString()
    packed = whole.mapInArrow(_pack, f"pack binary, k1 bigint, k2 bigint, row {kind}")
    slim = whole.select("pack", "k1", "k2").mapInArrow(_pack, "pack binary, k1 bigint, k2 bigint")
    joined = packed.join(spans(whole.select("k1", "k2", F.col("pack").alias("body")), slim, short, length, gram, group), ["k1", "k2"], "left").select("row", "pack", "found")

    def run(batches):
        for batch in batches:
            bodies = [_unpack(b) for b in batch.column(1).to_pylist()]
            found = batch.column(2).to_pylist()
            out = [_cut_out(b, f, 2 if short < length else 1) for b, f in zip(bodies, found)]
            more = []
            if with_text:
                left = [_cut_out(b, f, 1)[0] for b, f in zip(bodies, found)] if short < length else [o[0] for o in out]
                more = [pa.array([b.decode("utf-8", "ignore") for b in left], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([hashlib.sha256(o[0]).hexdigest() for o in out], pa.string()), *more], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    ran = joined.mapInArrow(run, f"row {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text)
    names = [F.col("row.id").alias(doc_id), *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)]]
    return ran.select(*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text)

"""Near-duplicate passages by compact windows.

A text is a sequence of ``SHINGLE``-word shingles. Under each of ``HASHES`` hash functions the Cartesian tree of
the hashes groups its subsequences by their minimum: a compact window (l, c, r) stands for all subsequences
within [l, r] that hold c, which all have c's hash as min-hash (Deng et al., "Near-duplicate sequence search at
scale"). Only nodes whose window spans ``LEAST`` shingles matter, some 2n / LEAST of n; they are the minima of
the sliding windows of that size, and so are the nearest smaller ones on either side, so a stack over those
alone gives the tree.

Windows of different texts with one min-hash are joined. First, windows whose ``LEAST`` shingles around c are
the same are linked in stars, by minima that are combined before the shuffle. Then, for min-hashes that still
join several classes of texts, windows become intervals [l, r], which carry the min-hashes of the windows of
other hash functions that share passages with them: intervals of two texts are verified only if they meet under
``ENOUGH`` hash functions. Two texts are linked if passages of ``LEAST`` or more shingles in such intervals, each
with a length and an offset of its own, have an exact Jaccard similarity of ``SIMILARITY`` or more. Intervals are
compared in blocks of ``BLOCK``, larger groups as block pairs; a block pair returns a spanning forest. Blocks of
the largest class of a group meet the blocks of its other classes only.

How far around c to look follows from the threshold. Let similar passages have no repeated shingle and keep
their order. Cut both behind a match: one side is similar as well, and is a passage unless it is too short. So
passages that cannot be shortened have at most ``2 * LEAST - 1`` matches, and as many over ``SIMILARITY``
shingles. They have their own min-hashes; each hash function shows them with a probability of their similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut
from plinthwork.operators.components import connected_components

SHINGLE, LEAST, HASHES, ENOUGH, SIMILARITY, BLOCK, COLD = 5, 46, 4, 2, 0.8, 2048, 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPAN, _POS = 1 << 19, np.uint64((1 << 21) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(32))


def shingles(body: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words of a text, A-Z lower-cased."""
    words = (body or b"").translate(_LOWER).split()
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = (h ^ (w[j : j + n] * _MIX[j % 5])) * _MIX[(j + 1) % 5]
        h ^= h >> np.uint64(31)
    return h


def compact_windows(x: np.ndarray, seed: int, least: int = LEAST):
    """(c, l, r) arrays of the compact windows of ``least`` or more shingles; ties go to the leftmost."""
    return _windows(x, np.array([0]), np.array([len(x)]), seed, least)


def _windows(x: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int, least: int):
    """The same for several texts in one array, at most 2 ** 21 long, each within [begin, end)."""
    n = len(x)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    v = (_mixed(x, seed) & ~_POS) | np.arange(n, dtype=np.uint64)
    full = -(-n // least) * least
    grid = np.concatenate((v, np.full(full - n, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, least)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(tail[: n - least + 1], head[least - 1 : n])
    inside = np.zeros(n + 1, np.int32)
    wide = ends - begins >= least
    np.add.at(inside, begins[wide], 1)
    np.add.at(inside, (ends - least + 1)[wide], -1)
    low = low[np.cumsum(inside)[: n - least + 1] > 0]
    low = low[np.concatenate(([True], low[1:] != low[:-1]))] if len(low) else low
    c = (low & _POS).astype(np.int64)
    text = np.searchsorted(begins, c, side="right") - 1
    left, right, stack, own = begins[text].tolist(), (ends[text] - 1).tolist(), [], -1
    at, value = c.tolist(), low.tolist()
    for k, (y, t) in enumerate(zip(value, text.tolist())):
        if t != own:
            stack, own = [], t
        while stack and value[stack[-1]] > y:
            right[stack.pop()] = at[k] - 1
        if stack:
            left[k] = at[stack[-1]] + 1
        stack.append(k)
    return c, np.array(left, np.int64), np.array(right, np.int64)


def _keys(x: np.ndarray, c: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(x[c] + np.uint64(seed), seed + 100).view(np.int64)


def _rolled(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values."""
    h, wide = x * _MIX[0], 1
    while wide * 2 <= size:
        h = h[:-wide] * _MIX[1] + h[wide:]
        h ^= h >> np.uint64(29)
        h *= _MIX[2]
        wide *= 2
    if wide < size:
        h = h[: len(x) - size + 1] * _MIX[3] + h[size - wide : len(x) - wide + 1]
        h ^= h >> np.uint64(31)
    return h


def _laid_out(bodies, least: int, reach: int):
    """Shingles of many texts in arrays of bounded size: (x, texts, begins, ends), ``reach`` zeros around each text.

    Very long texts come in spans that overlap so that each passage that cannot be shortened is whole in one.
    """
    def flush(held):
        gap, parts, begins, at = np.zeros(reach, np.uint64), [], [], 0
        for _, x in held:
            parts += [gap, x]
            begins.append(at + reach)
            at += reach + len(x)
        begins = np.array(begins)
        return np.concatenate([*parts, gap]), np.array([i for i, _ in held]), begins, begins + np.array([len(x) for _, x in held])

    held, size, step = [], 0, _SPAN - 2 * reach - least
    for i, body in enumerate(bodies):
        x = shingles(body)
        for at in range(0, max(1, len(x) - 2 * reach - least), step):
            part = x[at : at + _SPAN]
            if len(part) < least:
                continue
            if held and size + len(part) + reach > _SPAN:
                yield flush(held)
                held, size = [], 0
            held.append((i, part))
            size += len(part) + reach
    if held:
        yield flush(held)


def _find(least, hashes, reach):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for x, text, begins, ends in _laid_out(batch.column(1).to_pylist(), least, reach):
                rolled, rows = _rolled(x, least), []
                for f in range(hashes):
                    c, l, r = _windows(x, begins, ends, f, least)
                    middle = rolled[np.clip(c - least // 2, l, r - least + 1)].view(np.int64)  # LEAST shingles around c, in its window
                    own = text[np.searchsorted(begins, c, side="right") - 1]
                    seen = np.column_stack((own, _keys(x, c, f), middle))
                    seen = seen[np.argsort(_mixed(_mixed(seen[:, 1].view(np.uint64) ^ seen[:, 2].view(np.uint64) * _MIX[3], 1) + seen[:, 0].astype(np.uint64), 2))]
                    rows.append(seen[np.concatenate(([True], (seen[1:] != seen[:-1]).any(axis=1)))] if len(seen) else seen)
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[:, 0]], pa.int64()), pa.array(rows[:, 1], pa.int64()), pa.array(rows[:, 2], pa.int64())], ["node", "key", "middle"])

    return run


def reach_of(least: int, similarity: float) -> int:
    """Shingles on either side of a minimum that hold every passage that cannot be shortened."""
    return int((2 * least - 1) / similarity + 1e-9) - 1


_INTERVAL = {"key": pa.int64(), "node": pa.int64(), "at": pa.int32(), "piece": pa.binary(), "others": pa.list_(pa.int32())}


def _intervals(least, hashes, reach, enough):
    """For texts and the min-hashes asked for: their windows as intervals, and the others asked for that they meet there.

    ``piece`` holds the shingles of the interval (32 bits each, no zeros), at most ``reach`` on either side of its
    minimum, which is number ``at``. Windows of two hash functions meet if a passage holds both minima; later
    hash functions are looked at only.
    """
    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), _INTERVAL.values())], list(_INTERVAL))

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            kinds = np.unique(flat)
            asked = np.unique(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)) * len(kinds) + np.searchsorted(kinds, flat))
            for x, text, begins, ends in _laid_out(batch.column(1).to_pylist(), least, reach):
                near = (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                every = []
                for f in range(hashes):
                    c, l, r = _windows(x, begins, ends, f, least)
                    key = _keys(x, c, f)
                    own = text[np.searchsorted(begins, c, side="right") - 1]
                    code = np.minimum(np.searchsorted(kinds, key), len(kinds) - 1)
                    pair = own * len(kinds) + code
                    hit = np.flatnonzero((kinds[code] == key) & (asked[np.minimum(np.searchsorted(asked, pair), len(asked) - 1)] == pair))
                    every.append((c[hit], l[hit], r[hit], key[hit], (key[hit] >> np.int64(32)).astype(np.int32), own[hit]))
                out, seen = [], set()
                for f, (c, l, r, key, _, own) in enumerate(every):
                    low, high = np.maximum(l, c - reach), np.minimum(r, c + reach)
                    met = [np.zeros(0, np.int64)]
                    for c2, l2, r2, _, short, _ in every[f + 1 :]:  # passages with enough in common are met under the first hash function they share
                        first = np.searchsorted(c2, low)
                        n = np.searchsorted(c2, high, side="right") - first
                        k = np.repeat(np.arange(len(c)), n)
                        j = np.arange(len(k)) + np.repeat(first - np.cumsum(n) + n, n)
                        ok = (l2[j] <= c[k]) & (r2[j] >= c[k]) & (np.minimum(r2[j], r[k]) - np.maximum(l2[j], l[k]) >= least - 1)
                        met.append((k[ok] << 32) + short[j[ok]] + (1 << 31))
                    met = np.unique(np.concatenate(met))
                    n = np.bincount(met >> 32, minlength=len(c))
                    ends, others = np.cumsum(n).tolist(), ((met & 0xFFFFFFFF) - (1 << 31)).tolist()
                    for k in np.flatnonzero(n >= enough - 1).tolist():
                        a, b, o = int(low[k]), int(high[k]) + 1, int(own[k])
                        piece = near[a:b].tobytes()
                        if (o, key[k], piece) not in seen:
                            seen.add((o, key[k], piece))
                            out.append((int(key[k]), ids[o], int(c[k]) - a, piece, others[ends[k] - int(n[k]) : ends[k]]))
                    if len(out) > 5000:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    return run


def _extent(a: np.ndarray) -> tuple[int, int]:
    """Shingles of a row on the left and on the right of its middle."""
    at, c = np.flatnonzero(a), len(a) // 2
    return c - int(at[0]), int(at[-1]) - c


def _similar(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> bool:
    """Whether any passages of ``least`` or more shingles around the middles of two rows are similar.

    Passages reach s, t to the left and e, g to the right of the middles. Without repeats, and with matches on
    one side only, (1 + similarity) * matches - similarity * both lengths is a sum of a left and a right part.
    """
    (s, e), (t, g), c = _extent(a), _extent(b), len(a) // 2
    return _similar_around(a[c - s : c + e + 1], s, b[c - t : c + g + 1], t, least, similarity)


def _similar_around(x: np.ndarray, s: int, y: np.ndarray, t: int, least: int, similarity: float, ux: np.ndarray | None = None, uy: np.ndarray | None = None) -> bool:
    """The same for rows without padding, whose middles are number s and t; their distinct values may be given."""
    e, g = len(x) - 1 - s, len(y) - 1 - t
    if min(s + e, t + g) + 1 < least:
        return False
    ux, uy = np.unique(x) if ux is None else ux, np.unique(y) if uy is None else uy
    plain = len(ux) == len(x) and len(uy) == len(y)
    begins = _starts(x, s, uy, least, similarity, plain)
    if not begins or not (others := _starts(y, t, ux, least, similarity, plain)) or max(begins.values()) + max(others.values()) < -1e-9:
        return False
    if not plain:
        return _similar_sets(x, y, s, t, least, similarity, begins, others)
    # Distinct shingles on the left and on the right of each middle with their least distance from it.
    (lx, dlx), (rx, drx), (ly, dly), (ry, dry) = _nearest(x[:s][::-1]), _nearest(x[s + 1 :]), _nearest(y[:t][::-1]), _nearest(y[t + 1 :])

    def side(u, du, wide, v, dv, high):
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        m = np.bincount(du[i] * (high + 1) + dv[j], minlength=(wide + 1) * (high + 1)).reshape(wide + 1, high + 1).cumsum(0).cumsum(1)
        n, k = (np.bincount(d, minlength=z + 1).cumsum() for d, z in ((du, wide), (dv, high)))
        return (1 + similarity) * m - similarity * (n[:, None] + k)

    right = side(rx, drx, e, ry, dry, g)
    right = np.maximum.accumulate(np.maximum.accumulate(right[::-1, ::-1], 0), 1)[::-1, ::-1]  # the best from there on
    short, low = np.maximum(0, least - 1 - np.arange(s + 1)), np.maximum(0, least - 1 - np.arange(t + 1))
    p, q = np.flatnonzero(short <= e), np.flatnonzero(low <= g)
    best = (side(lx, dlx, s, ly, dly, t)[np.ix_(p, q)] + right[np.ix_(short[p], low[q])]).max() + 1 - similarity
    crossing = np.isin(lx, ry).sum() + np.isin(rx, ly).sum()
    if plain and not crossing:
        return bool(best >= -1e-9)
    again = len(np.append(lx, rx)) + 1 - len(ux) + len(np.append(ly, ry)) + 1 - len(uy)  # counted on both sides
    return bool(best + (1 + similarity) * crossing + similarity * again >= -1e-9) and _similar_sets(x, y, s, t, least, similarity, begins, others)


def _nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with the least distance, from 1, of each."""
    v, at = np.unique(x, return_index=True)
    return v, at + 1


def _starts(x: np.ndarray, s: int, y: np.ndarray, least: int, similarity: float, plain: bool) -> dict[int, float]:
    """Starts of passages around number s of a row with a share of ``similarity`` of their shingles in sorted y, as all similar ones have.

    Two passages are similar if (1 + similarity) * matches - similarity * both lengths is not negative. Half of
    the matches belong to either side: each start comes with the most that its side can add to this sum.
    """
    on, half = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x, (1 + similarity) / 2
    begin = np.arange(min(s, len(x) - least) + 1)
    if plain:
        stop = np.maximum(s + 1, begin + least)

        def best(value):
            total = np.concatenate(([0.0], np.cumsum(value)))
            return np.maximum.accumulate(total[::-1])[::-1][stop] - total[begin]  # to the best end from there on

        share, gain = best(on - similarity), best(half * on - similarity)
    else:
        order = np.argsort(x, kind="stable")
        same = x[order[1:]] == x[order[:-1]]
        before = np.full(len(x), -1)
        before[order[1:][same]] = order[:-1][same]
        new = before[None, :] < begin[:, None]  # the first of its kind from this start on
        new &= np.arange(len(x))[None, :] >= begin[:, None]
        n, m = np.cumsum(new, axis=1, dtype=np.int32), np.cumsum(new & on, axis=1, dtype=np.int32)
        early = np.arange(len(x))[None, :] < np.maximum(s, begin + least - 1)[:, None]
        share, gain = (np.where(early, -np.inf, w * m - similarity * n).max(axis=1) for w in (1.0, half))
    at = np.flatnonzero(share >= -1e-9)
    return dict(zip(at.tolist(), gain[at].tolist()))


def _firsts(x: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles from ``begin`` on, and where each comes first."""
    v, at = np.unique(x[begin:], return_index=True)
    return v, at + begin


def _similar_sets(x: np.ndarray, y: np.ndarray, s: int, t: int, least: int, similarity: float, begins: dict[int, float], others: dict[int, float]) -> bool:
    """The same for shingles that repeat or change sides, by sets: all ends at once for each two starts."""
    both = np.intersect1d(x, y)

    def opened(z, c, starts, least_gain):
        seen = set()
        for begin, gain in sorted(starts.items(), key=lambda kv: -kv[1]):
            if gain < least_gain:
                return
            stop = max(c, begin + least - 1)
            v, at = _firsts(z, begin)
            n = np.bincount(at, minlength=len(z)).cumsum()[stop:]
            if n[0] == n[-1]:  # one set whatever the end, as in text with a short period
                if v.tobytes() in seen:
                    continue
                seen.add(v.tobytes())
                n = n[:1]
            end = np.full(len(both), -1)  # how far behind the least end each common shingle comes first
            code = np.minimum(np.searchsorted(both, v), len(both) - 1)
            here = both[code] == v
            end[code[here]] = np.maximum(at[here] - stop, 0)
            yield gain, n, end

    if not len(both):
        return False
    ready = list(opened(y, t, others, -1e-9 - max(begins.values())))
    for gain, n, p in opened(x, s, begins, -1e-9 - max(others.values())):
        for gain2, n2, q in ready:
            if gain + gain2 < -1e-9:
                break
            use = (p >= 0) & (q >= 0)
            if (1 + similarity) * np.count_nonzero(use) < similarity * (n[0] + n2[0]) - 1e-9:
                continue
            m = np.bincount(p[use] * len(n2) + q[use], minlength=len(n) * len(n2)).reshape(len(n), len(n2)).cumsum(0).cumsum(1)
            if ((1 + similarity) * m >= similarity * (n[:, None] + n2) - 1e-9).any():
                return True
    return False


def _least_matches(x: np.ndarray, kinds: int, s: int, least: int, similarity: float) -> int:
    """Matches that any similar passage around number s of a row has at least."""
    fewest = least if kinds == len(x) else min((len(np.unique(x[b : b + least])) for b in range(max(0, s - least + 1), min(s, len(x) - least) + 1)), default=least)
    return int(np.ceil(similarity * fewest - 1e-9))


def _candidates(sets: list[np.ndarray], label: np.ndarray, need: np.ndarray):
    """Row pairs of different labels with enough values in common, most first, as two arrays.

    Values of at most ``COLD`` rows are looked up in lists of their rows. A row whose other values are too few
    to suffice must share one of those with any partner; rows with more are counted against each other.
    """
    n = len(sets)
    row = np.repeat(np.arange(n), [len(v) for v in sets])
    v, code = np.unique(np.concatenate(sets), return_inverse=True)
    low, high = np.full(len(v), n), np.full(len(v), -1)
    np.minimum.at(low, code, label[row])
    np.maximum.at(high, code, label[row])
    use = (low < high)[code]
    order = np.argsort(code[use], kind="stable")
    row, code = row[use][order], code[use][order]
    often = np.bincount(code, minlength=len(v))
    cold = often[code] <= COLD
    crow, ccode, pairs = row[cold], code[cold], []
    for d in range(1, COLD):
        same = np.flatnonzero(ccode[d:] == ccode[:-d]) if len(ccode) > d else []
        if not len(same):
            break
        a, b = crow[same], crow[same + d]
        apart = label[a] != label[b]
        pairs.append(np.minimum(a, b)[apart] * n + np.maximum(a, b)[apart])
    pair, common = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    hot = np.flatnonzero(often > COLD)
    has = np.zeros((n, len(hot)), bool)
    has[row[~cold], np.searchsorted(hot, code[~cold])] = True
    held, bits = has.sum(axis=1), np.packbits(has, axis=1)
    i, j = pair // n, pair % n
    want = np.maximum(need[i], need[j])
    on = common + np.minimum(held[i], held[j]) >= want
    i, j, common, want = i[on], j[on], common[on], want[on]
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        common[part] += np.bitwise_count(bits[i[part]] & bits[j[part]]).sum(axis=1, dtype=np.int64)
    on = common >= want
    found = [(i[on], j[on], common[on])]
    heavy = np.flatnonzero(held >= need)
    if len(heavy) > 1 and len(np.unique(label[heavy])) > 1:
        h = has[heavy].astype(np.float32)
        for at in range(0, len(heavy), 512):
            g = h[at : at + 512] @ h.T
            a, b = np.nonzero((g >= np.maximum(need[heavy[at : at + 512], None], need[heavy])) & (label[heavy[at : at + 512], None] < label[heavy]))
            found.append((np.minimum(heavy[at + a], heavy[b]), np.maximum(heavy[at + a], heavy[b]), g[a, b].astype(np.int64)))
    i, j, common = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.argsort(-common, kind="stable")
    return i[order], j[order]


def _compare(least, similarity, enough):
    def flush(rows):
        """Links between classes of one block pair, one for each merge of two classes."""
        out = []
        label = np.unique([r[2] for r in rows], return_inverse=True)[1]  # texts of one class need no link
        if not label.any():
            return out
        x = [np.frombuffer(r[4], np.uint32) for r in rows]
        sets = [np.unique(v) for v in x]
        need = np.array([_least_matches(v, len(u), r[3], least, similarity) for v, u, r in zip(x, sets, rows)])
        others = [set(r[5]) for r in rows]
        i, j = _candidates(sets, label, need)
        for low in range(0, len(i), 4096):
            p, q = i[low : low + 4096], j[low : low + 4096]
            apart = label[p] != label[q]
            for a, b in zip(p[apart].tolist(), q[apart].tolist()):
                if label[a] != label[b] and (enough < 2 or len(others[a] & others[b]) >= enough - 1) and _similar_around(x[a], rows[a][3], x[b], rows[b][3], least, similarity, sets[a], sets[b]):
                    out.append((rows[a][1], rows[b][1]))
                    label[label == label[b]] = label[a]
        return out

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches):
        held, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out += flush(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            if len(out) > 5000:
                yield batch_of(out)
                out = []
        out += flush(held) if len(held) > 1 else []
        if out:
            yield batch_of(out)

    return run


def passage_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, hashes: int = HASHES, enough: int = ENOUGH, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shared, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest id among the texts that chains of near-duplicate passages reach, itself
    included; ``n_shared`` counts the min-hashes of the text that occur in other documents too, whether or not
    they come from linked passages.
    Null texts, and texts under ``least`` shingles, link with nothing. Rows that share an id are one document;
    rows with a null id are left as they are, linked with nothing. No rows: no rows.
    """
    reach = reach_of(least, similarity)
    given = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("binary").alias("body"))
    found = cut(given.mapInArrow(_find(least, hashes, reach), "node bigint, key bigint, middle bigint"), "windows")
    counts = found.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    shared = cut(found.join(counts, "key"), "shared")
    lows = shared.groupBy("key", "middle").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = cut(shared.join(lows, ["key", "middle"]).where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "same-passages")
    first = connected_components(stars)
    classed = cut(shared.select("key", "node").distinct().join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("class")), "classes")
    mixed = classed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("key")
    asked = cut(classed.join(mixed, "key").groupBy("node", "class").agg(F.collect_list("key").alias("asked")), "asked")
    kind = "key bigint, node bigint, at int, piece binary, others array<int>"
    pieces = given.join(asked.select("node", "asked"), "node").select("node", "body", "asked").mapInArrow(_intervals(least, hashes, reach, enough), kind)
    # Copies have equal intervals: one of each class stands for them.
    pieces = pieces.join(asked.select("node", "class"), "node").groupBy("key", "class", "at", "piece", "others").agg(F.min("node").alias("node"))
    pieces = cut(pieces, "intervals")

    def crowds(rows: DataFrame, name: str) -> DataFrame:
        """Keys with several classes, their largest class, and in how many blocks it and the rest come."""
        sizes = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.groupBy("key").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("all")).where("all > top.n")
        in_blocks = [F.ceil(n / block).cast("int").alias(k) for n, k in ((F.col("top.n"), "tops"), (F.col("all") - F.col("top.n"), "rests"))]
        return cut(most.select("key", F.col("top.class").alias("most"), *in_blocks, (F.col("all") > block).alias("large")), name)

    def compared(rows: DataFrame) -> DataFrame:
        """Links of the rows of each key. Rows of its largest class need no comparison with each other, so their blocks meet those of the rest only."""
        top, mark = F.col("class") == F.col("most"), F.xxhash64("piece")
        own = F.when(top, F.pmod(mark, F.col("tops").cast("long"))).otherwise(F.col("tops") + F.pmod(mark, F.col("rests").cast("long"))).cast("int")
        meets = F.when(top, F.sequence(F.col("tops"), F.col("tops") + F.col("rests") - 1)).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("tops") + F.col("rests") - 1), F.col("own")))
        dealt = rows.withColumn("own", own).withColumn("other", F.explode(meets))
        dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "node", "class", "at", "piece", "others")
        return cut(dealt.repartition("g").sortWithinPartitions("g", "node").mapInArrow(_compare(least, similarity, enough), "a bigint, b bigint"), "near")

    # Small groups first: what they link need not be told apart in the large ones, most of which then hold one class.
    sized = pieces.join(crowds(pieces, "crowds"), "key")
    links = stars.unionByName(compared(sized.where("not large")))
    joined = connected_components(links)
    large = sized.where("large").join(joined, "node", "left").select("key", "node", "at", "piece", "others", F.coalesce("component", "class").alias("class"))
    large = cut(large.groupBy("key", "class", "at", "piece", "others").agg(F.min("node").alias("node")), "large")
    parts = connected_components(links.unionByName(compared(large.join(crowds(large, "still"), "key"))))
    tally = shared.groupBy("node").agg(F.countDistinct("key").alias("n_shared"))
    out = docs.select(F.col(doc_id), F.col(doc_id).cast("long").alias("__node"))
    return (
        out.join(tally, out["__node"] == tally["node"], "left").drop("node")
        .join(parts, F.col("__node") == parts["node"], "left")
        .select(doc_id, F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), F.coalesce("component", "__node").alias("component_id"))
    )

"""String similarities. Set measures are built-in expressions; edit-based ones run on Arrow batches."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from plinthwork.functions.numbers import as_col
from plinthwork.functions.text import tokens


def trigrams(x) -> Column:
    """Distinct three-character pieces of each lower-case word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(as_col(x), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def jaccard(a, b) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 for two empty ones."""
    a, b = as_col(a), as_col(b)
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def overlap(a, b) -> Column:
    """Shared values over those of the shorter array."""
    a, b = as_col(a), as_col(b)
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def trigram_similarity(a, b) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def bigrams(x) -> Column:
    s = F.coalesce(as_col(x), F.lit(""))
    n = F.greatest(F.length(s) - 1, F.lit(0))
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def bigram_jaccard(a, b) -> Column:
    return jaccard(bigrams(a), bigrams(b))


def token_overlap(a, b) -> Column:
    """Shared words over the words of the shorter side."""
    return overlap(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    taken, mine = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    k = len(mine)
    if not k:
        return 0.0
    swaps = sum(x != y for x, y in zip(mine, (b[j] for j in range(m) if taken[j]))) // 2
    jaro = (k / n + k / m + (k - swaps) / k) / 3
    prefix = next((i for i in range(min(4, n, m)) if a[i] != b[i]), min(4, n, m))
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_grid(a: list[str], b: list[str], weight: float = 0.1) -> np.ndarray:
    """:func:`jaro_winkler` of all pairs, with the same values: characters of ``b`` that are taken are bits of one number a pair.

    Texts of over 63 characters, which do not fit one, are compared one by one.
    """
    out = np.empty((len(a), len(b)))
    long_a, long_b = [i for i, x in enumerate(a) if len(x) > 63], [j for j, y in enumerate(b) if len(y) > 63]
    for i in long_a:
        out[i] = [jaro_winkler(a[i], y, weight) for y in b]
    for j in long_b:
        out[:, j] = [jaro_winkler(x, b[j], weight) for x in a]
    rows, cols = ([k for k, x in enumerate(side) if len(x) <= 63] for side in (a, b))
    if not rows or not cols:
        return out
    xs, ys = [a[i] for i in rows], [b[j] for j in cols]
    letters = {c: k for k, c in enumerate(sorted({c for x in xs for c in x} | {c for y in ys for c in y}))}
    m, one = np.array([len(y) for y in ys]), np.uint64(1)
    where = np.zeros((len(letters) + 1, len(ys)), np.uint64)  # the last row: beyond a text's end
    for j, y in enumerate(ys):
        for k, c in enumerate(y):
            where[letters[c], j] |= one << np.uint64(k)
    starts = np.array([[letters[c] for c in y[:4]] + [-2] * (4 - len(y[:4])) for y in ys])
    equal: dict[str, list[int]] = {}
    for j, y in enumerate(ys):
        equal.setdefault(y, []).append(j)
    at, step = np.array(cols), max(1, 65_536 // len(ys))
    for lo in range(0, len(xs), step):
        part = xs[lo : lo + step]
        n = np.array([len(x) for x in part])
        codes = np.full((len(part), max(4, n.max())), -1)
        for i, x in enumerate(part):
            codes[i, : len(x)] = [letters[c] for c in x]
        reach = np.maximum(0, np.maximum(n[:, None], m[None, :]) // 2 - 1)
        taken, k, hits = np.zeros(reach.shape, np.uint64), np.zeros(reach.shape), []
        for i in range(n.max()):
            low, high = np.maximum(0, i - reach), np.minimum(m[None, :], i + reach + 1)
            window = (one << high.astype(np.uint64)) - (one << np.minimum(low, high).astype(np.uint64))
            free = where[codes[:, i]] & window & ~taken
            bit = free & (~free + one)
            taken |= bit
            hits.append(bit != 0)
            k += hits[-1]
        left, wrong = taken, np.zeros(reach.shape, np.int64)
        for i, hit in enumerate(hits):
            bit = left & (~left + one)
            wrong += hit & ((where[codes[:, i]] & bit) == 0)
            left = np.where(hit, left ^ bit, left)
        some = np.where(k > 0, k, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(k > 0, (k / n[:, None] + k / m[None, :] + (k - wrong // 2) / some) / 3, 0.0)
        alike, prefix = np.ones(reach.shape, bool), np.zeros(reach.shape, np.int64)
        for i in range(4):
            alike &= codes[:, i, None] == starts[None, :, i]
            prefix += alike
        value = np.where(jaro > 0.7, jaro + prefix * weight * (1 - jaro), jaro)
        for i, x in enumerate(part):
            value[i, equal.get(x, [])] = 1.0
        out[np.ix_(np.array(rows)[lo : lo + step], at)] = value
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, in bit vectors (Hyyro)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, in percent; two empty texts: 100."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio of the shared words with and without each side's own; no words on a side: 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, mine, theirs = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not mine or not theirs):
        return 100.0
    base = " ".join(sorted(both))
    left, right = (base + " " + mine).strip(), (base + " " + theirs).strip()
    ratios = [indel_ratio(left, right)]
    if base:
        ratios += [indel_ratio(base, left), indel_ratio(base, right)]
    return max(ratios)


def composite(a: str, b: str) -> float:
    return 0.35 * jaro_winkler(a, b) + 0.35 * token_set_ratio(a, b) / 100 + 0.30 * indel_ratio(a, b) / 100


def sequence_ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()




def metaphone(word: str) -> str:
    """A short consonant key: silent starts dropped, letter groups by sound, vowels only in front."""
    w = "".join(c for c in word.lower() if "a" <= c <= "z")
    if not w:
        return ""
    if w[:2] in ("kn", "gn", "pn", "ae", "wr"):
        w = w[1:]
    elif w[0] == "x":
        w = "s" + w[1:]
    out = ""
    for i, c in enumerate(w):
        before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        if c == before and c != "c":
            continue
        if c in "aeiou":
            out += c.upper() if not i else ""
        elif c == "c":
            out += "X" if after == "h" else "S" if after and after in "iey" else "K"
        elif c == "g":
            out += "" if after == "h" else "J" if after and after in "iey" else "K"
        elif c == "h":
            out += "" if before and before in "cgpst" or after not in tuple("aeiou") else "H"
        elif c in "wy":
            out += c.upper() if after and after in "aeiou" else ""
        elif c == "s":
            out += "X" if after == "h" else "S"
        elif c == "t":
            out += "0" if after == "h" else "T"
        elif c == "p":
            out += "F" if after == "h" else "P"
        else:
            out += {"q": "K", "v": "F", "x": "KS", "z": "S", "d": "T", "b": "" if i == len(w) - 1 and before == "m" else "B"}.get(c, c.upper())
    return out


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = np.empty(len(a))
        for i, pair in enumerate(zip(a.fillna(""), b.fillna(""))):
            v = known.get(pair)
            if v is None:
                v = known[pair] = f(*pair)
            out[i] = v
        return pd.Series(out)

    return pandas_udf(run, DoubleType())


jaro_winkler_col = _pairwise(jaro_winkler)
indel_col = _pairwise(indel_ratio)
token_sort_col = _pairwise(token_sort_ratio)
token_set_col = _pairwise(token_set_ratio)
composite_col = _pairwise(composite)
sequence_col = _pairwise(sequence_ratio)


@pandas_udf(StringType())
def phonetic_key(s: pd.Series) -> pd.Series:
    """Keys of the first four words, joined by a bar."""
    return s.fillna("").map(lambda x: "|".join(metaphone(w) for w in x.split()[:4]))

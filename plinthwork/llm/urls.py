"""URL filter: longest matching host and path rules, then gradient-boosted trees on lexical features.

Rules say allow or block for what they fit, and so label the URLs that the trees are trained on. The trees see
lexical features only: lengths, depth, digit share, entropy, parameter counts and the record of the host's
suffix and of the path's first part among labelled URLs. Boosting is on logistic loss with histogram splits.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Bound of the fit: distinct labelled URLs that are read, drawn by a hash of the URL. Copies say nothing new, as the label follows from the URL.
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 40, 3, 0.2, 32, 20
FEATURES = ("url length", "host length", "path length", "host depth", "path depth", "digit share", "entropy", "parameters", "query length", "hyphens", "suffix record", "first part record", "secure")


def host_path(url):
    """Columns of a URL's host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_columns(host, path, rules=RULES):
    """Columns of the longest rule that fits, as host and path in one, and of its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # longer ones are asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _suffix(host: str) -> str:
    return host.rsplit(".", 1)[-1]


def _first(path: str) -> str:
    return path.split("/", 2)[1] if path.count("/") > 1 else ""


def features(url: str | None, host: str, path: str, records: tuple[dict, dict, float]) -> list[float]:
    url = url or ""
    query = re.sub(r"#.*", "", url.partition("?")[2], flags=re.S)
    suffixes, firsts, base = records
    return [len(url), len(host), len(path), host.count("."), path.count("/"), sum(c.isdigit() for c in url) / max(1, len(url)), _entropy(url), len([x for x in re.split("[&;]", query) if x]), len(query), url.count("-"), suffixes.get(_suffix(host), base), firsts.get(_first(path), base), float(url.startswith("https"))]


class Boosted:
    """Boosted regression trees for a 0 or 1 label; trees are arrays (feature, cut, left, right, value)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees=TREES, depth=DEPTH, rate=RATE, bins=BINS, least=LEAST):
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        self.bias, self.trees = math.log(p / (1 - p)), []
        if len(y) < 2 * least or y.min() == y.max():
            return
        seen = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1), method="nearest")) for j in range(x.shape[1])]
        cuts = [(v[1:] + v[:-1]) / 2 for v in seen]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.bias)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            nodes, waiting = [], [(np.arange(len(y)), 0, None)]
            while waiting:
                rows, level, parent = waiting.pop(0)
                me = len(nodes)
                if parent:
                    nodes[parent[0]][parent[1]] = me
                value = rate * g[rows].sum() / (h[rows].sum() + 1.0)
                nodes.append([-1, 0.0, -1, -1, value])
                split = self._split(code, cuts, g, h, rows, least) if level < depth else None
                if split:
                    j, b = split
                    nodes[me][:2] = [j, float(cuts[j][b])]
                    low = code[rows, j] <= b
                    waiting += [(rows[low], level + 1, (me, 2)), (rows[~low], level + 1, (me, 3))]
                else:
                    score[rows] += value
            self.trees.append(np.array(nodes))

    @staticmethod
    def _split(code, cuts, g, h, rows, least):
        best, at = 1e-6, None
        gs, hs = g[rows].sum(), h[rows].sum()
        whole = gs * gs / (hs + 1.0)
        for j, c in enumerate(cuts):
            k = len(c) + 1
            gl, hl, nl = (np.cumsum(np.bincount(code[rows, j], w, k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + 1.0) + (gs - gl) ** 2 / (hs - hl + 1.0) - whole
            gain = np.where((nl >= least) & (len(rows) - nl >= least), gain, -1.0)
            if len(gain) and gain.max() > best:
                best, at = gain.max(), (j, int(gain.argmax()))
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(inner := np.flatnonzero(t[at, 0] >= 0)):
                n = t[at[inner]]
                go = x[inner, n[:, 0].astype(int)] <= n[:, 1]
                at[inner] = np.where(go, n[:, 2], n[:, 3]).astype(int)
            score += t[at, 4]
        return 1 / (1 + np.exp(-score))


def fit(labelled: list[tuple[str, str, str, int]]) -> tuple[Boosted, tuple[dict, dict, float]]:
    """Trees and records from (url, host, path, blocked) rows; no rows: nothing is blocked."""
    base = (sum(r[3] for r in labelled) + 0.5) / (len(labelled) + 1.0) if labelled else 0.0

    def record(of):
        n, k = Counter(), Counter()
        for r in labelled:
            n[of(r)] += 1
            k[of(r)] += r[3]
        return {s: (k[s] + 10 * base) / (n[s] + 10) for s in n if n[s] >= LEAST}

    records = (record(lambda r: _suffix(r[1])), record(lambda r: _first(r[2])), base)
    x = np.array([features(u, h, p, records) for u, h, p, _ in labelled], float).reshape(-1, len(FEATURES))
    return Boosted(x, np.array([r[3] for r in labelled], float)) if labelled else None, records


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages``.

    The verdict is the longest fitting rule's; without one, ``block`` where the trees' ``score`` reaches
    ``threshold``. A null URL, or one without ``://``, has an empty host and path and is scored like any other.
    Without labelled rows nothing more is blocked. Repeated rows stay.
    """
    host, path = host_path(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("__verdict"))
    known = ruled.where("rule is not null").select("__url", "host", "path", "__verdict").distinct().orderBy(F.xxhash64("__url"), "__url").limit(rows)
    model, records = fit([(r["__url"], r["host"], r["path"], int(r["__verdict"] == "block")) for r in known.collect()])

    def run(batches):
        for batch in batches:
            urls, hosts, paths = (batch.column(i).to_pylist() for i in (1, 2, 3))
            x = np.array([features(*r, records) for r in zip(urls, hosts, paths)], float).reshape(-1, len(FEATURES))
            score = model.predict(x) if model else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "__verdict", "score"])

    kind = split.schema["page_id"].dataType.simpleString()
    scored = ruled.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, __verdict string, score double")
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("page_id").alias(page_id), "host", "path", "rule", F.coalesce("__verdict", own).alias("verdict"), "score")

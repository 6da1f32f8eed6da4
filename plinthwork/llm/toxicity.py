"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the same classes of words: insults, threats, targets, negation and reported speech.
Their product, built state by state, is one machine that turns a clause into events: an insult that is plain,
aimed at a target, negated or reported, and a threat. A text's score is a logistic function of the weights that
its events collect, so an insult word inside a negated or quoted clause counts apart from a plain one.

Insult words and word stems (those whose counts pass a likelihood-ratio test), with their weights, and the weights of the events are learned from labelled rows;
a short list of English words is known before. Only the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut

THRESHOLD = 0.7
#: Bounds of the fit: labelled rows of each class that are read, and words or stems that are kept.
FIT_ROWS, FIT_WORDS = 4000, 2000
LEAST_DOCS, LEAST_ODDS, LEAST_G, STEMS = 5, 3.5, 20.0, (4, 5, 6, 7)

# The grammar's closed word classes.
INSULTS = "idiot moron scum trash stupid pathetic worthless disgusting loser imbecile vermin filth".split()
THREATS = "kill hurt destroy beat shoot stab burn töten verletzen zerstören tuer blesser détruire matar herir destruir".split()
TARGETS = "you your they them he she him her these those du ihr sie dich euch tu vous ils elles toi usted tú ellos vosotros".split()
NEGATIONS = "not no never neither without isn't aren't don't nicht kein keine nie ne pas jamais aucun no nunca sin".split()
REPORTS = "said says wrote reported quoted claimed called asked sagte schrieb berichtete nannte dit écrit rapporté appelé dijo escribió llamó".split()
PRIOR, PRIOR_WEIGHTS = 4.0, (-2.0, 2.2, 2.6, 0.3, 0.5, 2.2)

EVENTS = ("plain", "aimed", "negated", "reported", "threat")
NEGATION_SCOPE, TARGET_SCOPE, THREAT_SCOPE = 3, 4, 3
_ENDS = ".!?;:\n\r"
_END, _WORD = re.compile(f"[{_ENDS}]"), re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def _countdown(on: str, scope: int):
    """A transducer that remembers for ``scope`` words that it has read ``on``."""
    return lambda state, word: scope if word == on else max(0, state - 1)


def compose() -> dict:
    """Product of the component transducers: (state, class) -> (next state, event or None)."""
    parts = (_countdown("N", NEGATION_SCOPE), lambda s, w: 1 if w == "R" else s, _countdown("Y", TARGET_SCOPE), _countdown("T", THREAT_SCOPE))
    start = (0, 0, 0, 0)
    table, waiting = {}, [start]
    while waiting:
        state = waiting.pop()
        for word in "WINRYT":
            if (state, word) in table:
                continue
            negated, reported, aimed, threat = state
            event = None
            if word == "I":
                event = "negated" if negated else "reported" if reported else "aimed" if aimed else "plain"
            elif (word == "Y" and threat or word == "T" and aimed) and not negated and not reported:
                event = "threat"
            after = tuple(f(s, word) for f, s in zip(parts, state))
            table[state, word] = (after, event)
            waiting.append(after)
    return table


class Grammar:
    """The composed machine with its lexicon ({word or ``stem*``: weight}) and event weights (bias first)."""

    def __init__(self, lexicon: dict[str, float], weights=PRIOR_WEIGHTS):
        self.lexicon, self.weights = lexicon, tuple(weights)
        self.table = compose()
        self.classes = {w: c for c, words in (("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS), ("T", THREATS)) for w in words}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*")}
        self.finder = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *THREATS]:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def _class(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            if n <= len(word) and (x := self.stems.get(word[:n], 0.0)) > weight:
                weight = x
        return ("I", weight) if weight else (self.classes.get(word, "W"), 1.0)

    def features(self, text: str | None) -> list[float]:
        """Weight collected by each event over all clauses of the whole text."""
        low, totals, done = (text or "").lower(), dict.fromkeys(EVENTS, 0.0), 0
        for end, length in self.finder.iter(low):
            at = end - length + 1
            if at < done or at and low[at - 1].isalnum():
                continue
            begin = max(done, 1 + max(low.rfind(c, done, at) for c in _ENDS))  # the clause's real start
            stop = m.start() if (m := _END.search(low, end + 1)) else len(low)
            state = (0, 0, 0, 0)
            for m in _WORD.finditer(low, begin, stop):
                kind, weight = self._class(m.group())
                state, event = self.table[state, kind]
                if event:
                    totals[event] += weight
            done = stop
        return [math.log1p(totals[e]) for e in EVENTS]

    def score(self, text: str | None) -> float:
        b, *w = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, b + sum(x * y for x, y in zip(w, self.features(text)))))))


def held_out(doc_id):
    """Rows whose labels are never learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _terms(batches):
    """Words and word stems of labelled texts with the number of texts, of either label, that have them."""
    def out(seen):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["term", "y", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1)):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            terms = words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}
            seen.update((t, y.as_py()) for t in terms if len(t) < 40)
            if len(seen) > 200_000:
                yield out(seen)
                seen = Counter()
    if seen:
        yield out(seen)


def _lowest(batches):
    """Each text with the lowest hash among its three-word shingles."""
    for batch in batches:
        low = []
        for text in batch.column(0):
            words = text.as_py().encode().split()
            low.append(min(xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(low, np.uint64).view(np.int64)), *batch.columns], ["low", "__text", "__y"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, words: int = FIT_WORDS) -> Grammar:
    """Learn from at most ``rows`` labelled texts of each class, drawn by a hash of the id, none held out.

    Labels other than 0 and 1, and labels without a text, are ignored. Without both classes: the prior.
    """
    prior = dict.fromkeys(INSULTS, PRIOR)
    usable = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).where(~held_out("__id") & F.col("__y").isin(0, 1))
    picks = [usable.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows) for y in (0, 1)]
    chosen = picks[0].unionByName(picks[1]).dropDuplicates(["__id"])  # at most 2 * rows ids
    read = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id").where("__text is not null")
    # One text of each lowest shingle: copies of one toxic text must not make its other words look toxic.
    lowest = read.select("__text", "__y").mapInArrow(_lowest, "low bigint, __text string, __y int")
    sample = cut(lowest.groupBy("low").agg(F.min(F.struct("__text", "__y")).alias("w")).select("w.*"), "toxic-sample")
    counts = {r["__y"]: r["n"] for r in sample.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Grammar(prior)
    seen = sample.mapInArrow(_terms, "term string, y bigint, n bigint").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = F.log((F.col("p") + 0.5) / (counts[1] + 1.0)) - F.log((F.col("q") + 0.5) / (counts[0] + 1.0))
    share = counts[1] / (counts[0] + counts[1])
    both = F.col("p") + F.col("q")
    g = 2 * (F.col("p") * F.log(F.col("p") / (both * share)) + F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / (both * (1 - share)))).otherwise(0.0))
    best = seen.where(F.col("p") >= LEAST_DOCS).select("term", "p", "q", odds.alias("odds"), g.alias("g")).where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G)).orderBy(F.desc("odds"), "term").limit(words).collect()
    lexicon: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r["term"]), r["term"])):
        if any(t["term"] != r["term"] and t["term"].startswith(r["term"].rstrip("*")) and t["p"] >= 0.9 * r["p"] and t["odds"] > r["odds"] + 0.7 for t in best):
            continue  # a longer term says the same, and more surely
        stem = next((s for n in STEMS if (s := r["term"][:n] + "*") in lexicon and s != r["term"]), None)
        if stem is None or lexicon[stem] < r["odds"] - 0.7:
            lexicon[r["term"]] = min(8.0, float(r["odds"]))
    grammar = Grammar(prior | lexicon)

    def run(batches):
        for batch in batches:
            found = [grammar.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["y", "f"])

    got = sample.select("__text", "__y").mapInArrow(run, "y int, f array<double>").groupBy("y", "f").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "f").collect()
    x, y, n = (np.array([r[k] for r in got], float) for k in ("f", "y", "n"))
    return Grammar(grammar.lexicon, _logistic(x, y, n))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weighted ridge logistic regression by Newton steps; event weights are kept at 0 or more."""
    a = np.column_stack((np.ones(len(y)), x))
    n = n * np.where(y == 1, n[y == 0].sum() / n[y == 1].sum(), 1.0)
    w, free = np.zeros(a.shape[1]), np.ones(a.shape[1], bool)
    penalty = np.array([1e-3, *[ridge] * x.shape[1]])
    for _ in range(4):
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (n * (y - p)) - penalty * w
            h = (a * (n * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
            step = np.zeros_like(w)
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        bad = free & (w < 0)
        bad[0] = False
        if not bad.any():
            break
        free &= ~bad
        w[bad] = 0
    return tuple(float(v) for v in w)


def score_documents(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, *keep, held_out, score, predicted`` for each row; a null text scores as an empty one.

    Equal texts have equal scores, so repeated rows stay and agree. A null id is held out. No rows: no rows.
    """
    lexicon, weights = grammar.lexicon, grammar.weights  # at most FIT_WORDS entries
    made: list[Grammar] = []

    def run(batches):
        if not made:
            made.append(Grammar(lexicon, weights))
        for batch in batches:
            scores = [made[0].score(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"])

    given = docs.select(F.col(text).alias("__text"), doc_id, *keep, held_out(doc_id).alias("held_out"))
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (doc_id, *keep)]
    return given.mapInArrow(run, ", ".join([*kept, "held_out boolean, score double"])).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

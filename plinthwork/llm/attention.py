"""Document quality by attention-based multiple-instance learning (Ilse et al., "Attention-based Deep Multiple Instance Learning").

A document is a bag of passages of 48 words. Every passage is encoded by what its bytes and words look like (classes
of characters, shouting, decorated or repeated words, ...) and by a small hidden layer; gated attention weighs the
passages of a document, and the weighted passage is scored. Only the documents have labels: which passages speak for
or against one is learned with the rest, by gradient descent on a bounded sample of labelled documents.

Encoding works on the bytes of many texts at once, so the passages of all texts are scored in whole array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut
from plinthwork.llm.toxicity import held_out

THRESHOLD, PASSAGE = 0.5, 48
#: Bounds of the fit: labelled documents of each class, passages of one document and of all that are read.
FIT_ROWS, FIT_LONGEST, FIT_PASSAGES = 2000, 2000, 60_000
HIDDEN, GATES, ROUNDS, RATE, DECAY = 16, 8, 250, 0.03, 1e-3
#: Bytes that are encoded at a time, in whole passages.
_CHUNK = 4 << 20

_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "'\"`", "|", "$%&*#@^~", "<>{}[]()/\\=_+", ":;-")
_KIND = np.full(256, len(_KINDS) + 1, np.uint8)  # control bytes
_KIND[128:] = len(_KINDS)
for _k, _chars in enumerate(_KINDS):
    _KIND[[ord(_c) for _c in _chars]] = _k
_LOWER, _UPPER, _DIGIT, _MARK, _HIGH, _N = 0, 1, 2, 9, len(_KINDS), len(_KINDS) + 2
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_DICE = np.random.default_rng(7)
_BYTE, _PLACE = (_DICE.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (256, 4096))
FEATURES = _N + 10


def encode(bodies: pa.Array, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows, float32), and the number of passages of each text; an empty text has one, of zeros."""
    bodies = bodies.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    if not len(bodies) or ends[-1] == ends[0]:
        return np.zeros((len(bodies), FEATURES), np.float32), np.ones(len(bodies), np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    solid = ~_SPACE[data]
    first = np.zeros(len(data), bool)
    first[1:] = solid[1:] & ~solid[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    first[heads] = solid[heads]
    start = np.flatnonzero(first)
    words = np.searchsorted(start, ends)
    size = np.diff(words)
    bags = np.maximum(1, -(-size // passage))
    number = np.repeat(np.cumsum(bags) - bags, size) + (np.arange(len(start)) - np.repeat(words[:-1], size)) // passage
    out = np.zeros((int(bags.sum()), FEATURES), np.float32)
    limit = np.searchsorted(ends, start, "right")  # the text of each word
    stop = np.append(start[1:], len(data))
    stop = np.minimum(stop, ends[limit])
    low = 0
    while low < len(start):
        high = int(np.searchsorted(start, start[low] + _CHUNK))
        if high < len(start):
            high = max(int(np.searchsorted(number, number[high])), int(np.searchsorted(number, number[low], "right")))
        _describe(out, data, solid, start[low:high], stop[low:high], number[low:high])
        low = high
    return out, bags


def _describe(out, data, solid, start, stop, number):
    """Fill the rows of ``out`` for a stretch of words in whole passages."""
    a, b = int(start[0]), int(stop[-1])
    kind, here = _KIND[data[a:b]], solid[a:b]
    at, length = start - a, stop - start
    base, rows = int(number[0]), int(number[-1]) - int(number[0]) + 1
    word = np.repeat(np.arange(len(at)), np.diff(np.append(at, b - a)))
    word[: at[0]] = 0
    place = np.arange(b - a) - at[word]
    inside = here & (place >= 0)
    of = number - base
    count = np.bincount(of, minlength=rows).astype(float)
    chars = np.bincount(of[word[inside]] * _N + kind[inside], minlength=rows * _N).reshape(rows, _N)
    total = np.maximum(1, chars.sum(axis=1))
    out[base : base + rows, :_N] = chars / total[:, None]

    by_word = np.bincount(word[inside] * _N + kind[inside], minlength=len(at) * _N).reshape(len(at), _N)
    size = by_word.sum(axis=1)
    letters = by_word[:, _LOWER] + by_word[:, _UPPER] + by_word[:, _HIGH]
    mixed = np.where(inside, _BYTE[data[a:b]] * _PLACE[np.minimum(place, 4095)], np.uint64(0))
    digest = np.add.reduceat(mixed, at)
    same = np.zeros(len(at), bool)
    same[1:] = (digest[1:] == digest[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((digest, of))
    new = np.ones(len(at), bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=rows)

    def share(flags):
        return np.bincount(of, weights=flags, minlength=rows) / np.maximum(1, count)

    more = (
        share(np.log1p(size)), share(size <= 3), share(size >= 16), share(same), distinct / np.maximum(1, count), share((by_word[:, _UPPER] > 1) & (by_word[:, _LOWER] == 0)),
        share((letters > 0) & (by_word[:, _MARK] > 0)), share(letters == 0), share(by_word[:, _DIGIT] > 0), np.log1p(count),
    )
    out[base : base + rows, _N:] = np.column_stack(more)


class Attention:
    """Weights of the encoder, of the gated attention and of the score; features are centred and scaled first."""

    def __init__(self, mean, scale, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def _forward(self, x: np.ndarray, bags: np.ndarray):
        we, be, v, u, w, c, b = self.weights
        h = np.tanh(x @ we + be)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ w
        at = np.cumsum(bags) - bags
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), bags))
        a = e / np.repeat(np.add.reduceat(e, at), bags)
        z = np.add.reduceat(a[:, None] * h, at)
        return h, t, s, a, z, z @ c + b[0]

    def scores(self, features: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each document."""
        if not len(bags):
            return np.zeros(0)
        logit = self._forward((features - self.mean) / self.scale, bags)[-1]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss with row weights n; x is centred and scaled."""
        we, be, v, u, w, c, b = self.weights
        h, t, s, a, z, logit = self._forward(x, bags)
        at = np.cumsum(bags) - bags
        dl = n * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n.sum()
        dz = dl[:, None] * c
        dz_at = np.repeat(dz, bags, axis=0)
        da = (dz_at * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at), bags))
        dt, ds = de[:, None] * w * s * (1 - t * t), de[:, None] * w * t * s * (1 - s)
        dh = (dz_at * a[:, None] + dt @ v.T + ds @ u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ dl, np.array([dl.sum()])]


def learn(features: np.ndarray, bags: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = 11) -> Attention:
    """Adam on all bags at once; both classes count alike. Equal input, equal weights."""
    dice = np.random.default_rng(seed)
    scale = np.maximum(features.std(axis=0), 1e-3)
    shapes = ((FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,))
    model = Attention(features.mean(axis=0), scale, [dice.normal(0, 1 / np.sqrt(s[0]), s) for s in shapes])
    x = (features - model.mean) / scale
    n = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    first, second = ([np.zeros(s) for s in shapes] for _ in range(2))
    for r in range(1, rounds + 1):
        for i, g in enumerate(model.gradients(x, bags, y, n)):
            g = g + DECAY * model.weights[i] * (i not in (1, 6))
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.001 * (g * g - second[i])
            model.weights[i] = model.weights[i] - RATE * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.999**r)) + 1e-8)
    return model


def plain() -> Attention:
    """The model without labels of both classes: every document scores one half."""
    shapes = ((FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATES), (HIDDEN, GATES), (GATES,), (HIDDEN,), (1,))
    return Attention(np.zeros(FEATURES), np.ones(FEATURES), [np.zeros(s) for s in shapes])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Attention:
    """Learn from at most ``rows`` labelled documents of each class, drawn by a hash of the id, none held out.

    Whole texts are read; documents of more than ``FIT_LONGEST`` passages are not drawn, and no more than have
    ``FIT_PASSAGES`` together. Labels other than 0 and 1, and labels without a text, are ignored. Without both
    classes the model says one half of every document.
    """
    usable = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).where(~held_out("__id") & F.col("__y").isin(0, 1))
    picks = [usable.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows) for y in (0, 1)]
    chosen = picks[0].unionByName(picks[1]).dropDuplicates(["__id"])  # at most 2 * rows ids
    read = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__body")).join(F.broadcast(chosen), "__id").where("__body is not null")
    once = read.groupBy("__body").agg(F.min("__y").alias("y"), F.max("__y").alias("most"), F.min(F.xxhash64("__id")).alias("h")).where("y = most")  # a text counts once, and not with two labels

    def run(batches):
        for batch in batches:
            features, bags = encode(batch.column(0))
            ends = np.cumsum(bags)
            packed = [features[e - n : e].tobytes() for e, n in zip(ends, bags)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(bags), pa.array(packed, pa.binary())], ["y", "h", "n", "features"])

    sample = cut(once.select("__body", "y", "h").mapInArrow(run, "y int, h bigint, n bigint, features binary").where(F.col("n") <= FIT_LONGEST), "quality-sample")
    sizes = sorted((r["h"], r["n"]) for r in sample.select("h", "n").collect())  # at most 2 * rows
    held, last = 0, None
    for h, n in sizes:
        if held + n > FIT_PASSAGES:
            break
        held, last = held + n, h
    if last is None:
        return plain()
    got = sorted(sample.where(F.col("h") <= last).collect(), key=lambda r: (r["h"], r["y"], r["features"]))
    y = np.array([r["y"] for r in got], float)
    if y.min() == y.max():
        return plain()
    features = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES) for r in got]).astype(float)
    return learn(features, np.array([r["n"] for r in got], np.int64), y)


def score_documents(docs: DataFrame, model: Attention, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, *keep, held_out, score, predicted`` for each row; a null or blank text is one passage of zeros.

    Equal texts have equal scores, so repeated rows stay and agree. A null id is held out. No rows: no rows.
    """
    names = (doc_id, *keep, "held_out")

    def run(batches):
        for batch in batches:
            low, bodies = 0, batch.column(0)
            lengths = np.cumsum(pc.binary_length(bodies).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(lengths, (lengths[low - 1] if low else 0) + _CHUNK, "right")))
                part = batch.slice(low, high - low)
                scores = model.scores(*encode(part.column(0)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores)], [*part.schema.names[1:], "score"])
                low = high

    given = docs.select(F.col(text).cast("binary").alias("__body"), doc_id, *keep, held_out(doc_id).alias("held_out"))
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in names), "score double"])
    return given.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

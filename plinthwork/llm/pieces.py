"""SentencePiece BPE encoding and decoding by a table of last tokens.

Every prefix of a chunk has one BPE encoding, so one last token. Going left to right, an automaton yields the
vocabulary pieces that end at each place; the last token is the one that is compatible with the last token of
the prefix before it. Ids are then read off backwards. Two tokens are compatible if no merge between the right
spine of the first and the left spine of the second would come before the merges that bury them; the spines
come from each piece's own merges, ranked by score, leftmost first.

Pieces never hold a space mark behind another character, so chunks (marks, then other characters) are encoded
apart. Pieces made of marks alone share one score; runs of marks are merged by that rule and kept by length.
Characters outside the vocabulary become byte pieces and bound the merges.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
KEPT_CHUNKS, KEPT_LENGTH = 300_000, 48
_INF = float("inf")


class Pieces:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)  # read for its vocabulary only
        size = reader.get_piece_size()
        self.text, self.byte_id, self.byte_of = {}, {}, {}
        scored = []
        for i in range(size):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                self.byte_id[int(piece[3:5], 16)], self.byte_of[i] = i, int(piece[3:5], 16)
            elif not (reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)):
                self.text[i] = piece
                scored.append((-reader.get_score(i), piece, i))
        self.id = {p: i for i, p in self.text.items()}
        places = {s: k for k, s in enumerate(sorted({s for s, _, _ in scored}))}
        self.rank = {p: places[s] for s, p, _ in scored}
        self.chars = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if not (len(p) > 1 and set(p) == {MARK}):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.alone, self.right, self.left, self.fits, self.runs = {}, {}, {}, {}, {}
        self.kept: dict[str, tuple[bytes, int, str, bytes]] = {}

    def _merge(self, chars: str):
        """Plain merging by a heap; tokens as (piece, left part, right part)."""
        nodes = [(c, None, None) for c in chars]
        after, before = list(range(1, len(nodes) + 1)), list(range(-1, len(nodes) - 1))
        heap: list[tuple[int, int, int, str]] = []

        def offer(i):
            j = after[i] if i >= 0 else len(nodes)
            if i >= 0 and j < len(nodes):
                both = nodes[i][0] + nodes[j][0]
                if both in self.rank:
                    heapq.heappush(heap, (self.rank[both], i, j, both))

        for i in range(len(nodes)):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if nodes[i] is None or j >= len(nodes) or nodes[j] is None or after[i] != j or nodes[i][0] + nodes[j][0] != both:
                continue
            nodes[i], nodes[j] = (both, nodes[i], nodes[j]), None
            after[i] = after[j]
            if after[i] < len(nodes):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in nodes if x is not None]

    def _whole(self, i: int) -> bool:
        """Whether the piece's own text encodes as that piece; learns its spines."""
        if i not in self.alone:
            tree = self._merge(self.text[i])
            self.alone[i] = len(tree) == 1
            for side, spines in ((2, self.right), (1, self.left)):
                spine, node, end = [], tree[0], _INF
                while node is not None:
                    spine.append((node[0], self.rank[node[0]] if node[1] else -1, end))
                    end, node = self.rank[node[0]], node[side]
                spines[i] = spine
        return self.alone[i]

    def _fit(self, one: int, two: int) -> bool:
        if not self._whole(two):
            return False
        for a, from_a, to_a in self.right[one]:
            for b, from_b, to_b in self.left[two]:
                at = self.rank.get(a + b)
                if at is not None:
                    at = max(at, from_a, from_b)
                    if at < to_a and at <= to_b:
                        return False
        return True

    def _known(self, chunk: str) -> list[int]:
        """Ids of characters that are all in the vocabulary."""
        n = len(chunk)
        last, fits = [-1] * (n + 1), self.fits
        for end, (i, length) in self.automaton.iter(chunk):
            end += 1
            if last[end] < 0:
                start = end - length
                if not start:
                    if self._whole(i):
                        last[end] = i
                elif (p := last[start]) >= 0:
                    pair = p << 20 | i
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > 1_000_000:
                            fits.clear()
                        ok = fits[pair] = self._fit(p, i)
                    if ok:
                        last[end] = i
        ids = []
        while n:
            ids.append(last[n])
            n -= len(self.text[last[n]])
        ids.reverse()
        return ids

    def _any(self, chunk: str) -> list[int]:
        if self.chars.issuperset(chunk):
            return self._known(chunk)
        ids, begin = [], 0
        for at, c in enumerate(chunk):
            if c not in self.chars:
                ids += self._known(chunk[begin:at]) if at > begin else []
                ids += [self.byte_id[b] for b in c.encode()]
                begin = at + 1
        return ids + (self._known(chunk[begin:]) if begin < len(chunk) else [])

    def _run(self, n: int) -> list[int]:
        """Ids of n space marks that nothing else takes."""
        if n not in self.runs:
            self.runs[n] = [self.id[x[0]] for x in self._merge(MARK * n)]
        return self.runs[n]

    def _chunk(self, marks: int, rest: str) -> list[int]:
        if not rest:
            return self._run(marks)
        ids = self._any(MARK + rest)
        if marks == 1:
            return ids
        if ids[0] == self.id[MARK]:
            return self._run(marks) + ids[1:]
        return self._run(marks - 1) + ids

    def parts(self, text: str) -> list[tuple[bytes, int, str, bytes]]:
        """For each chunk its ids as text, their number, what they decode to, and the ids as 32-bit integers."""
        if not text:
            return []
        if " " not in (text[0], text[-1]) and "  " not in text and MARK not in text:
            chunks = text.split(" ")
        else:
            found = re.findall(f"({MARK}+)([^{MARK}]*)", MARK + text.replace(" ", MARK))
            chunks = [rest if len(marks) == 1 and rest else (len(marks), rest) for marks, rest in found]
        kept = self.kept
        try:
            return [kept[c] for c in chunks]
        except KeyError:
            pass
        out = []
        for c in chunks:
            part = kept.get(c)
            if part is None:
                ids = self._chunk(1, c) if isinstance(c, str) else self._chunk(*c)
                part = (",".join(map(str, ids)).encode(), len(ids), self.decode_raw(ids), array("i", ids).tobytes())
                if len(c) <= KEPT_LENGTH and not (isinstance(c, tuple) and len(c[1]) + c[0] > KEPT_LENGTH):
                    if len(kept) >= KEPT_CHUNKS:
                        kept.clear()
                    kept[c] = part
            out.append(part)
        return out

    def encode(self, text: str | None) -> list[int]:
        return array("i", b"".join([p[3] for p in self.parts(text or "")])).tolist()

    def decode_raw(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text.get(i, ""))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the mark put before every text is taken off again. Control ids decode to nothing."""
        raw = self.decode_raw(ids)
        return raw[1:] if raw.startswith(" ") and ids and ids[0] not in self.byte_of else raw


_loaded: dict[str, Pieces] = {}


def load(model: bytes) -> Pieces:
    """One encoder for each model and process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` for each row; ``ids`` too on request.

    A null or empty text has no ids. The model file (some 0.5 MB, read on the driver) is broadcast.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        pieces = load(model.value)
        for batch in batches:
            n, a, b, ids = [], [], [], []
            for text in batch.column(0):
                parts = pieces.parts(text.as_py() or "")
                joined = b",".join([p[0] for p in parts])
                decoded = "".join([p[2] for p in parts])
                if decoded.startswith(" "):
                    decoded = decoded[1:]
                n.append(sum([p[1] for p in parts]))
                a.append(hashlib.sha256(joined).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.append(b"".join([p[3] for p in parts]))
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *more], [*batch.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    given = docs.select(F.col(text).alias("__text"), *keep)
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return given.mapInArrow(run, ", ".join([*kept, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids]))

"""Chat formatting by a finite-state machine over roles and a declarative template.

The machine reads the roles of a conversation in order and marks the first turn that its table does not allow.
Each turn becomes text segments with a loss flag each, as the template says: opening mark, role, separator,
text, closing mark. Control strings inside roles and texts are escaped, so the marks in the output are only
those of the template and the reader gets every role and text back.

Turns stream through one sorted partition, so a conversation of any length needs no more memory than one turn.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, strings no text may show as they are, roles under the loss, and allowed role orders."""

    open: str = "<|turn|>"
    middle: str = "<|text|>"
    close: str = "<|done|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    steps: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})

    @property
    def control(self) -> tuple[str, ...]:
        return (self.open, self.middle, self.close, *self.reserved)

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(re.escape(c) for c in sorted(self.control, key=len, reverse=True)))


def escape(text: str, pattern: re.Pattern) -> str:
    """Double each backslash, then put backslash-point behind the first character of each control string."""
    out = text.replace("\\", "\\\\")
    while pattern.search(out):  # again where a broken string laid another one bare
        out = pattern.sub(lambda m: m.group()[0] + "\\." + m.group()[1:], out)
    return out


_ESCAPED = re.compile(r"\\([\\.])")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m.group(1) == "\\" else "", text)


SEGMENT = "conv_id bigint, seq bigint, state string, part string, segment string, loss boolean"
_NAMES = [x.split()[0] for x in SEGMENT.split(", ")]


def _format(template: Template):
    def run(batches):
        pattern, key, state, seq = template.pattern(), object(), template.start, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                role, text = role or "", text or ""
                if conv != key:
                    key, state, seq = conv, template.start, 0
                state = template.steps.get((state, role), "bad") if state != "bad" else "bad"
                loss = role in template.loss_roles
                for part, segment, under in (("open", template.open, False), ("role", escape(role, pattern), False), ("middle", template.middle, False), ("text", escape(text, pattern), loss), ("close", template.close, False)):
                    out.append((conv, seq, state, part, segment, under))
                seq += 1
                if len(out) >= 2000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return run


def _batch(out):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], _NAMES)


def format_conversations(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments ``conv_id, seq, state, part, segment, loss`` of every turn, sorted within partitions.

    Turns go by number, ties by role and text, null numbers first. Null roles and texts are empty; null
    conversation ids are one conversation. ``state`` is ``bad`` from the first turn out of order on; such
    conversations are formatted all the same. No rows: no segments.
    """
    given = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(template), SEGMENT)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


def _read(template: Template):
    def run(batches):
        pattern = template.pattern()
        key, row, turn = object(), None, ""

        def close():
            conv, n, turns, chars, loss, size, valid = row
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, valid

        def batch_of(out):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in DIGEST.split(", ")])

        for batch in batches:
            out = []
            for conv, _, state, _, segment, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != key:
                    if row:
                        out.append(close())
                    key, row, turn = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True], ""
                turn += segment
                row[5] += len(segment)
                row[6] &= state != "bad"
                if loss:
                    said = unescape(segment)
                    row[3] += len(said)
                    row[4].update(said.encode())
                if segment == template.close:  # the marks alone say where role and text are
                    marks = [m.group() for m in pattern.finditer(turn)]
                    if marks != [template.open, template.middle, template.close]:
                        raise ValueError("a turn's marks are not those of the template")
                    role, text = turn[len(template.open) : -len(template.close)].split(template.middle)
                    row[1] += 1
                    row[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    turn = ""
            if out:
                yield batch_of(out)
        if row:
            yield batch_of([close()])

    return run


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, from the marks and loss flags in its segments (sorted as formatted)."""
    return segments.mapInArrow(_read(template), DIGEST)

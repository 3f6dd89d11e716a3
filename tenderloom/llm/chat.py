"""Chat formatting by a grammar round trip.

A turn is rendered as

    <s>[ROLE] role [/ROLE]\\ntext</s>\\n

and read back by a deterministic parser. The renderer first writes role and text as they are; if the parser does not give
back the same role and text, conflicting content is escaped, a little more each time, until it does:

    1. the control strings get a backslash before them,
    2. every backslash and every "<" and "[" gets one.

In the parser a backslash takes the meaning from the character after it, so the second form is read back identically
whatever the text. Turns are rendered where they are read, without a shuffle. The loss mask of a turn is its text if the
role is `assistant`.

Conversations are put together turn by turn: pieces are dealt by conversation and sorted inside the tasks, and a task reads
them as a stream, so memory does not grow with a conversation. The digest of a whole conversation is sequential by its
definition; all of a conversation passes through one task, but never lies in it.

Null role or text count as empty; a null turn comes first, equal turns are ordered by role and text, repeated rows are
turns of their own, and rows with a null conversation id form one conversation. An empty table has no conversations.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import bounded_batches

CONTROL = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]"]
TRAINED_ROLE = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TOKENS = re.compile(r"\\(.)|(" + "|".join(map(re.escape, CONTROL)) + r")|([^\\<\[]+|.)", re.DOTALL)
_ESCAPES = [
    lambda text: text,
    lambda text: _CONTROL.sub(lambda m: "\\" + m[0], text),
    lambda text: re.sub(r"[\\<\[]", lambda m: "\\" + m[0], text),
]


class Malformed(ValueError):
    pass


def _lexed(rendered: str) -> Iterator[tuple[bool, str]]:
    """(is a control string, text) of a rendered string, unescaped."""
    at = 0
    while at < len(rendered):
        m = _TOKENS.match(rendered, at)
        if m is None:
            raise Malformed("a backslash at the end")
        yield (True, m[2]) if m[2] else (False, m[1] if m[1] is not None else m[3])
        at = m.end()


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation. Grammar: (<s> [ROLE] " " role " " [/ROLE] "\\n" text </s> "\\n")*."""
    turns, state, role, text = [], "start", [], []
    for control, token in _lexed(rendered):
        if state == "start" and token == "\n" and not control and turns:
            state = "between"
        elif state in ("start", "between") and control and token == "<s>" and (state == "between" or not turns):
            state = "open"
        elif state == "between" and not control and token.startswith("\n"):
            raise Malformed("text between turns")
        elif state == "open" and control and token == "[ROLE]":
            state, role = "role", []
        elif state == "role" and not control:
            role.append(token)
        elif state == "role" and control and token == "[/ROLE]":
            state, text = "text", []
        elif state == "text" and not control:
            text.append(token)
        elif state == "text" and control and token == "</s>":
            name, body = "".join(role), "".join(text)
            if len(name) < 2 or name[0] != " " or name[-1] != " " or body[:1] != "\n":
                raise Malformed("no blanks around a role or no line break after it")
            turns.append((name[1:-1], body[1:]))
            state = "start"
        else:
            raise Malformed(f"{token!r} in state {state}")
    if state not in ("start", "between") or (turns and state == "start"):
        raise Malformed("an unfinished turn")
    return turns


def render(role: str, text: str) -> str:
    """One turn in the first form that is read back as it was."""
    for escape in _ESCAPES:
        rendered = f"<s>[ROLE] {escape(role)} [/ROLE]\n{escape(text)}</s>\n"
        try:
            if parse(rendered) == [(role, text)]:
                return rendered
        except Malformed:
            pass
    raise Malformed("no form of the turn is read back")


def rendered_turns(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, turn, role, rendered, trained (whether the text is under the loss mask), one row per turn, unshuffled."""
    bounded_batches(turns.sparkSession)
    kinds = [turns.schema[c].dataType.simpleString() for c in (conv_column, turn_column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([render(r, t) for r, t in zip(roles, texts)], pa.string()),
                 pa.array([r == TRAINED_ROLE for r in roles], pa.bool_())],
                names=["conv_id", "turn", "role", "rendered", "trained"])

    rows = turns.select(F.col(conv_column).alias("conv_id"), F.col(turn_column).alias("turn"),
                        F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, rendered string, trained boolean")


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation what the parser finds in its rendered turns: counts and digests."""
    kind = rendered.schema["conv_id"].dataType.simpleString()
    fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def finish() -> None:
            if state is not None:
                done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != current:
                    finish()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == TRAINED_ROLE:
                        state[2] += len(said)
                        state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield from _rows(done, batch.schema.field(0).type)
            done.clear()
            id_type = batch.schema.field(0).type
        if state is not None:
            finish()
            yield from _rows(done, id_type)

    def _rows(found: list, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if found:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=fields)

    # equal turns are ordered by role and text: the rendered form starts with the role
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "rendered").mapInArrow(run, schema)

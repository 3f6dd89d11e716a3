"""Conversation state over a stream of exchanges."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tenderloom import fixed_values as fixed
from tenderloom.operators.conversation import with_intent
from tenderloom.streaming.state import HELD, in_frames, in_order, use_stored_state

OUTPUT = "conv_id long, turn long, n_history int, summary string, last_org string, has_previous boolean, is_follow_up boolean"
_COLUMNS = ["conv_id", "turn", "n_history", "summary", "last_org", "has_previous", "is_follow_up"]
_READ = ["turn", "query", "answer", "org_name"]


def _summary(history: list) -> str:
    cut = fixed.ANSWER_EXCERPT
    return "\n".join(f"Q: {q}\nA: {a[:cut]}..." for q, a in history[-fixed.SUMMARY_EXCHANGES :])


class Conversation(StatefulProcessor):
    """The last exchanges and the last organisation of every conversation; all else is derived from them."""

    def __init__(self, expires_ms: int | None, held_rows: int):
        self.expires_ms, self.held_rows = expires_ms, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getListState("history", "query string, answer string", self.expires_ms)
        self.last_org = handle.getValueState("last_org", "org_name string", self.expires_ms)
        self.waiting = handle.getMapState("waiting", "turn long, arrival long", "turn long, query string, answer string, org_name string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from in_frames(self._followed(key[0], rows), _COLUMNS)

    def _followed(self, conversation: int, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        history = [tuple(e) for e in self.history.get()]
        last = self.last_org.get()
        last_org = last[0] if last is not None else None
        for turn, query, answer, org in in_order(rows, _READ, self.waiting, self.held_rows):
            known = bool(history)
            follows = known and any(w in query.lower() for w in fixed.FOLLOW_UP_WORDS)
            yield conversation, turn, len(history), _summary(history), last_org, known, follows
            # Only excerpts of the last exchanges are kept, whatever the length of the conversation.
            history = [*history, (query, answer[: fixed.ANSWER_EXCERPT])][-fixed.HISTORY_LENGTH :]
            last_org = org
        self.history.put(history)
        self.last_org.update((last_org,))

    def close(self) -> None:
        pass


def followed(exchanges: DataFrame, expires: timedelta | None = None, held_rows: int = HELD) -> DataFrame:
    """A stream of exchanges (conv_id, turn, query, answer), each with what the conversation knew before it.

    Within a micro-batch exchanges are taken by turn. Null texts are empty, exchanges without a conversation or a turn have
    no place and are left out. With `expires` a conversation that was silent for so long starts anew; such a stream
    may have work in batches without data, so an `availableNow` run ends only with `spark.sql.streaming.noDataMicroBatches.enabled`
    set to false.
    """
    use_stored_state(exchanges.sparkSession)
    rows = exchanges.where("conv_id is not null and turn is not null").fillna("", ["query", "answer"])
    rows = with_intent(rows).selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "query", "answer", "org_name")
    expires_ms = None if expires is None else int(expires.total_seconds() * 1000)
    mode = "None" if expires is None else "ProcessingTime"
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversation(expires_ms, held_rows), OUTPUT, "Append", mode)

"""A bounded cache of question intents over a stream: first in, first out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tenderloom import fixed_values as fixed
from tenderloom.functions.questions import cache_key, intent, signature
from tenderloom.functions.text import nfkc
from tenderloom.streaming.state import HELD, in_frames, in_order, use_stored_state

OUTPUT = "shard int, arrival long, found_by string, query_type string, org_name string"
_COLUMNS = ["shard", "arrival", "found_by", "query_type", "org_name"]
_READ = ["arrival", "exact", "signature", "query_type", "org_name"]


class _FirstInFirstOut:
    """Up to `size` entries of a map state, in memory while a batch is worked on; only changes are written back."""

    def __init__(self, state, size: int):
        self.state, self.size = state, size
        stored = sorted(((v[0], k[0], tuple(v[1:])) for k, v in state.iterator()))
        self.entries = {name: value for _, name, value in stored}
        self.born = {name: n for n, name, _ in stored}
        self.before = dict(self.entries)
        self.next = stored[-1][0] + 1 if stored else 0

    def put(self, name: str, value: tuple) -> None:
        if name not in self.entries:  # an entry that is put again keeps its place in the queue
            self.born[name], self.next = self.next, self.next + 1
        self.entries[name] = value
        while len(self.entries) > self.size:
            oldest = next(iter(self.entries))
            del self.entries[oldest], self.born[oldest]

    def store(self) -> None:
        for name in self.before.keys() - self.entries.keys():
            self.state.removeKey((name,))
        for name, value in self.entries.items():
            if self.before.get(name) != value:
                self.state.updateValue((name,), (self.born[name], *value))


class IntentCache(StatefulProcessor):
    """Two queues for every shard: intents by the exact question and by its signature."""

    def __init__(self, size: int, held_rows: int):
        self.size, self.held_rows = size, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = "born long, query_type string, org_name string"
        self.exact = handle.getMapState("exact", "name string", value)
        self.alike = handle.getMapState("signature", "name string", value)
        self.waiting = handle.getMapState(
            "waiting", "arrival long, n long", "arrival long, exact string, signature string, query_type string, org_name string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from in_frames(self._looked_up(key[0], rows), _COLUMNS)

    def _looked_up(self, shard: int, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        exact, alike = _FirstInFirstOut(self.exact, self.size), _FirstInFirstOut(self.alike, self.size)
        for arrival, name, signed, *own in in_order(rows, _READ, self.waiting, self.held_rows):
            if name and name in exact.entries:
                yield shard, arrival, "exact", *exact.entries[name]
            elif name and signed and signed in alike.entries:
                yield shard, arrival, "signature", *alike.entries[signed]
            else:
                if name:
                    exact.put(name, tuple(own))
                if signed:
                    alike.put(signed, tuple(own))
                yield shard, arrival, None, *own
        exact.store()
        alike.store()

    def close(self) -> None:
        pass


def with_cached_intent(questions: DataFrame, shards: int = 1, size: int = fixed.INTENT_CACHE_SIZE, held_rows: int = HELD) -> DataFrame:
    """A stream of questions (arrival: long, query) with their intents and what found them: exact, signature, or null for none.

    Rows without `found_by` are those that need work: their intents come from the rules, all others from the cache. Each
    of `shards` caches keeps `size` entries of either kind; one shard is the cache of a single application, more of them
    spread the stream. Questions with one signature meet in one shard. Within a micro-batch questions are taken by
    arrival; those without one are left out. Null and empty questions are never cached.
    """
    use_stored_state(questions.sparkSession)
    rows = questions.where("arrival is not null").withColumn("exact", cache_key(nfkc(F.lower(F.coalesce("query", F.lit(""))))))
    rows = rows.withColumn("signature", signature(F.col("exact"))).withColumn("i", intent(F.coalesce("query", F.lit(""))))
    shard = F.pmod(F.xxhash64(F.coalesce(F.nullif("signature", F.lit("")), "exact")), F.lit(shards)).cast("int")
    keyed = rows.select(shard.alias("shard"), F.col("arrival").cast("long"), "exact", "signature", "i.query_type", "i.org_name")
    return keyed.groupBy("shard").transformWithStateInPandas(IntentCache(size, held_rows), OUTPUT, "Append", "None")

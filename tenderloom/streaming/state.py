"""What stateful operators share: the state store they need and rows in order without holding all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import MapState

HELD = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_stored_state(spark: SparkSession) -> None:
    """Lists and maps of state need a store on disk; the setting counts for streams started from now on."""
    if spark.conf.get(_PROVIDER, None) != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


def in_order(batches: Iterator[pd.DataFrame], columns: Sequence[str], waiting: MapState, held_rows: int = HELD) -> Iterator[tuple]:
    """The rows of one key by their first column, equal ones as they came.

    At most `held_rows` rows and one batch are in memory: the others wait in the state store (place, arrival -> row) until
    it is their turn, and only two numbers of each stay.
    """
    keys: list[tuple[int, int]] = []
    held: dict[tuple[int, int], tuple] = {}
    for batch in batches:
        for row in batch[list(columns)].itertuples(index=False, name=None):
            keys.append((int(row[0]), len(keys)))
            held[keys[-1]] = row
        if len(held) > held_rows:
            for key, row in held.items():
                waiting.updateValue(key, row)
            held.clear()
    for key in sorted(keys):
        if key in held:
            yield held.pop(key)
        else:
            yield tuple(waiting.getValue(key))
            waiting.removeKey(key)


def in_frames(rows: Iterator[tuple], columns: Sequence[str], size: int = HELD) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most `size` rows."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pd.DataFrame(part, columns=list(columns))
            part = []
    if part:
        yield pd.DataFrame(part, columns=list(columns))

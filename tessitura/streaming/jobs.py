"""The session fold as Spark jobs: over complete streams, and as a stateful streaming query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessitura.operators.ordered import fold_groups

from .session import COLUMNS, OUTPUT, Limits, State, frames_text, from_json, step, to_json

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(state: State, pushes: pd.DataFrame, limits: Limits, decode: Callable) -> tuple[State, list[tuple]]:
    out = []
    for p in pushes.sort_values("seq", kind="stable").itertuples():
        state, rows = step(state, p.seq, p.samples, p.intervals, p.is_final, p.control, limits, decode)
        out += rows
    return state, out


def fold_sessions(pushes: DataFrame, key: str = "stream_id", limits: Limits | None = None, decode: Callable = frames_text) -> DataFrame:
    """Rows of every stream's events and results; its pushes are read in order, batch by batch, with the state in hand."""
    limits = limits or Limits()
    schema = f"`{key}` {dict(pushes.dtypes)[key]}, {OUTPUT}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def fold(value: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State()
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                state, rows = step(state, p["seq"], p["samples"], p["intervals"], p["is_final"], p["control"], limits, decode)
                out += [(value, *r) for r in rows]
            columns = zip(*out, strict=True) if out else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return fold_groups(pushes.select(key, "seq", "samples", "intervals", "is_final", "control"), key, ["seq"], fold, schema)


class SessionProcessor(StatefulProcessor):
    """Keeps each stream's state between micro-batches; rows of a batch are taken by ``seq``."""

    def __init__(self, key: str, limits: Limits, decode: Callable):
        self.key, self.limits, self.decode = key, limits, decode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = from_json(self.kept.get()[0]) if self.kept.exists() else State()
        state, out = _rows(state, pd.concat(list(rows)), self.limits, self.decode)
        self.kept.update((to_json(state),))
        made = pd.DataFrame(out, columns=COLUMNS)
        made.insert(0, self.key, key[0])
        yield made

    def close(self) -> None:
        pass


def stream_sessions(pushes: DataFrame, key: str = "stream_id", limits: Limits | None = None, decode: Callable = frames_text) -> DataFrame:
    """The same rows from a streaming DataFrame; needs the RocksDB state store (``ROCKSDB``)."""
    return pushes.groupBy(key).transformWithStateInPandas(
        statefulProcessor=SessionProcessor(key, limits or Limits(), decode),
        outputStructType=f"`{key}` {dict(pushes.dtypes)[key]}, {OUTPUT}",
        outputMode="Append",
        timeMode="None",
    )

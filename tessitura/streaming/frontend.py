"""Features of a stream as it arrives: samples that don't fill a window yet, and frames that lack neighbours, are carried.

What is carried is small (less than a window of samples, fewer than ``m`` frames), so a stream of any length is worked on
in bounded memory, over complete streams and in a streaming query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessitura.functions.audio import MELS, SHIFT, WINDOW, log_mel
from tessitura.operators.ordered import fold_groups

from .endpoints import stack_online

OUTPUT = "frame_idx int, vec array<float>"


class OnlineFeatures:
    """Log-mel frames, stacked. All pushes of a stream give the rows that its whole waveform gives."""

    def __init__(self, m: int = 7, n: int = 6):
        self.m, self.n = m, n
        self.rest, self.carried, self.begun, self.made = np.zeros(0, np.float32), [], False, 0

    def push(self, samples: np.ndarray, final: bool = False) -> list[list[float]]:
        self.rest = np.concatenate([self.rest, np.asarray(samples, np.float32)])
        many = max(0, (len(self.rest) - WINDOW) // SHIFT + 1)
        rows = [list(r) for r in log_mel(self.rest[: (many - 1) * SHIFT + WINDOW])] if many else []
        self.rest = self.rest[many * SHIFT :]
        first, self.begun = not self.begun and bool(rows), self.begun or bool(rows)
        if not self.begun:
            return []
        out, self.carried = stack_online(self.carried, rows, self.m, self.n, first, final)
        self.made += len(out)
        return out

    def record(self) -> tuple[bytes, bytes, bool, int]:
        """What is carried, as state keeps it."""
        return self.rest.tobytes(), np.array(self.carried, np.float64).tobytes(), self.begun, self.made

    @classmethod
    def restored(cls, record: tuple, m: int, n: int) -> OnlineFeatures:
        online = cls(m, n)
        rest, carried, online.begun, online.made = record
        online.rest = np.frombuffer(bytes(rest), np.float32)
        online.carried = [list(r) for r in np.frombuffer(bytes(carried), np.float64).reshape(-1, MELS)]
        return online


def stream_features(pushes: DataFrame, key: str, order: str, samples: str, m: int = 7, n: int = 6) -> DataFrame:
    """key, frame_idx, vec of complete streams; each is read push by push in order."""
    key_kind = dict(pushes.dtypes)[key]
    key_type = pa.int64() if key_kind in ("int", "bigint") else pa.string()

    def fold(value: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        online = OnlineFeatures(m, n)

        def rows(made: list[list[float]]) -> pa.RecordBatch:
            first = online.made - len(made)
            return pa.RecordBatch.from_arrays([pa.array([value] * len(made), key_type), pa.array(range(first, online.made), pa.int32()), pa.array(made, pa.list_(pa.float32()))], names=[key, "frame_idx", "vec"])

        for batch in batches:
            for x in batch.column("s").to_pylist():
                yield rows(online.push(np.array([] if x is None else x, np.float32)))
        yield rows(online.push(np.zeros(0, np.float32), True))

    some = pushes.select(F.col(key).cast("bigint" if key_type == pa.int64() else "string").alias(key), F.col(order).alias("o"), F.col(samples).alias("s"))
    return fold_groups(some, key, ["o"], fold, f"`{key}` {'bigint' if key_type == pa.int64() else 'string'}, {OUTPUT}")


class FeatureProcessor(StatefulProcessor):
    """The waveform reserve and the frames that wait for neighbours, as typed state."""

    def __init__(self, key: str, order: str, samples: str, final: str, m: int, n: int):
        self.key, self.order, self.samples, self.final, self.m, self.n = key, order, samples, final, m, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("carried", "rest binary, carried binary, begun boolean, made long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        online = OnlineFeatures.restored(self.kept.get(), self.m, self.n) if self.kept.exists() else OnlineFeatures(self.m, self.n)
        out = []
        for push in pd.concat(list(rows)).sort_values(self.order, kind="stable")[[self.samples, self.final]].itertuples(index=False):
            first, last = online.made, bool(push[1]) if push[1] is not None else False
            made = online.push(np.array([] if push[0] is None else push[0], np.float32), last)
            out += [(key[0], first + k, np.array(row, np.float32)) for k, row in enumerate(made)]
            online = OnlineFeatures(self.m, self.n) if last else online
        if online.begun or len(online.rest):
            self.kept.update(online.record())
        else:
            self.kept.clear()
        yield pd.DataFrame(out, columns=[self.key, "frame_idx", "vec"])

    def close(self) -> None:
        pass


def features_of_stream(pushes: DataFrame, key: str, order: str, samples: str, final: str, m: int = 7, n: int = 6) -> DataFrame:
    """The same rows from a streaming DataFrame; a push whose ``final`` is true ends its stream and frees its state.

    Frames whose right neighbours haven't come are held back across micro-batches. Needs the RocksDB state store.
    """
    return pushes.groupBy(key).transformWithStateInPandas(
        statefulProcessor=FeatureProcessor(key, order, samples, final, m, n),
        outputStructType=f"`{key}` {dict(pushes.dtypes)[key]}, {OUTPUT}",
        outputMode="Append",
        timeMode="None",
    )

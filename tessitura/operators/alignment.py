"""CTC forced alignment: each utterance's frames against its tokens, a Viterbi pass per utterance.

Utterances are independent. Those of at most ``block`` frames are aligned in one piece each. Longer recordings go block by
block: a pass in order keeps one vector of scores and writes it at each block's begin; then all blocks, side by side, make
their back pointers again and say for each state at their end which one they were entered from; these maps are followed
from the last block to the first; and the blocks, side by side again, trace their own frames. No task holds more than a
block of back pointers, and the result is that of one piece, as the same sums are made in the same order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import ordered

#: Frames that are aligned in one piece.
BLOCK = 4096


class Lattice:
    """States blank, t1, blank, t2, ..., blank of an utterance.

    A state is entered from itself, its predecessor, or the one before that when it is another token. Of equal scores
    the state itself wins, then its predecessor; at the end, the last token.
    """

    def __init__(self, targets: list[int], blank: int = 0):
        self.states = np.full(2 * len(targets) + 1, blank)
        self.states[1::2] = targets
        self.jump = np.zeros(len(self.states), dtype=bool)
        self.jump[2:] = self.states[2:] != self.states[:-2]

    def begin(self, scores: np.ndarray) -> np.ndarray:
        """Scores of the states at the first frame."""
        out = np.full(len(self.states), -np.inf)
        out[:2] = scores[self.states[:2]]
        return out

    def step(self, score: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores at the next frame, and how many states back each came from."""
        options = np.full((3, len(self.states)), -np.inf)
        options[0] = score
        options[1, 1:] = score[:-1]
        options[2, 2:] = np.where(self.jump[2:], score[:-2], -np.inf)
        return options.max(axis=0) + frame[self.states], options.argmax(axis=0).astype(np.int8)

    def back(self, score: np.ndarray | None, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores behind a block, and its back pointers; without ``score`` the block is the utterance's first."""
        pointers = np.zeros((len(frames), len(self.states)), dtype=np.int8)
        for t, frame in enumerate(frames):
            if score is None:
                score = self.begin(frame)
            else:
                score, pointers[t] = self.step(score, frame)
        return score, pointers

    def last(self, score: np.ndarray) -> int:
        """The state that the best path ends in."""
        end = len(self.states) - 1
        return end - 1 if end and score[end - 1] >= score[end] else end


def align(log_probs: np.ndarray, targets: list[int], blank: int = 0) -> np.ndarray:
    """The token (or blank) that the best path has in each frame."""
    lattice = Lattice(targets, blank)
    score, pointers = lattice.back(None, log_probs)
    return lattice.states[_trace(pointers, lattice.last(score))]


def _trace(pointers: np.ndarray, at: int) -> np.ndarray:
    path = np.zeros(len(pointers), dtype=int)
    for t in range(len(pointers) - 1, -1, -1):
        path[t] = at
        at -= pointers[t, at]
    return path


def forced_align(frames: DataFrame, targets: DataFrame, key: str, order: str, scores: str, blank: int = 0, block: int = BLOCK) -> DataFrame:
    """key, order, token: ``frames`` has a score array per frame, ``targets`` an array ``tokens`` per key.

    Utterances without frames give no rows; without tokens, blanks. ``order`` tells a key's frames apart.
    """
    sizes = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    long_keys = sizes.where(F.col("_n") > block).select(key)
    if long_keys.isEmpty():
        return align_whole(frames, targets, key, order, scores, blank)
    short = align_whole(frames.join(long_keys, key, "left_anti"), targets, key, order, scores, blank)
    return short.unionByName(align_blocks(frames.join(long_keys, key), targets, key, order, scores, blank, block))


def align_blocks(frames: DataFrame, targets: DataFrame, key: str, order: str, scores: str, blank: int = 0, block: int = BLOCK) -> DataFrame:
    """``forced_align`` in blocks of ``block`` frames. ``order`` is a number; keys aren't null."""
    kinds = dict(frames.dtypes)
    key_type, order_type = (to_arrow_type(frames.schema[c].dataType) for c in (key, order))
    placed = ordered.number(frames.select(key, order, F.col(scores).cast("array<double>").alias("_s")), key, order, "_at")
    known = placed.select(key).distinct().join(targets.select(key, F.col("tokens").cast("array<int>").alias("tokens")), key, "left")
    # a block's head holds what its frames need: a key's tokens come before all of its frames
    rows = placed.select(key, F.col("_at").alias("_t"), F.col(order).alias("_o"), "_s", F.lit(None).cast("array<int>").alias("tokens"))
    heads = known.select(key, F.lit(-1).cast("long").alias("_t"), F.lit(None).cast(kinds[order]).alias("_o"), F.lit(None).cast("array<double>").alias("_s"), "tokens")

    def forward(value: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The scores before each block; block -1 is the best path's last state."""
        lattice, score, at = None, None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["_t"] < 0:
                    lattice = Lattice(row["tokens"] or [], blank)
                    continue
                if at % block == 0:
                    out.append((at // block, score))
                score = lattice.begin(np.array(row["_s"])) if score is None else lattice.step(score, np.array(row["_s"]))[0]
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array([value] * len(out), key_type), pa.array([b for b, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.float64()))], names=[key, "block", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([value], key_type), pa.array([-1], pa.int64()), pa.array([[float(lattice.last(score))]], pa.list_(pa.float64()))], names=[key, "block", "score"])

    passed = ordered.fold_groups(rows.unionByName(heads), key, ["_t"], forward, f"`{key}` {kinds[key]}, block long, score array<double>")
    # one row a block and key: its scores and tokens
    checkpoints = passed.join(known, key)
    blocks = rows.select(key, F.floor(F.col("_t") / block).alias("block"), "_t", "_o", "_s", F.lit(None).cast("array<double>").alias("score"), "tokens", F.lit(None).cast("int").alias("exit"))
    as_heads = lambda df, state: df.select(key, "block", F.lit(-1).cast("long").alias("_t"), F.lit(None).cast(kinds[order]).alias("_o"), F.lit(None).cast("array<double>").alias("_s"), "score", "tokens", state.alias("exit"))

    def lattice_of(table: pa.Table) -> tuple[dict, Lattice, np.ndarray, pa.Table]:
        table = table.sort_by("_t")
        head = table.slice(0, 1).to_pylist()[0]
        own = table.slice(1)
        return head, Lattice(head["tokens"] or [], blank), np.array(own.column("_s").to_pylist()), own

    def entries(table: pa.Table) -> pa.Table:
        """From which state of the block before each state at this one's end was reached."""
        head, lattice, own, _ = lattice_of(table)
        _, pointers = lattice.back(None if head["block"] == 0 else np.array(head["score"]), own)
        at = np.arange(len(lattice.states))
        for t in range(len(pointers) - 1, -1, -1):
            at = at - pointers[t, at]
        return pa.table({key: table.column(key).slice(0, 1), "block": pa.array([head["block"]], pa.int64()), "entry": pa.array([at.tolist()], pa.list_(pa.int32()))})

    real = checkpoints.where("block >= 0")
    maps = blocks.unionByName(as_heads(real, F.lit(None).cast("int"))).groupBy(key, "block").applyInArrow(entries, f"`{key}` {kinds[key]}, block long, entry array<int>")
    ends = passed.where("block < 0").select(key, F.lit(1 << 40).alias("block"), F.array(F.col("score")[0].cast("int")).alias("entry"))

    def follow(value: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From the last block to the first: the state at each one's end."""
        state = None
        for batch in batches:
            numbers, exits = [], []
            for number, entry in zip(batch.column("block").to_pylist(), batch.column("entry").to_pylist(), strict=True):
                if state is None:
                    state = entry[0]
                    continue
                numbers.append(number)
                exits.append(state)
                state = entry[state]
            yield pa.RecordBatch.from_arrays([pa.array([value] * len(numbers), key_type), pa.array(numbers, pa.int64()), pa.array(exits, pa.int32())], names=[key, "block", "exit"])

    chained = maps.unionByName(ends).withColumn("_down", -F.col("block"))
    exits = ordered.fold_groups(chained.select(key, "block", "entry", "_down"), key, ["_down"], follow, f"`{key}` {kinds[key]}, block long, exit int")

    def traced(table: pa.Table) -> pa.Table:
        head, lattice, own, rows = lattice_of(table)
        _, pointers = lattice.back(None if head["block"] == 0 else np.array(head["score"]), own)
        path = lattice.states[_trace(pointers, head["exit"])]
        return pa.table({key: rows.column(key), "frame": rows.column("_o").cast(order_type), "token": pa.array(path, pa.int32())})

    finished = as_heads(real.join(exits, [key, "block"]), F.col("exit"))
    return blocks.unionByName(finished).groupBy(key, "block").applyInArrow(traced, f"`{key}` {kinds[key]}, frame {kinds[order]}, token int")


def align_whole(frames: DataFrame, targets: DataFrame, key: str, order: str, scores: str, blank: int = 0) -> DataFrame:
    """``forced_align`` of utterances that fit in a row each."""
    gathered = frames.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(scores).cast("array<double>").alias("s")))).alias("f"))
    joined = gathered.join(targets.select(key, "tokens"), key, "left")

    def run(batches):
        for part in batches:
            rows = []
            for k, f, tokens in zip(part[key], part["f"], part["tokens"], strict=True):
                got = align(np.array([x["s"] for x in f]), [] if tokens is None else list(tokens), blank)
                rows.append(pd.DataFrame({key: k, "frame": [x["o"] for x in f], "token": got}))
            if rows:
                yield pd.concat(rows)

    kind = dict(frames.dtypes)
    return joined.mapInPandas(run, f"`{key}` {kind[key]}, frame {kind[order]}, token int")


#: Models of this worker, by the place that they were loaded from.
_LOADED: dict[str, object] = {}


def loaded(path: str, load: Callable[[str], object]) -> object:
    """The model of a path, loaded once a worker however many tasks it runs."""
    if path not in _LOADED:
        _LOADED.clear()  # a worker keeps one model
        _LOADED[path] = load(path)
    return _LOADED[path]


def file_scores(frames: DataFrame, path: str, load: Callable[[str], Callable[[np.ndarray], np.ndarray]], vector: str, name: str = "scores", size: int = 512) -> DataFrame:
    """``model_scores`` by a model that each worker loads from a shared file; ``size`` rows at once, across Arrow batches.

    The file's path and ``load`` go to the tasks, not the model. Null vectors get null.
    """
    schema = frames.withColumn(name, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def give() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(waiting).combine_chunks()
            x = table.column(vector)
            there = x.is_valid().to_numpy(zero_copy_only=False)
            got = loaded(path, load)(np.array(x.drop_null().to_pylist(), dtype=np.float32)) if there.any() else []
            found = iter(np.asarray(got, dtype=np.float32))
            made = pa.array([next(found) if ok else None for ok in there], pa.list_(pa.float32()))
            yield from table.append_column(name, made).to_batches()

        for batch in batches:
            for k in range(0, batch.num_rows, size):
                waiting.append(batch.slice(k, size))
                if sum(map(len, waiting)) >= size:
                    yield from give()
                    waiting = []
        if waiting:
            yield from give()

    return frames.mapInArrow(run, schema)


def model_scores(frames: DataFrame, model: Callable[[np.ndarray], np.ndarray], vector: str, name: str = "scores") -> DataFrame:
    """A model as a black box: a function from a matrix of frames to a matrix of scores, over Arrow batches."""

    @F.pandas_udf("array<float>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(model(np.array(x.tolist(), dtype=np.float32)), dtype=np.float32))) if len(x) else pd.Series([], dtype=object)

    return frames.withColumn(name, apply(vector))

"""Groups of a punctuated stream, kept open over micro-batches.

Rows of a key wait in its state until the watermark has passed them, so that
rows which come late, or in another order, are counted in their place; then
they are applied in order, and a group that a marker ends is sent on. Open
groups and waiting rows live in the state store: a query that starts again from
its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that such queries need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Waiting rows that are sorted together into a run, and rows of a run that lie together in one entry of the state.
RUN, PAGE = 1 << 16, 1 << 10
#: The tag of a value.
NONE = -(1 << 62)


class OpenGroups(StatefulProcessor):
    """Per key: the groups that are open at each of `levels`, and the rows that wait. A marker of level k ends those of the levels 0 to k.

    Waiting rows lie in the state as sorted runs, cut into pages; when they are
    due, the runs are merged. A task holds a run, or a page of each run of a
    key, never all rows that wait.
    """

    def __init__(self, levels: int):
        self.levels = levels

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "g array<bigint>, n array<bigint>, total array<bigint>")
        # of each run its number, its first page that is left, how many there are, how many rows of that page are done, and the time of the next row
        self.runs = handle.getValueState("runs", "run array<bigint>, page array<bigint>, pages array<bigint>, done array<bigint>, ms array<bigint>")
        self.pages = handle.getMapState("pages", "run bigint, page bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, held, size, first = self._directory(), [], 0, None
        for pdf in rows:
            held.append(self._rows(pdf))
            size += len(pdf)
            if size >= RUN:
                runs.append(self._sorted(runs, held))
                held, size = [], 0
                first = runs[-1][4] if first is None else min(first, runs[-1][4])
        if size:
            runs.append(self._sorted(runs, held))
            first = runs[-1][4] if first is None else min(first, runs[-1][4])
        if first is not None:
            self._keep(runs)
            self.handle.registerTimer(first)
        yield from ()

    def _directory(self) -> list[list[int]]:
        return [list(map(int, x)) for x in zip(*self.runs.get(), strict=True)] if self.runs.exists() else []

    def _keep(self, runs: list[list[int]]) -> None:
        if runs:
            self.runs.update(tuple(list(x) for x in zip(*runs, strict=True)))
        else:
            self.runs.clear()

    @staticmethod
    def _rows(pdf: pd.DataFrame) -> np.ndarray:
        """Rows ms, seq, tag and value."""
        whole = lambda c, null: c.where(c.notna(), null).astype("int64")
        return np.stack([whole(pdf.ms, 0), whole(pdf.seq, 0), whole(pdf.tag, NONE), whole(pdf.value, 0)])

    def _sorted(self, runs: list[list[int]], held: list[np.ndarray]) -> list[int]:
        """Stores rows as a run after the others; its entry of the directory."""
        x = np.concatenate(held, axis=1)
        x = x[:, np.lexsort((x[1], x[0]))]
        run, pages = runs[-1][0] + 1 if runs else 0, -(-x.shape[1] // PAGE)
        for p in range(pages):
            self.pages.updateValue((run, p), (x[:, p * PAGE : (p + 1) * PAGE].tobytes(),))
        return [run, 0, pages, 0, int(x[0, 0])]

    def _due(self, runs: list[list[int]], upto: int) -> Iterator[np.ndarray]:
        """The rows up to a time, in order and in pieces; takes them out of the runs."""
        pages = {}
        while active := [r for r in runs if r[1] < r[2] and r[4] <= upto]:
            for r in active:
                if r[0] not in pages:
                    pages[r[0]] = np.frombuffer(self.pages.getValue((r[0], r[1]))[0], np.int64).reshape(4, -1)
            # what follows the pages at hand is not before the least of their last rows
            last = min([(upto, np.iinfo(np.int64).max), *(tuple(pages[r[0]][:2, -1].tolist()) for r in active if r[1] + 1 < r[2])])
            piece = []
            for r in active:
                x = pages[r[0]][:, r[3] :]
                n = int(((x[0] < last[0]) | (x[0] == last[0]) & (x[1] <= last[1])).sum())
                piece.append(x[:, :n])
                if n < x.shape[1]:
                    r[3], r[4] = r[3] + n, int(x[0, n])
                else:  # the next page begins at its last row's time, or later
                    self.pages.removeKey((r[0], r[1]))
                    r[1], r[3], r[4] = r[1] + 1, 0, int(x[0, -1])
                    del pages[r[0]]
            x = np.concatenate(piece, axis=1)
            yield x[:, np.lexsort((x[1], x[0]))]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        runs = self._directory()
        if not any(r[4] <= upto for r in runs):
            return
        g, n, total = (list(x) for x in self.open.get()) if self.open.exists() else ([0] * self.levels for _ in range(3))
        for _, _, tag, value in self._due(runs, upto):
            own = tag == NONE
            count, sums = np.cumsum(own), np.cumsum(np.where(own, value, 0))
            out = []
            for k in range(self.levels):
                at = np.flatnonzero(~own & (tag >= k))
                if len(at):
                    out.append(pd.DataFrame({"key": key[0], "level": k, "g": g[k] + np.arange(len(at)), "n": np.diff(count[at], prepend=-n[k]), "total": np.diff(sums[at], prepend=-total[k])}))
                    g[k], n[k], total[k] = g[k] + len(at), -int(count[at[-1]]), -int(sums[at[-1]])
                if len(tag):
                    n[k], total[k] = n[k] + int(count[-1]), total[k] + int(sums[-1])
            if out:
                yield pd.concat(out)
        self.open.update((g, n, total))
        runs = [r for r in runs if r[1] < r[2]]
        self._keep(runs)
        if runs:
            self.handle.registerTimer(max(upto + 1, min(r[4] for r in runs)))


def ended(stream: DataFrame, levels: int, late: str) -> DataFrame:
    """(key, level, g, n, total): each group that has ended, its number from 0, its values and their sum.

    stream has key (long), seq, ts (a timestamp that grows with seq), tag (null
    for a value, else a marker's level) and value. Rows that come more than
    `late` behind the latest are not counted; a group stays open until the
    watermark has passed its marker.
    """
    rows = stream.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"), "seq", "tag", "value")
    return rows.groupBy("key").transformWithStateInPandas(OpenGroups(levels), "key bigint, level int, g bigint, n bigint, total bigint", "append", "eventTime")


def run(result: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs what the source has now through a query that goes on from its checkpoint, and returns all it has written."""
    spark = result.sparkSession
    old = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(result.schema).parquet(out)

"""Folds of streams in event time: typed state, timers, and a buffer that puts late rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from opstables.operators.runs import Step

#: Rows of a key in an Arrow batch from which on they are buffered by slots of time, so that a slot is read at a time.
MANY_ROWS = 1000
#: Seconds of event time a slot.
SLOT_SECONDS = 600
_WIDTH = SLOT_SECONDS * 1_000_000
#: Types whose columns are given to Spark as Arrow arrays, which it takes as they are.
_PLAIN = (LongType, IntegerType, DoubleType, BooleanType, StringType)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _values(column: pd.Series, kind: DataType) -> list:
    """A column's values as the state takes them: pandas has turned numbers with nulls into floats."""
    if column.dtype.kind in "iub":
        return column.tolist()
    as_kind = {LongType: int, BooleanType: bool, StringType: str}.get(type(kind), lambda x: x)
    return [None if x is None or x != x else as_kind(x) for x in column.tolist()]


def _rows(frame: pd.DataFrame, kinds: dict[str, DataType]) -> list[tuple]:
    return list(zip(*(_values(frame[c], kind) for c, kind in kinds.items()), strict=True))


def _column(values: tuple, kind: pa.DataType | None) -> pd.api.extensions.ExtensionArray | list:
    return list(values) if kind is None else pd.arrays.ArrowExtensionArray(pa.array(values, kind))


def _order(row: tuple) -> tuple:
    """By time, then fields; nulls first."""
    return tuple((x is not None, x) for x in row)


def _sort(rows: list[tuple]) -> list[tuple]:
    try:
        rows.sort()
    except TypeError:  # a null was compared
        rows.sort(key=_order)
    return rows


class OrderedFold(StatefulProcessor):
    """Buffers each key's rows until the watermark has passed them, then folds them by time and fields, whatever order they came in.

    A call of the state is a message to the JVM and back, so a key has one value, read and written once a call: the typed state,
    its timer, and the rows that wait (an Arrow batch) while they are few.  Many go to a map from (slot of time, part) to Arrow
    batches: a batch of the stream adds parts and rewrites none, and a slot is read when it is due.  One timer wakes the key for
    the first row, or the state's own moment, whichever comes first.
    """

    def __init__(self, kinds: dict[str, DataType], given: StructType, step: Step, start: Any, state: str, due: Callable, expired: Callable) -> None:
        self.kinds, self.names, self.step, self.start, self.due, self.expired = kinds, given.names, step, start, due, expired
        self.types = [to_arrow_type(f.dataType) if isinstance(f.dataType, _PLAIN) else None for f in given]
        self.packed = pa.schema([(c, to_arrow_type(kind)) for c, kind in kinds.items()])
        self.state = StructType.fromDDL(state)
        self.single = len(self.state) == 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("held", f"state {self.state.simpleString()}, parts long, wake long, rows binary")
        self.buffer = handle.getMapState("buffer", "slot long, part long", "rows binary")

    def close(self) -> None:
        pass

    def _pack(self, rows: list[tuple]) -> bytes:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.packed, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=self.packed).serialize().to_pybytes()

    def _unpack(self, rows: bytes) -> list[tuple]:
        return list(zip(*(c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(rows), self.packed).columns), strict=True))

    def _load(self) -> tuple[Any, int, int | None, list[tuple]]:
        """The state, the parts in the buffer (0: it is empty), the timer, and the few rows that wait."""
        held = self.value.get()
        if held is None:
            return self.start, 0, None, []
        now, parts, wake, rows = held
        if now is None:
            now = self.start
        else:
            now = now[0] if self.single else list(now)
            now = list(now) if isinstance(now, tuple) else now
        return now, parts, wake, [] if rows is None else self._unpack(rows)

    def _put(self, rows: list[tuple], parts: int) -> None:
        """Rows into the slots of their times."""
        slots: dict[int, list[tuple]] = {}
        for row in rows:
            slots.setdefault(row[0] // _WIDTH, []).append(row)
        for slot, some in slots.items():
            self.buffer.updateValue((slot, parts), (self._pack(some),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, parts, wake, loose = self._load()
        for frame in rows:
            loose += _rows(frame, self.kinds)
            if len(loose) >= MANY_ROWS:
                parts += 1
                self._put(loose, parts)
                loose = []
        yield from self._release(key, timerValues, now, parts, wake, loose)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, parts, _, loose = self._load()
        yield from self._release(key, timerValues, now, parts, None, loose)

    def _take(self, keys: list[tuple[int, int]]) -> list[tuple]:
        out: list[tuple] = []
        for k in keys:
            out += self._unpack(self.buffer.getValue(k)[0])
            self.buffer.removeKey(k)
        return out

    def _release(self, key: Any, timers: Any, now: Any, parts: int, wake: int | None, loose: list[tuple]) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs()
        slots: dict[int, list[tuple[int, int]]] = {}
        for k in list(self.buffer.keys()) if parts else ():
            slots.setdefault(k[0], []).append(tuple(k))
        _sort(loose)
        first: int | None = None  # the first row that has to wait
        for slot in sorted(slots):
            if slot * _WIDTH // 1000 > mark:
                first = slot * _WIDTH
                break
            before = sum(r[0] < (slot + 1) * _WIDTH for r in loose)
            rows, loose = _sort(self._take(slots.pop(slot)) + loose[:before]), loose[before:]
            ready = sum(r[0] // 1000 <= mark for r in rows)
            now, out = self._fold(now, rows[:ready])
            if out:
                yield self._frame(key, out)
            loose = rows[ready:] + loose
        ready = sum(r[0] // 1000 <= mark for r in loose)
        now, out = self._fold(now, loose[:ready])
        # what the watermark has passed without a further row
        while now is not None and (moment := self.due(now)) is not None and int(moment * 1000) < mark:
            now, rows = self.expired(now)
            out += rows
        if out:
            yield self._frame(key, out)
        loose = loose[ready:]
        if loose:
            first = min(loose[0][0], first) if first is not None else loose[0][0]
        if not slots:
            parts = 0
        if len(loose) >= MANY_ROWS:
            parts += 1
            self._put(loose, parts)
            loose = []
        self._save(now, parts, wake, first, mark, loose)

    def _fold(self, now: Any, rows: list[tuple]) -> tuple[Any, list[tuple]]:
        out: list[tuple] = []
        for us, *fields in rows:
            t = us / 1e6
            while now is not None and (moment := self.due(now)) is not None and t > moment:  # what was due before comes first
                now, more = self.expired(now)
                out += more
            now, more = self.step(self.start if now is None else now, t, *fields)
            out += more
        return now, out

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        columns = [(key[0],) * len(rows), *zip(*rows, strict=True)]
        return pd.DataFrame({n: _column(c, t) for n, c, t in zip(self.names, columns, self.types, strict=True)}, copy=False)

    def _save(self, now: Any, parts: int, wake: int | None, first: int | None, mark: int, loose: list[tuple]) -> None:
        moment = None if now is None else self.due(now)
        # a timer is due when the watermark is above it
        times = [first // 1000 - 1] if first is not None else []
        times += [int(moment * 1000)] if moment is not None else []
        new = max(min(times), mark) if times else None
        if wake is not None and wake != new:
            self.handle.deleteTimer(wake)
        if new is not None and wake != new:
            self.handle.registerTimer(new)
        if now is None and first is None:
            self.value.clear()
            return
        held = None if now is None else (now,) if self.single else tuple(now)
        self.value.update((held, parts, new, self._pack(loose) if loose else None))


def fold(
    sdf: DataFrame, key: str, time: str, fields: list[str], step: Step, start: Any, state: str, schema: str, *,
    due: Callable[[Any], float | None], expired: Callable[[Any], tuple[Any, list[tuple]]] = lambda s: (None, []), delay: str | None = "0 seconds",
) -> DataFrame:
    """The key and the rows of schema that `step(state, time, *fields) -> (state, rows)` gives over each key's events, in the order of time and fields.

    Events wait until the watermark (the latest time less delay) has passed them, so rows that come in any order within the
    delay give what they give in order; later ones are dropped.  The watermark counts milliseconds: an event of its own
    millisecond that comes a batch late is folded when it comes.  state: names and types of what start and step hold (one name: the value
    itself).  due(state) is the moment, in seconds of event time, at which expired(state) gives more rows and the state after (None drops
    it).  delay None: sdf comes from a stateful operator, and time has that one's watermark.  State is kept by RocksDB, for which the session is set.
    """
    sdf.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    rows = (sdf if delay is None else sdf.withWatermark(time, delay)).select(key, time, F.unix_micros(time).alias("us"), *fields)
    given = StructType([sdf.schema[key], *StructType.fromDDL(schema).fields])
    kinds: dict[str, DataType] = {"us": LongType(), **{c: sdf.schema[c].dataType for c in fields}}
    processor = OrderedFold(kinds, given, step, start, state, due, expired)
    return rows.groupBy(key).transformWithStateInPandas(processor, given, "append", "eventTime")

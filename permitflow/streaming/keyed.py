"""The state log as keyed state: a batch meets the record that the state store holds under its key, and no older batch is
read.

Records are matched by key, else by an old id of the same source, so there are two stateful steps. The first is keyed by
record: it settles what it has on file itself, and what has no old id. Whatever else goes on to the second step, keyed by
source and old id, which holds the records logged under that id; the first remembers under which, so that the record finds
itself there again. Settled records pass through the second step too, which files them under their old id.

Both steps give the records that are new or changed; these are written as in :mod:`permitflow.streaming.incremental`, to a
folder per batch that a replay overwrites. A checkpoint holds both stores, so a restart goes on where it stopped. An earlier
log, such as migrated old ids, is loaded into both stores when the stream starts for the first time.

It differs from the batch form in one case: a record that was never logged because its old id was known, and that comes
again with another old id, is matched by the first of them only.

Defined edge cases: rows without a key are left out; a micro-batch may hold a key's rows in any order and number, since they
are merged one by one; a null source and a null old id are like a value of their own and like no old id.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from permitflow.operators import state

FOUND = "key string, source string, source_id string, licence_id string, legacy_id string, stage string, first_seen date, legacy_ids array<string>, settled boolean, at_source string, at_id string"
LINES = "key string, source string, source_id string, licence_id string, legacy_ids array<string>, first_seen date, stage string"
_Found = Row(*(c.split()[0] for c in FOUND.split(", ")))
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _verdict(before: str | None, now: str) -> str:
    """Kind of a record that is on file with stage ``before``."""
    return "update" if before == "pending" and now == "licensed" else "known"


def _place(v: object) -> tuple:
    """What orders values as Spark does: nulls first, a struct by its fields."""
    return tuple(map(_place, v.values())) if isinstance(v, dict) else (v is not None, v)


class ByRecord(StatefulProcessor):
    """State of a key: the stage, first day and old ids that it was logged with, or the old id that it was referred to."""

    def __init__(self, today: dt.date) -> None:
        self.today = today

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "stage string, first_seen date, legacy_ids array<string>, referred string")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N802, N803
        self.record.update((initialState.stage, initialState.first_seen, list(initialState.legacy_ids), None))

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        first = licence = place = None
        stage = "pending"
        for r in rows:  # merged like requests are: the first in order that says something
            at = _place(r.ord)
            if first is None or at < place:
                first, place = r, at
            if r.licence_id and (licence is None or at < licence[0]):
                licence = (at, r.licence_id)
            stage = "licensed" if r.stage == "licensed" else stage
        licence_id = licence[1] if licence else None
        legacy = licence_id if first.source == state.API else first.source_id
        old = self.record.get() if self.record.exists() else None
        on_file = old is not None and old[0] is not None
        referred = old[3] if old else None
        if on_file:
            if _verdict(old[0], stage) == "known":
                return
        elif legacy is not None or referred is not None:
            referred = referred or legacy
            self.record.update((None, None, [], referred))
            yield _Found(key[0], first.source, first.source_id, licence_id, legacy, stage, self.today, [], False, first.source, referred)
            return
        since = old[1] if on_file else self.today
        ids = sorted({*(old[2] if on_file else ()), *([legacy] if legacy is not None else ())})
        self.record.update((stage, since, ids, None))
        yield _Found(key[0], first.source, first.source_id, licence_id, legacy, stage, since, ids, True, first.source, legacy if legacy is not None else key[0])

    def close(self) -> None:
        pass


class ByOldId(StatefulProcessor):
    """State of a source's old id: the records that were logged with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.logged = handle.getMapState("logged", "key string", "stage string, first_seen date, legacy_ids array<string>")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N802, N803
        self.logged.updateValue((initialState.key,), (initialState.stage, initialState.first_seen, list(initialState.legacy_ids)))

    def _earliest(self) -> tuple | None:
        """The stage of the record first seen, one without a day before all others."""
        best = None
        for _, (stage, day, _ids) in self.logged.iterator():
            rank = (day is not None, day or dt.date.min, stage is not None, stage or "")
            if best is None or rank < best[0]:
                best = (rank, stage)
        return best

    def handleInputRows(self, key: tuple, rows: Iterable[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        before = None
        open_rows = []
        for r in rows:
            if r.settled:
                if r.legacy_id is not None:
                    self.logged.updateValue((r.key,), (r.stage, r.first_seen, r.legacy_ids))
                yield r
            else:
                open_rows.append(r)  # a row per record of one old id
        if not open_rows:
            return
        # All are matched with what was on file before this batch, as in the batch form.
        settled = {r.key for r in open_rows if self.logged.containsKey((r.key,))}
        before = self._earliest()
        for r in open_rows:
            since, ids = r.first_seen, set()
            if r.key in settled:
                stage, since, ids = self.logged.getValue((r.key,))
                if _verdict(stage, r.stage) == "known":
                    continue
            elif before is not None and _verdict(before[1], r.stage) == "known":
                continue
            ids = sorted({*ids, *([r.legacy_id] if r.legacy_id is not None else ())})
            self.logged.updateValue((r.key,), (r.stage, since, ids))
            yield _Found(r.key, r.source, r.source_id, r.licence_id, r.legacy_id, r.stage, since, ids, True, r.at_source, r.at_id)

    def close(self) -> None:
        pass


def changes(lines: DataFrame, today: str, log: DataFrame | None = None) -> DataFrame:
    """State lines of the records of a stream of line rows that are new or changed. ``log``: state lines from before."""
    day = dt.date.fromisoformat(today)
    rows = lines.filter("key is not null").select("key", "source", "source_id", "licence_id", "stage", "ord")
    by_key = by_id = None
    if log is not None:
        old = state.fold(log).select("key", "source", F.coalesce("stage", F.lit("licensed")).alias("stage"), "first_seen", "legacy_ids")
        by_key = old.select("key", "stage", "first_seen", "legacy_ids").groupBy("key")
        by_id = old.select(F.col("source").alias("at_source"), F.explode("legacy_ids").alias("at_id"), "key", "stage", "first_seen", "legacy_ids").groupBy("at_source", "at_id")
    found = rows.groupBy("key").transformWithState(ByRecord(day), FOUND, "Append", "None", by_key)
    return found.groupBy("at_source", "at_id").transformWithState(ByOldId(), FOUND, "Append", "None", by_id).select("key", "source", "source_id", "licence_id", "legacy_ids", "first_seen", "stage")


def start(lines: DataFrame, path: str, checkpoint: str, today: str, log: DataFrame | None = None) -> StreamingQuery:
    """Runs over what is there and stops; state lines go to ``path``, a folder per batch."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes(lines, today, log).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

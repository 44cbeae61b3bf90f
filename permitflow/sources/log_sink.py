"""State lines published whole, under an ordinal that no other run can take.

Tasks of a write stage their lines in a folder of the write's own, which readers pass over. The commit gathers the files of
the tasks that count, and publishes them by renaming their folder to ``run=<n>``, one more than the largest there. A rename
onto a folder that holds files fails, so of two runs that commit at once the later tries the next number. A write that is
killed leaves staged files only, and no line.

The path is one that driver and executors share as a file system (``/...`` or ``file:...``), where a rename is one step; other
stores are refused. A write without lines publishes nothing.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging"
RUN = re.compile(r"run=(\d+)")


def local_path(path: str) -> str:
    """The path in the shared file system; an error for another store."""
    if path.startswith("file:"):
        return re.sub(r"^file:/*", "/", path)
    if "://" in path:
        raise ValueError(f"{path} is not in a file system where a rename is one step")
    return path


def largest_run(path: str) -> int:
    """The largest ordinal published; 0 without any."""
    names = os.listdir(path) if os.path.isdir(path) else []
    return max((int(m[1]) for n in names if (m := RUN.fullmatch(n))), default=0)


@dataclass
class Staged(WriterCommitMessage):
    """A task's file, or None if it had no rows."""

    file: str | None


class StateLog(DataSource):
    """Option path. Rows: ``value``, a state line as JSON text."""

    @classmethod
    def name(cls) -> str:
        return "state_log"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> StateLogWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("the state log is only appended to")
        return StateLogWriter(local_path(self.options["path"]), int(self.options.get("after", 0)))


class StateLogWriter(DataSourceWriter):
    def __init__(self, path: str, after: int) -> None:
        self.path, self.after = path, after
        self.staging = f"{path}/{STAGING}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.json"
        at = None
        for row in iterator:
            if at is None:
                os.makedirs(self.staging, exist_ok=True)
                at = open(f"{self.staging}/{name}", "w", encoding="utf-8")  # noqa: SIM115
            at.write(row[0] + "\n")
        if at is None:
            return Staged(None)
        at.flush()
        os.fsync(at.fileno())
        at.close()
        return Staged(name)

    def commit(self, messages: list) -> None:
        files = [m.file for m in messages if m and m.file]
        if files:
            whole = f"{self.staging}/whole"
            os.makedirs(whole)
            for f in files:  # not those of attempts that failed or were overtaken
                os.rename(f"{self.staging}/{f}", f"{whole}/{f}")
            n = max(largest_run(self.path), self.after)
            while True:
                n += 1
                try:
                    os.rename(whole, f"{self.path}/run={n}")
                    break
                except OSError:
                    if not os.path.isdir(f"{self.path}/run={n}"):
                        raise
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def publish(lines: DataFrame, path: str, after: int = 0) -> None:
    """Appends state lines, nulls left in, under the next ordinal, which is larger than ``after``."""
    lines.sparkSession.dataSource.register(StateLog)
    rows = lines.select(F.to_json(F.struct(*lines.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.format("state_log").option("after", after).mode("append").save(path)

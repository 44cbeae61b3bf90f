"""Delta-maintained token counts: signed changes, additive totals, idempotent batch commits.

A store is a folder in shared storage. Each batch of changes is turned into signed ledger rows: an insert is +1 row, a
delete is a -1 row for the live count, a revised count is both. The rows of a batch are also summed into a delta of the
totals by (source, lang, version). A batch is written beside the store and becomes part of it by one rename to the next
number; whoever finds the number taken reads the store anew and tries the one after, so no two batches rest on the same
state. A batch whose name is in the store is skipped, so a replay after a lost driver or executor changes nothing.
Totals are sums of the deltas and never need a recount. :meth:`TokenRollup.compact` writes the state as one batch, from
which later readers start.

Within a batch the last change of a (doc_id, version) by ``seq`` wins, ties by the larger count, then source and lang.
Defined edge cases: a null doc_id is no key and its row is an insert that cannot be revised; rows that repeat a doc_id
are changes of one document; null source or lang are groups of their own; a null text has no tokens and a text of any
length is encoded whole; a delete of what isn't there changes nothing; an empty batch commits and changes nothing; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitflow.llm.common import cut, drop
from permitflow.llm.packing import encoder

LEDGER = "doc_id long, source string, lang string, version string, n_tokens long, sign long"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"
KEYS = ["source", "lang", "version"]
_COLUMNS = ["doc_id", *KEYS, "n_tokens"]
#: Prefix of the empty files that number and name the batches of a folder, and the one that marks a folder as a whole state. Spark
#: does not read files that begin with an underscore.
_NAME, _BASE = "_batch-", "_base"


class TokenRollup:
    """One store. ``path`` is any folder that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._dir = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._dir(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marks(self, pattern: str) -> list[tuple[str, str]]:
        """(folder, file) of the marks in committed folders."""
        found = self._fs.globStatus(self._dir(f"{self.path}/batches/*/{pattern}"))
        return sorted((s.getPath().getParent().getName(), s.getPath().getName()) for s in found or [])

    def batches(self) -> list[str]:
        """Names of the committed batches, in order of commit."""
        return list(dict.fromkeys(name.removeprefix(_NAME).partition("-")[2] for _, name in self._marks(f"{_NAME}*")))

    def _folders(self) -> list[str]:
        """The folders that hold the state: the last whole one and those after it."""
        top = self._dir(f"{self.path}/batches")
        every = sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []
        base = max((folder for folder, _ in self._marks(_BASE)), default="")
        return [f for f in every if f >= base]

    def _read(self, what: str, schema: str, folders: list[str]) -> DataFrame:
        parts = [f"{self.path}/batches/{f}/{what}" for f in folders]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def live(self, folders: list[str] | None = None) -> DataFrame:
        """doc_id, source, lang, version, n_tokens of the counts that stand, and ``copies`` of each."""
        rows = self._read("ledger", LEDGER, self._folders() if folders is None else folders)
        return rows.groupBy(*_COLUMNS).agg(F.sum("sign").alias("copies")).filter("copies > 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups that have come to nothing are left out."""
        t = self._read("delta", TOTALS, self._folders()).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return t.filter("n_docs <> 0 or n_tokens <> 0")

    def _signed(self, last: DataFrame, loose: DataFrame, folders: list[str]) -> DataFrame:
        old = self.live(folders).filter("doc_id is not null").select("doc_id", "version", F.col("source").alias("o_source"), F.col("lang").alias("o_lang"), F.col("n_tokens").alias("o_tokens"))
        on = (last["doc_id"] == old["doc_id"]) & last["version"].eqNullSafe(old["version"])
        minus = last.join(old, on).select(last["doc_id"], F.col("o_source").alias("source"), F.col("o_lang").alias("lang"), last["version"], F.col("o_tokens").alias("n_tokens"), F.lit(-1).cast("long").alias("sign"))
        plus = last.filter("action = 'upsert'").unionByName(loose, allowMissingColumns=True).select(*_COLUMNS, F.lit(1).cast("long").alias("sign"))
        return plus.unionByName(minus)

    def _publish(self, signed: DataFrame, names: list[str], after: list[str], base: bool) -> bool:
        """Writes a batch that rests on the folders ``after`` and moves it into place; false if its number was taken."""
        work = f"{self.path}/pending/{uuid.uuid4().hex}"
        signed.write.parquet(f"{work}/ledger")
        rows = self.spark.read.schema(LEDGER).parquet(f"{work}/ledger")
        rows.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).write.parquet(f"{work}/delta")
        for name in [f"{_NAME}{i:09d}-{n}" for i, n in enumerate(names)] + [_BASE] * base:
            self._fs.create(self._dir(f"{work}/{name}")).close()
        number = int(after[-1]) + 1 if after else 0
        final = self._dir(f"{self.path}/batches/{number:012d}")
        self._fs.mkdirs(self._dir(f"{self.path}/batches"))
        if not self._fs.exists(final) and self._fs.rename(self._dir(work), final):
            # Where another writer was first in between, the rename has nested; that batch does not count.
            nested = self._dir(f"{final}/{work.rpartition('/')[2]}")
            if not self._fs.exists(nested):
                return True
            self._fs.delete(nested, True)
        self._fs.delete(self._dir(work), True)
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies ``changes`` (doc_id, source, lang, version, n_tokens, action: upsert or delete, seq) once; false if the
        batch was there already. The changes are computed once, however often the commit is tried."""
        if batch in self.batches():
            return False
        c = cut(changes.select(F.col("doc_id").cast("long"), *KEYS, F.col("n_tokens").cast("long"), "action", F.col("seq").cast("long")))
        order = F.struct("seq", "n_tokens", "source", "lang", "action")
        last = c.filter("doc_id is not null").groupBy("doc_id", "version").agg(F.max_by(F.struct("source", "lang", "n_tokens", "action"), order).alias("c")).select("doc_id", "version", "c.*")
        loose = c.filter("doc_id is null and action = 'upsert'")
        done = False
        while not done and batch not in self.batches():
            folders = self._folders()
            done = self._publish(self._signed(last, loose, folders), [batch], folders, base=False)
        drop(c)
        return done

    def compact(self) -> bool:
        """Writes the live counts as one batch, from which readers start; the folders before it may then be removed by
        :meth:`prune`. False if another batch came in between, which loses nothing."""
        folders = self._folders()
        return self._publish(self.live(folders).select(*_COLUMNS, F.col("copies").alias("sign")), self.batches(), folders, base=True)

    def prune(self) -> int:
        """Removes folders before the last whole state, once no reader of them is left. Returns their number."""
        top = self._dir(f"{self.path}/batches")
        keep = set(self._folders())
        old = [s.getPath() for s in self._fs.listStatus(top) if s.getPath().getName() not in keep] if self._fs.exists(top) else []
        for p in old:
            self._fs.delete(p, True)
        return len(old)

    def temporary(self) -> TokenRollup:
        """Marks the store to be removed when the JVM ends."""
        self._fs.mkdirs(self._dir(self.path))
        self._fs.deleteOnExit(self._dir(self.path))
        return self

    def delete(self) -> None:
        """Removes the store."""
        self._fs.delete(self._dir(self.path), True)


def count_tokens(docs: DataFrame, path: str, version: str, seq: int = 0) -> DataFrame:
    """Changes that insert or revise every document's token count under the tokenizer file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = [len(encode(x.as_py() or "")) // 4 for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    s = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    c = s.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")
    return c.select("*", F.lit(version).alias("version"), F.lit("upsert").alias("action"), F.lit(seq).alias("seq"))


def withdrawals(ids: DataFrame, version: str, seq: int = 0) -> DataFrame:
    """Changes that delete the counts of the documents in ``ids`` (doc_id)."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), none("string", "source"), none("string", "lang"), none("long", "n_tokens"), F.lit(version).alias("version"), F.lit("delete").alias("action"), F.lit(seq).alias("seq"))

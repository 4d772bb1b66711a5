"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are never recounted: each batch of
changes becomes signed deltas (an insert adds, a delete takes away, a revised count does
both), aggregated before they are stored.  A batch is staged under a name of its own and
then renamed to its place, which fails if there is something: so it is committed whole
or not at all, by one of two writers, and committing it again changes nothing.  (On a
store whose rename is not atomic, only one writer may commit at a time.)  Totals are
sums over the committed batches; a fold replaces all those it has seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.blocks import lean, put_columns, slices, with_columns
from pathloom.llm.hashing import text_buffer
from pathloom.llm.tokens import byte_bpe
from pathloom.plans.scratch import drop, materialize, new_path

KEYS = ["source", "lang", "version"]
WORDS = "words"
STORED = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` without the text, a row for each version: ``version``, ``tokens``, ``n_bytes``.

    ``tokenizers`` maps versions to byte-level tokenizer files; the version ``words``
    needs none and counts white-space separated words.  Null texts have no tokens.
    """
    kept = docs.drop(text_col)
    schema = with_columns(kept.schema, "version string, tokens long, n_bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            column = batch.column(batch.schema.get_field_index(text_col))
            raw, offs = text_buffer(column)
            size = pa.array(offs[1:] - offs[:-1], pa.int64())
            for version, path in tokenizers.items():
                if version == WORDS:
                    blob = raw.tobytes()
                    n = [len(blob[a:z].split()) for a, z in zip(offs[:-1], offs[1:], strict=True)]
                else:
                    n = [len(x) // 4 for x in byte_bpe(path).encode_all([t or "" for t in column.to_pylist()])]
                yield put_columns(batch, schema, {"version": pa.array([version] * len(n), pa.string()), "tokens": pa.array(n, pa.int64()), "n_bytes": size})

    return docs.mapInArrow(lean(run), schema)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch by source, language and version.

    ``changes`` has ``op`` and the columns ``source, lang, version, tokens`` of the new
    state and ``old_source, old_lang, old_version, old_tokens`` of the old.  ``insert``
    uses the new, ``delete`` the old, ``revise`` both.  A null count is zero, a null key
    is a key of its own, other columns are ignored; any other ``op`` is an error.
    """
    new = F.struct("source", "lang", "version", F.lit(1).alias("d"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("t"))
    old = F.struct(
        F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_version").alias("version"), F.lit(-1).alias("d"), (-F.coalesce(F.col("old_tokens"), F.lit(0))).cast("long").alias("t")
    )
    unknown = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("null")))).cast("array<struct<source:string,lang:string,version:string,d:int,t:bigint>>")
    signed = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(old, new)).otherwise(unknown)
    rows = changes.select(F.explode(signed).alias("c")).select("c.*")
    return rows.groupBy(*KEYS).agg(F.sum("d").cast("long").alias("n_docs"), F.sum("t").cast("long").alias("n_tokens"))


class TokenRollup:
    """Totals in a folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, kind: str) -> list[str]:
        if not self._fs.exists(self._hadoop.Path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(self.path))]
        return sorted(n.removeprefix(f"{kind}-") for n in names if n.startswith(f"{kind}-"))

    def _folded(self) -> tuple[str | None, set[str]]:
        """The last fold and the batches in it (a name for each batch, as many as were ever committed)."""
        folds = self._names("fold")
        if not folds:
            return None, set()
        at = f"{self.path}/fold-{folds[-1]}"
        return f"{at}/sums", {r.name for r in self.spark.read.schema("name string").parquet(f"{at}/names").collect()}

    def committed(self) -> list[str]:
        """Names of the committed batches, folded ones included."""
        return sorted({*self._names("batch"), *self._folded()[1]})

    def _put(self, staged: str, name: str) -> bool:
        """Rename a staged folder; False, and the folder is gone, if something has the name."""
        jvm, target = self.spark._jvm, self._path(name)
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._path(staged)), self._fs.makeQualified(target), none)
        except Py4JJavaError:
            if not self._fs.exists(target):
                raise
            self._fs.delete(self._path(staged), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was there already, or another writer was first."""
        if batch in self.committed():
            return False
        staged = f"staging-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{staged}")
        return self._put(staged, f"batch-{batch}")

    def fold(self) -> bool:
        """Add all committed batches up into one table; False if another fold came first.

        Batches committed meanwhile are not in it and still count.  What was folded stays
        until the next fold, for readers that have begun.
        """
        last, old = self._folded()
        batches = [n for n in self._names("batch") if n not in old]
        folds = self._names("fold")
        if not batches:
            return False
        staged = f"staging-{uuid.uuid4().hex}"
        self._sums(last, batches).write.parquet(f"{self.path}/{staged}/sums")
        self.spark.createDataFrame([(n,) for n in sorted({*old, *batches})], "name string").coalesce(1).write.parquet(f"{self.path}/{staged}/names")
        if not self._put(staged, f"fold-{int(folds[-1]) + 1 if folds else 1:012d}"):
            return False
        for name in folds[:-1]:
            self._fs.delete(self._path(f"fold-{name}"), True)
        for name in old:
            self._fs.delete(self._path(f"batch-{name}"), True)
        return True

    def _sums(self, fold: str | None, batches: list[str]) -> DataFrame:
        paths = [*([fold] if fold else []), *[f"{self.path}/batch-{n}" for n in batches]]
        if not paths:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(STORED).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens``; keys whose documents are all gone are left out."""
        batches = self._names("batch")  # before the fold is read: a batch it has is not counted twice
        fold, folded = self._folded()
        return self._sums(fold, [n for n in batches if n not in folded]).where("n_docs <> 0 OR n_tokens <> 0")


def rollup_documents(docs: DataFrame, tokenizers: dict[str, str], path: str | None = None) -> DataFrame:
    """Totals of a corpus that arrives in batches: estimates first, then revised by real counts.

    The first batch inserts each document with a quarter of its bytes as the estimate of
    a tokenizer's count, under the name of the crawl that brought it; the second revises
    count and source; a third brings all documents once more, and a fourth deletes those.
    The first is then delivered again, as a restarted feed would, and has no effect, and
    the batches are folded.
    """
    spark = docs.sparkSession
    counts = materialize(count_tokens(docs, tokenizers), "token-counts")
    estimate = F.floor(F.col("n_bytes") / 4).cast("long")
    crawl = F.concat(F.lit("crawl of "), F.coalesce("source", F.lit("")))
    first = [crawl.alias("source"), "lang", "version", estimate.alias("tokens")]
    new, old = [*KEYS, "tokens"], ["old_source", "old_lang", "old_version", "old_tokens"]
    nothing = [F.lit(None).cast("string").alias(c) for c in old[:3]] + [F.lit(None).cast("long").alias(old[3])]
    as_ = lambda frame, names: frame.toDF(*names)
    insert = as_(counts.select(F.lit("insert"), *first, *nothing), ["op", *new, *old])
    revise = as_(counts.select(F.lit("revise"), *new, *first), ["op", *new, *old])
    again = as_(counts.select(F.lit("insert"), *new, *nothing), ["op", *new, *old])
    delete = as_(counts.select(F.lit("delete"), *nothing, *new), ["op", *new, *old])
    rollup = TokenRollup(spark, path or new_path(spark, "token-rollup"))
    rollup.commit("000001-insert", insert)
    rollup.commit("000002-revise", revise)
    rollup.commit("000003-again", again)
    rollup.commit("000004-delete", delete)
    rollup.commit("000001-insert", insert)
    rollup.fold()
    drop(counts)
    return rollup.totals()

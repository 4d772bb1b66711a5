"""How much of each arriving text is new to the collection: its growth curve, kept up to date.

The growth curve of a graph asks how much new sequence each further assembly brings.  This job
keeps the same account for a collection of texts that files are added to: documents are
paths, their lines segments.  It takes only files that are new since its last run (a file
stream with a checkpoint, run until nothing is left), compares their segments with those
seen before, and writes a row for each arriving document: its segments and characters, and
how many of them no earlier document had.  Rows written once never change.

    python -m jobs.text_novelty --config jobs/text_novelty.json --input DIR --output OUT --checkpoint CHK

Output, as Parquet: ``OUTPUT/ledger/batch=N/lang=...`` (the rows) and ``OUTPUT/index/batch=N`` (the
segments first seen in that batch).  Both of a batch are written over on a replay, from the
batches before it alone, so that a run that broke off goes on where it was.

Within a batch a segment that several documents have belongs to the smallest ``doc_id``.  Rows
with the same ``doc_id`` in one batch are one document; rows without one can't be kept apart
and are left out (the log says how many).  A null text has no segments.
"""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.options import command_line, log_to_stderr, logger, options
from pathloom.plans.scratch import drop, materialize
from pathloom.streaming.novelty import first_owners, gains, segments, sizes, unseen

DEFAULTS = {
    "input": ...,  # a folder that Parquet files of documents are added to (or one file)
    "output": ...,
    "checkpoint": ...,  # which files are done
    "delim": "\n",  # between segments
    "files_per_batch": 0,  # at most, in one step of a run; 0: all that are new
}
COLUMNS = ["doc_id", "source", "lang", "text"]
INDEX = "segment string, owner long, chars long, batch long"
LEDGER = "doc_id long, source string, n_segments long, n_distinct long, n_chars long, new_segments long, new_chars long, batch long, lang string"
LOG = logger("text_novelty")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table written by earlier batches; None before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _pattern(path: str) -> str:
    """A pattern that matches ``path`` alone: a file stream takes a single file only by pattern, a folder either way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path


def take(docs: DataFrame, batch: int, output: str, delim: str) -> dict:
    """Write the index and the ledger of one batch; gives the rows read and written."""
    spark = docs.sparkSession
    index, ledger = _read(spark, f"{output}/index", INDEX), _read(spark, f"{output}/ledger", LEDGER)
    if ledger is not None and ledger.where(F.col("batch") > batch).head(1):
        raise ValueError(f"{output} has batches after {batch}: its checkpoint is missing or is another one's")
    pieces = docs.select("doc_id", "source", "lang", segments(F.col("text"), delim).alias("pieces"))
    kept = materialize(pieces.where("doc_id IS NOT NULL"), "novelty")
    n = {"read": docs.count(), "documents": kept.count()}
    owners = first_owners(kept, "doc_id", "pieces")
    if index is not None:
        owners = unseen(owners, index.where(F.col("batch") < batch))
    at = f"{output}/index/batch={batch}"
    owners.write.mode("overwrite").parquet(at)
    new = spark.read.schema(INDEX.removesuffix(", batch long")).parquet(at)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = sizes(kept, "doc_id", "pieces", "source", "lang").join(gains(new, "doc_id"), "doc_id", "left")
    rows = rows.select("doc_id", "source", "n_segments", "n_distinct", "n_chars", zero("new_segments"), zero("new_chars"), "lang")
    rows.hint("rebalance", "lang").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("lang").parquet(f"{output}/ledger/batch={batch}")
    drop(kept)
    n |= {"new_segments": new.count(), "written": read_ledger(spark, output).where(F.col("batch") == batch).count()}
    LOG.info("batch %d: read %d rows (%d without doc_id), wrote %d to %s/ledger and %d segments to %s/index", batch, n["read"], n["read"] - n["documents"], n["written"], output, n["new_segments"], output)
    return n


def read_ledger(spark: SparkSession, output: str) -> DataFrame:
    """All rows written so far."""
    return spark.read.schema(LEDGER).parquet(f"{output}/ledger")


def run(spark: SparkSession, given: dict) -> list[dict]:
    """Take all files that are new and stop; gives what each batch read and wrote."""
    o = options(DEFAULTS, given)
    done: list[dict] = []
    schema = spark.read.parquet(o["input"]).select(*COLUMNS).schema
    # A file may be older than those before it; Spark would pass it over after a week.
    reader = spark.readStream.schema(schema).option("maxFileAge", "36500d")
    if o["files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", o["files_per_batch"])
    stream = (
        reader.parquet(_pattern(o["input"]))
        .writeStream.foreachBatch(lambda docs, batch: done.append(take(docs, batch, o["output"], o["delim"])))
        .option("checkpointLocation", o["checkpoint"])
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    LOG.info("%s: %d batches, %d rows read, %d written", o["input"], len(done), sum(n["read"] for n in done), sum(n["written"] for n in done))
    return done


def main(argv: list[str]) -> int:
    """The command line."""
    log_to_stderr()
    o = command_line(argv, DEFAULTS, __doc__.splitlines()[0])
    spark = SparkSession.builder.appName("text_novelty").getOrCreate()
    try:
        run(spark, o)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

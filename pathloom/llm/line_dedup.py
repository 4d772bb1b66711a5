"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash is built where the lines are read
and merged by the aggregation, so a line that stands on a third of all pages reaches
its reducer as one sketch per task.  Lines whose estimate lies within the sketch's
error of the threshold get an exact distinct count before anything is removed.
"""

from __future__ import annotations

from math import ceil, floor, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.blocks import fresh
from pathloom.plans.scratch import materialize

SPACES = " \t\n\x0b\x0c\r"


def line_dedup(docs: DataFrame, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id", min_sites: int = 5, lg_k: int = 12) -> DataFrame:
    """Remove lines that stand on ``min_sites`` or more distinct sites, except in one document.

    A line is a ``\\n``-separated piece with a word, compared without white space at its
    ends.  The document with the smallest id that has a boilerplate line keeps it, so no
    text leaves the corpus.  Returns ``docs`` with the text rewritten, plus ``n_lines``
    (lines with a word) and ``n_removed``; input columns of these names are replaced.

    Null texts stay null with no lines.  A null site is no site; a row whose id is null
    never keeps a line, unless all rows with that line have null ids: then none loses it.
    Repeated rows with one id are one document.  An empty table gives an empty table.
    """
    kept_cols = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    row = fresh(kept_cols, "row")[0]
    base = materialize(docs.select(*kept_cols, F.monotonically_increasing_id().alias(row)), "lines-docs")
    lines = (
        base.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
        .select("row", "id", "site", "pos", F.btrim("line", F.lit(SPACES)).alias("line"))
        .where("line <> ''")
        # Two 64-bit hashes: at 10**12 lines one of them alone would meet another by chance.
        .select("row", "id", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))
    )
    error = 3 * 1.04 / sqrt(1 << lg_k)
    low, high = floor(min_sites * (1 - error)), ceil(min_sites * (1 + error))
    # A line without any site has no sketch entry and an estimate of zero.
    spread = materialize(
        lines.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min("id").alias("home")).where(F.col("sites") >= low),
        "lines-spread",
    )
    near = spread.where(F.col("sites") <= high)
    exact = lines.select("h", "g", "site").join(near.select("h", "g"), ["h", "g"], "left_semi").groupBy("h", "g", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h", "g").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    wide = spread.where(F.col("sites") > high).select("h", "g", "home").union(near.join(exact, ["h", "g"], "left_semi").select("h", "g", "home"))
    # The rows of a line that stands on a third of all pages are split among tasks: broadcast
    # where the wide lines are few, by the adaptive skew join (no row is aggregated there) else.
    gone = (
        lines.join(wide, ["h", "g"])
        .where(~F.col("id").eqNullSafe(F.col("home")) & F.col("home").isNotNull())
        .groupBy("row")
        .agg(F.collect_list("pos").alias("gone"))
    )
    held = base.select(F.col(row).alias("row"), F.struct(*[F.col(c) for c in kept_cols]).alias("doc"))
    old = F.col("doc").getField(text_col)
    out = held.join(gone, "row", "left").withColumn("split", F.split(old, "\n"))
    solid = F.filter("split", lambda x: F.btrim(x, F.lit(SPACES)) != "")
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "gone")
    text = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(F.transform(left, lambda p: F.get("split", p)), "\n"))
    return out.select(
        *[(text if c == text_col else F.col("doc").getField(c)).alias(c) for c in kept_cols],
        F.coalesce(F.size(solid), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE_SQL = """
WITH s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, i AS pos, ls[i + 1] AS raw, trim(ls[i + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
      FROM (SELECT doc_id, source, ls, unnest(range(0, len(ls))) AS i FROM s)),
b AS (SELECT line, min(doc_id) AS home FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
k AS (SELECT l.doc_id, count(*) FILTER (WHERE l.line <> '') AS n_lines,
        count(*) FILTER (WHERE b.line IS NOT NULL AND l.doc_id <> b.home) AS n_removed,
        coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL OR l.doc_id = b.home), '') AS kept
      FROM l LEFT JOIN b ON l.line = b.line GROUP BY l.doc_id)
SELECT s.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN k ON s.doc_id = k.doc_id
"""

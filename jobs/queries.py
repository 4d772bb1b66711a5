"""The jobs as queries: each run twice into one new folder, and what is there then; with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import haplotype_report, text_novelty
from pathloom.plans.scratch import new_path
from pathloom.sources.tables import SQL


def job1_haplotype_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "job1")
    o = {"kind": "tables", "input": sf_dir, "output": out, "reference": "NATION_3", "core": 0.7, "cloud": 0.6, "least_run": 30}
    for _ in range(2):
        haplotype_report.run(spark, o)
    return haplotype_report.read_report(spark, out)


def job2_text_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "job2")
    o = {"input": f"{sf_dir}/documents.parquet", "output": out, "checkpoint": f"{out}/checkpoint"}
    for _ in range(2):
        text_novelty.run(spark, o)
    return text_novelty.read_ledger(spark, out)


REPORT_SQL = f"""
WITH RECURSIVE {SQL},
samples AS (SELECT path_id, path_name, split_part(path_name, '#', 1) AS sample FROM paths),
total AS (SELECT count(DISTINCT sample) AS total FROM samples),
found AS (SELECT node_id, count(DISTINCT sample) AS n FROM steps JOIN samples USING (path_id) GROUP BY node_id),
shared AS (SELECT DISTINCT node_id FROM steps JOIN samples USING (path_id) WHERE sample = 'NATION_3'),
classed AS (SELECT node_id, n, depth, CASE WHEN n / total >= 0.7 THEN 'core' WHEN n / total < 0.6 THEN 'cloud' ELSE 'shell' END AS class, node_id IN (SELECT node_id FROM shared) AS known FROM found JOIN depths USING (node_id), total),
parts AS (SELECT path_id, sum(len * depth) / sum(len) AS mean_depth, sum(len * n) / sum(len) AS mean_samples, sum(len) FILTER (class = 'core') AS core_bp, sum(len) FILTER (class = 'shell') AS shell_bp,
    sum(len) FILTER (class = 'cloud') AS cloud_bp, sum(len) FILTER (known) AS reference_bp FROM steps JOIN classed USING (node_id) GROUP BY path_id),
outside AS (SELECT path_id, pos, len, step_rank - row_number() OVER (PARTITION BY path_id ORDER BY step_rank) AS run FROM steps WHERE node_id NOT IN (SELECT node_id FROM shared)),
runs AS (SELECT path_id, sum(len) AS bp FROM outside GROUP BY path_id, run HAVING sum(len) >= 30),
novel AS (SELECT path_id, count(*) AS novel_runs, sum(bp) AS novel_bp, max(bp) AS longest_novel_bp FROM runs GROUP BY path_id)
SELECT path_id, l.path_name, step_count, length_bp, mean_depth, mean_samples, coalesce(core_bp, 0)::BIGINT AS core_bp, coalesce(shell_bp, 0)::BIGINT AS shell_bp, coalesce(cloud_bp, 0)::BIGINT AS cloud_bp,
    coalesce(reference_bp, 0)::BIGINT AS reference_bp, coalesce(novel_runs, 0)::BIGINT AS novel_runs, coalesce(novel_bp, 0)::BIGINT AS novel_bp, coalesce(longest_novel_bp, 0)::BIGINT AS longest_novel_bp, sample
FROM lengths l JOIN samples USING (path_id) LEFT JOIN parts USING (path_id) LEFT JOIN novel USING (path_id)
"""

NOVELTY_SQL = """
WITH docs AS (SELECT doc_id, source, lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS p FROM documents WHERE doc_id IS NOT NULL),
pieces AS (SELECT doc_id, md5(x) AS segment, length(x) AS chars FROM (SELECT doc_id, unnest(p) AS x FROM docs)),
firsts AS (SELECT segment, min(doc_id) AS owner, max(chars) AS chars FROM pieces GROUP BY segment),
gains AS (SELECT owner AS doc_id, count(*) AS new_segments, sum(chars) AS new_chars FROM firsts GROUP BY owner),
sizes AS (SELECT doc_id, min(source) AS source, min(lang) AS lang, sum(len(p)) AS n_segments, sum(len(list_distinct(p))) AS n_distinct, sum(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)) AS n_chars FROM docs GROUP BY doc_id)
SELECT doc_id, source, n_segments::BIGINT AS n_segments, n_distinct::BIGINT AS n_distinct, n_chars::BIGINT AS n_chars, coalesce(new_segments, 0)::BIGINT AS new_segments, coalesce(new_chars, 0)::BIGINT AS new_chars, 0::BIGINT AS batch, lang
FROM sizes LEFT JOIN gains USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Both jobs by name."""
    return {f.__name__: f for f in (job1_haplotype_report, job2_text_novelty)}


def oracle_sql() -> dict[str, str]:
    """Their SQL."""
    return {"job1_haplotype_report": REPORT_SQL, "job2_text_novelty": NOVELTY_SQL}

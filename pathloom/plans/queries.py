"""The registered graph queries: each with the SQL that states the same result on the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import dna, names, numbers
from pathloom.functions.names import haplotype_of, sample_of
from pathloom.operators import context as C
from pathloom.operators import edges as E
from pathloom.operators import edits as M
from pathloom.operators import order as O
from pathloom.operators import paths as P
from pathloom.operators import ranges as R
from pathloom.operators import structure as X
from pathloom.operators import summary as S
from pathloom.operators import traverse as T
from pathloom.operators.alignment import local_alignments
from pathloom.plans.graph import Graph, by_step, with_positions
from pathloom.plans.prefix import dense_index
from pathloom.plans.session import ship_package
from pathloom.plans.strong import strong_components, topological_keys
from pathloom.plans.scratch import FEW, materialize, new_path, unless_many
from pathloom.sources import gfa, side
from pathloom.sources.tables import RANGES_SQL, SQL, example_ranges, graph_of_tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, extra: str = ""):
    """Add a query on the graph of the tables; ``sql`` may use its views, ``extra`` adds more."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(graph_of_tables(spark, sf_dir))

        _QUERIES[name] = query
        if sql:
            _SQL[name] = f"WITH RECURSIVE {SQL}{', ' + extra if extra else ''} {sql}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All graph queries by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Their SQL."""
    return dict(_SQL)


# --- side tables -------------------------------------------------------------------------

SAMPLES = "samples AS MATERIALIZED (SELECT path_id, split_part(path_name, '#', 1) AS grp FROM paths)"
HAPS = "samples AS MATERIALIZED (SELECT path_id, split_part(path_name, '#', 1) || '#' || split_part(path_name, '#', 2) AS grp FROM paths)"
SEGMENTS = "samples AS MATERIALIZED (SELECT path_id, split_part(path_name, '#', 2) AS grp FROM paths)"
HIT = f"{RANGES_SQL}, hit AS MATERIALIZED (SELECT r.path_id, r.start, r.\"end\", s.node_id, s.is_rev, s.len, s.pos, least(s.pos + s.len, r.\"end\") - greatest(s.pos, r.start) AS overlap FROM ranges r JOIN steps s ON r.path_id = s.path_id AND s.pos + s.len > r.start AND s.pos < r.\"end\")"
POSITIONS = "positions AS (SELECT path_id, (path_id * 13) % 60 AS \"offset\" FROM paths), located AS MATERIALIZED (SELECT p.path_id, p.\"offset\", node_id, is_rev, p.\"offset\" - pos AS node_offset, len FROM positions p JOIN steps s ON p.path_id = s.path_id AND pos <= p.\"offset\" AND p.\"offset\" < pos + len)"
GAPS = "own AS (SELECT DISTINCT path_id, node_id, rank FROM pairs UNION SELECT path_id, node_id, node_id - 1 FROM steps), following AS MATERIALIZED (SELECT path_id, node_id, lead(node_id) OVER (PARTITION BY path_id ORDER BY rank) AS next_id FROM own), gaps AS MATERIALIZED (SELECT p.path_id, p.step_rank FROM pairs p JOIN following f ON p.path_id = f.path_id AND p.node_id = f.node_id AND p.node_id2 = f.next_id)"
ROLL = "GROUP BY ROLLUP (path_name)"
NAMED = "named AS (SELECT pairs.*, path_name FROM pairs JOIN paths USING (path_id))"


def samples(g: Graph) -> DataFrame:
    return P.groups_by(g, sample_of(F.col("path_name"), "#", 1))


def haplotypes(g: Graph) -> DataFrame:
    return P.groups_by(g, haplotype_of(F.col("path_name")))


def segments(g: Graph) -> DataFrame:
    return P.groups_by(g, F.split("path_name", "#")[1])


def positions(g: Graph) -> DataFrame:
    return g.paths.select("path_id", (F.col("path_id") * 13 % 60).alias("offset"))


def reference(g: Graph) -> DataFrame:
    return g.paths.where("startswith(path_name, 'NATION_3#')").select("path_id")


# --- totals ------------------------------------------------------------------------------

register("g1_graph_summary", "SELECT (SELECT sum(len) FROM nodes)::BIGINT AS length, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM paths) AS paths, (SELECT count(*) FROM steps) AS steps")(S.graph_summary)
register("g2_node_depth", "SELECT * FROM depths")(lambda g: g.depths())
register("g4_depth_summary", "SELECT *, step_count / node_count AS mean_node_depth, path_length / graph_length AS mean_graph_depth FROM (SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT sum(len) FROM nodes)::BIGINT AS graph_length, (SELECT count(*) FROM steps) AS step_count, (SELECT sum(len) FROM steps)::BIGINT AS path_length)")(S.depth_summary)
register("g8_node_degree", "SELECT * FROM degrees")(lambda g: g.degrees())
register("g11_degree_summary", "SELECT count(*) AS node_count, sum(degree)::BIGINT // 2 AS edge_count, sum(degree)::BIGINT / count(*) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM degrees")(S.degree_summary)
register("g14_self_loops", "SELECT count(*) AS total, count(DISTINCT from_id) AS unique_nodes FROM edges WHERE from_id = to_id")(S.self_loops)
register("g15_base_content", "SELECT base, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS base FROM nodes) WHERE base <> '' GROUP BY base")(S.base_content)
register(
    "g16_sequence_classes",
    "SELECT grp AS sample, coalesce(sum(len) FILTER (c = 'core'), 0)::BIGINT AS core_bp, coalesce(sum(len) FILTER (c = 'private'), 0)::BIGINT AS private_bp, coalesce(sum(len) FILTER (c = 'shell'), 0)::BIGINT AS shell_bp FROM o JOIN k USING (node_id) GROUP BY grp",
    f"{SEGMENTS}, o AS MATERIALIZED (SELECT DISTINCT node_id, grp, len FROM steps JOIN samples USING (path_id)), k AS (SELECT node_id, CASE WHEN count(*) = 1 THEN 'private' WHEN count(*) < (SELECT count(DISTINCT grp) FROM samples) THEN 'shell' ELSE 'core' END AS c FROM o GROUP BY node_id)",
)(lambda g: S.sequence_classes(g.with_(paths=g.paths.withColumn("path_name", F.split("path_name", "#")[1]))))
register("g32_path_lengths", "SELECT * FROM lengths")(lambda g: g.path_lengths())
register("g37_orientation_balance", "SELECT path_id, coalesce(sum(len) FILTER (NOT is_rev), 0)::BIGINT AS forward_bp, coalesce(sum(len) FILTER (is_rev), 0)::BIGINT AS reverse_bp FROM steps GROUP BY path_id")(P.orientation_balance)
register("g38_path_order", "SELECT path_id, key, row_number() OVER (ORDER BY key, path_id) - 1 AS nth FROM (SELECT path_id, avg(node_id) AS key FROM steps GROUP BY path_id)")(lambda g: P.path_order(g, "avg"))
register(
    "o12_nondeterministic_edges",
    "SELECT h, t, base FROM (SELECT *, count(*) OVER (PARTITION BY h, base) AS n FROM b) WHERE n > 1",
    "f AS (SELECT (from_id - 1) * 2 + from_rev::INT AS h, (to_id - 1) * 2 + to_rev::INT AS t FROM edges UNION SELECT (to_id - 1) * 2 + (NOT to_rev)::INT, (from_id - 1) * 2 + (NOT from_rev)::INT FROM edges), b AS (SELECT h, t, CASE WHEN t % 2 = 0 THEN seq[1] ELSE translate(seq[-1], 'ACGT', 'TGCA') END AS base FROM f JOIN nodes ON node_id = t // 2 + 1)",
)(S.nondeterministic_edges)
register("g34_matrix", "SELECT from_id AS i, to_id AS j, 1.0::DOUBLE AS w FROM edges UNION ALL SELECT to_id, from_id, 1.0 FROM edges")(S.sparse_matrix)
register("g34_matrix_depth", "SELECT from_id AS i, to_id AS j, n::DOUBLE AS w FROM w UNION ALL SELECT to_id, from_id, n FROM w", "w AS (SELECT from_id, from_rev, to_id, to_rev, count(*) AS n FROM walked GROUP BY ALL)")(lambda g: S.sparse_matrix(g, edge_depth=True))
register("g34_matrix_delta", "SELECT i, j, 1.0::DOUBLE / greatest(1, abs(i - j)) AS w FROM (SELECT from_id AS i, to_id AS j FROM edges UNION ALL SELECT to_id, from_id FROM edges)")(lambda g: S.sparse_matrix(g, delta=True))

# --- links -------------------------------------------------------------------------------

_SPAN = "sum(abs(rank2 + is_rev2::INT - rank - (NOT is_rev)::INT) * {k}) AS s, sum(abs(pan_pos2 + CASE WHEN is_rev2 THEN len2 ELSE 0 END - pan_pos - CASE WHEN is_rev THEN 0 ELSE len END) * {k}) AS t, count(*) AS num_links"
register("g17_mean_links", f"SELECT coalesce(path_name, 'all_paths') AS path, s / num_links AS in_node_space, t / num_links AS in_nucleotide_space, num_links, 0::BIGINT AS num_gap_links FROM (SELECT path_name, {_SPAN.format(k=1)} FROM named {ROLL})", NAMED)(E.mean_links_length)
register(
    "g17_mean_links_without_gaps",
    f"SELECT coalesce(path_name, 'all_paths') AS path, s / num_links AS in_node_space, t / num_links AS in_nucleotide_space, num_links, num_gap_links FROM (SELECT path_name, {_SPAN.format(k='(gap IS NULL)::INT')}, count(gap) AS num_gap_links FROM (SELECT named.*, gaps.step_rank AS gap FROM named LEFT JOIN gaps USING (path_id, step_rank)) {ROLL})",
    f"{NAMED}, {GAPS}",
)(lambda g: E.mean_links_length(g, True))
register(
    "g18_mean_links_2d",
    f"SELECT coalesce(path_name, 'all_paths') AS path, round(sum(sqrt((x(pan_pos, len, is_rev) - x(pan_pos2, len2, is_rev2)) * (x(pan_pos, len, is_rev) - x(pan_pos2, len2, is_rev2)) + (rank % 10 - rank2 % 10) * (rank % 10 - rank2 % 10))) / count(*), 6) AS in_2d_space, count(*) AS num_links FROM named {ROLL}".replace("x(pan_pos, len, is_rev)", "(pan_pos + CASE WHEN is_rev THEN len ELSE 0 END)").replace("x(pan_pos2, len2, is_rev2)", "(pan_pos2 + CASE WHEN is_rev2 THEN len2 ELSE 0 END)"),
    NAMED,
)(lambda g: E.mean_links_length_2d(g, linear_layout(g)))
register(
    "g19_path_distance",
    f"SELECT coalesce(path_name, 'all_paths') AS path, sum(coalesce(n, 0) + 1) / sum(nodes) AS in_node_space, sum(coalesce(b, 0) + last) / sum(nucleotides) AS in_nucleotide_space, sum(nodes)::BIGINT AS nodes, sum(nucleotides)::BIGINT AS nucleotides, sum(coalesce(back, 0))::BIGINT AS num_penalties, sum(coalesce(turns, 0))::BIGINT AS num_turns FROM size JOIN paths USING (path_id) LEFT JOIN links USING (path_id) {ROLL}",
    "links AS (SELECT path_id, sum(abs(rank2 - rank) * k) AS n, sum(abs(pan_pos2 - pan_pos) * k) AS b, sum((rank2 < rank)::INT) AS back, sum((is_rev <> is_rev2)::INT) AS turns FROM (SELECT *, CASE WHEN rank2 < rank THEN 3 ELSE 1 END + 2 * (is_rev <> is_rev2)::INT AS k FROM pairs) GROUP BY path_id), size AS (SELECT path_id, count(*) AS nodes, sum(len) AS nucleotides, arg_max(len, step_rank) AS last FROM steps GROUP BY path_id)",
)(lambda g: E.path_node_distance(g, True))
register("g20_feedback_arcs", f"SELECT coalesce(path_name, 'all_paths') AS path, count(*) FILTER ((NOT is_rev AND NOT is_rev2 AND rank >= rank2) OR (is_rev AND is_rev2 AND rank <= rank2)) AS n FROM named {ROLL}", NAMED)(E.feedback_arcs)
register("g21_reversing_joins", f"SELECT coalesce(path_name, 'all_paths') AS path, count(*) FILTER (is_rev <> is_rev2) AS n FROM named {ROLL}", NAMED)(E.reversing_joins)
register(
    "g22_links_per_nucleotide",
    "SELECT sum(CASE WHEN NOT is_rev AND NOT is_rev2 THEN CASE WHEN node_id > node_id2 THEN pan_pos - pan_pos2 + len WHEN g.step_rank IS NULL THEN pan_pos2 - pan_pos - len ELSE 0 END WHEN NOT is_rev THEN CASE WHEN node_id <= node_id2 THEN pan_pos2 + len2 - pan_pos - len ELSE pan_pos - pan_pos2 - len2 + len END WHEN NOT is_rev2 THEN CASE WHEN node_id <= node_id2 THEN pan_pos2 - pan_pos ELSE pan_pos - pan_pos2 + len + len2 END ELSE CASE WHEN node_id <= node_id2 THEN pan_pos2 - pan_pos + len + len2 ELSE pan_pos - pan_pos2 - len2 END END)::BIGINT / (SELECT sum(len)::BIGINT FROM steps) AS links_length_per_nuc FROM pairs LEFT JOIN gaps g USING (path_id, step_rank)",
    GAPS,
)(E.links_length_per_nucleotide)
register("j9_missing_edges", "SELECT DISTINCT from_id, from_rev, to_id, to_rev FROM walked WHERE from_rev <> to_rev")(lambda g: E.missing_edges(g.with_(edges=g.edges.where("from_rev = to_rev"))))
_NBR = "nbr AS MATERIALIZED (SELECT node_id, 'N' AS dir, (node_id2 - 1) * 2 + is_rev2::INT AS nbr, count(*) AS n FROM pairs GROUP BY ALL UNION ALL SELECT node_id2, 'P', (node_id - 1) * 2 + is_rev::INT, count(*) FROM pairs GROUP BY ALL)"
_AS_PAIR = "SELECT DISTINCT CASE WHEN dir = 'N' THEN (node_id - 1) * 2 ELSE nbr END AS from_handle, CASE WHEN dir = 'N' THEN nbr ELSE (node_id - 1) * 2 END AS to_handle FROM"
register("o5_edges_outside_depth", f"{_AS_PAIR} nbr WHERE n < 2 OR n > 4", _NBR)(lambda g: E.edges_outside_depth(g, 2, 4))
register("t17_edges_beyond_best", f"{_AS_PAIR} (SELECT *, row_number() OVER (PARTITION BY node_id, dir ORDER BY n) - 1 AS i FROM (SELECT node_id, dir, n, max(nbr) AS nbr, size FROM (SELECT *, count(*) OVER (PARTITION BY node_id, dir) AS size FROM nbr) GROUP BY node_id, dir, n, size)) WHERE size - i > 20", _NBR)(lambda g: E.edges_beyond_best(g, 20))

# --- nodes -------------------------------------------------------------------------------

register("o4_nodes_outside_depth", "SELECT node_id FROM depths WHERE depth < 20 OR depth > 40")(lambda g: g.depths().where("depth < 20 OR depth > 40").select("node_id"))
register("o6_high_degree_nodes", "SELECT node_id FROM degrees WHERE deg_l + deg_r > 50")(lambda g: g.degrees().where("degree > 50").select("node_id"))
register("o7_tips", "SELECT node_id FROM degrees WHERE deg_l < 22 OR deg_r < 22")(lambda g: g.degrees().where("deg_l < 22 OR deg_r < 22").select("node_id"))
register("o10_heads_and_tails", "SELECT node_id, deg_l = 0 AS head, deg_r = 0 AS tail FROM degrees WHERE deg_l = 0 OR deg_r = 0", "")(lambda g: g.degrees().where("deg_l = 0 OR deg_r = 0").selectExpr("node_id", "deg_l = 0 AS head", "deg_r = 0 AS tail"))
register("o14_pangenome_range", "SELECT node_id FROM nodes WHERE pan_pos + len >= 1000 AND pan_pos <= 2000")(lambda g: R.nodes_in_pangenome_range(g, 1000, 2000))
register(
    "o11_non_reference_nodes",
    "SELECT n.node_id, n.len, (length(seq) - length(replace(replace(seq, 'N', ''), 'n', '')))::BIGINT AS uncalled, coalesce(string_agg(DISTINCT path_name, ',' ORDER BY path_name), '') AS paths FROM nodes n LEFT JOIN steps s ON s.node_id = n.node_id LEFT JOIN paths p ON p.path_id = s.path_id WHERE n.len >= 5 AND n.node_id NOT IN (SELECT node_id FROM steps WHERE path_id IN (SELECT path_id FROM paths WHERE starts_with(path_name, 'NATION_3#'))) GROUP BY n.node_id, n.len, seq",
)(lambda g: P.non_reference_nodes(g, reference(g), 5))

# --- ranges ------------------------------------------------------------------------------

register("g3_range_mean_depth", "SELECT path_id, start, \"end\", sum(depth * overlap)::BIGINT / (\"end\" - start) AS mean_depth FROM hit JOIN depths USING (node_id) GROUP BY path_id, start, \"end\"", HIT)(lambda g: R.mean_depth(g, example_ranges(g)))
register("g9_range_mean_degree", "SELECT path_id, start, \"end\", sum(degree * overlap)::BIGINT / (\"end\" - start) AS mean_degree FROM hit JOIN degrees USING (node_id) GROUP BY path_id, start, \"end\"", HIT)(lambda g: R.mean_degree(g, example_ranges(g)))
register(
    "g9_mean_degree_of_subset",
    "SELECT path_id, 0::BIGINT AS start, length_bp AS \"end\", sum(len * CASE WHEN node_id IN (SELECT node_id FROM steps WHERE path_id IN (SELECT path_id FROM paths WHERE starts_with(path_name, 'NATION_3#'))) THEN degree ELSE 0 END)::BIGINT / length_bp AS mean_degree FROM steps JOIN degrees USING (node_id) JOIN lengths USING (path_id) GROUP BY path_id, length_bp",
)(lambda g: R.mean_degree(g, R.whole_paths(g), reference(g)))
register("j11_locate", "SELECT path_id, \"offset\", node_id, is_rev, node_offset FROM located", POSITIONS)(lambda g: R.locate(g, positions(g)))
register("g5_depth_at_positions", "SELECT path_id, \"offset\", depth, depth_uniq FROM located JOIN depths USING (node_id)", POSITIONS)(lambda g: R.depth_at(g, positions(g)))
register("g10_degree_at_positions", "SELECT path_id, \"offset\", degree, depth_uniq AS degree_uniq FROM located JOIN degrees USING (node_id) JOIN depths USING (node_id)", POSITIONS)(lambda g: R.degree_at(g, positions(g)))
register("c15_pangenome_position", "SELECT path_id, \"offset\" + 1 AS \"offset\", pan_pos + 1 + CASE WHEN is_rev THEN l.len - node_offset - 1 ELSE node_offset END AS pan_position FROM located l JOIN nodes USING (node_id)", POSITIONS)(lambda g: R.pangenome_position(g, positions(g).withColumn("offset", F.col("offset") + 1)))
_VECTOR = "SELECT path_id, string_agg(t, ' ' ORDER BY step_rank) AS vector FROM (SELECT path_id, step_rank, rtrim(repeat({v}::VARCHAR || ' ', len::INT)) AS t FROM steps s JOIN {t} USING (node_id)) GROUP BY path_id"
register("g6_depth_vectors", _VECTOR.format(v="depth", t="depths"))(lambda g: R.base_vector(g, g.depths().selectExpr("node_id", "depth AS v")))
register("g12_degree_vectors", _VECTOR.format(v="degree", t="degrees"))(lambda g: R.base_vector(g, g.degrees().selectExpr("node_id", "degree AS v")))


def _islands(inside: str, merge: int) -> str:
    return f"""runs AS (SELECT path_id, min(pos) AS start, max(pos + len) AS "end" FROM (SELECT *, step_rank - row_number() OVER (PARTITION BY path_id ORDER BY step_rank) AS r FROM steps WHERE node_id IN ({inside})) GROUP BY path_id, r),
    marked AS (SELECT *, sum(new) OVER (PARTITION BY path_id ORDER BY start) AS grp FROM (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY path_id ORDER BY start) < {merge} THEN 0 ELSE 1 END AS new FROM runs))"""


_WINDOWS = "SELECT path_id, min(start) AS start, max(\"end\") AS \"end\" FROM marked GROUP BY path_id, grp"
register("g7_depth_windows_in", _WINDOWS, _islands("SELECT node_id FROM depths WHERE depth BETWEEN 28 AND 32", 25))(lambda g: R.windows(g, R.bounded(g.depths().selectExpr("node_id", "depth AS v"), 28, 32), 25))
register("g7_depth_windows_out", _WINDOWS, _islands("SELECT node_id FROM depths WHERE NOT depth_uniq BETWEEN 28 AND 32", 25))(lambda g: R.windows(g, R.bounded(g.depths().selectExpr("node_id", "depth_uniq AS v"), 28, 32, out=True), 25))
register(
    "g7_depth_windows_at_tips", f"SELECT w.* FROM ({_WINDOWS}) w JOIN lengths USING (path_id) WHERE start = 0 OR \"end\" = length_bp", _islands("SELECT node_id FROM depths WHERE depth BETWEEN 28 AND 32", 0)
)(lambda g: R.windows(g, R.bounded(g.depths().selectExpr("node_id", "depth AS v"), 28, 32), 0, tips=1))
register("g13_degree_windows", _WINDOWS, _islands("SELECT node_id FROM degrees WHERE degree BETWEEN 40 AND 46", 10))(lambda g: R.windows(g, R.bounded(g.degrees().selectExpr("node_id", "degree AS v"), 40, 46), 10))
register("o13_nodes_in_ranges", "SELECT DISTINCT node_id FROM hit", HIT)(lambda g: R.nodes_in_ranges(g, example_ranges(g)))
register(
    "j7_overlapping_paths",
    "SELECT DISTINCT h.path_id, h.start, h.\"end\", s.path_id AS other_id FROM (SELECT DISTINCT r.path_id, r.start, r.\"end\", node_id, is_rev FROM ranges r JOIN steps s ON r.path_id = s.path_id AND s.pos + s.len >= r.start AND s.pos < r.\"end\") h JOIN steps s ON h.node_id = s.node_id AND h.is_rev = s.is_rev WHERE h.path_id <> s.path_id",
    RANGES_SQL,
)(lambda g: R.overlapping_paths(g, example_ranges(g)))
register(
    "j16_annotate_nodes",
    "SELECT node_id, annotation, '#' || substr(sha256(annotation), 49, 2) || substr(sha256(annotation), 17, 2) || substr(sha256(annotation), 33, 2) AS color FROM (SELECT node_id, string_agg(DISTINCT label, ';' ORDER BY label) AS annotation FROM steps s JOIN (SELECT path_id, start, \"end\", 'f' || (path_id % 3) AS label FROM ranges) r ON s.path_id = r.path_id AND s.pos <= r.\"end\" AND s.pos + s.len >= r.start GROUP BY node_id)",
    RANGES_SQL,
)(lambda g: R.annotate_nodes(g, example_ranges(g).withColumn("label", F.concat(F.lit("f"), (F.col("path_id") % 3).cast("string")))))
register(
    "j15_shifted_bed",
    "SELECT name || ':' || ref_start || '-' || ref_end AS name, b.start - ref_start AS start, b.\"end\" - ref_start AS \"end\", label FROM (SELECT path_name AS name, start, \"end\", 'r' || path_id AS label FROM ranges) b JOIN (SELECT path_name AS base, (path_id % 5)::BIGINT AS ref_start, (path_id % 5 + 24)::BIGINT AS ref_end FROM paths) w ON name = base AND ref_start <= b.start AND b.\"end\" <= ref_end",
    RANGES_SQL,
)(
    lambda g: R.shifted_bed(
        example_ranges(g).select(F.col("path_name").alias("name"), "start", "end", F.concat(F.lit("r"), F.col("path_id").cast("string")).alias("label")),
        g.paths.select(F.col("path_name").alias("base"), (F.col("path_id") % 5).alias("ref_start"), (F.col("path_id") % 5 + 24).alias("ref_end")),
    )
)
register("c16_flatten", "SELECT pan_pos AS start, pan_pos + s.len AS \"end\", path_name, CASE WHEN is_rev THEN '-' ELSE '+' END AS strand, step_rank FROM steps s JOIN nodes USING (node_id) JOIN paths USING (path_id)")(R.flatten)

# --- paths and groups --------------------------------------------------------------------

register("o1_list_paths", "SELECT path_name, 1::BIGINT AS first, length_bp AS last FROM lengths")(P.list_paths)
register("o2_keep_paths", "SELECT path_id, step_rank, node_id, is_rev, len, pos FROM steps JOIN paths USING (path_id) WHERE starts_with(path_name, 'NATION_7#') OR path_name LIKE '%#BUILDING#%'")(lambda g: g.select_paths(g.paths.where("startswith(path_name, 'NATION_7#') OR path_name LIKE '%#BUILDING#%'")).steps)
register("o3_all_positions", "SELECT path_id, node_id, pos FROM steps WHERE path_id IN (SELECT path_id FROM paths WHERE starts_with(path_name, 'NATION_3#'))")(lambda g: g.select_paths(reference(g)).steps.select("path_id", "node_id", "pos"))
register("o9_drop_empty_paths", "SELECT path_id, path_name FROM lengths WHERE step_count > 0")(lambda g: P.drop_empty_paths(g).paths)
register("o16_prefix_groups", "SELECT substr(path_name, 1, 8) AS prefix, count(*) AS n FROM paths WHERE NOT starts_with(path_name, 'NATION_2') GROUP BY 1")(lambda g: g.paths.where(~F.col("path_name").startswith("NATION_2")).groupBy(F.substring("path_name", 1, 8).alias("prefix")).agg(F.count(F.lit(1)).alias("n")))
register("j18_path_groups", "SELECT path_id, split_part(path_name, '#', 1) || '#' || split_part(path_name, '#', 2) AS grp FROM paths")(haplotypes)
_SIM = f"{SAMPLES}, v AS MATERIALIZED (SELECT node_id, grp, count(*) AS n, any_value(len) AS len FROM steps JOIN samples USING (path_id) GROUP BY node_id, grp), sz AS (SELECT grp, sum(n * len)::BIGINT AS l FROM v GROUP BY grp), i AS (SELECT a.grp AS group_a, b.grp AS group_b, x.l AS a_len, y.l AS b_len, sum(a.len * least(a.n, b.n))::BIGINT AS intersection FROM v a JOIN v b USING (node_id) JOIN sz x ON x.grp = a.grp JOIN sz y ON y.grp = b.grp GROUP BY ALL)"
_J = "intersection / (a_len + b_len - intersection)"
register("g23_similarity", f"SELECT *, {_J} AS jaccard, intersection / sqrt((a_len * b_len)::DOUBLE) AS cosine, 2 * intersection / (a_len + b_len) AS dice, 2 * ({_J}) / (1 + {_J}) AS est_identity FROM i", _SIM)(lambda g: P.similarity(g, samples(g)))
register(
    "g23_distances",
    f"SELECT *, 1 - {_J} AS jaccard, 1 - intersection / sqrt((a_len * b_len)::DOUBLE) AS cosine, 1 - 2 * intersection / (a_len + b_len) AS dice, 1 - 2 * ({_J}) / (1 + {_J}) AS est_identity, sqrt((a_len + b_len - 2 * intersection)::DOUBLE) AS euclidean, a_len + b_len - 2 * intersection AS manhattan FROM i",
    _SIM,
)(lambda g: P.similarity(g, samples(g), distances=True))
register(
    "j8_path_overlaps",
    "SELECT a.grp, a.path_id AS path_a, b.path_id AS path_b, sum(a.len * least(a.n, b.n))::BIGINT AS overlap, sum(a.len * least(a.n, b.n))::BIGINT / ((x.length_bp + y.length_bp) / 2) AS fraction FROM v a JOIN v b ON a.grp = b.grp AND a.node_id = b.node_id AND a.is_rev = b.is_rev AND a.path_id < b.path_id JOIN lengths x ON x.path_id = a.path_id JOIN lengths y ON y.path_id = b.path_id GROUP BY a.grp, a.path_id, b.path_id, x.length_bp, y.length_bp",
    f"{HAPS}, v AS MATERIALIZED (SELECT path_id, grp, node_id, is_rev, count(*) AS n, any_value(len) AS len FROM steps JOIN samples USING (path_id) GROUP BY ALL)",
)(lambda g: P.path_overlaps(g, haplotypes(g)))
_PAV = f"{SEGMENTS}, {HIT}, h AS (SELECT path_id, start, \"end\", node_id, len FROM hit), whole AS (SELECT path_id, start, \"end\", sum(len) AS w FROM h GROUP BY ALL), part AS (SELECT path_id, start, \"end\", grp, sum(len) AS p FROM h JOIN (SELECT DISTINCT node_id, grp FROM steps JOIN samples USING (path_id)) USING (node_id) GROUP BY ALL), pav AS (SELECT w.path_id, w.start, w.\"end\", g.grp, coalesce(p, 0)::BIGINT / w::BIGINT AS pav FROM whole w CROSS JOIN (SELECT DISTINCT grp FROM samples) g LEFT JOIN part USING (path_id, start, \"end\", grp))"
register("g24_presence", "SELECT * FROM pav", _PAV)(lambda g: P.presence(g, example_ranges(g), segments(g)))
register("g24_presence_binary", "SELECT path_id, start, \"end\", grp, (pav >= 0.9)::INT::DOUBLE AS pav FROM pav", _PAV)(lambda g: P.presence(g, example_ranges(g), segments(g), 0.9))
register("g25_presence_matrix", "SELECT path_id, start, \"end\", max(pav) FILTER (grp = 'BUILDING') AS \"BUILDING\", max(pav) FILTER (grp = 'MACHINERY') AS \"MACHINERY\" FROM pav GROUP BY path_id, start, \"end\"", _PAV)(lambda g: P.presence_matrix(P.presence(g, example_ranges(g), segments(g)), ["BUILDING", "MACHINERY"]))
register("g26_haplotypes", "SELECT path_id, node_id, count(*) * any_value(len) AS visits FROM steps GROUP BY path_id, node_id")(lambda g: P.haplotypes(g, True))
register("g26_haplotype_matrix", "SELECT path_name, length_bp, step_count, count(node_id) FILTER (node_id = 1) AS node_1, count(node_id) FILTER (node_id = 2) AS node_2 FROM lengths LEFT JOIN steps USING (path_id) GROUP BY path_id, path_name, length_bp, step_count")(lambda g: P.haplotype_matrix(g, [1, 2]))
_CLASS = f"{SAMPLES}, cls AS MATERIALIZED (SELECT n.node_id, n.len, CASE WHEN count(DISTINCT grp) < 12 THEN 'c<12' WHEN count(DISTINCT grp) < 18 THEN '12<=c<18' ELSE 'c>=18' END AS class FROM nodes n LEFT JOIN steps USING (node_id) LEFT JOIN samples USING (path_id) GROUP BY n.node_id, n.len)"
register("g27_coverage_classes", "SELECT * FROM cls", _CLASS)(lambda g: P.coverage_classes(g, samples(g), [12, 18]))
register("g27_fraction_classes", "SELECT n.node_id, n.len, CASE WHEN count(DISTINCT grp) / (SELECT count(DISTINCT grp) FROM samples) < 0.6 THEN 'c<0.6' ELSE 'c>=0.6' END AS class FROM nodes n LEFT JOIN steps USING (node_id) LEFT JOIN samples USING (path_id) GROUP BY n.node_id, n.len", SAMPLES)(lambda g: P.coverage_classes(g, samples(g), [0.6], fraction=True))
register(
    "w3_class_ranges",
    "SELECT path_id, min(pos) AS start, max(pos + len) AS \"end\", class FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY step_rank) - row_number() OVER (PARTITION BY path_id, class ORDER BY step_rank) AS r FROM steps JOIN cls USING (node_id, len)) GROUP BY path_id, class, r",
    _CLASS,
)(lambda g: P.class_ranges(g, P.coverage_classes(g, samples(g), [12, 18])))
register(
    "w2_non_reference_ranges",
    "SELECT path_id, start, \"end\" FROM (SELECT path_id, min(pos) AS start, max(pos + len) AS \"end\" FROM (SELECT *, step_rank - row_number() OVER (PARTITION BY path_id ORDER BY step_rank) AS r FROM steps WHERE node_id NOT IN (SELECT node_id FROM steps WHERE path_id IN (SELECT path_id FROM paths WHERE starts_with(path_name, 'NATION_3#')))) GROUP BY path_id, r) WHERE \"end\" - start >= 10",
)(lambda g: P.non_reference_ranges(g, reference(g), 10))
_BASES = """cut AS MATERIALIZED (SELECT path_id, step_rank, is_rev, b + 1 AS bin, pos - pan_pos + greatest(b * 500, pan_pos) + 1 AS a, pos - pan_pos + least((b + 1) * 500, pan_pos + len) AS z FROM (SELECT s.*, pan_pos, unnest(range(pan_pos // 500, (pan_pos + s.len - 1) // 500 + 1)) AS b FROM steps s JOIN nodes USING (node_id))),
    runs AS MATERIALIZED (SELECT path_id, bin, nth, CASE WHEN is_rev THEN max(z) WHEN min(a) = max(z) THEN 0 ELSE min(a) END AS first, CASE WHEN NOT is_rev THEN max(z) WHEN min(a) = max(z) THEN 0 ELSE min(a) END AS second FROM (SELECT *, sum(new) OVER w AS nth FROM (SELECT *, CASE WHEN lag(z) OVER w + 1 = a AND lag(is_rev) OVER w = is_rev THEN 0 ELSE 1 END AS new FROM cut WINDOW w AS (PARTITION BY path_id, bin ORDER BY a)) WINDOW w AS (PARTITION BY path_id, bin ORDER BY a)) GROUP BY path_id, bin, nth, is_rev)"""
register("w15_bin_ranges", "SELECT path_id, bin, nth::BIGINT AS nth, first, second FROM runs", _BASES)(lambda g: P.bin_ranges(g, 500))
register(
    "g28_bins",
    "SELECT path_id, bin, bases / 500 AS mean_cov, rev / bases AS mean_inv, sp / bases / length_bp AS mean_pos, first_nucl, last_nucl FROM (SELECT path_id, bin, sum(z - a + 1)::BIGINT AS bases, sum(CASE WHEN is_rev THEN z - a + 1 ELSE 0 END)::BIGINT AS rev, sum((z - a + 1) * (a - 1) + (z - a + 1) * (z - a) // 2)::BIGINT AS sp FROM cut GROUP BY path_id, bin) JOIN (SELECT path_id, bin, arg_min(first, nth) AS first_nucl, arg_max(CASE WHEN second = 0 THEN first ELSE second END, nth) AS last_nucl FROM runs GROUP BY path_id, bin) USING (path_id, bin) JOIN lengths USING (path_id)",
    _BASES,
)(lambda g: P.bins(g, 500))
_STEP_BINS = "sb AS MATERIALIZED (SELECT path_id, step_rank, pan_pos // 500 + 1 AS b0, (pan_pos + s.len - 1) // 500 + 1 AS b1 FROM steps s JOIN nodes USING (node_id))"
register(
    "g29_bin_links_without_gaps",
    "SELECT j.path_id, pb AS from_bin, b0 AS to_bin FROM (SELECT *, lag(b1) OVER (PARTITION BY path_id ORDER BY step_rank) AS pb FROM sb) j WHERE abs(b0 - pb) > 1 AND (pb > b0 OR EXISTS (SELECT 1 FROM sb o WHERE o.path_id = j.path_id AND (o.b0 > pb AND o.b0 < j.b0 OR o.b1 > pb AND o.b1 < j.b0)))",
    _STEP_BINS,
)(lambda g: P.bin_links(g, 500, drop_gap_links=True))
register(
    "g29_bin_links",
    "SELECT path_id, pb AS from_bin, b0 AS to_bin FROM (SELECT *, lag(b1) OVER (PARTITION BY path_id ORDER BY step_rank) AS pb FROM sb) WHERE abs(b0 - pb) > 1 UNION ALL SELECT path_id, 0, arg_min(b0, step_rank) FROM sb GROUP BY path_id UNION ALL SELECT path_id, arg_max(b1, step_rank), 0 FROM sb GROUP BY path_id",
    _STEP_BINS,
)(lambda g: P.bin_links(g, 500))
register("g30_haplo_bins", "SELECT node_id, path_id, visits FROM (SELECT *, count(*) OVER (PARTITION BY node_id) AS k FROM (SELECT node_id, path_id, count(*) AS visits FROM steps GROUP BY node_id, path_id)) WHERE k >= 30 AND k < (SELECT count(*) FROM paths)")(lambda g: P.haplo_bins(g, 30, 1))
register(
    "g31_growth",
    "SELECT o.permutation, o.nth, sum(coalesce(sum(f.len), 0)) OVER (PARTITION BY o.permutation ORDER BY o.nth)::BIGINT AS base_pairs FROM orders o LEFT JOIN (SELECT permutation, node_id, any_value(len) AS len, min(nth) AS nth FROM steps JOIN samples USING (path_id) JOIN orders USING (grp) GROUP BY permutation, node_id) f ON o.permutation = f.permutation AND o.nth = f.nth GROUP BY o.permutation, o.nth",
    f"{SAMPLES}, orders AS MATERIALIZED (SELECT grp, p AS permutation, row_number() OVER (PARTITION BY p ORDER BY md5(p::VARCHAR || grp)) AS nth FROM (SELECT DISTINCT grp FROM samples), (SELECT unnest([0, 1, 2]) AS p))",
)(lambda g: P.growth(g, samples(g), _md5_orders(g)))
register("g40_coverage_sets", "SELECT path_set, count(*) AS n_nodes, sum(len)::BIGINT AS length FROM (SELECT node_id, any_value(len) AS len, string_agg(DISTINCT grp, ',' ORDER BY grp) AS path_set FROM steps JOIN samples USING (path_id) GROUP BY node_id) GROUP BY path_set", SEGMENTS)(lambda g: P.coverage_sets(g, segments(g)))
register("j17_self_dotplot", "SELECT a.path_id, a.pos AS from_pos, b.pos AS to_pos FROM steps a JOIN steps b USING (path_id, node_id)")(lambda g: P.self_dotplot(g, g.paths.select("path_id")))


def linear_layout(g: Graph) -> DataFrame:
    """A layout along the graph's axis: both node ends at their positions."""
    end = F.explode(F.array(F.lit(0), F.lit(1))).alias("end")
    return g.nodes.select("node_id", "pan_pos", "len", "rank", end).select("node_id", "end", (F.col("pan_pos") + F.col("end") * F.col("len")).cast("double").alias("x"), (F.col("rank") % 10).cast("double").alias("y"))


def _md5_orders(g: Graph) -> DataFrame:
    names = samples(g).select("grp").distinct().withColumn("permutation", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    key = F.md5(F.concat(F.col("permutation").cast("string"), "grp").cast("binary"))
    return names.withColumn("nth", F.row_number().over(Window.partitionBy("permutation").orderBy(key)))


# --- steps, windows and contexts ---------------------------------------------------------

_RC = "reverse(translate(seq, 'ACGTN', 'TGCAN'))"
_ORIENTED = f"CASE WHEN is_rev THEN {_RC} ELSE seq END"

register("w4_step_positions", "SELECT * FROM steps")(lambda g: g.steps)
register("w5_pangenome_positions", "SELECT node_id, seq, len, rank, pan_pos FROM nodes")(lambda g: g.nodes)
register(
    "w6_neighbour_steps", "SELECT path_id, step_rank, coalesce(lag(node_id) OVER w, 0) AS prev_id, coalesce(lead(node_id) OVER w, 0) AS next_id, row_number() OVER w - 1 AS ordinal FROM steps WINDOW w AS (PARTITION BY path_id ORDER BY step_rank)"
)(lambda g: g.steps.select("path_id", "step_rank", F.coalesce(F.lag("node_id").over(by_step()), F.lit(0)).alias("prev_id"), F.coalesce(F.lead("node_id").over(by_step()), F.lit(0)).alias("next_id"), (F.row_number().over(by_step()) - 1).alias("ordinal")))
register("w8_visit_index", "SELECT path_id, step_rank, row_number() OVER (PARTITION BY path_id, node_id ORDER BY step_rank) AS visit FROM steps")(lambda g: g.steps.select("path_id", "step_rank", F.row_number().over(Window.partitionBy("path_id", "node_id").orderBy("step_rank")).alias("visit")))
register("j2_range_steps", "SELECT path_id, start, \"end\", node_id, is_rev, overlap FROM hit", HIT)(lambda g: R.range_steps(g.steps, example_ranges(g)).select("path_id", "start", "end", "node_id", "is_rev", "overlap"))
register("j3_touching_range_steps", "SELECT r.path_id, r.start, r.\"end\", s.node_id FROM ranges r JOIN steps s ON r.path_id = s.path_id AND s.pos + s.len >= r.start AND s.pos < r.\"end\"", RANGES_SQL)(lambda g: R.range_steps(g.steps, example_ranges(g), touching=True).select("path_id", "start", "end", "node_id"))
register(
    "j10_lift_over",
    "SELECT path_name, \"offset\", node_id, is_rev, \"offset\" - tpos AS node_offset FROM (SELECT p.path_id, path_name, \"offset\" FROM positions p JOIN paths USING (path_id)) p JOIN (SELECT path_id, node_id, NOT is_rev AS is_rev, total - pos - len AS tpos, len AS tlen FROM steps JOIN (SELECT path_id, sum(len)::BIGINT AS total FROM steps GROUP BY path_id) USING (path_id)) t ON p.path_id = t.path_id AND tpos <= \"offset\" AND \"offset\" < tpos + tlen",
    POSITIONS,
)(lambda g: R.lift_over(g, _backwards(g), positions(g)))
register(
    "j13_first_hits",
    "SELECT t.path_id AS target_id, q.path_id AS query_id, min(q.step_rank) AS first_rank, max(q.step_rank) AS last_rank FROM steps q JOIN (SELECT DISTINCT path_id, node_id FROM steps JOIN paths USING (path_id) WHERE starts_with(path_name, 'NATION_3#')) t ON q.node_id = t.node_id AND q.path_id <> t.path_id GROUP BY ALL",
)(lambda g: _first_hits(g))
_CONTEXT = """ctx AS MATERIALIZED (SELECT c.path_id * 1000 + c.step_rank AS key, s.node_id, s.len FROM steps c JOIN steps s ON c.path_id = s.path_id AND (c.step_rank = s.step_rank OR (s.step_rank < c.step_rank AND c.pos - (s.pos + s.len) < 30) OR (s.step_rank > c.step_rank AND s.pos - (c.pos + c.len) < 30))),
full_ctx AS (SELECT key FROM ctx GROUP BY key HAVING sum(len) >= 60), multi AS MATERIALIZED (SELECT key, node_id, count(*) AS n, any_value(len) AS len FROM ctx WHERE key IN (SELECT key FROM full_ctx) GROUP BY key, node_id)"""
register("w9_step_contexts", "SELECT * FROM multi", _CONTEXT)(lambda g: C.contexts(g, _all_steps(g)))
register(
    "w10_context_jaccard",
    "SELECT p.l AS \"left\", p.r AS \"right\", coalesce(i, 0)::BIGINT / (coalesce(a.s, 0) + coalesce(b.s, 0) - coalesce(i, 0))::BIGINT AS jaccard FROM prs p LEFT JOIN sz a ON a.key = p.l LEFT JOIN sz b ON b.key = p.r LEFT JOIN (SELECT x.key AS l, y.key AS r, sum(x.len * least(x.n, y.n)) AS i FROM prs JOIN multi x ON x.key = prs.l JOIN multi y ON y.key = prs.r AND x.node_id = y.node_id GROUP BY x.key, y.key) USING (l, r) WHERE a.s IS NOT NULL OR b.s IS NOT NULL",
    f"{_CONTEXT}, sz AS (SELECT key, sum(n * len) AS s FROM multi GROUP BY key), prs AS MATERIALIZED (SELECT a.path_id * 1000 + a.step_rank AS l, b.path_id * 1000 + b.step_rank AS r FROM steps a JOIN steps b ON a.node_id = b.node_id AND a.path_id < b.path_id)",
)(lambda g: _context_pairs(g))
register(
    "j14_map_segments",
    "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_start ORDER BY jaccard DESC, query_id = target_id DESC, inverted DESC, target_id DESC, target_start DESC) AS k FROM (SELECT q.path_id AS query_id, q.start AS query_start, q.\"end\" AS query_end, t.path_id AS target_id, t.start AS target_start, t.\"end\" AS target_end, i::BIGINT / (q.\"end\" - q.start + t.\"end\" - t.start - i)::BIGINT AS jaccard, inv * 2 > i AS inverted FROM m JOIN seg q ON q.path_id = m.qp AND q.start = m.qs JOIN seg t ON t.path_id = m.tp AND t.start = m.ts)) WHERE k = 1",
    """seg AS MATERIALIZED (SELECT path_id, start, lead(start, 1, total) OVER (PARTITION BY path_id ORDER BY start) AS "end" FROM (SELECT path_id, min(pos) AS start, sum(sum(len)) OVER (PARTITION BY path_id)::BIGINT AS total FROM steps GROUP BY path_id, step_rank // 2)),
    vis AS MATERIALIZED (SELECT g.path_id, g.start, s.node_id, s.len, s.is_rev, row_number() OVER (PARTITION BY g.path_id, g.start, s.node_id ORDER BY step_rank) AS k FROM steps s JOIN seg g ON s.path_id = g.path_id AND s.pos >= g.start AND s.pos < g."end"),
    m AS (SELECT a.path_id AS qp, a.start AS qs, b.path_id AS tp, b.start AS ts, sum(a.len)::BIGINT AS i, sum(CASE WHEN a.is_rev <> b.is_rev THEN a.len ELSE 0 END)::BIGINT AS inv FROM vis a JOIN vis b ON a.node_id = b.node_id AND a.k = b.k GROUP BY ALL)""",
)(lambda g: _pair_segments(g))

# --- sequences and files -----------------------------------------------------------------

register(
    "f_scalar_functions",
    f"SELECT node_id, {_RC} AS rc, regexp_replace(seq, 'N+', 'N', 'g') AS crushed, (length(seq) - length(replace(seq, 'N', '')))::BIGINT AS uncalled, substr({_RC}, 1, 1) AS first_rev, least(1.0, round(-ln(2.0 * ((1 + node_id % 7) / 8.0) / (1 + (1 + node_id % 7) / 8.0)), 9))::DOUBLE AS dist, (node_id & 15)::BIGINT AS mod16 FROM nodes",
)(
    lambda g: g.nodes.select(
        "node_id", dna.reverse_complement(F.col("seq")).alias("rc"), dna.crush_n(F.col("seq")).alias("crushed"), dna.uncalled(F.col("seq")).cast("long").alias("uncalled"), F.substring(dna.oriented(F.col("seq"), F.lit(True)), 1, 1).alias("first_rev"),
        F.least(F.lit(1.0), F.round(-F.log(2.0 * ((1 + F.col("node_id") % 7) / 8.0) / (1 + (1 + F.col("node_id") % 7) / 8.0)), 9)).alias("dist"), F.col("node_id").bitwiseAND(15).alias("mod16"),
    )
)
register(
    "f_path_names",
    "SELECT path_id, split_part(path_name, '#', 1) AS sample, split_part(path_name, '#', 1) || '#' || split_part(path_name, '#', 2) AS haplotype, path_name || ':' || 3 || '-' || 9 AS sub, regexp_replace(path_name, '#[^#]*$', '') AS before_last FROM paths",
)(lambda g: g.paths.select("path_id", sample_of(F.col("path_name")).alias("sample"), haplotype_of(F.col("path_name")).alias("haplotype"), names.subpath(F.col("path_name"), F.lit(3), F.lit(9)).alias("sub"), names.prefix(F.col("path_name"), "#", 7).alias("before_last")))
register("s15_path_fasta", f"SELECT path_id, '>' || path_name || chr(10) || coalesce(s, '') AS value FROM paths LEFT JOIN (SELECT path_id, string_agg({_ORIENTED}, '' ORDER BY step_rank) AS s FROM steps JOIN nodes USING (node_id, len) GROUP BY path_id) USING (path_id)")(gfa.path_fasta)
register("s15_flat_fasta", "SELECT -1::BIGINT AS line, '>flat' AS value UNION ALL SELECT i, substr(s, (i * 80 + 1)::BIGINT, 80) FROM (SELECT s, unnest(range(0, (length(s) + 79) // 80)) AS i FROM (SELECT string_agg(seq, '' ORDER BY rank) AS s FROM nodes))")(lambda g: gfa.flat_fasta(g, "flat"))
_SIGN = "CASE WHEN {} THEN '-' ELSE '+' END"
register(
    "s6_gfa_lines",
    f"SELECT 'H' || chr(9) || 'VN:Z:1.0' AS value UNION ALL SELECT concat_ws(chr(9), 'S', node_id, seq, 'DP:i:' || depth, 'RC:i:' || depth * len) FROM nodes JOIN depths USING (node_id) UNION ALL SELECT concat_ws(chr(9), 'L', from_id, {_SIGN.format('from_rev')}, to_id, {_SIGN.format('to_rev')}, '0M') FROM edges UNION ALL SELECT concat_ws(chr(9), 'P', path_name, coalesce(w, ''), '*') FROM paths LEFT JOIN (SELECT path_id, string_agg(node_id || {_SIGN.format('is_rev')}, ',' ORDER BY step_rank) AS w FROM steps GROUP BY path_id) USING (path_id)",
)(lambda g: gfa.gfa_lines(g, annotate=True).select("value"))

# --- graphs from graphs ------------------------------------------------------------------

register("m4_chop", "SELECT row_number() OVER (ORDER BY rank, k) AS node_id, substr(seq, (k * 16 + 1)::BIGINT, 16) AS seq FROM (SELECT rank, seq, unnest(range(0, (len + 15) // 16)) AS k FROM nodes)")(lambda g: M.chop(g, 16).nodes.select("node_id", "seq"))
register(
    "m4_chop_steps",
    "SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY step_rank, CASE WHEN is_rev THEN -k ELSE k END) - 1 AS step_rank, p.node_id, is_rev FROM steps s JOIN piece p ON p.old = s.node_id",
    "piece AS (SELECT row_number() OVER (ORDER BY rank, k) AS node_id, old, k FROM (SELECT rank, node_id AS old, unnest(range(0, (len + 15) // 16)) AS k FROM nodes))",
)(lambda g: M.chop(g, 16).steps.select("path_id", "step_rank", "node_id", "is_rev"))
register("m8_crush", "SELECT node_id, regexp_replace(seq, 'N+', 'N', 'g') AS seq FROM nodes")(lambda g: M.crush(g).nodes.select("node_id", "seq"))
register(
    "m9_flip_paths",
    "SELECT s.path_id, path_name || CASE WHEN t THEN '_inv' ELSE '' END AS path_name, CASE WHEN t THEN n - 1 - step_rank ELSE step_rank END AS step_rank, node_id, is_rev <> t AS is_rev FROM steps s JOIN (SELECT path_id, count(*) AS n, sum(CASE WHEN is_rev THEN len ELSE -len END) > 0 AS t FROM steps GROUP BY path_id) USING (path_id) JOIN paths USING (path_id)",
)(lambda g: (lambda f: f.steps.join(f.paths, "path_id").select("path_id", "path_name", "step_rank", "node_id", "is_rev"))(M.flip_paths(g)))
register(
    "m10_inject",
    "SELECT 'r' || path_id AS path_name, string_agg(b, '' ORDER BY p) AS seq FROM (SELECT r.path_id, s.pos + i AS p, o[(i + 1)::BIGINT] AS b FROM ranges r JOIN (SELECT path_id, pos, o, unnest(range(0, len)) AS i FROM (SELECT s.path_id, s.pos, s.len, CASE WHEN is_rev THEN reverse(translate(seq, 'ACGTN', 'TGCAN')) ELSE seq END AS o FROM steps s JOIN nodes USING (node_id))) s ON r.path_id = s.path_id AND s.pos + i >= r.start AND s.pos + i < r.\"end\") GROUP BY path_id",
    RANGES_SQL,
)(lambda g: _injected(g))
register("m20_reverse_order", "SELECT (SELECT count(*) FROM nodes) - rank AS node_id, seq FROM nodes")(lambda g: M.renumber(g, O.reverse(g)).nodes.select("node_id", "seq"))
register("t13_target_order", "SELECT node_id, row_number() OVER (ORDER BY a IS NULL, coalesce(a, rank), coalesce(b, 0), node_id) - 1 AS nth FROM nodes LEFT JOIN (SELECT node_id, min(path_id) AS a, arg_min(r, path_id) AS b FROM (SELECT node_id, path_id, min(step_rank) AS r FROM steps JOIN paths USING (path_id) WHERE starts_with(path_name, 'NATION_3#') GROUP BY ALL) GROUP BY node_id) USING (node_id)")(lambda g: O.by_paths(g, reference(g)))
register("u1_squeeze", "SELECT node_id, seq FROM nodes UNION ALL SELECT node_id + (SELECT max(node_id) FROM nodes), seq FROM nodes")(lambda g: M.squeeze([g, g], "_").nodes.select("node_id", "seq"))
register("u2_common_paths", "SELECT path_name FROM paths WHERE path_name LIKE '%#BUILDING#%' INTERSECT SELECT path_name FROM lengths WHERE length_bp > 50")(lambda g: g.paths.where("path_name LIKE '%#BUILDING#%'").select("path_name").intersect(g.path_lengths().where("length_bp > 50").select("path_name")))
register("u5_inverse_extract", "SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM degrees WHERE degree > 40)")(lambda g: M.extract(g, g.degrees().where("degree > 40").select("node_id"), inverse=True, max_gap=0).nodes.select("node_id"))


def _filled(gap: int, rounds: int) -> str:
    """Views k0, k1, ...: kept nodes before and after each round of gap filling, and the paths that ranges do not name."""
    views = "k0 AS MATERIALIZED (SELECT DISTINCT node_id FROM hit JOIN paths USING (path_id) WHERE starts_with(path_name, 'NATION_3#')), others AS MATERIALIZED (SELECT s.* FROM steps s JOIN paths USING (path_id) WHERE NOT starts_with(path_name, 'NATION_3#'))"
    for i in range(rounds):
        flagged = f"SELECT o.*, k.node_id IS NOT NULL AS kept FROM others o LEFT JOIN k{i} k USING (node_id)"
        views += (
            f", k{i + 1} AS MATERIALIZED (SELECT node_id FROM k{i} UNION SELECT node_id FROM (SELECT *, max(CASE WHEN kept THEN pos + len END) OVER (PARTITION BY path_id ORDER BY step_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,"
            f" min(CASE WHEN kept THEN pos END) OVER (PARTITION BY path_id ORDER BY step_rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM ({flagged})) WHERE NOT kept AND b - a <= {gap})"
        )
    return f"{HIT}, {views}"


def _extracted(last: str) -> str:
    return (
        "SELECT path_name || CASE WHEN s = 0 AND e = length_bp THEN '' ELSE ':' || s || '-' || e END AS path_name, n AS step_count FROM ("
        f"SELECT path_id, min(pos) AS s, max(pos + len) AS e, count(*) AS n FROM (SELECT *, step_rank - row_number() OVER (PARTITION BY path_id ORDER BY step_rank) AS r FROM others WHERE node_id IN (SELECT node_id FROM {last})) GROUP BY path_id, r "
        "UNION ALL SELECT path_id, min(pos), max(pos + len), count(*) FROM hit JOIN paths USING (path_id) WHERE starts_with(path_name, 'NATION_3#') GROUP BY path_id) JOIN lengths USING (path_id)"
    )


def _of_reference(g: Graph, **more) -> DataFrame:
    return M.extract(g, ranges=example_ranges(g).join(reference(g), "path_id", "left_semi"), **more).path_lengths().select("path_name", "step_count")


register("m14_extract_ranges", _extracted("k6"), _filled(300_000, 6))(_of_reference)
register("m14_extract_small_gaps", _extracted("k1"), _filled(20, 1))(lambda g: _of_reference(g, max_gap=20, gap_rounds=1))
register("m11_prune", "SELECT node_id FROM degrees WHERE degree <= 50")(lambda g: M.prune(g, max_degree=50).nodes.select("node_id"))
_GROW = "SELECT t.node_id, min(least(t.l, u.l)) AS l FROM {} t JOIN nbrs ON t.node_id = nbrs.a JOIN {} u ON u.node_id = nbrs.b GROUP BY t.node_id"
_LABELS = "nbrs AS MATERIALIZED (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges UNION SELECT node_id, node_id FROM nodes), l0 AS (SELECT node_id, node_id AS l FROM nodes), " + ", ".join(f"l{i + 1} AS MATERIALIZED ({_GROW.format(f'l{i}', f'l{i}')})" for i in range(8))
register("c1_components", "SELECT node_id, l AS component FROM l8", _LABELS)(S.components)
register(
    "g33_component_sizes",
    "SELECT component, n_nodes, bp, coalesce(longest_path, 0)::BIGINT AS longest_path, coalesce(path_mass, 0)::BIGINT AS path_mass FROM (SELECT l AS component, count(*) AS n_nodes, sum(len)::BIGINT AS bp FROM l8 JOIN nodes USING (node_id) GROUP BY l) LEFT JOIN (SELECT component, max(x) AS longest_path, sum(x) AS path_mass FROM (SELECT l AS component, path_id, sum(len) AS x FROM steps JOIN l8 USING (node_id) GROUP BY ALL) GROUP BY component) USING (component)",
    _LABELS,
)(S.component_sizes)
_WAYS = "ways AS MATERIALIZED (SELECT (from_id - 1) * 2 + from_rev::INT AS h, (to_id - 1) * 2 + to_rev::INT AS t FROM edges UNION SELECT (to_id - 1) * 2 + (NOT to_rev)::INT, (from_id - 1) * 2 + (NOT from_rev)::INT FROM edges)"
register("c6_distances", "SELECT h, min(k) AS steps FROM (SELECT 0 AS h, 0 AS k UNION ALL SELECT t, 1 FROM ways WHERE h = 0 UNION ALL SELECT b.t, 2 FROM ways a JOIN ways b ON b.h = a.t WHERE a.h = 0) GROUP BY h", _WAYS)(lambda g: T.distances(g, g.nodes.where("node_id = 1").select(F.lit(0).cast("long").alias("h")), 2))
_KMERS = f"{_WAYS}, o AS MATERIALIZED (SELECT (node_id - 1) * 2 AS h, node_id, FALSE AS is_rev, seq, len FROM nodes UNION ALL SELECT (node_id - 1) * 2 + 1, node_id, TRUE, {_RC}, len FROM nodes), km AS (SELECT node_id, is_rev, i AS \"offset\", h, substr(seq, (i + 1)::BIGINT, 3) AS kmer FROM (SELECT *, unnest(range(0, len)) AS i FROM o) UNION ALL SELECT km.node_id, km.is_rev, \"offset\", t, substr(kmer || o.seq, 1, 3) FROM km JOIN ways USING (h) JOIN o ON o.h = t WHERE length(kmer) < 3)"
register("c9_kmers", "SELECT kmer, node_id, is_rev, \"offset\"::INT AS \"offset\" FROM km WHERE length(kmer) = 3", _KMERS)(lambda g: T.kmers(g, 3))
register("g36_unique_kmers", "SELECT count(DISTINCT kmer) AS unique_kmers FROM km WHERE length(kmer) = 3", _KMERS)(lambda g: T.unique_kmers(g, 3))
register(
    "g35_node_tension",
    "SELECT node_id, r * depth AS total, CASE WHEN depth > 0 THEN r END AS mean FROM (SELECT node_id, CASE WHEN r < 1 THEN 1 / r ELSE r END AS r FROM (SELECT node_id, (len + 3.0)::DOUBLE / len AS r FROM nodes)) JOIN depths USING (node_id)",
)(lambda g: O.tension(g, _stretched(g)))
register("sw1_alignments")(lambda g: _neighbour_alignments(g))
register("c14_untangle")(lambda g: C.untangle(g, g.paths, reference(g)))
register("c12_break_points")(lambda g: C.break_points(g, reference(g), g.paths, 100))
register("t1_topological_order")(lambda g: O.topological(g))


def _backwards(g: Graph) -> Graph:
    """Every path turned over."""
    n = g.steps.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))
    s = g.steps.join(n, "path_id").select("path_id", (F.col("n") - 1 - F.col("step_rank")).alias("step_rank"), "node_id", (~F.col("is_rev")).alias("is_rev"))
    return g.with_(steps=with_positions(s, g.nodes))


def _first_hits(g: Graph) -> DataFrame:
    t = g.steps.join(reference(g), "path_id", "left_semi").select(F.col("path_id").alias("target_id"), "node_id").distinct()
    q = g.steps.select(F.col("path_id").alias("query_id"), "node_id", "step_rank")
    return q.join(t, "node_id").where("target_id <> query_id").groupBy("target_id", "query_id").agg(F.min("step_rank").alias("first_rank"), F.max("step_rank").alias("last_rank"))


def _all_steps(g: Graph) -> DataFrame:
    place = [F.col("node_id").alias("own"), F.col("pos").alias("cpos"), F.col("len").alias("clen")]
    return g.steps.select((F.col("path_id") * 1000 + F.col("step_rank")).alias("key"), "path_id", "step_rank", F.lit(30).alias("before"), F.lit(30).alias("after"), *place)


def _context_pairs(g: Graph) -> DataFrame:
    """How alike the contexts of any two steps of two paths on one node are, where at least one is whole.

    A step's context is put together where its path lies and goes to the node once; pairs are compared
    where they meet and never move.
    """
    at = _all_steps(g)
    if g.steps.groupBy("path_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1000").isEmpty():
        c = C.context_lists(g, at, "before", "after", "path_id", "own").withColumnRenamed("own", "node_id")
    else:  # numbers of two paths' steps may be equal
        c = C.context_lists(g, at).join(at.select("key", "path_id", F.col("own").alias("node_id")), "key", "right")
    c = c.withColumn("context", F.coalesce("context", C.no_context())).withColumn("all", C.bases("context")).withColumn("own", C.bases(F.filter("context", lambda x: x["node_id"] == F.col("node_id"))))
    of = lambda k: c.select("node_id", F.col("path_id").alias(f"p_{k}"), F.col("key").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("context", "all", "own")])
    pairs = of("left").join(of("right"), "node_id").where("p_left < p_right AND (all_left > 0 OR all_right > 0)")
    # Most pairs share the node they meet on and no other.
    shared = F.size(F.array_intersect("context_left.node_id", "context_right.node_id"))
    i = F.when(shared == 0, 0).when(shared == 1, F.least("own_left", "own_right")).otherwise(C.shared_bases(F.col("context_left"), F.col("context_right")))
    pairs = pairs.select("left", "right", (F.col("all_left") + F.col("all_right")).alias("both"), i.alias("i"))
    return pairs.select("left", "right", (F.col("i") / (F.col("both") - F.col("i"))).alias("jaccard"))


def _pairs_of_steps(g: Graph) -> DataFrame:
    """Each path in segments of two steps."""
    return g.steps.groupBy("path_id", F.expr("step_rank div 2").alias("k")).agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("end")).drop("k")


def _pair_segments(g: Graph) -> DataFrame:
    """The best match of each segment of two steps among all."""
    g = C.with_visits(g)
    s = _pairs_of_steps(g)
    return C.map_segments(g, s, s).drop("self_coverage", "nth")


def _injected(g: Graph) -> DataFrame:
    r = example_ranges(g).select("path_id", "start", "end", F.concat(F.lit("r"), F.col("path_id").cast("string")).alias("name"))
    # A path may end before its range does, or before it starts.
    r = r.join(g.path_lengths().select("path_id", "length_bp"), "path_id").where("start < length_bp").drop("length_bp")
    f = gfa.path_fasta(M.injected_paths(g, r))
    return f.select(F.substring_index(F.expr("substring(value, 2)"), "\n", 1).alias("path_name"), F.substring_index("value", "\n", -1).alias("seq"))


def _stretched(g: Graph) -> DataFrame:
    """Each node drawn three units longer than it is."""
    end = F.explode(F.array(F.lit(0), F.lit(1))).alias("end")
    return g.nodes.select("node_id", "len", end).select("node_id", "end", (F.col("end") * (F.col("len") + 3)).cast("double").alias("x"), F.lit(0.0).alias("y"))


def _neighbour_alignments(g: Graph) -> DataFrame:
    """Each node aligned with the next by id."""
    a, b = g.nodes.select("node_id", F.col("seq").alias("a")), g.nodes.select((F.col("node_id") - 1).alias("node_id"), F.col("seq").alias("b"))
    return local_alignments(a.join(b, "node_id"))


# --- structure ---------------------------------------------------------------------------


def thin(g: Graph) -> Graph:
    """Only the edges that paths walk twice or more."""
    return g.with_(edges=E.edge_walks(g).where("n >= 2").select("from_id", "from_rev", "to_id", "to_rev"))


def _ways(edges: str) -> str:
    """Oriented nodes as integers: ``hs`` all of them, ``hw`` each with those that may follow."""
    return (
        "hs AS MATERIALIZED (SELECT (node_id - 1) * 2 + b AS h, node_id, len FROM nodes, (VALUES (0), (1)) v(b)), "
        f"hw AS MATERIALIZED (SELECT (from_id - 1) * 2 + from_rev::INT AS h, (to_id - 1) * 2 + to_rev::INT AS t FROM {edges} UNION SELECT (to_id - 1) * 2 + (NOT to_rev)::INT, (from_id - 1) * 2 + (NOT from_rev)::INT FROM {edges})"
    )


THIN = f"thin AS MATERIALIZED (SELECT from_id, from_rev, to_id, to_rev FROM walked GROUP BY ALL HAVING count(*) >= 2), {_ways('thin')}"
SIDES = (
    "meet AS MATERIALIZED (SELECT h, t FROM hw UNION SELECT t, h FROM hw), reach AS (SELECT h, h AS r FROM hs UNION SELECT reach.h, meet.t FROM reach JOIN meet ON reach.r = meet.h), side AS MATERIALIZED (SELECT h, min(r) AS c FROM reach GROUP BY h), "
    "turned AS MATERIALIZED (SELECT a.h // 2 + 1 AS node_id, least(a.c, b.c) // 2 + 1 AS component, b.c < a.c AS flip, a.c <> b.c AS oriented FROM side a JOIN side b ON b.h = a.h + 1 WHERE a.h % 2 = 0), "
    "tips AS MATERIALIZED (SELECT node_id, h NOT IN (SELECT t FROM hw) AS head, h NOT IN (SELECT h FROM hw) AS tail FROM hs WHERE h % 2 = 0)"
)
register("c2_component_ends", "SELECT component, count(*) FILTER (head) AS heads, count(*) FILTER (tail) AS tails FROM turned JOIN tips USING (node_id) GROUP BY component", f"{THIN}, {SIDES}")(lambda g: T.component_ends(thin(g)))
register("c3_orientations", "SELECT * FROM turned", f"{THIN}, {SIDES}")(lambda g: X.orientations(thin(g)))
register(
    "c3_nice_components",
    "SELECT component, oriented, acyclic, nice, CASE WHEN nice THEN heads ELSE 0 END AS heads FROM (SELECT *, oriented AND acyclic AND (turned = 0 OR straight = 0) AS nice FROM (SELECT component, bool_and(oriented) AS oriented, bool_and(node_id NOT IN (SELECT h // 2 + 1 FROM onward WHERE h = t)) AS acyclic, count(*) FILTER ((head OR tail) AND flip) AS turned, count(*) FILTER ((head OR tail) AND NOT flip) AS straight, count(*) FILTER (head) AS heads FROM turned JOIN tips USING (node_id) GROUP BY component))",
    f"{THIN}, {SIDES}, onward AS (SELECT h, t FROM hw UNION SELECT o.h, w.t FROM onward o JOIN hw w ON o.t = w.h)",
)(lambda g: X.nice_components(thin(g)))
register("c4_acyclic_components", "SELECT component, bool_and(node_id NOT IN (SELECT h // 2 + 1 FROM onward WHERE h = t)) AS acyclic FROM turned GROUP BY component", f"{THIN}, {SIDES}, onward AS (SELECT h, t FROM hw UNION SELECT o.h, w.t FROM onward o JOIN hw w ON o.t = w.h)")(lambda g: T.acyclic_components(thin(g)))
# The part around the handle with most ways, and what is left, pair by pair.
register(
    "c5_strong_components",
    "SELECT node_id, CASE WHEN node_id IN (SELECT h // 2 + 1 FROM core) THEN (SELECT min(h) // 2 + 1 FROM core) ELSE coalesce((SELECT min(least(a.h, a.t)) // 2 + 1 FROM onward a JOIN onward b ON a.h = b.t AND a.t = b.h WHERE a.h // 2 + 1 = n.node_id), node_id) END AS component FROM nodes n",
    f"{_ways('edges')}, hub AS (SELECT h FROM hw GROUP BY h ORDER BY count(*) DESC, h LIMIT 1), ahead AS (SELECT h FROM hub UNION SELECT t FROM ahead JOIN hw USING (h)), behind AS (SELECT h FROM hub UNION SELECT hw.h FROM behind JOIN hw ON behind.h = hw.t), core AS MATERIALIZED (SELECT h FROM ahead INTERSECT SELECT h FROM behind), "
    "left_over AS MATERIALIZED (SELECT h, t FROM hw WHERE h NOT IN (SELECT h FROM core) AND t NOT IN (SELECT h FROM core)), onward AS (SELECT h, t FROM left_over UNION SELECT o.h, w.t FROM onward o JOIN left_over w ON o.t = w.h)",
)(X.strong_nodes)
_HEAVIEST = "counted AS (SELECT (from_id - 1) * 2 + from_rev::INT AS a, (to_id - 1) * 2 + to_rev::INT AS b, count(*) AS n FROM walked GROUP BY ALL), heaviest AS MATERIALIZED (SELECT h, arg_min(t, (-n, t)) AS t FROM (SELECT a AS h, b AS t, n FROM counted UNION SELECT xor(b, 1), xor(a, 1), n FROM counted) GROUP BY h)"
register("c11_heaviest_ways", "SELECT h, t FROM heaviest", _HEAVIEST)(X.heaviest_ways)
register("c5_heaviest_cycles", "SELECT a.h AS node, least(a.h, min(a.t)) AS component FROM onward a JOIN onward b ON a.h = b.t AND a.t = b.h WHERE a.h <> a.t GROUP BY a.h", f"{_HEAVIEST}, onward AS (SELECT h, t FROM heaviest UNION SELECT o.h, w.t FROM onward o JOIN heaviest w ON o.t = w.h)")(
    lambda g: strong_components(X.heaviest_ways(g), "h", "t")
)
_NEAR = "dist{0} AS (SELECT h, 0 AS d FROM hs JOIN tips USING (node_id) WHERE {1} UNION SELECT {2}, d + len FROM dist{0} w JOIN hs USING (h) JOIN hw e ON e.{3} = w.h WHERE d + len <= 500)"
register(
    "c8_distances_to_ends",
    "SELECT node_id, min(a.d) AS to_head, min(b.d) AS to_tail FROM hs LEFT JOIN dist0 a USING (h) LEFT JOIN dist1 b USING (h) WHERE h % 2 = 0 GROUP BY node_id",
    f"{THIN}, {SIDES}, {_NEAR.format(0, 'head', 'e.t', 'h')}, {_NEAR.format(1, 'tail', 'e.h', 't')}",
)(lambda g: X.distances_to_ends(thin(g), 500))
register(
    "c8_connecting",
    "SELECT h // 2 + 1 AS node_id, h % 2 = 1 AS is_rev, a.d AS from_start, b.d AS to_end FROM (SELECT h, min(d) AS d FROM ahead GROUP BY h) a JOIN (SELECT h, min(d) AS d FROM back GROUP BY h) b USING (h) WHERE a.d + b.d <= 90",
    f"{_ways('edges')}, ahead AS (SELECT 0 AS h, 0 AS d UNION SELECT t, d + len FROM ahead JOIN hs USING (h) JOIN hw USING (h) WHERE d + len <= 90), back AS (SELECT 4 AS h, 0 AS d UNION SELECT hw.h, d + hs.len FROM back JOIN hw ON hw.t = back.h JOIN hs ON hs.h = hw.h WHERE d + hs.len <= 90)",
)(lambda g: X.connecting(g, (1, False, 0), (3, False, 0), 90))
register("t16_largest_components", "SELECT component, count(*) AS n_nodes, sum(len)::BIGINT AS bp FROM turned JOIN nodes USING (node_id) GROUP BY component ORDER BY bp DESC, component LIMIT 10", f"{THIN}, {SIDES}")(lambda g: S.largest_components(thin(g), 10).select("component", "n_nodes", "bp"))
register("t15_id_order", "SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS nth FROM nodes")(O.by_id)
register("t12_given_order", "SELECT node_id, row_number() OVER (ORDER BY len DESC, node_id) - 1 AS nth FROM nodes")(lambda g: O.given(dense_index(g.nodes.select("node_id", (-F.col("len")).alias("k")), ["k", "node_id"], "nth")))
register("o8_isolated_nodes", "SELECT any_value(node_id) AS node_id FROM steps WHERE path_id IN (SELECT path_id FROM lengths WHERE step_count = 1) GROUP BY node_id HAVING count(*) = 1")(lambda g: M.isolated_nodes(_single_steps(g)))
register(
    "m2_divide",
    "SELECT row_number() OVER (ORDER BY rank, k) AS node_id, piece AS seq FROM (SELECT rank, 0 AS k, substr(seq, 1, CASE WHEN len > 1 THEN len // 2 ELSE len END) AS piece FROM nodes UNION ALL SELECT rank, 1, substr(seq, len // 2 + 1) FROM nodes WHERE len > 1)",
)(lambda g: M.divide(g, g.nodes.select("node_id", F.floor(F.col("len") / 2).alias("offset"))).nodes.select("node_id", "seq"))


def _single_steps(g: Graph) -> Graph:
    """The paths of one step alone, without edges."""
    one = g.select_paths(g.path_lengths().where("step_count = 1"))
    return one.with_(edges=one.edges.limit(0))


# --- number functions ----------------------------------------------------------------------

_DJB2 = "list_reduce(list_concat([5381::HUGEINT], list_transform(string_split(seq, ''), lambda c: ord(c)::HUGEINT)), lambda h, c: (h * 33 + c) % {})"
register("f9_djb2_hashes", f"SELECT node_id, ({_DJB2.format('4294967296')})::BIGINT AS djb2_32, ({_DJB2.format('18446744073709551616')})::VARCHAR AS djb2_64 FROM nodes")(
    lambda g: g.nodes.select("node_id", numbers.djb2(F.col("seq"), 32).alias("djb2_32"), numbers.djb2(F.col("seq")).cast("string").alias("djb2_64"))
)
_DISTANCE = "least(1.0, ln((1.0 + j) / (2.0 * j)))"
register("f14_distances", f"SELECT group_a, group_b, round({_DISTANCE}, 9)::DOUBLE AS distance, round((1.0 - {_DISTANCE}) * 100.0, 7)::DOUBLE AS identity FROM (SELECT *, intersection / (a_len + b_len - intersection) AS j FROM i)", _SIM)(
    lambda g: P.similarity(g, samples(g)).select("group_a", "group_b", F.round(numbers.mash_distance(F.col("jaccard")), 9).alias("distance"), F.round(numbers.percent_identity(F.col("jaccard")), 7).alias("identity"))
)
# The quarter of each level, finest first, turns and shifts the point built so far.
_QUARTER = "SELECT *, (d // (side * side)) % 4 AS q FROM curve"
register(
    "f16_hilbert_start",
    'SELECT node_id, "end", x::DOUBLE AS x, y::DOUBLE AS y FROM curve WHERE side = (SELECT side FROM square)',
    "square AS (SELECT min(s) AS side FROM (SELECT (1::BIGINT << k) AS s FROM range(1, 40) t(k)) WHERE s >= (SELECT 2 * count(*) FROM nodes)), "
    'curve AS (SELECT node_id, "end", rank * 2 + "end" AS d, 1::BIGINT AS side, 0::BIGINT AS x, 0::BIGINT AS y FROM nodes, (VALUES (0), (1)) v("end") '
    f"UNION ALL SELECT node_id, \"end\", d, side * 2, CASE q WHEN 0 THEN y WHEN 3 THEN side - 1 - y ELSE x END + CASE WHEN q >= 2 THEN side ELSE 0 END, CASE q WHEN 0 THEN x WHEN 3 THEN side - 1 - x ELSE y END + CASE WHEN q IN (1, 2) THEN side ELSE 0 END FROM ({_QUARTER}) WHERE side < (SELECT side FROM square))",
)(lambda g: O.layout_start(g, "h"))


# --- mappings as files, and edges pruned -----------------------------------------------------

# Segments of two steps, mapped to those of the reference paths; the best two of each.
_MAPPED = """seg AS MATERIALIZED (SELECT path_id, start, lead(start, 1, total) OVER (PARTITION BY path_id ORDER BY start) AS "end" FROM (SELECT path_id, min(pos) AS start, sum(sum(len)) OVER (PARTITION BY path_id)::BIGINT AS total FROM steps GROUP BY path_id, step_rank // 2)),
own AS (SELECT path_id, node_id, count(*) AS visits FROM steps GROUP BY ALL),
vis AS MATERIALIZED (SELECT g.path_id, g.start, s.node_id, s.len, s.is_rev, visits, row_number() OVER (PARTITION BY g.path_id, g.start, s.node_id ORDER BY step_rank) AS k FROM steps s JOIN own USING (path_id, node_id) JOIN seg g ON s.path_id = g.path_id AND s.pos >= g.start AND s.pos < g."end"),
cover AS (SELECT path_id, start, sum(visits * len) / sum(len) AS self_coverage FROM vis GROUP BY ALL),
met AS (SELECT a.path_id AS qp, a.start AS qs, b.path_id AS tp, b.start AS ts, sum(a.len)::BIGINT AS i, sum(CASE WHEN a.is_rev <> b.is_rev THEN a.len ELSE 0 END)::BIGINT AS inv FROM vis a JOIN (SELECT * FROM vis JOIN paths USING (path_id) WHERE starts_with(path_name, 'NATION_3#')) b ON a.node_id = b.node_id AND a.k = b.k GROUP BY ALL),
shares AS (SELECT q.path_id AS query_id, q.start AS query_start, q."end" AS query_end, t.path_id AS target_id, t.start AS target_start, t."end" AS target_end, i::BIGINT / (q."end" - q.start + t."end" - t.start - i)::BIGINT AS jaccard, inv * 2 > i AS inverted FROM met JOIN seg q ON q.path_id = qp AND q.start = qs JOIN seg t ON t.path_id = tp AND t.start = ts),
mapped AS MATERIALIZED (SELECT shares.*, self_coverage, nth, ql.path_name AS query_name, ql.length_bp AS query_length, tl.path_name AS target_name, tl.length_bp AS target_length, CASE WHEN inverted THEN '-' ELSE '+' END AS strand
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, query_start ORDER BY jaccard DESC, query_id = target_id DESC, inverted DESC, target_id DESC, target_start DESC) AS nth FROM shares) shares JOIN cover ON cover.path_id = query_id AND cover.start = query_start JOIN lengths ql ON ql.path_id = query_id JOIN lengths tl ON tl.path_id = target_id WHERE nth <= 2)"""


def _on_mapped(g: Graph, write: Callable[[Graph, DataFrame], DataFrame]) -> DataFrame:
    """What ``write`` makes of the graph and the mappings of all paths to the reference."""
    g = C.with_visits(g)
    s = _pairs_of_steps(g)
    return write(g, C.map_segments(g, s, s.join(reference(g), "path_id", "left_semi"), best=2))


register(
    "c14_paf",
    f"SELECT query_name, query_length, query_start, query_end, strand, target_name, target_length, target_start, target_end, 0 AS matches, greatest(target_end - target_start, query_end - query_start) AS block, 255 AS quality, round((1.0 - {_DISTANCE.replace('j', 'jaccard')}) * 100.0, 7)::DOUBLE AS identity, round(jaccard, 9) AS jaccard, round(self_coverage, 9) AS self_coverage, nth FROM mapped",
    _MAPPED,
)(lambda g: _on_mapped(g, C.paf).withColumns({"identity": F.round("identity", 7), "jaccard": F.round("jaccard", 9), "self_coverage": F.round("self_coverage", 9)}))
register("c14_bedpe", "SELECT query_name, query_start, query_end, target_name, target_start, target_end, round(jaccard, 9) AS jaccard, strand, round(self_coverage, 9) AS self_coverage, nth FROM mapped", _MAPPED)(
    lambda g: _on_mapped(g, C.bedpe).withColumns({"jaccard": F.round("jaccard", 9), "self_coverage": F.round("self_coverage", 9)})
)
register(
    "w13_gene_order",
    "SELECT query_name, place, target_name, min(query_start) AS query_start, max(query_end) AS query_end, min(target_start) AS target_start, max(target_end) AS target_end, inverted FROM (SELECT *, sum(CASE WHEN go THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY query_start, nth)::BIGINT - 1 AS place FROM (SELECT *, coalesce(lag(target_id) OVER w = target_id AND lag(inverted) OVER w = inverted AND lag(query_end) OVER w = query_start AND lag(target_end) OVER w = target_start, false) AS go FROM mapped WHERE nth = 1 WINDOW w AS (PARTITION BY query_id ORDER BY query_start, nth))) GROUP BY query_id, target_id, query_name, target_name, place, inverted",
    _MAPPED,
)(lambda g: _on_mapped(g, lambda g, m: C.gene_order(g, m.where("nth = 1"))))
_GONE = "pairs_gone AS (SELECT from_handle // 2 + 1 AS a, from_handle % 2 = 1 AS ar, to_handle // 2 + 1 AS b, to_handle % 2 = 1 AS br FROM ({0})), gone AS MATERIALIZED (SELECT DISTINCT CASE WHEN turn THEN b ELSE a END AS from_id, CASE WHEN turn THEN NOT br ELSE ar END AS from_rev, CASE WHEN turn THEN a ELSE b END AS to_id, CASE WHEN turn THEN NOT ar ELSE br END AS to_rev FROM (SELECT *, (ar AND br) OR ((ar OR br) AND (a - 1) * 2 + ar::INT > (b - 1) * 2 + br::INT) AS turn FROM pairs_gone))"
_LEFT = "SELECT from_id, from_rev, to_id, to_rev FROM edges ANTI JOIN gone USING (from_id, from_rev, to_id, to_rev)"
register("m11_prune_edge_depth", _LEFT, f"{_NBR}, {_GONE.format(f'{_AS_PAIR} nbr WHERE n < 2')}")(lambda g: M.prune(g, min_depth=2, edge_depth=True).edges)
register("m11_prune_best_edges", _LEFT, f"{_NBR}, " + _GONE.format(f"{_AS_PAIR} (SELECT *, row_number() OVER (PARTITION BY node_id, dir ORDER BY n) - 1 AS i FROM (SELECT node_id, dir, n, max(nbr) AS nbr, size FROM (SELECT *, count(*) OVER (PARTITION BY node_id, dir) AS size FROM nbr) GROUP BY node_id, dir, n, size)) WHERE size - i > 20"))(
    lambda g: M.prune(g, best_edges=20).edges
)


def _ways_back(g: Graph) -> DataFrame:
    """How many of the heaviest ways go back in the order of their condensation (none), and how many there are."""
    ways = materialize(X.heaviest_ways(g), "heaviest")
    nodes = g.nodes.select("node_id", "rank").join(unless_many(ways).select((F.floor(F.col("h") / 2) + 1).cast("long").alias("node_id")).distinct(), "node_id", "left_semi")
    label = strong_components(ways, "h", "t")
    size = ways.count()
    label = label.hint("merge") if size > FEW else label
    of = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    between = ways.join(of("h"), "h", "left").join(of("t"), "t", "left").select(F.coalesce("h_in", "h").alias("a"), F.coalesce("t_in", "t").alias("b"))
    between = materialize(between, "between")
    keys = topological_keys(between.where("a <> b"))
    keys = keys.hint("merge") if size > FEW else keys
    place = lambda c: keys.select(F.col("node").alias(c), F.col("key").alias(f"{c}_key"))
    met = between.join(place("a"), "a", "left").join(place("b"), "b", "left")
    return met.agg(F.count(F.lit(1)).alias("ways"), F.count_if((F.col("a") != F.col("b")) & ~F.coalesce(F.col("a_key") < F.col("b_key"), F.lit(False))).alias("back")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes")))  # one row each


register("t1_condensed_ways", "SELECT (SELECT count(*) FROM heaviest) AS ways, 0 AS back, (SELECT count(DISTINCT h // 2) FROM heaviest) AS nodes", _HEAVIEST)(_ways_back)


# --- files read back -------------------------------------------------------------------------


def _file(lines: DataFrame) -> str:
    """A new folder of text files with the lines of ``value``."""
    path = new_path(lines.sparkSession, "text")
    lines.select("value").write.text(path)
    return path


def _gfa_file(g: Graph) -> str:
    path = new_path(g.nodes.sparkSession, "gfa")
    gfa.write_gfa(g, path)
    return path


def _scanned(g: Graph) -> Graph:
    return gfa.read_gfa(g.nodes.sparkSession, _gfa_file(g))


def _text(*columns) -> Column:
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).alias("value")


register("s1_gfa_nodes", "SELECT node_id, seq, len, rank, pan_pos FROM nodes")(lambda g: _scanned(g).nodes)
register("s1_gfa_steps", "SELECT path_name, step_rank, node_id, is_rev, len, pos FROM steps JOIN paths USING (path_id)")(lambda g: (lambda x: x.steps.join(x.paths, "path_id").select("path_name", "step_rank", "node_id", "is_rev", "len", "pos"))(_scanned(g)))
register("s1_gfa_edges", "SELECT * FROM edges")(lambda g: _scanned(g).edges)
register("s2_line_types", "SELECT 'H' AS type, 1 AS n UNION ALL SELECT 'S', count(*) FROM nodes UNION ALL SELECT 'L', count(*) FROM edges UNION ALL SELECT 'P', count(*) FROM paths")(lambda g: gfa.line_types(g.nodes.sparkSession, _gfa_file(g)))
register("s3_compact_ids", "SELECT row_number() OVER (ORDER BY rank) AS node_id, seq FROM nodes JOIN degrees USING (node_id) WHERE degree <= 45")(lambda g: M.compact_ids(M.without_nodes(g, g.degrees().where("degree > 45"))).nodes.select("node_id", "seq"))
register("s7_bed_ranges", "SELECT path_id, path_name, start, \"end\", 'r' || path_id AS name, CASE WHEN path_id % 3 = 0 THEN '-' ELSE '+' END AS strand FROM ranges", RANGES_SQL)(
    lambda g: side.read_bed(g.nodes.sparkSession, _file(example_ranges(g).select(_text("path_name", "start", "end", F.concat(F.lit("r"), F.col("path_id").cast("string")), F.lit("0"), F.when(F.col("path_id") % 3 == 0, "-").otherwise("+")))), g)
)
register("s8_bed_defaults", "SELECT path_id, path_name, 0 AS start, length_bp - 1 AS \"end\", '.' AS name, '+' AS strand FROM lengths WHERE length_bp > 0")(
    lambda g: side.read_bed(g.nodes.sparkSession, _file(g.path_lengths().where("length_bp > 0").select(F.col("path_name").alias("value"))), g, inclusive_end=True)
)
register("s10_path_positions", "SELECT path_id, path_id * 7 % 50 AS \"offset\", path_id % 2 = 0 AS is_rev FROM paths")(
    lambda g: side.path_positions(g.paths.select(F.concat_ws(",", "path_name", (F.col("path_id") * 7 % 50).cast("string"), F.when(F.col("path_id") % 2 == 0, "-").otherwise("+")).alias("value")), g)
)
register("s12_group_file", "SELECT path_id, split_part(path_name, '#', 2) AS grp FROM paths")(lambda g: side.read_groups(g.nodes.sparkSession, _file(g.paths.select(_text("path_name", F.split_part("path_name", F.lit("#"), F.lit(2))))), g))
register("s13_node_mask", "SELECT node_id FROM nodes WHERE len % 3 = 0")(lambda g: side.read_node_mask(g.nodes.sparkSession, _file(g.nodes.orderBy("rank").select(F.when(F.col("len") % 3 == 0, "1").otherwise("0").alias("value"))), g))
register("o15_node_list", "SELECT node_id FROM nodes WHERE node_id % 2 = 0")(lambda g: side.read_node_list(g.nodes.sparkSession, _file(g.nodes.select((F.col("node_id") * 2).cast("string").alias("value"))), g))

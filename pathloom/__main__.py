"""``python -m pathloom COMMAND GRAPH [options]``: reports as TSV on standard output, graphs to ``-o``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.names import prefix
from pathloom.operators import context, edges, edits, order, paths, ranges, sampling, structure, summary, traverse
from pathloom.plans.graph import Graph
from pathloom.plans.session import local_session
from pathloom.sources import gfa, side


def _groups(g: Graph, a: argparse.Namespace) -> DataFrame:
    return paths.groups_by(g, prefix(F.col("path_name"), a.delim, a.delim_pos) if a.delim else F.col("path_name"))


def _ranges(g: Graph, a: argparse.Namespace) -> DataFrame:
    return side.read_bed(g.nodes.sparkSession, a.bed, g) if a.bed else ranges.whole_paths(g)


def _targets(g: Graph, a: argparse.Namespace) -> DataFrame:
    return g.paths.where(F.col("path_name") == a.target) if a.target else g.paths


#: A report gives a table, anything else a graph.
COMMANDS = {
    "stats": lambda g, a: summary.graph_summary(g),
    "depth": lambda g, a: ranges.mean_depth(g, _ranges(g, a)),
    "depth-table": lambda g, a: g.depths(),
    "degree": lambda g, a: ranges.mean_degree(g, _ranges(g, a)),
    "degree-table": lambda g, a: g.degrees(),
    "paths": lambda g, a: paths.list_paths(g),
    "fasta": lambda g, a: gfa.path_fasta(g).select("value"),
    "similarity": lambda g, a: paths.similarity(g, _groups(g, a)),
    "pav": lambda g, a: paths.presence(g, _ranges(g, a), _groups(g, a)),
    "heaps": lambda g, a: paths.growth(g, _groups(g, a), paths.random_orders(_groups(g, a), a.number, a.seed)),
    "bin": lambda g, a: paths.bins(g, a.number),
    "matrix": lambda g, a: summary.sparse_matrix(g),
    "flatten": lambda g, a: ranges.flatten(g),
    "overlap": lambda g, a: ranges.overlapping_paths(g, _ranges(g, a)),
    "links": lambda g, a: edges.mean_links_length(g),
    "validate": lambda g, a: edges.missing_edges(g),
    "components": lambda g, a: summary.component_sizes(g),
    "strong": lambda g, a: structure.strong_nodes(g),
    "nice": lambda g, a: structure.nice_components(g),
    "ends": lambda g, a: structure.distances_to_ends(g, a.number),
    "kmers": lambda g, a: traverse.kmers(g, a.number),
    "unitig": lambda g, a: traverse.unitigs(g),
    "untangle": lambda g, a: context.untangle(g, g.paths, _targets(g, a)),
    "tips": lambda g, a: context.break_points(g, _targets(g, a), g.paths, a.number),
    "layout": lambda g, a: order.layout_2d(g, a.seed),
    "view": lambda g, a: gfa.gfa_lines(g).orderBy("section", "key", "part", "value").select("value"),
    "build": lambda g, a: g,
    "chop": lambda g, a: edits.chop(g, a.number),
    "unchop": lambda g, a: edits.unchop(g),
    "crush": lambda g, a: edits.crush(g),
    "flip": lambda g, a: edits.flip_paths(g),
    "normalize": lambda g, a: sampling.normalize(g),
    "groom": lambda g, a: order.groom(g),
    "sort": lambda g, a: order.sort(g, a.pipeline, _targets(g, a), a.seed),
    "extract": lambda g, a: edits.extract(g, ranges=_ranges(g, a), max_gap=a.max_gap, lace=g.paths.where(F.col("path_name") == a.lace) if a.lace else None),
    "dagify": lambda g, a: structure.dagify(traverse.split_strands(g), a.number)[0],
    "inject": lambda g, a: edits.inject(g, _ranges(g, a).select("path_id", "start", "end", "name")),
    "prune": lambda g, a: edits.prune(g, max_degree=a.number),
    "break": lambda g, a: traverse.break_cycles(g, a.number),
    "cover": lambda g, a: sampling.path_cover(g, a.number),
    "priv": lambda g, a: sampling.private_paths(g, seed=a.seed),
}


def main(argv: list[str]) -> int:
    """Run one command."""
    p = argparse.ArgumentParser(prog="pathloom", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("graph", help="a .gfa file or a Parquet folder")
    p.add_argument("-o", "--out", help="where a graph goes: a folder, as GFA lines if it ends in .gfa")
    p.add_argument("-b", "--bed", help="ranges on paths")
    p.add_argument("-n", "--number", type=int, default=10, help="length, width, limit or count of the command")
    p.add_argument("-D", "--delim", help="group paths by the fields before this delimiter")
    p.add_argument("-p", "--delim-pos", type=int, default=1)
    p.add_argument("-r", "--target", help="name of the target path")
    p.add_argument("-P", "--pipeline", default="Ygs", help="letters of the sort orders")
    p.add_argument("-d", "--max-gap", type=int, default=300_000, help="extract: base pairs of a stretch between extracted nodes that is filled in")
    p.add_argument("-R", "--lace", help="extract: a path whose stretches outside become a node each")
    p.add_argument("-s", "--seed", type=int, default=0)
    a = p.parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    out = COMMANDS[a.command](gfa.load_graph(spark, a.graph), a)
    if isinstance(out, Graph):
        if not a.out:
            p.error("this command makes a graph: give --out")
        (gfa.write_gfa if a.out.endswith(".gfa") else gfa.save_graph)(out, a.out)
        return 0
    if out.columns != ["value"]:
        print("#" + "\t".join(out.columns))
    for row in out.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

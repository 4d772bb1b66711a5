"""Side inputs: ranges, positions, annotations, groups, masks, node lists and layouts; and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.plans.graph import Graph
from pathloom.plans.prefix import dense_index
from pathloom.sources.gfa import lines_in_order


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')")


def _demand(ok: Column, message: Column, value: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message).cast("long"))


def read_bed(spark: SparkSession, path: str, g: Graph, inclusive_end: bool = False) -> DataFrame:
    """``(path_id, path_name, start, end, name, strand)`` from a BED file on paths of ``g``.

    Missing fields: start 0, end the path's length, name ``.``, strand ``+``.  A path
    that the graph does not have, or a start that is not before the end, is an error.
    ``inclusive_end`` turns the end into the last base.
    """
    f = _lines(spark, path).select(F.split("value", "\t").alias("f"))
    get = lambda i: F.get("f", F.lit(i))
    rows = f.select(get(0).alias("path_name"), F.nullif(get(1), F.lit("")).cast("long").alias("s"), F.nullif(get(2), F.lit("")).cast("long").alias("e"), F.coalesce(F.nullif(get(3), F.lit("")), F.lit(".")).alias("name"), F.coalesce(get(5), F.lit("+")).alias("strand"))
    rows = rows.join(g.path_lengths().select("path_id", "path_name", "length_bp"), "path_name", "left")
    start, end = F.coalesce("s", F.lit(0).cast("long")), F.coalesce("e", "length_bp")
    known = _demand(F.col("path_id").isNotNull(), F.concat(F.lit("unknown path: "), "path_name"), F.col("path_id"))
    checked = _demand(start < end, F.concat(F.lit("empty range on "), "path_name"), start)
    return rows.select(known.alias("path_id"), "path_name", checked.alias("start"), (end - int(inclusive_end)).alias("end"), "name", "strand")


def parse_region(text: str) -> tuple[str, int | None, int | None]:
    """``path[:a[-b]]``: the last colon splits; a single number is both ends."""
    name, colon, rest = text.rpartition(":")
    first, dash, last = rest.partition("-")
    if not colon or not first.isdigit() or dash and not last.isdigit():
        return text, None, None
    return name, int(first), int(last) if dash else int(first)


def graph_positions(lines: DataFrame) -> DataFrame:
    """``(node_id, offset, is_rev)`` from a column ``value`` of ``id[,offset[,strand]]``."""
    f = lines.select(F.split("value", ",").alias("f"))
    return f.select(F.get("f", F.lit(0)).cast("long").alias("node_id"), F.coalesce(F.get("f", F.lit(1)).cast("long"), F.lit(0)).alias("offset"), (F.coalesce(F.get("f", F.lit(2)), F.lit("+")) == "-").alias("is_rev"))


def path_positions(lines: DataFrame, g: Graph) -> DataFrame:
    """``(path_id, offset, is_rev)`` from ``name[,offset[,strand]]``."""
    f = lines.select(F.split("value", ",").alias("f"))
    p = f.select(F.get("f", F.lit(0)).alias("path_name"), F.coalesce(F.get("f", F.lit(1)).cast("long"), F.lit(0)).alias("offset"), (F.coalesce(F.get("f", F.lit(2)), F.lit("+")) == "-").alias("is_rev"))
    return p.join(g.paths, "path_name").select("path_id", "offset", "is_rev")


def read_gff(spark: SparkSession, path: str, g: Graph, attribute: str = "Name") -> DataFrame:
    """``(path_id, start, end, label)`` of GFF or GTF features, clipped to sub-path names.

    Features are one-based and closed; results are zero-based offsets in the path, with
    the closed end.  On a path named ``seq:a-b`` they are shifted and clipped to it.
    The label is an attribute's value, or the whole attribute field without it.
    """
    f = _lines(spark, path).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 9)
    label = F.regexp_extract(F.col("f")[8], rf"(?:^|;)\s*{attribute}[= ]\x22?([^;\x22]+)", 1)
    feats = f.select(F.col("f")[0].alias("seq"), (F.col("f")[3].cast("long") - 1).alias("a"), (F.col("f")[4].cast("long") - 1).alias("z"), F.when(label != "", label).otherwise(F.col("f")[8]).alias("label"))
    base = F.regexp_extract("path_name", r"^(.*):(\d+)-(\d+)$", 1)
    shift = F.expr("try_cast(regexp_extract(path_name, '^(.*):([0-9]+)-([0-9]+)$', 2) AS bigint)")
    p = g.path_lengths().select("path_id", "length_bp", F.when(base != "", base).otherwise(F.col("path_name")).alias("seq"), F.coalesce(shift, F.lit(0)).alias("shift"))
    hit = feats.join(p, "seq").select("path_id", F.greatest(F.lit(0), F.col("a") - F.col("shift")).alias("start"), F.least(F.col("length_bp") - 1, F.col("z") - F.col("shift")).alias("end"), "label")
    return hit.where("start <= end")


def read_names(spark: SparkSession, path: str, g: Graph) -> DataFrame:
    """Paths that a file names, one a line; an unknown or repeated name is an error."""
    names = _lines(spark, path).select(F.trim("value").alias("path_name"))
    if twice := names.groupBy("path_name").count().where("count > 1").head():
        raise ValueError(f"path named twice: {twice[0]}")
    if lost := names.join(g.paths, "path_name", "left_anti").head():
        raise ValueError(f"unknown path: {lost[0]}")
    return g.paths.join(names, "path_name", "left_semi")


def read_groups(spark: SparkSession, path: str, g: Graph) -> DataFrame:
    """``(path_id, grp)`` from two columns ``path group``; unknown or repeated paths are errors."""
    rows = _lines(spark, path).select(F.split("value", "\t").alias("f")).select(F.col("f")[0].alias("path_name"), F.col("f")[1].alias("grp"))
    if twice := rows.groupBy("path_name").count().where("count > 1").head():
        raise ValueError(f"path grouped twice: {twice[0]}")
    if lost := rows.join(g.paths, "path_name", "left_anti").head():
        raise ValueError(f"unknown path: {lost[0]}")
    return rows.join(g.paths, "path_name").select("path_id", "grp")


def read_node_mask(spark: SparkSession, path: str, g: Graph) -> DataFrame:
    """Nodes whose line in a file of 0 and 1 is 1; there must be a line for each node."""
    lines = dense_index(lines_in_order(spark, path), ["at"], "nth")
    if (n := lines.count()) != (m := g.nodes.count()):
        raise ValueError(f"mask has {n} lines for {m} nodes")
    ranked = dense_index(g.nodes.select("node_id", "rank"), ["rank"], "nth")
    return ranked.join(lines.where("trim(value) = '1'"), "nth").select("node_id")


def read_node_list(spark: SparkSession, path: str, g: Graph) -> DataFrame:
    """Nodes of a file of ids that the graph has; others are left out."""
    ids = _lines(spark, path).select(F.trim("value").cast("long").alias("node_id")).distinct()
    return g.nodes.select("node_id").join(ids, "node_id", "left_semi")


def read_layout_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(node_id, end, x, y)`` from lines ``idx X Y component``, two for each node."""
    f = _lines(spark, path).where("NOT startswith(value, 'idx')").select(F.split("value", "\t").alias("f"))
    idx = F.col("f")[0].cast("long")
    return f.select((F.floor(idx / 2) + 1).alias("node_id"), (idx % 2).cast("int").alias("end"), F.col("f")[1].cast("double").alias("x"), F.col("f")[2].cast("double").alias("y"))


def layout_tsv(layout: DataFrame, component: DataFrame) -> DataFrame:
    """``(idx, value)`` lines of a layout file."""
    idx = (F.col("node_id") - 1) * 2 + F.col("end")
    return layout.join(component, "node_id").select(idx.alias("idx"), F.concat_ws("\t", idx.cast("string"), F.col("x").cast("string"), F.col("y").cast("string"), F.col("component").cast("string")).alias("value"))


def bins_json(bins: DataFrame, links: DataFrame, g: Graph, width: int) -> DataFrame:
    """``value``: a header object, then one JSON object for each path with its bins and links."""
    b = bins.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("bin", "mean_cov", "mean_inv", "mean_pos", F.array("first_nucl", "last_nucl").alias("range")))).alias("bins"))
    k = links.groupBy("path_id").agg(F.sort_array(F.collect_list(F.array("from_bin", "to_bin"))).alias("links"))
    head = g.nodes.agg(F.sum("len").alias("pangenome_length")).select(F.lit(-1).cast("long").alias("path_id"), F.to_json(F.struct(F.lit(width).alias("bin_width"), "pangenome_length")).alias("value"))
    body = g.paths.join(b, "path_id").join(k, "path_id", "left").select("path_id", F.to_json(F.struct("path_name", "bins", "links")).alias("value"))
    return head.union(body)


def summary_yaml(sections: dict[str, DataFrame]) -> str:
    """Reports of one or few rows as YAML, one section each."""
    out = ["---"]
    for name, df in sections.items():
        out.append(f"{name}:")
        for row in df.toLocalIterator():
            items = row.asDict()
            out += [f"  {'- ' if i == 0 else '  '}{k}: {v}" for i, (k, v) in enumerate(items.items())]
    return "\n".join(out) + "\n"


def path_svg(layout: DataFrame, g: Graph, scale: float = 1.0) -> DataFrame:
    """``value``: one SVG line for each node of a layout, after the opening tag and before the closing one."""
    a, b = layout.where("end = 0").select("node_id", F.col("x").alias("x1"), F.col("y").alias("y1")), layout.where("end = 1").select("node_id", F.col("x").alias("x2"), F.col("y").alias("y2"))
    at = lambda c: F.round(F.col(c) * scale, 3).cast("string")
    line = F.format_string('<line x1="%s" y1="%s" x2="%s" y2="%s" stroke="black"/>', at("x1"), at("y1"), at("x2"), at("y2"))
    box = layout.agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    head = box.select(F.lit(0).cast("long").alias("node_id"), F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%s %s %s %s">', at("x"), at("y"), at("w"), at("h")).alias("value"))
    tail = g.nodes.agg(F.max("node_id").alias("m")).select((F.col("m") + 1).alias("node_id"), F.lit("</svg>").alias("value"))
    return head.union(a.join(b, "node_id").select("node_id", line.alias("value"))).union(tail)

import pytest
from pyspark.sql import functions as F

from pathloom.operators import edits, ranges, summary
from pathloom.operators import paths as P
from pathloom.sources import gfa, side

BUBBLE = """H\tVN:Z:1.0
S\t1\tCAA
S\t2\tA
S\t3\tG
S\t4\tT
S\t5\tC
S\t6\tTTG
S\t7\tA
S\t8\tGAT
S\t9\tGTC
S\t10\tCATG
P\ttarget\t3+,5+,6+,6+,8+,9+\t*
P\tquery1\t2+,4+,6+,7+\t*
P\tquery2\t10+\t*
P\tquery3\t1+,2+,5+,6+,8+,9+\t*
L\t1\t+\t2\t+\t0M
L\t1\t+\t3\t+\t0M
L\t2\t+\t4\t+\t0M
L\t2\t+\t5\t+\t0M
L\t3\t+\t5\t+\t0M
L\t4\t+\t6\t+\t0M
L\t5\t+\t6\t+\t0M
L\t6\t+\t6\t+\t0M
L\t6\t+\t7\t+\t0M
L\t6\t+\t8\t+\t0M
L\t8\t+\t9\t+\t0M
"""


def load(spark, tmp_path, text, name="g.gfa"):
    p = tmp_path / name
    p.write_text(text)
    return gfa.load_graph(spark, f"file://{p}")


def spelled(g):
    return {r.path_id: r.value.split("\n")[1] for r in gfa.path_fasta(g).collect()}


@pytest.fixture
def bubble(spark, tmp_path):
    return load(spark, tmp_path, BUBBLE)


def test_known_answers(spark, tmp_path, bubble):
    g = bubble
    name = {r.path_id: r.path_name for r in g.paths.collect()}
    assert [r.degree for r in g.degrees().orderBy("node_id").collect()] == [2, 3, 2, 2, 3, 6, 1, 2, 1, 0]
    assert tuple(summary.degree_summary(g).first()) == (10, 11, 2.2, 0, 6)
    assert {name[r.path_id]: round(r.mean_degree, 5) for r in ranges.mean_degree(g, ranges.whole_paths(g)).collect()} == {"target": 3.57143, "query1": 4, "query2": 0, "query3": 2.78571}
    subset = g.paths.where("path_name IN ('target', 'query3')")
    assert {name[r.path_id]: round(r.mean_degree, 5) for r in ranges.mean_degree(g, ranges.whole_paths(g), subset).collect()} == {"target": 3.57143, "query1": 3.5, "query2": 0, "query3": 2.78571}
    values = g.degrees().selectExpr("node_id", "degree AS v")
    rows = lambda w: sorted((name[r.path_id], r.start, r.end) for r in w.collect())
    assert rows(ranges.windows(g, ranges.bounded(values, 0, 5), 10)) == [("query1", 0, 6), ("query2", 0, 4), ("query3", 0, 14), ("target", 0, 14)]
    assert rows(ranges.windows(g, ranges.bounded(values, 0, 5, out=True), 10)) == [("query1", 2, 5), ("query3", 5, 8), ("target", 2, 8)]
    at = ranges.degree_at(g, side.path_positions(spark.createDataFrame([("target,3,+",)], "value string"), g)).first()
    assert (at.degree, at.degree_uniq) == (6, 3)
    assert g.depths().where("node_id = 6").select("depth", "depth_uniq").first() == (4, 3)
    v = ranges.base_vector(g, values).collect()
    assert {name[r.path_id]: r.vector for r in v}["target"] == "2 3 6 6 6 6 6 6 2 2 2 1 1 1"
    bed = tmp_path / "r.bed"
    bed.write_text("#c\ntarget\t0\t1\nquery2\n")
    assert sorted((r.path_name, r.start, r.end, r.name) for r in side.read_bed(spark, f"file://{bed}", g).collect()) == [("query2", 0, 4, "."), ("target", 0, 1, ".")]
    bed.write_text("nobody\t0\t1\n")
    with pytest.raises(Exception, match="unknown path"):
        side.read_bed(spark, f"file://{bed}", g).collect()
    features = spark.createDataFrame([("target", 0, 6, "HLA-DQB2"), ("target", 6, 13, "HLA-DQB3")], "n string, start long, end long, label string")
    notes = ranges.annotate_nodes(g, features.join(g.paths, F.col("n") == F.col("path_name")))
    got = {r.node_id: (r.annotation, r.color) for r in notes.collect()}
    assert got[9] == ("HLA-DQB3", "#76d085") and got[3] == ("HLA-DQB2", "#db3619") and got[6] == ("HLA-DQB2;HLA-DQB3", "#5711d7")


def test_round_trips(spark, tmp_path, bubble):
    gfa.write_gfa(bubble, f"file://{tmp_path}/out.gfa", annotate=True)
    again = gfa.read_gfa(spark, f"file://{tmp_path}/out.gfa")
    gfa.save_graph(bubble, f"file://{tmp_path}/graph")
    for other in (again, gfa.load_graph(spark, f"file://{tmp_path}/graph")):
        for t in ("nodes", "edges", "paths", "steps"):
            assert sorted(map(str, getattr(other, t).collect())) == sorted(map(str, getattr(bubble, t).collect()))
    assert {r.type: r.n for r in gfa.line_types(spark, f"file://{tmp_path}/g.gfa").collect()} == {"H": 1, "S": 10, "P": 4, "L": 11}
    lines = [r.value for r in gfa.flat_fasta(bubble, "flat", 8).orderBy("line").collect()]
    assert lines == [">flat", "CAAAGTCT", "TGAGATGT", "CCATG"]
    with pytest.raises(ValueError, match="missing segment"):
        load(spark, tmp_path, "S\t1\tA\nL\t1\t+\t2\t+\t0M\n", "bad.gfa")


def test_edits_keep_sequences(spark, bubble):
    want = spelled(bubble)
    assert want == {1: "GCTTGTTGGATGTC", 2: "ATTTGA", 3: "CATG", 4: "CAAACTTGGATGTC"}
    chopped = edits.chop(bubble, 2)
    assert spelled(chopped) == want and chopped.nodes.agg(F.max("len")).first()[0] == 2
    assert E_missing(chopped) == 0
    joined = edits.unchop(chopped)
    assert spelled(joined) == want and E_missing(joined) == 0
    assert joined.nodes.count() == edits.unchop(bubble).nodes.count() == 9
    flipped = edits.renumber(bubble, bubble.nodes.select("node_id", (10 - F.col("node_id")).alias("nth"), (F.col("node_id") % 2 == 0).alias("flip")))
    assert spelled(flipped) == want and E_missing(flipped) == 0
    turned = edits.flip_paths(flipped)
    back = str.maketrans("ACGT", "TGCA")
    for r in turned.paths.collect():
        assert spelled(turned)[r.path_id] == (want[r.path_id].translate(back)[::-1] if r.path_name.endswith("_inv") else want[r.path_id])
    assert any(r.path_name == "target_inv" for r in turned.paths.collect()) and E_missing(turned) == 0
    two = edits.squeeze([bubble, bubble], "_")
    assert two.nodes.count() == 20 and {r.path_name for r in two.paths.collect()} >= {"target_1", "target_2"} and sorted(spelled(two).values()) == sorted([*want.values()] * 2)
    cut = edits.inject(bubble, spark.createDataFrame([(1, 1, 7, "part")], "path_id long, start long, end long, name string"))
    assert sorted(spelled(cut).values()) == sorted([*want.values(), "CTTGTT"]) and E_missing(cut) == 0
    with pytest.raises(ValueError, match="given twice"):
        edits.inject(bubble, spark.createDataFrame([(1, 1, 7, "target")], "path_id long, start long, end long, name string"))


def E_missing(g):
    from pathloom.operators.edges import missing_edges

    return missing_edges(g).count()


def test_extract_and_prune(spark, bubble):
    r = spark.createDataFrame([(1, 3, 9)], "path_id long, start long, end long")
    sub = edits.extract(bubble, ranges=r)
    names = {x.path_id: x.path_name for x in sub.paths.collect()}
    assert {names[i]: s for i, s in spelled(sub).items()} == {"target:2-11": "TTGTTGGAT", "query1:2-5": "TTG", "query3:5-11": "TTGGAT"}
    assert sorted(x.node_id for x in sub.nodes.collect()) == [6, 8]
    near = edits.expand(bubble, bubble.nodes.where("node_id = 7").select("node_id"), 1)
    assert sorted(x.node_id for x in near.collect()) == [6, 7]
    rest = edits.prune(bubble, max_degree=5, drop_empty=True)
    assert 6 not in {x.node_id for x in rest.nodes.collect()} and [x.path_name for x in rest.paths.collect()] == ["query2"]
    assert edits.isolated_nodes(bubble).collect()[0].node_id == 10
    assert {x.component for x in summary.components(bubble).collect()} == {1, 10}
    assert summary.largest_components(bubble, 1, "n_nodes").first().n_nodes == 9


def test_empty_paths_loops_and_strands(spark, tmp_path):
    g = load(spark, tmp_path, "S\t5\tAC\nS\t7\tGTN\nL\t5\t+\t5\t-\t0M\nL\t5\t+\t7\t-\t0M\nP\te\t*\t*\nP\tr\t7+,5-\t*\n")
    assert {r.node_id: r.degree for r in g.degrees().collect()} == {5: 2, 7: 1}
    assert spelled(g) == {1: "", 2: "GTNGT"}
    assert {r.path_name: r.length_bp for r in g.path_lengths().collect()} == {"e": 0, "r": 5}
    assert P.drop_empty_paths(g).paths.count() == 1
    assert sorted(r.node_id for r in edits.compact_ids(g).nodes.collect()) == [1, 2]
    assert spelled(edits.flip_paths(g))[2] == "GTNGT"
    assert edits.unchop(g).nodes.count() == 2

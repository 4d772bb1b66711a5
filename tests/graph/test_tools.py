import threading
import urllib.request

import pytest
from test_gfa import BUBBLE, load, spelled

from pathloom.__main__ import COMMANDS
from pathloom.operators import order, traverse
from pathloom.operators.edges import missing_edges
from pathloom.sources import gfa, server, side


@pytest.fixture
def bubble(spark, tmp_path):
    return load(spark, tmp_path, BUBBLE)


def test_strands(bubble):
    want = spelled(bubble)
    turned = traverse.reverse_complement_graph(bubble)
    assert spelled(turned) == want and missing_edges(turned).count() == 0 and not traverse.single_stranded(turned)
    two = traverse.split_strands(turned)
    assert spelled(two) == want and two.nodes.count() == 20 and missing_edges(two).count() == 0 and two.edges.count() == 22
    assert traverse.single_stranded(bubble)
    assert {r.component: (r.heads, r.tails) for r in traverse.component_ends(bubble).collect()} == {1: (1, 2), 10: (1, 1)}
    for f in (order.cycle_breaking, order.by_strands):
        assert sorted(r.nth for r in f(bubble).collect()) == list(range(10))


def test_server(bubble):
    s = server.server(bubble, port=0)
    t = threading.Thread(target=s.serve_forever)
    t.start()
    get = lambda x: urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/{x}").read().decode()
    try:
        assert get("hi") == "Hello World!"
        assert [get("target/1"), get("target/4"), get("target/99"), get("nobody/1")] == ["5", "9", "0", "0"]
    finally:
        s.shutdown()
        t.join()


def test_reports_of_the_command_line(spark, tmp_path, bubble):
    import argparse

    a = argparse.Namespace(bed=None, delim=None, delim_pos=1, number=3, seed=0, target="target", pipeline="f")
    for name in ("stats", "depth", "degree-table", "paths", "similarity", "pav", "heaps", "bin", "matrix", "flatten", "links", "components", "view", "unitig", "fasta"):
        assert COMMANDS[name](bubble, a).count() > 0, name
    for name in ("chop", "sort", "crush", "flip"):
        assert sorted(map(len, spelled(COMMANDS[name](bubble, a)).values())) == [4, 6, 14, 14], name


def test_side_files(spark, tmp_path, bubble):
    f = tmp_path / "x"
    read = lambda fn, text, *rest: (f.write_text(text), fn(spark, f"file://{f}", bubble, *rest).collect())[1]
    assert {r.path_name for r in read(side.read_names, "target\nquery2\n")} == {"target", "query2"}
    for bad in ("target\ntarget\n", "nobody\n"):
        with pytest.raises(ValueError, match="path"):
            read(side.read_names, bad)
    assert sorted(r.grp for r in read(side.read_groups, "target\ta\nquery1\tb\n")) == ["a", "b"]
    assert [r.node_id for r in read(side.read_node_mask, "1\n" + "0\n" * 9)] == [1]
    with pytest.raises(ValueError, match="mask"):
        read(side.read_node_mask, "1\n")
    assert sorted(r.node_id for r in read(side.read_node_list, "3\n77\n9\n")) == [3, 9]
    gff = read(side.read_gff, "##gff\ntarget\tx\tgene\t2\t6\t.\t+\t.\tID=1;Name=abc\n")
    assert [(r.start, r.end, r.label) for r in gff] == [(1, 5, "abc")]
    assert side.parse_region("a:b:3-9") == ("a:b", 3, 9) and side.parse_region("x:7") == ("x", 7, 7) and side.parse_region("x:y") == ("x:y", None, None)
    positions = spark.createDataFrame([("3",), ("4,1,-",)], "value string")
    assert [tuple(r) for r in side.graph_positions(positions).collect()] == [(3, 0, False), (4, 1, True)]
    from pathloom.operators import paths as P
    from pathloom.operators import summary

    lines = [r.value for r in side.bins_json(P.bins(bubble, 5), P.bin_links(bubble, 5), bubble, 5).orderBy("path_id").collect()]
    assert '"bin_width":5' in lines[0] and '"path_name":"target"' in lines[1] and len(lines) == 5
    assert "nodes: 10" in side.summary_yaml({"summary": summary.graph_summary(bubble)})
    from pathloom.plans.queries import linear_layout

    svg = [r.value for r in side.path_svg(linear_layout(bubble), bubble).orderBy("node_id").collect()]
    assert svg[0].startswith("<svg") and svg[-1] == "</svg>" and len(svg) == 12
    rows = side.layout_tsv(linear_layout(bubble), summary.components(bubble)).orderBy("idx").collect()
    (tmp_path / "lay.tsv").write_text("idx\tX\tY\tcomponent\n" + "\n".join(r.value for r in rows))
    assert sorted(map(tuple, side.read_layout_tsv(spark, f"file://{tmp_path}/lay.tsv").collect())) == sorted(map(tuple, linear_layout(bubble).select("node_id", "end", "x", "y").collect()))
    gfa.write_gfa(bubble, f"file://{tmp_path}/a.gfa")
    (tmp_path / "list").write_text(f"file://{tmp_path}/a.gfa\n")
    assert len(gfa.load_graphs(spark, f"file://{tmp_path}/list")) == 1


def test_stored_components_and_records(spark, tmp_path, bubble):
    gfa.write_components(bubble, f"file://{tmp_path}/parts")
    one = gfa.read_component(spark, f"file://{tmp_path}/parts", 10)
    assert [r.node_id for r in one.nodes.collect()] == [10] and spelled(one) == {3: "CATG"}
    assert gfa.read_component(spark, f"file://{tmp_path}/parts", 1).edges.count() == 11
    assert gfa.stored_bytes(spark, f"file://{tmp_path}/g.gfa") == len(BUBBLE)
    u = traverse.unitigs(bubble)
    assert any(r.value.endswith("\nCATG\n+\nIIII") for r in gfa.sequence_records(u, "unitig", "seq", "I").collect())
    assert all(r.value.startswith(">") for r in gfa.sequence_records(u, "unitig", "seq").collect())


def test_descent_brings_near_steps_together():
    """Shuffled nodes of a long chain with detours come out with most steps next to each other."""
    import numpy as np

    from pathloom.operators import order

    rng = np.random.default_rng(5)
    walks = [np.array([n for n in range(900) if n % 3 != 1 or rng.random() < 0.5]) for _ in range(6)]
    at, pos = np.concatenate(walks), np.concatenate([np.arange(len(w)) * 5 for w in walks])
    x = rng.permutation(900).astype(float).reshape(-1, 1) * 5
    apart = lambda x: np.mean(np.concatenate([np.abs(np.diff(np.argsort(np.argsort(x[:, 0]))[w])) for w in walks]))
    assert apart(x) > 200
    done = order._descend(x.copy(), at, pos, [(w, w) for w in walks], 1, 100, len(at), 0.99, 0.01)
    assert apart(done) < 3

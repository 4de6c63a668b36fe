"""Sources, admin commands, the command line and the closed-loop benchmark."""

import json

import pytest

from toy import EDGES, write_files
from weft import cli
from weft.admin import build_index, execute, set_config
from weft.emulator import emulate, random_values, read_mix
from weft.functions.render import lines
from weft.schema import TraversalError
from weft.sources.files import adjacency, disagreements, from_files, read_graph, write_graph


def test_adjacency_and_edges_agree(spark, toy_files):
    got = [(r.src, r.dst) for r in adjacency(spark, toy_files).collect()]
    assert sorted(got) == sorted([e[:2] for e in EDGES] * 2)
    assert disagreements(spark, toy_files).count() == 0


def test_a_missing_edge_is_found(spark, tmp_path):
    folder = write_files(tmp_path)
    path = tmp_path / "edge_property" / "part_1"
    path.write_text("\n".join(path.read_text().split("\n")[:-1]) + "\n7\t1\t1\t[]\n")
    assert sorted(map(tuple, disagreements(spark, folder).collect())) == [(6, 3, "vertices"), (7, 1, "edges")]


def test_odd_lines(spark, tmp_path):
    """No properties, blank lines, repeated keys, characters, commas and colons in texts, any order of keys."""
    folder = write_files(tmp_path)
    (tmp_path / "index" / "vtx_property_index").write_text("name\t1\t4\nage\t2\t1\nlang\t3\t4\ngrade\t12\t3\nscore\t4\t2\n")
    (tmp_path / "vtx_property" / "part_2").write_text('\n7\t1\t[]\n\n8\t1\t[12:\'a\',1:"x, y: [z]",4:-2.5]\n9\t2\t[2:5]\n')
    g = from_files(spark, folder)
    rows = {r.vid: r for r in g.vertices().collect()}
    assert rows[7].a_name is None and rows[7].a_label == "person"
    assert (rows[8].a_name, rows[8].a_grade, rows[8].a_score, rows[8].a_age) == ("x, y: [z]", "a", -2.5, None)
    assert rows[9].a_age == 5 and len(rows) == 9
    assert g.traverse("g.V().has(\"grade\",'a').values(\"score\")").first().value == -2.5


def test_written_graphs_come_back(spark, toy, tmp_path):
    write_graph(toy, str(tmp_path / "g"))
    again = read_graph(spark, str(tmp_path / "g"))
    assert again.schema == toy.schema
    for q in ("g.V().properties()", "g.E()", 'g.V().has("name","marko").out().values("name")'):
        assert sorted(map(tuple, again.traverse(q).collect())) == sorted(map(tuple, toy.traverse(q).collect()))


def test_index_and_config(toy):
    before = toy.traverse('g.V().has("age",29)').collect()
    said = build_index(toy, "V", "age").first().value
    assert "enabled" in said and "4 of 6" in said
    assert "disabled" in execute(toy, 'BuildIndex(V,"age")').first().value
    assert "6 of 6" in execute(toy, "BuildIndex(E, label)").first().value
    assert toy.traverse('g.V().has("age",29)').collect() == before
    shown = [r.value for r in execute(toy, "SetConfig(data_size, 1024)").collect()]
    assert "data_size: 1024 (decided by Spark)" in shown and len(shown) == 7
    assert toy.options["stealing"] is False and set_config(toy, "stealing", "y").count() == 7 and toy.options["stealing"] is True
    set_config(toy, "stealing", "n")
    for bad in ("BuildIndex(X,name)", "BuildIndex(V,nokey)", "SetConfig(colour,y)", "SetConfig(stealing,maybe)", "SetConfig(data_size,y)"):
        with pytest.raises(TraversalError):
            execute(toy, bad)


def test_caching_keeps_results(spark, toy_files):
    g = from_files(spark, toy_files)
    before = sorted(map(tuple, g.traverse("g.V().out()").collect()))
    set_config(g, "caching", "enable")
    assert sorted(map(tuple, g.traverse("g.V().out()").collect())) == before and g.options["caching"]


def test_lines(toy):
    show = lambda q: sorted(r.line for r in lines(toy.traverse(q)).collect())
    assert show("g.V().groupCount(label)") == ["person:4", "software:2"]
    assert show('g.V().hasLabel("software").group(label,"name")') == ["software:[lop, ripple]"]
    assert show('g.V().has("name","marko").as("a").out("created").as("b").select("a","b")') == ["[a:1, b:3]"]
    assert show('g.V().has("name","marko").values("age")') == ["29"]


def test_command_line(toy, toy_files, tmp_path, capsys):
    shown = cli.answer(toy, 'g.V().has("name","lop").values("lang")')
    assert shown[0] == "=>java" and shown[1].endswith("ms]")
    assert cli.answer(toy, "g.V().limit(0)")[0] == "=>Empty"
    assert cli.answer(toy, "g.V().fly()") == ["error: unexpected step: fly"]
    assert "BuildIndex" in cli.answer(toy, "help index")[0] and "quit" in cli.answer(toy, "help")[0]
    (tmp_path / "q.txt").write_text("g.V().count()\n\ng.E().count()\nquit\ng.V()\n")
    assert cli.main(["--files", toy_files, "-f", str(tmp_path / "q.txt"), "-o", str(tmp_path / "out.txt")]) == 0
    assert [x for x in (tmp_path / "out.txt").read_text().split("\n") if x.startswith("=>")] == ["=>6", "=>6"]
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a").write_text('g.V().has("age",27).values("name")\n')
    assert cli.main(["--files", toy_files, "-b", str(tmp_path / "many"), "-q", "g.V().count()"]) == 0
    assert [x for x in capsys.readouterr().out.split("\n") if x.startswith("=>")] == ["=>6", "=>vadas"]


def test_emulator(toy, tmp_path):
    mix = ["0.5 2 2", 'g.V().has("name",$RAND).count()\tV\tname\t0.7', 'g.E().has("weight",gt($RAND)).count()\tE\tweight\t0.3']
    found = emulate(toy, mix)
    assert found["queries"] == sum(t["count"] for t in found["templates"]) >= 2
    assert all(len(t["latency"]) == (25 if t["count"] else 0) for t in found["templates"])
    assert sorted(random_values(toy, "V", "age")) == [27, 29, 32, 35] and sorted(random_values(toy, "E", "weight")) == [0.2, 0.4, 0.5, 1.0]
    for bad in (["1 2"], ["1 1 2", "x\tV\tname\t1"]):
        with pytest.raises(TraversalError):
            read_mix(bad)
    (tmp_path / "mix").write_text("\n".join(["0.1 1 1", "g.V().count()\tV\tname\t1"]))
    assert json.loads(cli.answer(toy, f"emu {tmp_path / 'mix'}")[0])["queries"] >= 1

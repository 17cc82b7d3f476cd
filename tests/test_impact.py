"""Golden cases for whole projects, the decisions for odd ones, and hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidegraph import table_queries
from tidegraph.operators import report
from tidegraph.operators.classify import concatenated, ordered_changes
from tidegraph.operators.graph import Graph
from tidegraph.operators.impact import compute, impact_rows, uncertain_closure
from tidegraph.plans import cargo, golang, jest, pytest as py
from tidegraph.queries import inline_files

GO = {
    "go.mod": "module example.org/m\n\ngo 1.22\n",
    "a/a.go": 'package a\n\nimport "example.org/m/b"\n\nvar A = b.B\n',
    "a/a_test.go": "package a\n",
    "b/b.go": 'package b\n\nimport (\n\t"fmt"\n\n\tc "example.org/m/c"\n)\n\nvar B = c.C\nvar _ = fmt.Sprint\n',
    "b/b_test.go": "package b\n",
    "c/c.go": "package c\n\nvar C = 1\n",
    "c/c_test.go": "package c\n",
    "d/d.go": "package d\n",
    "d/d_test.go": "package d\n",
    "e/e.go": "package e\n",
    "e/e_test.go": 'package e\n\nimport (\n\t"testing"\n\n\t"example.org/m/d"\n)\n\nfunc TestE(t *testing.T) { _ = d.D }\n',
    "README.md": "text\n",
}
WORKSPACE = {
    "go.work": "go 1.22\n\nuse (\n\t./leafmod\n\t./rootmod\n)\n",
    "leafmod/go.mod": "module wsleaf\n",
    "leafmod/leaf/leaf.go": "package leaf\n",
    "leafmod/leaf/leaf_test.go": "package leaf\n",
    "rootmod/go.mod": "module wsroot\n",
    "rootmod/use/use.go": 'package use\n\nimport "wsleaf/leaf"\n',
    "rootmod/use/use_test.go": "package use\n",
}
JEST = {
    "package.json": '{"devDependencies": {"jest": "29"}}',
    "jest.config.json": '{"moduleNameMapper": {"(bad": "<rootDir>/x", "^@lib/(.*)$": ["<rootDir>/src/none/$1", "<rootDir>/src/lib$1"]}}',
    "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}, /* aliases */ "strict": true}}',
    "src/leaf.ts": "export const leaf = 1;\n",
    "src/leaf.test.ts": "import { leaf } from './leaf';\nimport { help } from './testutil';\n",
    "src/testutil.ts": "export const help = 1;\n",
    "src/mid.ts": "import { leaf } from './leaf';\nexport const mid = leaf;\n",
    "src/mid.test.ts": "import { mid } from './mid';\n",
    "src/consumer.ts": "import { mid } from '@/mid';\nexport const c = mid;\n",
    "src/consumer.test.ts": "import { c } from './consumer';\n",
    "src/isolated.ts": "export const i = 1;\n",
    "src/isolated.test.ts": "import { i } from './isolated';\nimport type { T } from './leaf';\n",
    "src/dynleaf.ts": "export const d = 1;\n",
    "src/dynconsumer.ts": "export async function load() {\n  return import('./dynleaf');\n}\n",
    "src/dynconsumer.test.ts": "import { load } from './dynconsumer';\n",
    "src/libthing.ts": "export const t = 1;\n",
    "src/mapped.ts": "import { t } from '@lib/thing';\n",
    "src/mapped.test.ts": "import './mapped';\n",
    "node_modules/x/index.js": "require(name)\n",
}
DYNAMIC = {
    "package.json": '{"jest": {}}',
    "src/opaque.ts": "export function load(name) {\n  return import(name);\n}\n",
    "src/opaque.test.ts": "import { load } from './opaque';\n",
    "src/unrelated.ts": "export const u = 1;\n",
    "src/unrelated.test.ts": "import { u } from './unrelated';\n",
    "src/glob.ts": "export function load(name) {\n  return import(`./locales/${name}.ts`);\n}\n",
    "src/glob.test.ts": "import { load } from './glob';\n",
    "src/locales/en.ts": "export const x = 1;\n",
    "src/locales/deep/de.ts": "export const x = 1;\n",
    "src/broken.ts": "import(`./missing/${x}`)\n",
}
PY = {
    "pyproject.toml": "[tool.pytest.ini_options]\n",
    "src/pk/__init__.py": "",
    "src/pk/leaf.py": "X = 1\n",
    "src/pk/mid.py": "from .leaf import X\n",
    "src/pk/testutil.py": "",
    "src/pk/sub/__init__.py": "",
    "src/pk/sub/consumer.py": "from ..mid import X\n",
    "src/pk/dynloader.py": "import importlib\n\n\ndef load(n):\n    return importlib.import_module(n)\n",
    "src/pk/plain.py": "from pk.dynloader import load\n",
    "tests/conftest.py": "",
    "tests/test_leaf.py": "from pk.leaf import X\nimport pk.testutil\n",
    "tests/test_mid.py": "import pk.mid\n",
    "tests/test_consumer.py": "from pk.sub.consumer import X\n",
    "tests/test_plain.py": "def test():\n    import pk.plain\n",
    ".venv/lib/test_other.py": "import pk.leaf\n",
}
CARGO = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n',
    "crates/leaf/Cargo.toml": '[package]\nname = "leaf"\n',
    "crates/leaf/src/lib.rs": "#[cfg(test)]\nmod t {\n    #[ test ]\n    fn t() {}\n}\n",
    "crates/mid/Cargo.toml": '[package]\nname = "mid"\n\n[dependencies]\nleaf = { path = "../leaf" }\n',
    "crates/mid/src/lib.rs": "#[test]\nfn t() {}\n",
    "crates/testutil/Cargo.toml": '[package]\nname = "testutil"\n',
    "crates/testutil/src/lib.rs": "#[tokio::test]\nasync fn no() {}\n",
    "crates/consumer/Cargo.toml": '[package]\nname = "consumer"\n\n[dependencies]\nmid = { path = "../mid" }\nserde = "1"\n\n[dev-dependencies]\ntestutil = { path = "../testutil" }\n',
    "crates/consumer/src/lib.rs": "",
    "crates/consumer/tests/it.rs": "",
    "crates/isolated/Cargo.toml": '[package]\nname = "isolated"\n',
    "crates/isolated/src/lib.rs": "#[test]\nfn t() {}\n",
    "target/debug/x.rs": "#[test]\n",
}


def impact(spark, graph, sets):
    rows = [(p, k, i, f) for p, k, fs in sets for i, f in enumerate(fs)]
    got = compute(graph, spark.createDataFrame(rows, "project string, change_set_id string, ord int, path string")).collect()
    return {r.change_set_id: r for r in got}


def short(paths, root):
    return [p.removeprefix(root) for p in paths]


def test_go(spark):
    g = golang.build(inline_files(spark, {"m": GO, "w": WORKSPACE}))
    sets = [("/m", k, [f"/m/{f}" for f in fs]) for k, fs in {"c": ["c/c.go"], "a": ["a/a.go"], "d": ["d/d.go"], "mod": ["go.mod"], "doc": ["c/c.go", "README.md"], "ghost": ["f/ghost.go"], "only": ["README.md"], "gone": ["c/gone.go"], "inside": ["c/notes.md"]}.items()]
    sets += [("/w", "leaf", ["/w/leafmod/leaf/leaf.go"]), ("/w", "work", ["/w/go.work"])]
    r = impact(spark, g, sets)
    m = "example.org/m/"
    assert short(r["c"].targets, m) == ["a", "b", "c"] and not r["c"].full_run
    assert short(r["a"].targets, m) == ["a"]
    assert short(r["d"].targets, m) == ["d", "e"]
    assert r["mod"].full_run and short(r["mod"].targets, m) == ["a", "b", "c", "d", "e"] and r["mod"].full_run_reasons == ["/m/go.mod"]
    assert (r["mod"].changed_targets, r["mod"].uncertain_targets) == ([], [])
    assert short(r["doc"].targets, m) == ["a", "b", "c"] and r["doc"].changed_targets == [m + "c"]
    assert r["ghost"].full_run
    assert not r["only"].full_run and r["only"].targets == []
    assert short(r["gone"].targets, m) == ["a", "b", "c"]  # a deleted file of a folder with one owner
    assert short(r["inside"].targets, m) == ["a", "b", "c"]  # the look-up comes before the ignorable test
    assert r["leaf"].targets == ["wsleaf/leaf", "wsroot/use"]
    assert r["work"].full_run
    p = {x.project: x.patterns for x in golang.patterns(inline_files(spark, {"m": GO, "w": WORKSPACE})).collect()}
    assert p == {"/m": ["./..."], "/w": ["./leafmod/...", "./rootmod/..."]}


def test_go_listing(spark):
    listing = """[
      {"ID": "m/a", "ImportPath": "m/a", "Main": true, "GoFiles": ["/m/a/a.go"], "Imports": ["m/b", "fmt"]},
      {"ID": "m/b", "ImportPath": "m/b", "Main": true, "GoFiles": ["/m/b/b.go"], "Imports": []},
      {"ID": "m/a [m/a.test]", "ImportPath": "m/a", "Main": true, "GoFiles": ["/m/a/a.go", "/m/a/a_test.go"], "Imports": ["m/b"]},
      {"ID": "m/a_test [m/a.test]", "ImportPath": "m/a_test", "Main": true, "GoFiles": ["/m/a/x_test.go"], "Imports": ["m/a [m/a.test]"]},
      {"ID": "m/a.test", "ImportPath": "m/a.test", "Main": true, "GoFiles": ["/tmp/main.go"], "Imports": ["m/a"]},
      {"ID": "fmt", "ImportPath": "fmt", "Main": false, "GoFiles": ["/go/fmt.go"], "Imports": []}]"""
    g = golang.build(None, spark.createDataFrame([("/m", listing)], "project string, content string"))
    assert sorted((r.node_id, r.has_tests) for r in g.nodes.collect()) == [("m/a", True), ("m/b", False)]
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("m/a", "m/b")]
    bad = spark.createDataFrame([("/m", '[{"ID": "m/a", "ImportPath": "m/a", "Main": true, "Errors": ["no such file"]}]')], "project string, content string")
    with pytest.raises(golang.PackageError, match="no such file"):
        golang.build(None, bad)


def test_jest(spark):
    g = jest.build(inline_files(spark, {"j": JEST}))
    sets = {"leaf": ["src/leaf.ts"], "util": ["src/testutil.ts"], "pkg": ["package.json"], "ts": ["tsconfig.app.json"], "doc": ["src/leaf.ts", "README.md"], "dyn": ["src/dynleaf.ts"], "map": ["src/libthing.ts"], "dts": ["types/x.d.ts"], "new": ["src/new.ts"]}
    r = impact(spark, g, [("/j", k, [f"/j/{f}" for f in fs]) for k, fs in sets.items()])
    t = {k: short(x.targets, "/j/src/") for k, x in r.items()}
    assert t["leaf"] == t["doc"] == ["consumer.test.ts", "leaf.test.ts", "mid.test.ts"]
    assert t["util"] == ["leaf.test.ts"]
    assert r["pkg"].full_run and r["ts"].full_run and r["new"].full_run
    assert t["dyn"] == ["dynconsumer.test.ts"]
    assert t["map"] == ["mapped.test.ts"]
    assert t["dts"] == [] and not r["dts"].full_run
    assert not g.nodes.where("has_dynamic").collect()


def test_jest_dynamic(spark):
    g = jest.build(inline_files(spark, {"d": DYNAMIC}))
    r = impact(spark, g, [("/d", "u", ["/d/src/unrelated.ts"]), ("/d", "en", ["/d/src/locales/deep/de.ts"])])
    assert short(r["u"].targets, "/d/src/") == ["opaque.test.ts", "unrelated.test.ts"]
    assert short(r["u"].uncertain_targets, "/d/src/") == ["opaque.test.ts"] and short(r["u"].changed_targets, "/d/src/") == ["unrelated.ts"]
    assert short(r["en"].targets, "/d/src/") == ["glob.test.ts", "opaque.test.ts"]
    assert sorted(short([x.node_id for x in g.nodes.where("has_dynamic").collect()], "/d/src/")) == ["broken.ts", "opaque.ts"]


def test_jest_one_matching_template_hides_another_only_if_strict(spark):
    files = inline_files(spark, {"k": {"src/a.ts": "import(`./here/${x}`); import(`./gone/${x}`)", "src/here/b.ts": ""}})
    flags = [[r.has_dynamic for r in jest.build(files, strict=s).nodes.where("node_id like '%a.ts'").collect()] for s in (True, False)]
    assert flags == [[False], [True]]


def test_pytest(spark):
    g = py.build(inline_files(spark, {"p": PY}))
    sets = {"leaf": ["src/pk/leaf.py"], "util": ["src/pk/testutil.py"], "toml": ["pyproject.toml"], "conf": ["tests/conftest.py"], "doc": ["src/pk/leaf.py", "README.md"], "req": ["requirements-x.txt"]}
    r = impact(spark, g, [("/p", k, [f"/p/{f}" for f in fs]) for k, fs in sets.items()])
    t = {k: short(x.targets, "/p/tests/") for k, x in r.items()}
    assert t["leaf"] == t["doc"] == ["test_consumer.py", "test_leaf.py", "test_mid.py", "test_plain.py"]
    assert short(r["leaf"].uncertain_targets, "/p/tests/") == ["test_plain.py"]
    assert t["util"] == ["test_leaf.py", "test_plain.py"]
    assert r["toml"].full_run and r["conf"].full_run and r["req"].full_run
    assert short([x.node_id for x in g.nodes.where("has_dynamic").collect()], "/p/src/pk/") == ["dynloader.py"]


def test_pytest_submodules_only_if_not_strict(spark):
    files = inline_files(spark, {"s": {"k/__init__.py": "", "k/sub.py": "", "test_k.py": "from k import sub\n"}})
    assert [[r.dst for r in py.build(files, strict=s).edges.orderBy("dst").collect()] for s in (True, False)] == [["/s/k/__init__.py"], ["/s/k/__init__.py", "/s/k/sub.py"]]


def test_cargo(spark):
    g = cargo.build(inline_files(spark, {"c": CARGO}))
    sets = {"leaf": ["crates/leaf/src/lib.rs"], "iso": ["crates/isolated/src/lib.rs"], "util": ["crates/testutil/src/lib.rs"], "toml": ["crates/leaf/Cargo.toml"], "doc": ["crates/leaf/src/lib.rs", "README.md"], "cfg": [".cargo/config"]}
    r = impact(spark, g, [("/c", k, [f"/c/{f}" for f in fs]) for k, fs in sets.items()])
    assert r["leaf"].targets == r["doc"].targets == ["consumer", "leaf", "mid"]
    assert r["iso"].targets == ["isolated"]
    assert r["util"].targets == ["consumer"] and r["util"].changed_targets == ["testutil"]
    assert r["toml"].full_run and r["toml"].targets == ["consumer", "isolated", "leaf", "mid"]
    assert r["cfg"].full_run


def test_cargo_metadata(spark):
    doc = """{"workspace_root": "/c", "workspace_members": ["leaf 0", "mid 0"], "packages": [
      {"id": "leaf 0", "name": "leaf", "manifest_path": "/c/crates/leaf/Cargo.toml"}, {"id": "mid 0", "name": "mid", "manifest_path": "/c/crates/mid/Cargo.toml"},
      {"id": "serde 1", "name": "serde", "manifest_path": "/r/serde/Cargo.toml"}],
      "resolve": {"nodes": [{"id": "mid 0", "deps": [{"name": "leaf", "pkg": "leaf 0"}, {"name": "serde", "pkg": "serde 1"}]}, {"id": "leaf 0", "deps": []}]}}"""
    g = cargo.build(inline_files(spark, {"c": CARGO}), spark.createDataFrame([("/c", doc)], "project string, content string"))
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("mid", "leaf")]
    assert sorted(r.node_id for r in g.nodes.where("has_tests").collect()) == ["leaf", "mid"]


def hand(spark, nodes, files, edges):
    n = spark.createDataFrame([("p", *x) for x in nodes], "project string, node_id string, has_tests boolean, has_dynamic boolean")
    f = spark.createDataFrame([("p", n_, p, p.rpartition("/")[0] or ".") for n_, p in files], "project string, node_id string, path string, dir string")
    return Graph("go", n, f, spark.createDataFrame([("p", *e) for e in edges], "project string, src string, dst string"))


def test_hand_made(spark):
    g = hand(spark, [("x", True, True), ("y", True, False), ("z", False, False)], [("x", "x/x.go"), ("y", "y/y.go"), ("z", "z/z.go"), ("y", "s/s.go"), ("x", "s/s.go")], [("y", "lost"), ("lost", "z"), ("y", "y")])
    r = impact(spark, g, [("p", "y", ["y/y.go"]), ("p", "x", ["x/x.go"]), ("p", "z", ["z/z.go"]), ("p", "doc", ["q/a.md"]), ("p", "both", ["s/s.go"]), ("p", "dir", ["s/other.go"]), ("p", "dup", ["y/y.go", " y/y.go ", ""])])
    assert (r["y"].targets, r["y"].uncertain_targets) == (["x", "y"], ["x"])
    assert (r["x"].targets, r["x"].uncertain_targets, r["x"].changed_targets) == (["x"], [], ["x"])
    assert r["z"].targets == ["x", "y"]  # through an id that has no node
    assert (r["doc"].targets, r["doc"].uncertain_targets, r["doc"].full_run) == (["x"], ["x"], False)
    assert r["both"].changed_targets == ["x"]  # of two owners the smaller id
    assert r["dir"].full_run  # a folder of two owners has none
    assert r["dup"].changed_targets == ["y"]


def test_no_changes(spark):
    g = hand(spark, [("x", True, True)], [("x", "x.go")], [])
    none = spark.createDataFrame([], "project string, change_set_id string, ord int, path string")
    assert compute(g, none).collect() == []
    sets = spark.createDataFrame([("p", "empty")], "project string, change_set_id string")
    r = compute(g, none, sets, uncertain_closure(g)).first()
    assert (r.full_run, r.targets, r.uncertain_targets, r.changed_targets, r.full_run_reasons) == (False, ["x"], ["x"], [], [])


def test_reasons_are_full_files_first_then_unresolved(spark):
    g = hand(spark, [("x", True, False)], [("x", "x/x.go")], [])
    r = impact(spark, g, [("p", "s", ["gone/a.go", "go.sum", "x/x.go", "gone/b.go", "go.mod"])])["s"]
    assert r.full_run_reasons == ["go.sum", "go.mod", "gone/a.go", "gone/b.go"]


def test_report(spark):
    g = hand(spark, [(n, True, n == "u") for n in "abcdefgu"], [(n, f"{n}/{n}.go") for n in "abcdefgu"], [("b", "a")])
    c = spark.createDataFrame([("p", "s", 0, "a/a.go")], "project string, change_set_id string, ord int, path string")
    i = compute(g, c)
    assert [(r.target, r.marker, r.selected, r.total, r.skip_pct) for r in report.report(i, g.nodes).orderBy("target").collect()] == [("a", "*", 3, 8, 62.0), ("b", " ", 3, 8, 62.0), ("u", "~", 3, 8, 62.0)]
    lines = report.text(i.first(), 8, "go", "/r")
    assert lines[0] == "tidegraph: 3 of 8 test targets to run (go, 62% left out)" and lines[-3:] == ["  * a", "    b", "  ~ u"]
    full = spark.createDataFrame([("p", "s", True, ["/r/go.mod", "/x/y"], [])], "project string, change_set_id string, full_run boolean, full_run_reasons array<string>, targets array<string>")
    assert [r.reason for r in report.full_run_report(full, F.lit("/r")).orderBy("ord").collect()] == ["go.mod", "/x/y"]


def test_union_of_change_lists(spark):
    s = "project string, change_set_id string, ord int, path string"
    a, b = spark.createDataFrame([("p", "s", 0, "x"), ("p", "s", 1, "y")], s), spark.createDataFrame([("p", "s", 0, "y"), ("p", "s", 1, "z")], s)
    assert [(r.path, r.ord) for r in ordered_changes(concatenated(a, b)).orderBy("ord").collect()] == [("x", 0), ("y", 1), ("z", 3)]


def test_report_of_long_lists(spark):
    """The report by rows gathers no targets, and no list is searched for each target."""
    n = 4_000
    g = hand(spark, [("a", True, False), ("b", False, True), *[(f"t{i:04}", True, False) for i in range(n)]], [("a", "a/a.go"), ("b", "b/b.go"), ("t0000", "t/t.go")], [(f"t{i:04}", "ab"[i % 2]) for i in range(n)])
    paths = [("one", "a/a.go"), ("one", "t/t.go"), ("none", "q/a.md"), ("all", "go.mod")]
    c = spark.createDataFrame([("p", s, i, path) for i, (s, path) in enumerate(paths)], "project string, change_set_id string, ord int, path string")
    odd = [f"t{i:04}" for i in range(1, n, 2)]
    one = {t: "~" for t in odd} | {f"t{i:04}": " " for i in range(0, n, 2)} | {"a": "*", "t0000": "*"}
    want = [("one", t, m, n + 1, n + 1, 0.0) for t, m in one.items()] + [("none", t, "~", n // 2, n + 1, 50.0) for t in odd] + [("all", t, " ", n + 1, n + 1, 0.0) for t in ["a", *(f"t{i:04}" for i in range(n))]]
    for r in (report.report(compute(g, c), g.nodes), report.report_rows(impact_rows(g, c)[1], g.nodes)):
        assert sorted(tuple(x)[1:] for x in r.collect()) == sorted(want)
        assert "array_contains" not in r._jdf.queryExecution().toString()
    plan = table_queries.QUERIES["impact_report_rows"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "array_contains" not in plan


def test_report_rows_are_not_dealt_by_project(spark):
    """Counts are joined to change sets; the rows of the targets, all of one project, never meet them by it."""
    g = hand(spark, [("a", True, False), ("b", True, False)], [("a", "a/a.go"), ("b", "b/b.go")], [("b", "a")])
    c = spark.createDataFrame([("p", "s", 0, "a/a.go")], "project string, change_set_id string, ord int, path string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as if the totals were large
    try:
        plan = report.report_rows(impact_rows(g, c)[1], g.nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "hashpartitioning(project" not in plan and "SortMergeJoin" not in plan

"""Scanner, paths, rules, detection, commands, sources, the stream and the command line."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tidegraph import cli
from tidegraph.functions import jsscan, paths, pyimports, rules
from tidegraph.operators import commands
from tidegraph.operators.graph import Graph
from tidegraph.queries import JS
from tidegraph.sources import git, manifests, tree
from tidegraph.streaming.changes import impact_stream


@pytest.mark.parametrize("name", JS)
def test_scan(name):
    text, opaque, calls = JS[name]
    s = jsscan.scan(text.encode())
    assert (s.opaque, len(s.calls)) == (opaque, calls)


def test_scan_offsets_and_prefix():
    src = "const é = 1; import(`./l/${x}.js`)".encode()
    (start, end, prefix), = jsscan.scan(src).calls
    assert src[start:end] == b"`./l/${x}.js`" and prefix == "./l/"
    assert not jsscan.scan(src[:start] + b"'./l/x.js'" + src[end:]).calls


@pytest.mark.parametrize(
    ("text", "opaque"),
    [("import(/* c */ './a')", True), ("import('./a', o)", True), ("import x from './a'", False), ("require.resolve(x)", False), ("importx(y)", False), ("import ( './a' )", False), ("require('a\\'b')", False), ("x = `${import(y)}`", False), ("", False), ("`unclosed ${ {", False), ("'unclosed", False), ("import(require(x))", True), ("éimport(x)", False)],
)
def test_scan_more(text, opaque):
    assert jsscan.scan(text.encode()).opaque is opaque


def test_static_imports():
    src = b"import a from './a'; import './b'\nexport * from \"./c\";\nimport type { T } from './t';\n// import x from './no'\nexport { d,\n e } from './d'; import * as f from './f'"
    assert jsscan.static_imports(src) == ["./a", "./b", "./c", "./d", "./f"]


def test_python_imports():
    assert pyimports.imports(b"import a.b, c\nfrom d import e\nfrom . import f\nfrom ..g import h\nif x:\n  import i\n", "p.q") == (["a.b", "c", "d", "p.q", "p.g", "i"], False)
    assert pyimports.imports(b"from . import x\n__import__('y')", "") == ([], True)
    assert pyimports.imports(b"def (", "p") == ([], False)
    assert pyimports.imports(b"a.b.import_module(n)", "p") == ([], True)


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_paths(spark):
    p = lambda x: F.lit(x)
    r = one(spark, a=paths.ancestors(p("/a/b/c")), b=paths.ancestors(p("a/b")), c=paths.ext(p("x/.babelrc")), d=paths.ext(p("x.d.ts")), e=paths.ext(p("a.b/c")), f=paths.parent(p("c")), g=paths.parent(p("/c")), h=paths.relative_or_self(p("/r"), p("/r/x")), i=paths.relative_or_self(p("/r"), p("/rx")), j=paths.module_name(p("a/__init__.py")), k=paths.module_name(p("__init__.py")), l=paths.quote(p("a.b+c")), m=paths.go_pattern(p("../x")), n=paths.normalize(p("a/./b/../c")), o=paths.real_target(p("m/a_test [m/a.test]"), p("m/a_test")), q=paths.relative(p("/x/y"), p("/x/z")))
    assert list(r) == [["/a/b", "/a", "/"], ["a", "."], ".babelrc", ".ts", "", ".", "/", "x", "/rx", "a", None, r"a\.b\+c", "../x/...", "a/c", "m/a", "../y"]


def test_rules(spark):
    f = [("go", "go.sum", True), ("go", "x.mod", False), ("jest", "a/tsconfig.x.json", True), ("jest", "a/.swcrc", True), ("pytest", "requirements.in", False), ("pytest", "conftest.py", True), ("cargo", ".cargo/config.toml", True), ("cargo", "config.toml", False), ("cargo", "a/build.rs", True)]
    df = spark.createDataFrame(f, "a string, p string, want boolean")
    got = df.select("a", "p", "want", rules.by_analyzer(F.col("a"), lambda a: rules.full_run(a, F.col("p"))).alias("got")).collect()
    assert [r for r in got if r.want != r.got] == []
    t = [("pytest", "test_.py", False), ("pytest", "test_a.py", True), ("pytest", "a_test.py", True), ("jest", "a.spec.mjs", True), ("jest", "__tests__/a.ts", True), ("jest", "a.test.py", False), ("go", "a_test.go", True)]
    df = spark.createDataFrame(t, "a string, p string, want boolean")
    got = df.select("a", "p", "want", rules.by_analyzer(F.col("a"), lambda a: rules.test_file(a, F.col("p"))).alias("got")).collect()
    assert [r for r in got if r.want != r.got] == []
    assert rules.table(spark).where("rule = 'full_run' AND match_kind = 'basename' AND analyzer = 'jest'").count() == 17


def test_commands(spark):
    t, none = F.lit(["a.ts", "b"]).cast("array<string>"), F.array().cast("array<string>")
    r = one(spark, go=commands.command("go", t, ["-v"]), jest=commands.command("jest", t, ["-i"]), jest0=commands.command("jest", none), local=commands.jest_command(t, local=F.lit("/b/jest")), py=commands.command("pytest", t, ["-q"], python="python3"), venv=commands.pytest_command(t, venv=F.lit("/v/pytest")), cargo=commands.command("cargo", t, ["x"]))
    assert list(r) == [["go", "test", "-v", "a.ts", "b"], ["npx", "jest", r"^a\.ts$|^b$", "-i"], ["npx", "jest"], ["/b/jest", r"^a\.ts$|^b$"], ["python3", "-m", "pytest", "a.ts", "b", "-q"], ["/v/pytest", "a.ts", "b"], ["cargo", "test", "-p", "a.ts", "-p", "b", "x"]]
    with pytest.raises(ValueError):
        commands.run([])
    assert commands.run(["true"]) == 0


def test_alias_rules():
    text = '{"moduleNameMapper": {"b(.*)": "x", "(?=a)": "no", "a": ["y", "z"]}}'
    assert manifests.ordered_rules(text) == [(0, "b(.*)", 0, "x"), (2, "a", 0, "y"), (2, "a", 1, "z")]
    assert manifests.ordered_rules(None) == []
    with pytest.raises(ValueError):
        manifests.ordered_rules('{"moduleNameMapper": {"a": 1}}')


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj é"
    for name, text in {"pyproject.toml": "[tool.pytest.ini_options]\n", "a.py": "X = 1\n", "b.py": "import a\n", "test_b.py": "import b\n", "test_c.py": "", "node_modules/x.py": "import a\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    g = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *a], cwd=root, check=True, capture_output=True)
    g("init", "-q", "-b", "main")
    g("add", ".")
    g("commit", "-qm", "one")
    return root, g


def test_git(project, spark):
    root, g = project
    assert git.changed_files(str(root)) == []
    (root / "a.py").write_text("X = 2\n")
    (root / "new ä.py").write_text("")
    assert [os.path.basename(p) for p in git.changed_files(str(root))] == ["a.py", "new ä.py"]
    assert [r.ord for r in git.changes(spark, str(root)).orderBy("ord").collect()] == [0, 1]
    g("checkout", "-qb", "side")
    g("commit", "-qam", "two")
    assert [os.path.basename(p) for p in git.changed_files(str(root), "main")] == ["a.py"]
    assert git.repo_root(str(root)) == os.path.realpath(root)
    with pytest.raises(RuntimeError):
        git.changed_files(str(root), "nowhere")


def test_tree(project, spark):
    root, _ = project
    t = tree.read_tree(spark, str(root), "*.py")
    assert sorted(r.base for r in tree.sources(t, "pytest").collect()) == ["a.py", "b.py", "test_b.py", "test_c.py"]
    assert tree.has_token(tree.read_tree(spark, str(root)), "pyproject.toml", "pytest").first().found is True


def test_command_line(project, spark):
    root, _ = project
    said = []
    assert cli.run(spark, str(root), cli.parse(["test"]), said.append) == 0
    assert said == ["tidegraph: no file has changed"]
    (root / "a.py").write_text("X = 3\n")
    said.clear()
    assert cli.run(spark, str(root), cli.parse(["test", "--dry-run", "-v", "--", "-x"]), said.append) == 0
    assert said == ["tidegraph: changed files: 1", "  a.py", "tidegraph: 1 of 2 test targets to run (pytest, 50% left out)", "    test_b.py", "tidegraph: dry run, nothing is executed"]
    said.clear()
    cli.run(spark, str(root), cli.parse(["test", "--all", "--dry-run"]), said.append)
    assert said[0] == "tidegraph: all tests were asked for (pytest)"
    assert cli.parse(["test", "--base", "main", "--", "-k", "x"]) == cli.Options("main", extra=["-k", "x"])


def test_stream(spark, tmp_path):
    s = "project string, change_set_id string, ord int, path string"
    nodes = spark.createDataFrame([("p", "x", True, True), ("p", "y", True, False)], "project string, node_id string, has_tests boolean, has_dynamic boolean")
    files = spark.createDataFrame([("p", "y", "y/y.go", "y")], "project string, node_id string, path string, dir string")
    g = Graph("go", nodes, files, spark.createDataFrame([], "project string, src string, dst string"))
    got = {}
    source = str(tmp_path / "in")
    spark.createDataFrame([("p", "one", 0, "y/y.go"), ("p", "two", 0, "go.mod")], s).coalesce(1).write.parquet(source)
    q = impact_stream(spark.readStream.schema(s).parquet(source), g, lambda df, n: got.update({r.change_set_id: (r.full_run, r.targets) for r in df.collect()}), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(120)
    assert got == {"one": (False, ["x", "y"]), "two": (True, ["x", "y"])}

"""Queries that run the engine's rules, parsers, plans, commands and reports over whole driver tables.

Two kinds of rows are made of a table's keys: a path (``cases``), or a small project of template files (``projects``). ``{k}`` in a template is the row's key, and the row's kind is the
key modulo the number of templates. The SQL has the expected results, written out by hand beside the templates.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .functions import paths, rules
from .operators import classify, commands, report
from .operators.detect import detected, facts
from .operators.impact import compute, impact_rows
from .plans import ANALYZERS, cargo, golang, jest, pytest
from .queries import DYN_SQL, EVENTS_SQL, FK_SQL, KEYED_SQL, TESTS_SQL, event_changes, event_classes, fk_graph, read, region_changes
from .sources import manifests, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    f.__name__ = name
    QUERIES[name], SQL[name] = f, sql


def literal(x) -> str:
    if x is None:
        return "NULL"
    return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def filled(c: Column, k: Column) -> Column:
    return F.replace(c, F.lit("{k}"), k.cast("string"))


# -- paths: a case is a path and what is expected of it


def cases(name: str, f: Callable[[Column], Column], given: Sequence[tuple[str, str | bool | None]]) -> None:
    """``(path, value)`` for each row of part."""
    n, inputs, wanted = len(given), [g[0] for g in given], [g[1] for g in given]

    def run(spark, sf):
        k = F.col("p_partkey")
        at = F.element_at(F.array(*map(F.lit, inputs)), (k % n + 1).cast("int"))
        p = read(spark, sf, "part").select(filled(at, k).alias("path"))
        return p.select("path", f(F.col("path")).alias("value"))

    fill = lambda xs: f"replace([{', '.join(map(literal, xs))}][p_partkey % {n} + 1], '{{k}}', CAST(p_partkey AS VARCHAR))"
    value = f"[{', '.join(map(literal, wanted))}][p_partkey % {n} + 1]" if isinstance(wanted[0], bool) else fill(wanted)
    add(name, run, f"SELECT {fill(inputs)} AS path, {value} AS value FROM part")


cases("go_full_run_rules", lambda p: rules.full_run("go", p), [("go.mod", True), ("d{k}/go.sum", True), ("go.work", True), ("x{k}/go.work.sum", True), ("d/go.mod.{k}", False), ("d{k}/a.go", False), ("go.mod/{k}", False)])
cases(
    "jest_full_run_rules",
    lambda p: rules.full_run("jest", p),
    [("package.json", True), ("p{k}/yarn.lock", True), ("p{k}/tsconfig.app.json", True), ("tsconfig.json", True), ("a{k}/jest.config.mjs", True), (".babelrc.js", True), ("w{k}/.swcrc", True), ("tsconfig{k}.ts", False), ("a/mytsconfig.json", False), ("src/{k}.ts", False), ("jest.config.py", False)],
)
cases(
    "pytest_full_run_rules",
    lambda p: rules.full_run("pytest", p),
    [("pyproject.toml", True), ("a{k}/conftest.py", True), ("requirements.txt", True), ("requirements-dev{k}.txt", True), ("b/poetry.lock", True), ("uv.lock", True), ("my_requirements.txt", False), ("requirements.in", False), ("a/test_{k}.py", False), ("setup.py.bak", False)],
)
cases(
    "cargo_full_run_rules",
    lambda p: rules.full_run("cargo", p),
    [("Cargo.toml", True), ("c{k}/Cargo.lock", True), ("c{k}/build.rs", True), ("rust-toolchain", True), (".cargo/config", True), ("c{k}/.cargo/config.toml", True), ("cargo/config.toml", False), ("config.toml", False), (".cargo/c{k}.toml", False), ("c{k}/src/lib.rs", False)],
)
for _a, _given in {
    "go": [("a/{k}.go", False), ("a/{k}.md", True), ("a/{k}.go.txt", True), ("Makefile", True)],
    "jest": [("a/{k}.tsx", False), ("a/{k}.mjs", False), ("a/{k}.d.ts", True), ("a/{k}.css", True), ("a/{k}", True)],
    "pytest": [("a/{k}.py", False), ("a/{k}.pyi", True), ("{k}.rst", True), (".py", False)],
    "cargo": [("src/{k}.rs", False), ("src/{k}.rss", True), ("README.md", True)],
}.items():
    cases(f"{_a}_ignorable_rules", lambda p, a=_a: rules.ignorable(a, p), _given)
for _a, _given in {
    "jest": [("src/{k}.ts", False), ("node_modules/x/{k}.js", True), ("a/dist/{k}.js", True), ("a/.next/b/{k}.js", True), ("distance/{k}.ts", False), ("build", False), ("a/coverage/{k}", True)],
    "pytest": [("a/{k}.py", False), (".venv/lib/{k}.py", True), ("x/pk.egg-info/{k}.py", True), ("site-packages/{k}.py", True), ("environment/{k}.py", False), ("a/__pycache__/{k}.py", True), ("env.py", False)],
    "cargo": [("target/debug/{k}.rs", True), ("a/target/{k}.rs", True), ("targets/{k}.rs", False), ("src/{k}.rs", False)],
    "go": [("vendor/{k}.go", False), ("a/{k}.go", False)],
}.items():
    cases(f"{_a}_skipped_folders", lambda p, a=_a: rules.skipped(a, p), _given)
cases("go_test_files", lambda p: rules.test_file("go", p), [("a/{k}_test.go", True), ("a/{k}.go", False), ("a/test{k}.go", False), ("_test.go", True)])
cases("normalized_paths", paths.normalize, [("a/./b/{k}", "a/b/{k}"), ("a/../b/{k}/", "b/{k}"), ("/a//b/../../{k}", "/{k}"), ("../x/{k}/..", "../x"), ("", "."), ("{k}/..", ".")])
cases("relative_paths", lambda p: paths.relative(p, F.lit("/w/a")), [("/w/a/{k}", "{k}"), ("/w/b/{k}", "../b/{k}"), ("/w", ".."), ("/x/{k}/y", "../../x/{k}/y"), ("/w/a", ".")])
cases("report_paths", lambda p: paths.relative_or_self(F.lit("/w/a"), p), [("/w/a/{k}/x", "{k}/x"), ("/w/ab/{k}", "/w/ab/{k}"), ("/w/a", "."), ("/x/{k}", "/x/{k}")])
cases("package_patterns", paths.go_pattern, [(".", "./..."), ("a/{k}", "./a/{k}/..."), ("../{k}", "../{k}/..."), ("x", "./x/...")])
cases("quoted_patterns", paths.quote, [("a/[{k}].test.ts", r"a/\[{k}\]\.test\.ts"), ("a+b({k})|c", r"a\+b\({k}\)\|c"), ("$x^{k}?*", r"\$x\^{k}\?\*"), ("plain-{k}", "plain-{k}")])
cases(
    "package_variants",
    lambda p: paths.real_target(p, F.regexp_replace(p, r" \[.*", "")),
    [("m/p{k}", "m/p{k}"), ("m/p{k} [m/p{k}.test]", "m/p{k}"), ("m/p{k}_test [m/p{k}.test]", "m/p{k}"), ("m/q [m/p{k}.test]", "m/p{k}"), ("m/p.test", "m/p.test")],
)
cases("joined_paths", lambda p: paths.join(F.lit("a/b/"), p), [("{k}", "a/b/{k}"), ("x/{k}", "a/b/x/{k}")])


def path_ancestors(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("path"))
    return p.select("page_id", F.posexplode(paths.ancestors(F.col("path"))).alias("place", "dir")).select("page_id", F.col("place").cast("long").alias("place"), "dir")


add(
    "path_ancestors",
    path_ancestors,
    """WITH p AS (SELECT page_id, str_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS x FROM pages), q AS (SELECT page_id, x, unnest(range(1, greatest(len(x), 1) + 1)) AS i FROM p)
SELECT page_id, CAST(i - 1 AS BIGINT) AS place, CASE WHEN i = len(x) THEN '.' ELSE array_to_string(x[1:len(x) - i], '/') END AS dir FROM q""",
)


# -- projects: a template is its files, and what is expected of it


def projects(spark: SparkSession, sf: str, templates: Sequence[dict[str, str]], table: str = "customer", k: str = "c_custkey") -> DataFrame:
    """``schema.FILES``: a project for each row of the table."""
    rows = [(i, name, text) for i, files in enumerate(templates) for name, text in files.items()]
    t = F.broadcast(spark.createDataFrame(rows, "kind int, name string, text string"))  # the templates above
    d = read(spark, sf, table).select(F.col(k).alias("k")).join(t, F.col("k") % len(templates) == F.col("kind"))
    root = F.concat(F.lit("/p"), F.col("k").cast("string"))
    return tree.described(d.select(root.alias("project"), F.concat(root, F.lit("/"), filled(F.col("name"), F.col("k"))).alias("path"), filled(F.col("text"), F.col("k")).alias("content")))


def exported(spark: SparkSession, sf: str, documents: Sequence[object], table: str = "customer", k: str = "c_custkey") -> DataFrame:
    """``(project, content)``: a listing for each row of the table."""
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)]
    t = F.broadcast(spark.createDataFrame(rows, "kind int, text string"))
    d = read(spark, sf, table).select(F.col(k).alias("k")).join(t, F.col("k") % len(documents) == F.col("kind"))
    return d.select(F.concat(F.lit("/p"), F.col("k").cast("string")).alias("project"), filled(F.col("text"), F.col("k")).alias("content"))


def expected(columns: str, rows: Sequence[tuple], kinds: int, table: str = "customer", k: str = "c_custkey") -> str:
    """SQL: ``rows`` (the kind, then the values) for each project of that kind."""
    names = columns.split()
    cells = ", ".join(f"replace(v.\"{c}\", '{{k}}', CAST({k} AS VARCHAR)) AS \"{c}\"" if isinstance(rows[0][i + 1], str) else f'v."{c}"' for i, c in enumerate(names))
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    heads = ", ".join(f'"{c}"' for c in names)
    return f"SELECT '/p' || {k} AS project, {cells} FROM {table} JOIN (VALUES {values}) v(kind_no, {heads}) ON {k} % {kinds} = v.kind_no"


KINDS = [
    {"go.mod": "module m\n", "package.json": '{"jest": {}}'},
    {"package.json": '{"devDependencies": {"jest": "{k}"}}', "conftest.py": ""},
    {"package.json": '{"dependencies": {"left": "1"}}', "Cargo.toml": "[workspace]\n"},
    {"pyproject.toml": "[tool.pytest.ini_options]\n"},
    {"setup.cfg": "[metadata]\n"},
    {"Cargo.toml": "[package]\n", "setup.cfg": "[tool:pytest]\n"},
    {"sub/go.mod": "module m\n", "requirements-dev.txt": "pytest=={k}\n"},
]
add(
    "detect_projects",
    lambda spark, sf: detected(facts(projects(spark, sf, KINDS))),
    expected("analyzer", [(0, "go"), (1, "jest"), (2, "cargo"), (3, "pytest"), (4, None), (5, "pytest"), (6, "pytest")], 7),
)

# Go

GO = [
    {
        "go.mod": "module ex.com/m{k}\n\ngo 1.22\n",
        "a/a.go": 'package a\n\nimport "ex.com/m{k}/b"\n',
        "a/a_test.go": 'package a\n\nimport (\n\t"fmt"\n\tx "ex.com/m{k}/c"\n)\n',
        "b/b.go": "package b\n",
        "c/c.go": 'package c\n\n// import "ex.com/m{k}/a"\nimport x "ex.com/m{k}/b"\n',
    },
    {"go.work": "go 1.22\nuse ./x\nuse (\n\t./y // more\n)\n", "x/go.mod": "module x{k}\n", "x/x.go": 'package x\nimport "y{k}"\n', "y/go.mod": "module y{k}\n", "y/y.go": "package y\n", "z/go.mod": "module z\n", "z/z.go": "package z\n"},
    {"README.md": "no module\n"},
]


def go_patterns(spark, sf):
    p = ANALYZERS["go"].all_targets(projects(spark, sf, GO))
    return p.select("project", F.array_join("patterns", " ").alias("patterns"))


add("go_patterns", go_patterns, expected("patterns", [(0, "./..."), (1, "./x/... ./y/...")], 3))
add("go_source_edges", lambda spark, sf: golang.build(projects(spark, sf, GO)).edges.select("project", "src", "dst"), expected("src dst", [(0, "ex.com/m{k}/a", "ex.com/m{k}/b"), (0, "ex.com/m{k}/a", "ex.com/m{k}/c"), (0, "ex.com/m{k}/c", "ex.com/m{k}/b"), (1, "x{k}", "y{k}")], 3))
add(
    "go_source_nodes",
    lambda spark, sf: golang.build(projects(spark, sf, GO)).nodes.select("project", "node_id", "has_tests"),
    expected("node_id has_tests", [(0, "ex.com/m{k}/a", True), (0, "ex.com/m{k}/b", False), (0, "ex.com/m{k}/c", False), (1, "x{k}", False), (1, "y{k}", False)], 3),
)


def package(id_: str, files: Sequence[str] = (), imports: Sequence[str] = (), main: bool = True, path: str | None = None) -> dict:
    return {"ID": id_, "ImportPath": path or id_, "ForTest": "", "Dir": "/d", "Main": main, "GoFiles": list(files), "Imports": list(imports), "Errors": []}


LISTED = [
    [
        package("m{k}/a", ["/w/a/a.go"], ["m{k}/b", "fmt"]),
        package("m{k}/a [m{k}/a.test]", ["/w/a/a.go", "/w/a/a_test.go"], ["m{k}/b", "m{k}/c", "testing"], path="m{k}/a [m{k}/a.test]"),
        package("m{k}/a.test", ["/cache/main.go"], ["m{k}/a"]),
        package("m{k}/b", ["/w/b/b.go"]),
        package("m{k}/c", ["/w/c/c.go"], ["ext/lib"]),
        package("ext/lib", ["/mod/lib.go"], [], False),
    ],
    [package("only{k}", ["/w/o.go"]), package("only{k}_test [only{k}.test]", ["/w/o_test.go"], ["only{k}"], path="only{k}_test")],
]
add("go_listing_edges", lambda spark, sf: golang.build(None, exported(spark, sf, LISTED)).edges.select("project", "src", "dst"), expected("src dst", [(0, "m{k}/a", "m{k}/b"), (0, "m{k}/a", "m{k}/c")], 2))
add("go_listing_nodes", lambda spark, sf: golang.build(None, exported(spark, sf, LISTED)).nodes.select("project", "node_id", "has_tests"), expected("node_id has_tests", [(0, "m{k}/a", True), (0, "m{k}/b", False), (0, "m{k}/c", False), (1, "only{k}", True)], 2))
add(
    "go_listing_files",
    lambda spark, sf: golang.build(None, exported(spark, sf, LISTED)).node_files.select("project", "node_id", "path"),
    expected("node_id path", [(0, "m{k}/a", "/w/a/a.go"), (0, "m{k}/a", "/w/a/a_test.go"), (0, "m{k}/b", "/w/b/b.go"), (0, "m{k}/c", "/w/c/c.go"), (1, "only{k}", "/w/o.go"), (1, "only{k}", "/w/o_test.go")], 2),
)

# Rust

METADATA = [
    {
        "workspace_root": "/w",
        "packages": [{"id": "a {k}", "name": "a{k}", "manifest_path": "/w/a/Cargo.toml"}, {"id": "b", "name": "b{k}", "manifest_path": "/w/b/Cargo.toml"}, {"id": "serde", "name": "serde", "manifest_path": "/reg/serde/Cargo.toml"}],
        "workspace_members": ["a {k}", "b"],
        "resolve": {"nodes": [{"id": "a {k}", "deps": [{"name": "b", "pkg": "b"}, {"name": "serde", "pkg": "serde"}]}, {"id": "b", "deps": [{"name": "serde", "pkg": "serde"}]}, {"id": "serde", "deps": []}]},
    },
    {"workspace_root": "/v", "packages": [{"id": "c", "name": "c{k}", "manifest_path": "/v/Cargo.toml"}], "workspace_members": ["c"], "resolve": {"nodes": [{"id": "c", "deps": [{"name": "c", "pkg": "c"}]}]}},
]
add("cargo_metadata_crates", lambda spark, sf: cargo.from_metadata(exported(spark, sf, METADATA))[0].select("project", "owner", "dir"), expected("owner dir", [(0, "a{k}", "/w/a"), (0, "b{k}", "/w/b"), (1, "c{k}", "/v")], 2))
add("cargo_metadata_edges", lambda spark, sf: cargo.from_metadata(exported(spark, sf, METADATA))[1].select("project", "src", "dst"), expected("src dst", [(0, "a{k}", "b{k}"), (1, "c{k}", "c{k}")], 2))
RUST = [
    {
        "Cargo.toml": '[workspace]\nmembers = ["a", "b"]\n',
        "a/Cargo.toml": '[package]\nname = "a{k}"\n[dependencies]\nb = { path = "../b" }\nserde = "1"\n',
        "a/src/lib.rs": "pub fn f() {}\n",
        "a/src/deep/x.rs": "# [ test ]\nfn t() {}\n",
        "b/Cargo.toml": '[package]\nname = "b{k}"\n[dev-dependencies]\nc = { path = "../c" }\n',
        "b/src/lib.rs": "// no tests\n",
        "c/Cargo.toml": '[package]\nname = "c{k}"\n[target."cfg(unix)".build-dependencies]\nb = { path = "../b" }\n',
        "c/tests/it.rs": "fn main() {}\n",
        "target/debug/gen.rs": "#[test]\n",
    }
]
add("cargo_graph_edges", lambda spark, sf: cargo.build(projects(spark, sf, RUST)).edges.select("project", "src", "dst"), expected("src dst", [(0, "a{k}", "b{k}"), (0, "b{k}", "c{k}"), (0, "c{k}", "b{k}")], 1))
add("cargo_graph_nodes", lambda spark, sf: cargo.build(projects(spark, sf, RUST)).nodes.select("project", "node_id", "has_tests"), expected("node_id has_tests", [(0, "a{k}", True), (0, "b{k}", False), (0, "c{k}", True)], 1))
add(
    "cargo_graph_files",
    lambda spark, sf: cargo.build(projects(spark, sf, RUST)).node_files.select("project", "node_id", "path"),
    expected("node_id path", [(0, "a{k}", "/p{k}/a/src/lib.rs"), (0, "a{k}", "/p{k}/a/src/deep/x.rs"), (0, "b{k}", "/p{k}/b/src/lib.rs"), (0, "c{k}", "/p{k}/c/tests/it.rs")], 1),
)

# JavaScript

MAPPED = [
    {"package.json": '{"jest": {"moduleNameMapper": {"^~/(.*)$": "<rootDir>/src/$1", "(?=x)y": "never", "^two$": ["gone{k}", "src/b"]}}}'},
    {"package.json": '{"jest": {"moduleNameMapper": {"^a$": "ignored"}}}', "jest.config.json": '{"moduleNameMapper": {"^b{k}$": "src/b"}}'},
    {"package.json": '{"name": "none"}'},
]
add(
    "jest_alias_rules",
    lambda spark, sf: manifests.alias_rules(projects(spark, sf, MAPPED)).select("project", F.col("rule_ord").cast("string").alias("rule_ord"), "pattern", F.col("target_ord").cast("string").alias("target_ord"), "template"),
    expected("rule_ord pattern target_ord template", [(0, "0", "^~/(.*)$", "0", "<rootDir>/src/$1"), (0, "2", "^two$", "0", "gone{k}"), (0, "2", "^two$", "1", "src/b"), (1, "0", "^b{k}$", "0", "src/b")], 3),
)
PACKAGES = [{"package.json": '{"dependencies": {"left": "^{k}"}, "devDependencies": {"jest": "29"}, "jest": {"roots": ["a{k}"]}}', "a/package.json": "{}"}, {"package.json": '{"name": "x"}'}, {"other.json": "{}"}]
add(
    "package_json_fields",
    lambda spark, sf: manifests.package_json(projects(spark, sf, PACKAGES)).select("project", F.col("dependencies")["left"].alias("left"), F.col("devDependencies")["jest"].alias("jest"), F.col("jest").alias("config")),
    expected("left jest config", [(0, "^{k}", "29", '{"roots":["a{k}"]}'), (1, None, None, None)], 3),
)
JS = [
    {
        "package.json": '{"jest": {"moduleNameMapper": {"^~/(.*)$": "<rootDir>/src/$1"}}}',
        "tsconfig.json": '{// paths\n"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["gone/*", "src/lib/*"]}},}',
        "src/a.ts": "import {b} from './b'\nimport type {T} from './types'\nexport * from '~/c'\nimport 'left'\n",
        "src/b.tsx": "const d = require('./dir')\n// import './a'\n",
        "src/c.ts": "import x from '@lib/util'\nimport './b.js'\n",
        "src/types.ts": "export type T = {k}\n",
        "src/dir/index.js": "const s = \"require('./a')\"\n",
        "src/lib/util.mjs": "export default {k}\n",
        "src/a.test.ts": "import {a} from './a'\n",
        "node_modules/left/index.js": "require('../../src/a')\n",
    },
    {
        "package.json": "{}",
        "src/opaque.ts": "import(name{k})\n",
        "src/glob.ts": "const load = n => import(`./pages/${n}.ts`)\n",
        "src/none.ts": "import(`./gone/${n}`)\n",
        "src/plain.ts": "import(`./pages/one`)\n",
        "src/pages/one.ts": "",
        "src/pages/deep/two.ts": "",
        "src/__tests__/all.ts": "import '../glob'\n",
    },
]
add(
    "jest_graph_edges",
    lambda spark, sf: jest.build(projects(spark, sf, JS, "supplier", "s_suppkey")).edges.select("project", "src", "dst"),
    expected(
        "src dst",
        [
            (i, f"/p{{k}}/src/{a}", f"/p{{k}}/src/{b}")
            for i, a, b in [
                (0, "a.ts", "b.tsx"), (0, "a.ts", "c.ts"), (0, "b.tsx", "dir/index.js"), (0, "c.ts", "lib/util.mjs"), (0, "c.ts", "b.tsx"), (0, "a.test.ts", "a.ts"),
                (1, "glob.ts", "pages/one.ts"), (1, "glob.ts", "pages/deep/two.ts"), (1, "plain.ts", "pages/one.ts"), (1, "__tests__/all.ts", "glob.ts"),
            ]
        ],
        2, "supplier", "s_suppkey",
    ),
)
add(
    "jest_graph_nodes",
    lambda spark, sf: jest.build(projects(spark, sf, JS, "supplier", "s_suppkey")).nodes.select("project", "node_id", "has_tests", "has_dynamic"),
    expected(
        "node_id has_tests has_dynamic",
        [
            (i, f"/p{{k}}/src/{a}", t, d)
            for i, a, t, d in [
                (0, "a.ts", False, False), (0, "b.tsx", False, False), (0, "c.ts", False, False), (0, "types.ts", False, False), (0, "dir/index.js", False, False), (0, "lib/util.mjs", False, False), (0, "a.test.ts", True, False),
                (1, "opaque.ts", False, True), (1, "glob.ts", False, False), (1, "none.ts", False, True), (1, "plain.ts", False, False), (1, "pages/one.ts", False, False), (1, "pages/deep/two.ts", False, False), (1, "__tests__/all.ts", True, False),
            ]
        ],
        2, "supplier", "s_suppkey",
    ),
)
add(
    "js_scanned_files",
    lambda spark, sf: jest.scanned(tree.sources(projects(spark, sf, JS), "jest")).select("project", "path", "kind", F.coalesce("value", F.lit("")).alias("value")),
    expected(
        "path kind value",
        [
            (i, f"/p{{k}}/src/{a}", kind, v)
            for i, a, kind, v in [
                (0, "a.ts", "import", "./b"), (0, "a.ts", "import", "~/c"), (0, "a.ts", "import", "left"), (0, "b.tsx", "import", "./dir"), (0, "c.ts", "import", "@lib/util"), (0, "c.ts", "import", "./b.js"), (0, "a.test.ts", "import", "./a"),
                (1, "opaque.ts", "opaque", ""), (1, "glob.ts", "template", "./pages/"), (1, "none.ts", "template", "./gone/"), (1, "plain.ts", "import", "./pages/one"), (1, "__tests__/all.ts", "import", "../glob"),
            ]
        ],
        2,
    ),
)

# Python

PY = [
    {
        "pyproject.toml": "",
        "src/pk{k}/__init__.py": "",
        "src/pk{k}/leaf.py": "import os\n",
        "src/pk{k}/mid.py": "from . import leaf\nfrom .leaf import f\n",
        "src/pk{k}/sub/__init__.py": "from .. import mid\n",
        "src/pk{k}/sub/deep.py": "from ..mid import g\nimport importlib\nimportlib.import_module('pk.leaf')\n",
        "tests/test_mid.py": "def test():\n    import pk{k}.mid\n    from pk{k}.sub import deep\n    from ....far import x\n",
        "tests/test_bad.py": "import pk{k}.leaf\ndef (\n",
        "src/same.py": "__import__('x')\n",
        "same.py": "import pk{k}\n",
        "user_test.py": "import same\n",
        "build/lib.py": "import same\n",
    }
]
add(
    "py_graph_edges",
    lambda spark, sf: pytest.build(projects(spark, sf, PY)).edges.select("project", "src", "dst"),
    expected(
        "src dst",
        [
            (0, f"/p{{k}}/{a}", f"/p{{k}}/{b}")
            for a, b in [
                ("src/pk{k}/mid.py", "src/pk{k}/__init__.py"), ("src/pk{k}/mid.py", "src/pk{k}/leaf.py"), ("src/pk{k}/sub/__init__.py", "src/pk{k}/__init__.py"), ("src/pk{k}/sub/deep.py", "src/pk{k}/mid.py"),
                ("tests/test_mid.py", "src/pk{k}/mid.py"), ("tests/test_mid.py", "src/pk{k}/sub/__init__.py"), ("same.py", "src/pk{k}/__init__.py"), ("user_test.py", "same.py"),
            ]
        ],
        1,
    ),
)
add(
    "py_graph_nodes",
    lambda spark, sf: pytest.build(projects(spark, sf, PY)).nodes.select("project", "node_id", "has_tests", "has_dynamic"),
    expected(
        "node_id has_tests has_dynamic",
        [
            (0, f"/p{{k}}/{a}", t, d)
            for a, t, d in [
                ("src/pk{k}/__init__.py", False, False), ("src/pk{k}/leaf.py", False, False), ("src/pk{k}/mid.py", False, False), ("src/pk{k}/sub/__init__.py", False, False), ("src/pk{k}/sub/deep.py", False, True),
                ("tests/test_mid.py", True, False), ("tests/test_bad.py", True, False), ("src/same.py", False, True), ("same.py", False, False), ("user_test.py", True, False),
            ]
        ],
        1,
    ),
)
add(
    "py_module_registry",
    lambda spark, sf: pytest.registry(pytest.modules(tree.sources(projects(spark, sf, PY), "pytest"))).select("project", "module", "path"),
    expected(
        "module path",
        [
            (0, m, f"/p{{k}}/{p}")
            for m, p in [
                ("pk{k}", "src/pk{k}/__init__.py"), ("pk{k}.leaf", "src/pk{k}/leaf.py"), ("pk{k}.mid", "src/pk{k}/mid.py"), ("pk{k}.sub", "src/pk{k}/sub/__init__.py"), ("pk{k}.sub.deep", "src/pk{k}/sub/deep.py"),
                ("tests.test_mid", "tests/test_mid.py"), ("tests.test_bad", "tests/test_bad.py"), ("same", "same.py"), ("user_test", "user_test.py"),
            ]
        ],
        1,
    ),
)

# -- commands; an order's parts are its targets

ORDER_SQL = "FROM (SELECT DISTINCT l_orderkey AS k, CAST(l_partkey AS VARCHAR) AS p FROM lineitem) GROUP BY k"


def order_targets(spark, sf, template: str) -> DataFrame:
    t = F.array_sort(F.collect_set(F.replace(F.lit(template), F.lit("{p}"), F.col("l_partkey").cast("string"))))  # an order has seven lines at most
    return read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(t.alias("targets"))


def command_query(name: str, template: str, f: Callable[[Column], Column], sql: str) -> None:
    add(name, lambda spark, sf: order_targets(spark, sf, template).select("k", F.array_join(f(F.col("targets")), " ").alias("command")), f"SELECT k, {sql} AS command {ORDER_SQL}")


command_query("go_commands", "./part{p}", lambda t: commands.command("go", t, ["-run", "X"]), "'go test -run X ' || string_agg('./part' || p, ' ' ORDER BY './part' || p)")
command_query(
    "jest_commands",
    "src/[{p}].test.ts",
    lambda t: commands.command("jest", t, ["--ci"], local=F.when(F.col("k") % 2 == 0, F.lit("/w/node_modules/.bin/jest"))),
    r"CASE WHEN k % 2 = 0 THEN '/w/node_modules/.bin/jest' ELSE 'npx jest' END || ' ' || string_agg('^src/\[' || p || '\]\.test\.ts$', '|' ORDER BY 'src/[' || p || '].test.ts') || ' --ci'",
)
command_query(
    "pytest_commands",
    "tests/test_{p}.py",
    lambda t: commands.command("pytest", t, ["-q"], venv=F.when(F.col("k") % 2 == 0, F.lit("/w/.venv/bin/pytest")), python="python3"),
    "CASE WHEN k % 2 = 0 THEN '/w/.venv/bin/pytest' ELSE 'python3 -m pytest' END || ' ' || string_agg('tests/test_' || p || '.py', ' ' ORDER BY 'tests/test_' || p || '.py') || ' -q'",
)
command_query("cargo_commands", "crate{p}", lambda t: commands.command("cargo", t, ["--", "x"]), "'cargo test ' || string_agg('-p crate' || p, ' ' ORDER BY 'crate' || p) || ' -- x'")
BINARIES = [{"node_modules/.bin/jest": "", "venv/bin/pytest": "", ".venv/bin/pytest": ""}, {"a/node_modules/.bin/jest": "", "env/bin/pytest": ""}, {"package.json": "{}"}]


def local_runners(spark, sf):
    files = projects(spark, sf, BINARIES)
    both = [commands.local_binaries(files, a).select("project", F.lit(a).alias("analyzer"), "binary") for a in ("jest", "pytest")]
    return both[0].unionByName(both[1])


add("local_runners", local_runners, expected("analyzer binary", [(0, "jest", "/p{k}/node_modules/.bin/jest"), (0, "pytest", "/p{k}/.venv/bin/pytest"), (1, "pytest", "/p{k}/env/bin/pytest")], 3))

# -- reports


def changed_report(spark, sf):
    r = report.changed_report(event_changes(spark, sf), F.lit("u"))
    return r.select("change_set_id", "n_changed", F.col("ord").cast("long").alias("ord"), "path")


add("changed_report", changed_report, f"WITH {EVENTS_SQL} SELECT change_set_id, count(*) OVER (PARTITION BY change_set_id) AS n_changed, CAST(ord AS BIGINT) AS ord, path[3:] AS path FROM k")


def full_run_report(spark, sf):
    gates = classify.gate(event_classes(spark, sf))
    return report.full_run_report(gates, F.lit("u")).select("change_set_id", F.col("ord").cast("long").alias("place"), "reason")


add(
    "full_run_report",
    full_run_report,
    f"WITH {EVENTS_SQL} SELECT change_set_id, row_number() OVER (PARTITION BY change_set_id ORDER BY cls <> 'full', ord, path) - 1 AS place, path[3:] AS reason FROM k WHERE cls IN ('full', 'unresolved')",
)


def impact_lists(spark, sf):
    """The result rows' lists: their lengths, and the digest of the sorted targets."""
    rows = compute(fk_graph(spark, sf), region_changes(spark, sf))
    n = lambda c: F.size(c).cast("long")
    return rows.select("change_set_id", "full_run", n("targets").alias("n_targets"), n("changed_targets").alias("n_changed"), n("uncertain_targets").alias("n_uncertain"), F.md5(F.array_join("targets", ",").cast("binary")).alias("targets_md5"))


SEEN_SQL = f"{FK_SQL}, {TESTS_SQL}, {DYN_SQL}, {KEYED_SQL}"
add(
    "impact_lists",
    impact_lists,
    f"""WITH RECURSIVE {SEEN_SQL},
a AS (SELECT change_set_id, node_id FROM c UNION SELECT 'region:' || r_regionkey, node_id FROM region, u),
s AS (SELECT change_set_id, a.node_id, c.node_id IS NULL AS only FROM a JOIN t USING (node_id) LEFT JOIN c USING (change_set_id, node_id))
SELECT r.id AS change_set_id, false AS full_run, count(s.node_id) AS n_targets, CAST(1 AS BIGINT) AS n_changed, count(*) FILTER (WHERE s.only) AS n_uncertain, md5(coalesce(string_agg(s.node_id, ',' ORDER BY s.node_id), '')) AS targets_md5
FROM (SELECT 'region:' || r_regionkey AS id FROM region) r LEFT JOIN s ON s.change_set_id = r.id GROUP BY r.id""",
)


def impact_report_rows(spark, sf):
    """A row for each target, with its marker and the counts that a report begins with."""
    g = fk_graph(spark, sf)
    r = report.report_rows(impact_rows(g, region_changes(spark, sf))[1], g.nodes)
    return r.select("change_set_id", "target", "marker", "selected", "total", "skip_pct")


add(
    "impact_report_rows",
    impact_report_rows,
    f"""WITH RECURSIVE {SEEN_SQL},
a AS (SELECT change_set_id, node_id FROM c UNION SELECT 'region:' || r_regionkey, node_id FROM region, u),
s AS (SELECT change_set_id, a.node_id AS target, CASE WHEN c.node_id IS NULL THEN '~' ELSE ' ' END AS marker, count(*) OVER (PARTITION BY change_set_id) AS selected FROM a JOIN t USING (node_id) LEFT JOIN c USING (change_set_id, node_id)),
n AS (SELECT count(*) AS total FROM t)
SELECT change_set_id, target, marker, selected, total, CAST(round_even((total - selected) / total * 100, 0) AS DOUBLE) AS skip_pct FROM s, n""",
)

# -- trees and rules


def tree_files(spark, sf):
    """Nations as a tree of files in the shared folder, read as a tree: a folder for each region and nation."""
    root = work.work_path(spark, "tree").removeprefix("file://")
    n = read(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("region"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("nation"), F.col("n_name").alias("value"))
    n.repartition("region", "nation").write.partitionBy("region", "nation").text(root)
    f = tree.read_tree(spark, root, "*.txt")
    rel = paths.relative_or_self(F.col("project"), F.col("dir"))
    return f.select(rel.alias("dir"), "ext", F.trim(F.regexp_replace(F.col("content").cast("string"), "\n", "")).alias("text"))


add("tree_files", tree_files, "SELECT 'region=r' || n_regionkey || '/nation=n' || n_nationkey AS dir, '.txt' AS ext, n_name AS text FROM nation")
TRACKED = [{"a.go": "", "a.md": "", "node_modules/x.js": "", "src/x.js": "", "src/x.d.ts": "", "target/x.rs": "", "src/x.rs": "", "venv/x.py": "", "x.py": "", "pk.egg-info/y.py": ""}]


def tracked_sources(spark, sf):
    """The files that each analyzer reads, without those below folders that it skips."""
    f = projects(spark, sf, TRACKED)
    out = [tree.sources(f, a).select("project", F.lit(a).alias("analyzer"), "path") for a in rules.ANALYZERS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


add("tracked_sources", tracked_sources, expected("analyzer path", [(0, "go", "/p{k}/a.go"), (0, "jest", "/p{k}/src/x.js"), (0, "cargo", "/p{k}/src/x.rs"), (0, "pytest", "/p{k}/x.py")], 1))
TOKENS = [{"setup.cfg": "[tool:pytest]\n"}, {"setup.cfg": "[metadata]\n"}, {"a/setup.cfg": "[tool:pytest]\n"}]
add("project_tokens", lambda spark, sf: tree.has_token(projects(spark, sf, TOKENS), "setup.cfg", "[tool:pytest]").select("project", "found"), expected("found", [(0, True), (1, False), (2, False)], 3))


def rule_names(spark, sf):
    """The rules table met by changed files: which analyzer's full-run names a path's last part is."""
    p = read(spark, sf, "customer").select(F.concat(F.lit("d"), F.col("c_custkey").cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, NAMED)), (F.col("c_custkey") % len(NAMED) + 1).cast("int"))).alias("path"))
    r = F.broadcast(rules.table(spark).where("rule = 'full_run' AND match_kind = 'basename'").select("analyzer", "value"))
    return p.withColumn("value", paths.base(F.col("path"))).join(r, "value").select("path", "analyzer")


NAMED = ["go.sum", "package.json", "tox.ini", "Cargo.lock", "notes.txt"]
add("rule_names", rule_names, "SELECT 'd' || c_custkey || '/' || ['go.sum', 'package.json', 'tox.ini', 'Cargo.lock'][c_custkey % 5 + 1] AS path, ['go', 'jest', 'pytest', 'cargo'][c_custkey % 5 + 1] AS analyzer FROM customer WHERE c_custkey % 5 < 4")

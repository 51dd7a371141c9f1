import pytest
from pyspark.sql import functions as F

from ripplet.operators import resolve
from ripplet.operators.resolve import index_files
from ripplet.sources.facts import file_facts, scan
from tests import library as lib


def named_edges(index, kind):
    nodes = index.graph.nodes.select("id", F.coalesce("qualified_name", "path").alias("n"))
    edges = index.graph.edges.filter(F.col("type") == kind)
    rows = edges.join(nodes.toDF("source", "s"), "source").join(nodes.toDF("target", "t"), "target").select("s", "t")
    return {tuple(r) for r in rows.collect()}


def test_symbols(library):
    rows = library[0].graph.nodes.filter("label = 'Symbol'").select("path", "qualified_name", "kind").collect()
    assert {tuple(r) for r in rows} == lib.SYMBOLS and len(rows) == len(lib.SYMBOLS)


def test_edges_of_every_type(library):
    index = library[0]
    for kind in ("IMPORTS", "CALLS", "TESTS", "EXTENDS", "IMPLEMENTS"):
        assert named_edges(index, kind) == getattr(lib, kind), kind
    assert len(named_edges(index, "DEFINES")) == len(lib.SYMBOLS)
    assert index.graph.edges.filter("type = 'CONTAINS'").count() == len(lib.FILES)


def test_diagnostics(library):
    d = library[0].diagnostics.head()
    assert (d.files_scanned, d.symbols_extracted, d.tests_detected) == (len(lib.FILES), len(lib.SYMBOLS), 2)
    # "chai" is no file of the project.
    assert (d.imports_resolved, d.imports_unresolved) == (12, 1)
    assert d.calls_resolved == len(lib.CALLS) and d.calls_unresolved > 0


def test_symbol_properties(library):
    rows = {r.qualified_name: r for r in library[0].graph.nodes.filter("label = 'Symbol'").collect()}
    assert rows["Desk.checkout"].is_async and rows["deskLends"].is_async and not rows["lend"].is_async
    assert rows["StandardRule.days"].exported and rows["clear"].exported and not rows["Shelf"].exported
    assert (rows["StandardRule"].start_line, rows["StandardRule"].end_line) == (7, 11)
    assert rows["loanLength"].signature == "export function loanLength(book: Book): number"
    assert rows["Shelf"].file_kind == "declaration"


def test_overloads_count_once(spark):
    text = """class Meter {
  read(at: Date): number;
  read(at: string): number;
  read(at: Date | string, zone: string): number;
  read(at: Date | string, zone?: string): number { return parse(at, zone); }
}
declare function parse(at: string): number;
function parse(at: any, zone?: any): number { return zone ? 1 : 2; }
"""
    files = spark.createDataFrame([("power/meter.mts", text)], "path string, content string")
    index = index_files(files, "o", "repository:o", "o")
    names = [r.qualified_name for r in index.graph.nodes.filter("label = 'Symbol'").collect()]
    assert sorted(names) == ["Meter", "Meter.read", "parse"]
    assert named_edges(index, "CALLS") == {("Meter.read", "parse")}


SHELF = """export class Base { stop(): void {} helper = makeHelper(); }
export class Helper { fix(): Helper { return this; } get peer(): Helper { return this; } }
export function makeHelper(): Helper { return new Helper(); }
export const build = (n: number): Shelf => new Shelf();
export class Shelf extends Base {
  top = new Helper();
  deep: Nest;
  stop(): void { super.stop(); }
  grow(): Helper { return this.top; }
}
export interface Nest { inner: Helper; }
export const shared = new Shelf();
"""
RECEIVERS = """import { build, makeHelper, shared, Shelf } from "@lib/shelf";
import * as all from "@lib/shelf";
export function result() { makeHelper().fix(); }
export function assigned() { const h = makeHelper(); h.fix(); }
export function deep() { const x = build(1), y = 2; const z = x.deep.inner; z.peer.fix(); }
export function chained() { shared.grow().fix().fix(); }
export function created() { new Shelf().stop(); }
export function spaced() { all.makeHelper().fix(); }
export function inherited() { shared.helper.fix(); }
export function through() { const m = all.shared; m.top.fix(); }
export function inner() { function own(): Shelf { return shared; } own().top.fix(); }
export function circular() { const p = q; const q = p; p.fix(); }
export function sum() { const n = makeHelper() + 1; n.fix(); }
export function unknown(a) { a.b().fix(); [makeHelper()][0].fix(); }
"""


def test_receivers_are_walked_over_declared_types(spark):
    files = spark.createDataFrame([("lib/shelf.ts", SHELF), ("app/main.ts", RECEIVERS)], "path string, content string")
    patterns = spark.createDataFrame([("@lib/*", 0, "nowhere/*"), ("@lib/*", 1, "./lib/*"), ("@*", 0, "wrong/*")], "pattern string, turn int, target string")
    index = index_files(files, "x", "repository:x", "x", patterns=patterns)
    assert named_edges(index, "IMPORTS") == {("app/main.ts", "lib/shelf.ts")}
    fix = {(f, "Helper.fix") for f in ("result", "assigned", "deep", "chained", "spaced", "inherited", "through", "inner")}
    assert named_edges(index, "CALLS") == fix | {
        ("Base", "makeHelper"), ("Shelf.stop", "Base.stop"), ("result", "makeHelper"), ("assigned", "makeHelper"), ("deep", "build"),
        ("chained", "Shelf.grow"), ("created", "Shelf.stop"), ("spaced", "makeHelper"), ("inner", "inner"), ("sum", "makeHelper"), ("unknown", "makeHelper"),
    }


def test_path_patterns(spark):
    from ripplet.operators.resolve import resolve_modules

    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/deep/a.ts", "other/a.d.ts", "kit/index.ts", "src/one.js", "src/x.gen.ts", "src/plain.ts")], "path string")
    patterns = spark.createDataFrame(
        [("@/*", 0, "other/*"), ("@/*", 1, "src/*"), ("@/deep/*", 0, "src/deep/*"), ("@/none/*", 0, "missing/*"), ("kit", 0, "./kit"), ("ki*", 0, "src/*"),
         ("gen:*.view", 0, "src/*.gen"), ("*", -1, "src/*")], "pattern string, turn int, target string")
    names = ["@/a", "@/one", "@/deep/a", "@/none/a", "kit", "kita", "gen:x.view", "gen:.view", "plain", "plain.js", "absent", "./src/a", "@/"]
    facts = spark.createDataFrame([("import", n) for n in names], "fact string, ref string")
    wanted = {"@/a": "other/a.d.ts", "@/one": "src/one.js", "@/deep/a": "src/deep/a.ts", "kit": "kit/index.ts", "gen:x.view": "src/x.gen.ts",
              "plain": "src/plain.ts", "plain.js": "src/plain.ts", "./src/a": "src/a.ts"}
    assert dict(map(tuple, resolve_modules(facts, files, patterns).collect())) == wanted
    assert dict(map(tuple, resolve_modules(facts, files).collect())) == {"./src/a": "src/a.ts"}


def test_patterns_of_a_project(tmp_path):
    from ripplet.sources.discovery import project_patterns

    assert project_patterns(str(tmp_path)) == []
    (tmp_path / "shared").mkdir()
    (tmp_path / "shared" / "base.json").write_text('{"compilerOptions": {"baseUrl": "../src", "paths": {"old/*": ["x/*"]}}}')
    (tmp_path / "tsconfig.json").write_text("""{ // settings
      "extends": "./shared/base", /* "paths": 1, */
      "compilerOptions": { "paths": { "@/*": ["./*", "../gen/*", "../../out/*"], "site//*": ["http,]*"], }, },
    }""")
    assert project_patterns(str(tmp_path)) == [("@/*", 0, "src/*"), ("@/*", 1, "gen/*"), ("site//*", 0, "src/http,]*"), ("*", -1, "src/*")]
    (tmp_path / "tsconfig.json").write_text("{ broken")
    assert project_patterns(str(tmp_path)) == []


def test_cyclic_reexports_resolve_to_nothing(spark):
    files = spark.createDataFrame([
        ("a.ts", 'export { x } from "./b";\nimport { x } from "./b";\nexport function go() { return x(); }\n'),
        ("b.ts", 'export { x } from "./a";\nexport * from "./c";\n'),
        ("c.ts", 'export * from "./b";\nexport function y() { return 1; }\n'),
        ("d.ts", 'import { y } from "./b";\nexport function use() { return y(); }\n'),
    ], "path string, content string")
    index = index_files(files, "c", "repository:c", "c")
    assert named_edges(index, "CALLS") == {("use", "y")}
    assert index.diagnostics.head().calls_unresolved == 1


def test_ambiguous_targets_are_counted_not_guessed(spark):
    files = spark.createDataFrame([(
        "m.ts", "class A { run(): void; run(x?: number): void { } }\nfunction f(a: A) { a.run(); }\n")],
        "path string, content string")
    index = index_files(files, "m", "repository:m", "m")
    # One declaration lies in the method, the other only in the class.
    assert named_edges(index, "CALLS") == set()
    assert index.diagnostics.head().calls_unresolved == 1


def test_callback_calls_stay_in_their_symbol(spark):
    files = spark.createDataFrame([("m.ts", "export function each(run: () => void) { run(); }\n")],
                                  "path string, content string")
    assert named_edges(index_files(files, "m", "repository:m", "m"), "CALLS") == {("each", "each")}


def test_scanner_skips_text():
    source = "const a = /\\/[/(]x(/.test(`a${f({b: `}`})}c()`) // g()\n/* h() */ + 'i()' + \"j()\";"
    words = [t[1] for t in scan(source)]
    assert "f" in words and "g" not in words and "h" not in words and "i" not in words
    calls = [r["name"] for r in file_facts("a.ts", source) if r["fact"] == "call"]
    assert sorted(calls) == ["f", "test"]


def test_scanner_survives_broken_files():
    for text in ("", "}", "class {", "import {", "export function f(", "`${", "const x = <", "a = 'open", "type X =",
                 "enum", "export default", "class A { m(", "({[", "@", "interface I extends", "function (", "export *"):
        file_facts("x.ts", text)


def test_generic_calls_and_new():
    rows = file_facts("a.ts", "function f() { g<string>(1); new H(2); a?.b?.(3); x!.y(); if (z) { w() } }")
    calls = {(r["owner"], r["name"]) for r in rows if r["fact"] == "call"}
    assert calls == {("", "g"), ("a", "b"), ("x", "y"), ("", "w")}


def test_facts_are_kept_as_compressed_columns(spark, monkeypatch):
    # A checkpoint keeps rows uncompressed; file texts and facts repeat themselves.
    class Stop(Exception):
        pass

    def stop(facts, files, *rest):
        assert all(f.endswith(".zstd.parquet") for df in (facts, files) for f in df.inputFiles() or ["none"])
        raise Stop

    monkeypatch.setattr(resolve, "Resolver", stop)
    files = spark.createDataFrame([("a.ts", "export const a = 1;")], "path string, content string")
    with pytest.raises(Stop):
        index_files(files, "r", "repository:r", "r")

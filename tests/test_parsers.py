from __future__ import annotations

import pytest

from repolens.functions.parsers import language_of, parse


def js(source: str, path: str = "/warehouse.js", **more: bool) -> dict:
    return parse(path, source, **more)


def one(rows: list[dict], **key: object) -> dict:
    found = [r for r in rows if all(r[k] == v for k, v in key.items())]
    assert len(found) == 1, rows
    return found[0]


def test_a_declared_function_on_several_lines():
    f = one(js("// stock keeping\n\nfunction countPallets(aisle,\n    floor) {\n  return aisle.length * floor;\n}\n")["functions"])
    assert (f["name"], f["args"], f["line_number"], f["end_line"]) == ("countPallets", ["aisle", "floor"], 3, 6)
    assert (f["cyclomatic_complexity"], f["is_async"], f["kind"], f["docstring"]) == (1, False, None, None)


def test_an_arrow_has_the_text_and_comment_of_its_statement():
    f = one(js("let first = 0;\n/** litres to gallons */\nconst gallons = (litres, factor = 0.264, ...rest) =>\n  litres * factor;\nlet last = 9")["functions"])
    assert (f["name"], f["args"], f["line_number"], f["end_line"]) == ("gallons", ["litres", "factor", "...rest"], 3, 4)
    assert f["source"] == "const gallons = (litres, factor = 0.264, ...rest) =>\n  litres * factor;" and f["docstring"] == "/** litres to gallons */"


@pytest.mark.parametrize("source", ["async function unload() {}", "const unload = async () => 0", "const unload = async function () {}", "class Truck { async unload() {} }"])
def test_async_of_every_form(source: str):
    assert one(js(source)["functions"], name="unload")["is_async"]


def test_members_by_kind():
    made = js("class Crane {\n  constructor(reach) {}\n  lift(load) {}\n  get load() { return 0 }\n  set load(kg) {}\n  static build() {}\n  set() {}\n  static() {}\n}")
    assert [(f["name"], f["kind"]) for f in made["functions"]] == [
        ("constructor", "constructor"), ("lift", None), ("load", "getter"), ("load", "setter"), ("build", "static"), ("set", None), ("static", None),
    ]
    assert all(f["class_context"] == "Crane" and f["context"] is None for f in made["functions"])


@pytest.mark.parametrize(
    ("body", "branches"),
    [
        ("return 0", 0), ("if (full) stop()", 1), ("if (full) stop(); else go()", 2), ("if (a) {} else if (b) {} else {}", 4), ("for (const box of boxes) for (let k in box) {}", 2),
        ("while (more) { do { next() } while (busy) }", 2), ("switch (day) { case 'mon': case 'tue': rest(); default: work() }", 2), ("try { sail() } catch { swim() } finally { dry() }", 1),
        ("return wet ? dry : wet ? 1 : 2", 2), ("return a || b && c", 2), ("x ??= a ?? b", 1), ("port?.berth?.[0]", 0), ("const s = `if ${k ? 1 : 2} while`", 1),
        ("/* for if while */ // ? :", 0), ("return /if|while(?:x)&&/.test(name)", 0), ("ship.catch(net).if(x)", 0),
    ],
)
def test_each_branch_counts(body: str, branches: int):
    assert one(js(f"function voyage() {{ {body} }}")["functions"])["cyclomatic_complexity"] == 1 + branches


def test_branches_of_inner_functions_count_for_the_outer_one():
    made = js("function harbour(n) {\n  const tide = () => n ? 1 : 2;\n  for (;;) { if (tide()) break; else continue }\n}")
    assert {f["name"]: f["cyclomatic_complexity"] for f in made["functions"]} == {"harbour": 5, "tide": 2}
    assert one(made["functions"], name="tide")["context"] == "harbour"


def test_class_forms_and_bases():
    made = js("class Vessel {}\nclass Ferry extends Vessel { dock() {} }\nconst Tug = class extends Vessel { tow() {} };")
    assert [(c["name"], c["bases"], c["line_number"]) for c in made["classes"]] == [("Vessel", [], 1), ("Ferry", ["Vessel"], 2), ("Tug", ["Vessel"], 3)]
    assert {f["name"]: f["class_context"] for f in made["functions"]} == {"dock": "Ferry", "tow": "Tug"}


def test_import_forms():
    made = js('import charts, { depth, buoy as marker } from "./sea";\nimport * as stars from "sky";\nimport "./lamp";\nconst rope = require("./rope");\nrequire("anchor");')
    rows = [(i["name"], i["source"], i["alias"], i["is_default"], i["is_namespace"], i["line_number"]) for i in made["imports"]]
    assert rows == [
        ("charts", "./sea", None, True, False, 1), ("depth", "./sea", None, False, False, 1), ("marker", "./sea", "buoy", False, False, 1),
        ("stars", "sky", None, False, True, 2), ("rope", "./rope", None, False, False, 4), ("anchor", "anchor", None, False, False, 5),
    ]
    assert [v["name"] for v in made["variables"]] == ["rope"]


def test_call_forms():
    made = js("function sail() {\n  hoist('main', { at: [2, 3] });\n  mast.raise(1);\n  const k = new Knot(9);\n  crew.all().rest(8, k);\n}\nsail();")
    rows = [(c["name"], c["full_call_name"], c["inferred_obj_type"], c["caller_name"], c["args"]) for c in sorted(made["calls"], key=lambda c: (c["line_number"], c["full_call_name"]))]
    assert rows == [
        ("hoist", "hoist", None, "sail", ["'main'", "{ at: [2, 3] }"]), ("raise", "mast.raise", "mast", "sail", ["1"]), ("Knot", "new Knot", None, "sail", ["9"]),
        ("all", "crew.all", "crew", "sail", []), ("rest", "crew.all().rest", "crew.all()", "sail", ["8", "k"]), ("sail", "sail", None, None, []),
    ]


def test_callers_are_named_functions_not_expressions():
    made = js("function deck() { const hatch = function () { open(); }; const lid = () => shut(); }\nconst hold = function () { fill(); };")
    assert {c["name"]: c["caller_name"] for c in made["calls"]} == {"open": "deck", "shut": "lid", "fill": None}


def test_variables_of_every_kind():
    made = js("const knots = 12.5;\nlet flag = 'red', pole;\nvar nets = [1, 2];\nfor (const fish of nets) {}\n")
    assert [(v["name"], v["value"], v["type"], v["line_number"]) for v in made["variables"]] == [("knots", "12.5", "const", 1), ("flag", "'red'", "let", 2), ("pole", None, "let", 2), ("nets", "[1, 2]", "var", 3)]
    assert len(js(f"let log = '{'z' * 900}'")["variables"][0]["value"]) == 200


def test_dependencies_keep_no_source_and_no_variables():
    made = js("let oil = 1;\nfunction burn() {}\nclass Stove {}", is_dependency=True)
    assert made["variables"] == [] and [made[t][0]["source"] for t in ("functions", "classes")] == [None, None]


def test_line_ends_without_semicolons():
    made = js("const wind = 4\nconst gust = () => wind\nfunction calm() { return gust }\nlet lull = calm()\n")
    assert [v["name"] for v in made["variables"]] == ["wind", "lull"] and [f["name"] for f in made["functions"]] == ["calm", "gust"]


def test_typescript():
    made = parse(
        "/port.ts",
        "interface Floats { draught(): number; }\ninterface Sails extends Floats, Steers { heel: number; }\nexport abstract class Hull<T> extends Form<T> implements Floats, Named<T> {\n"
        "  abstract keel(): T;\n  ribs(): number { return 40; }\n}\ntype Cargo = 'coal' | 'grain';\nfunction weigh(crate: Crate, tare?: number, unit: string = 'kg'): { net: number } { return scale<Crate>(crate); }",
    )
    assert made["lang"] == "typescript"
    assert [(c["name"], c["bases"], c["implements"], c["is_abstract"], c["is_interface"]) for c in made["classes"]] == [
        ("Floats", [], [], False, True), ("Sails", ["Floats", "Steers"], [], False, True), ("Hull", ["Form"], ["Floats", "Named"], True, False),
    ]
    assert [(f["name"], f["args"], f["class_context"]) for f in made["functions"]] == [("weigh", ["crate", "tare", "unit"], None), ("ribs", [], "Hull")]
    assert [(v["name"], v["type"]) for v in made["variables"]] == [("Cargo", "type")] and [c["name"] for c in made["calls"]] == ["scale"]


def test_php():
    made = parse(
        "/port.php",
        "<?php\nuse Sea\\Charts\\Depth;\nuse Sea\\Crew\\Mate as FirstMate;\nclass Barge extends Vessel implements Floats { protected $beam = 6; const BERTHS = [1, 2];\n"
        "function __construct(private $owner, ...$crew) {} static function launch() { return new Barge(7); } }\ninterface Floats { public function draught($load); }\ntrait Paint { function coat() {} }\n"
        "enum Tide { case Ebb; public function turn() {} }\nfunction depart($when) { ring('bell'); $barge->cast(); Depth::sound(3); }",
    )
    assert [(i["name"], i["source"], i["alias"]) for i in made["imports"]] == [("Depth", "Sea\\Charts\\Depth", None), ("FirstMate", "Sea\\Crew\\Mate", "Mate")]
    assert {f["name"]: (f["kind"], f["class_context"]) for f in made["functions"]} == {
        "depart": (None, None), "__construct": ("constructor", "Barge"), "launch": ("static", "Barge"), "draught": (None, None), "coat": (None, None), "turn": (None, None),
    }
    assert one(made["functions"], name="__construct")["args"] == ["$owner", "...$crew"]
    assert [(c["name"], c["bases"], c["implements"], c["is_interface"]) for c in made["classes"]] == [("Barge", ["Vessel"], ["Floats"], False), ("Floats", [], [], True), ("Paint", [], [], False)]
    assert {c["full_call_name"] for c in made["calls"]} == {"ring", "$barge->cast", "Depth::sound", "new Barge"}
    assert [(v["name"], v["value"], v["type"], v["class_context"]) for v in made["variables"]] == [("$beam", "6", None, "Barge"), ("BERTHS", "[1, 2]", "const", "Barge")]


@pytest.mark.parametrize("source", ["", "{", "}}}", "function", "class {", "const x = `${", "import {", "/* open", "<?php class", "<?php use ;", "a ? b", "(" * 50, "new", "function f(", "x = /a", "@", "class A { get"])
def test_broken_sources_do_not_fail(source: str):
    for path in ("/a.js", "/a.ts", "/a.php"):
        assert parse(path, source)["path"] == path


def test_dispatch_by_extension():
    assert parse("/port.rb", "puts 1") is None
    names = {"/a.js": "javascript", "/a.JSX": "javascript", "/b/c.cjs": "javascript", "/b/c.mjs": "javascript", "/a.ts": "typescript", "/a.Tsx": "typescript", "/x.php": "php", "/x": None, "/x.js/y": None}
    assert {p: language_of(p) for p in names} == names


def test_prescan_parses_once(spark):
    from repolens.plans.index import parse_files, prescan

    sources = spark.createDataFrame([("/a.js", "function f() {}\nclass C { m() {} }\n"), ("/b.js", None), ("/c.py", "x")], "path string, source string")
    df = prescan(parse_files(sources))
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(tuple(r) for r in df.collect()) == [("C", "/a.js", 2), ("f", "/a.js", 1)]
    some = parse_files(sources, only=("calls",))
    assert some.columns == ["path", "lang", "calls", "error"] and some.count() == 2


def test_templates_and_regular_expressions_among_tokens():
    from repolens.functions.parsers.ecma import tokenize

    kinds = lambda text: [(t.kind, t.text) for t in tokenize(text).tokens]
    assert kinds("  a /b/ c") == [("name", "a"), ("punct", "/"), ("name", "b"), ("punct", "/"), ("name", "c")]
    assert kinds("x = /b\\/`/g ; y") == [("name", "x"), ("punct", "="), ("regex", "/b\\/`/g"), ("punct", ";"), ("name", "y")]
    assert kinds("`a ${f(1)}` + b") == [("template", "`a ${f(1)}`"), ("punct", "{"), ("name", "f"), ("punct", "("), ("number", "1"), ("punct", ")"), ("punct", "}"), ("template", ""), ("punct", "+"), ("name", "b")]
    s = tokenize("a // c  \n /** d */\n b")
    assert [(t.start, t.end) for t in s.tokens] == [(0, 1), (20, 21)] and [s.source[a:b] for a, b in s.comments] == ["// c  ", "/** d */"]

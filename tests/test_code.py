from loomtrail.operators import code

BEFORE = "import os\n\ndef f(x):\n    return x\n"
AFTER = "import os\nimport re\n\ndef f(x):\n    if x is None:\n        return 0\n    return x + 1\n"
PATCH = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -3,2 +4,4 @@ def f(x):\n-    return x\n+    if x is None:\n+        return 0\n+    return x + 1\ndiff --git a/n.txt b/n.txt\n@@ -1 +1 @@\n-a\n+b\n"


def test_certificate():
    ops, delta = code.edit_operations("x = 1\n", "x = 1\nif x:\n    return_ = f(x)\n")
    assert [o for o in ops if o[2] in ("If", "Call", "Assign")] == [("assign_added", "line 3", "Assign"), ("call_added", "line 3", "Call"), ("guard_clause_added", "line 2", "If")]
    assert delta == 8  # If, its test, Assign, target, Call, function, argument, and Load
    assert code.edit_operations("a = 1", "\na = 1")[0][-1] == ("name_modified", "multiple", "Name")  # moved by a line
    assert code.edit_operations(AFTER, AFTER) == ([], 0) and code.edit_operations("x = (", None) == ([], 0) and code.edit_operations(None, "") == ([], 0)
    assert "function_added" in code.certificate("x = (", AFTER)
    long = "é" * 100
    assert code.edit_operations(f"s = '{long}a'", f"s = '{long}b'")[1] == 0  # nodes are told apart by 80 characters of their text


def test_segments_equal_the_parsers():
    import ast

    source = "class A:\n    x = 'é' + f('ü',\n        1)\n    def m(self): return 'é', self.x\n"
    want = {(type(n).__name__, getattr(n, "lineno", 0), (ast.get_source_segment(source, n) or "" if hasattr(n, "lineno") else "")[:80].replace("\n", " ")) for n in ast.walk(ast.parse(source))}
    assert code.nodes_of(source) == want


def test_hunks_and_sequence():
    assert [(h[0], h[1], h[2], len(h[3]), len(h[4])) for h in code.hunks(PATCH)] == [("m.py", 3, 4, 1, 3), ("n.txt", 1, 1, 1, 1)]
    added = "If Return Compare Return BinOp Name Constant Constant Name Constant".split()
    assert code.patch_sequence(PATCH) == ["DEL_Return", "DEL_Name", *("ADD_" + n for n in added)]
    assert code.patch_sequence("") == []
    odd = "diff --git a/m.py b/m.py\n@@ -1 +1 @@\n+  def f(:\n"
    assert code.patch_sequence(odd) == ["ADD_def"] and code.normal_operations(odd) == ["ADD_FunctionDef"]
    assert code.patch_sequence(odd, "x", "x = 1") == ["ADD_Assign", "ADD_Constant", "DEL_Expr"]
    assert code.patch_sequence(odd, "x", "x") == ["ADD_def"]


def test_fragments_and_imports():
    assert code.lines_to_nodes(["    if a:"]) == ["If", "Name", "Pass"] and code.lines_to_nodes([]) == []
    assert code.lines_to_nodes(["else:"]) == ["If", "Constant", "Pass", "Pass"]
    assert code.lines_to_nodes(["except E:", "    pass"]) == ["Try", "Pass", "ExceptHandler", "Name", "Pass"]
    assert code.lines_to_nodes(["return", "x)"]) == ["return"] and code.lines_to_nodes(["  return x"]) == ["Return", "Name"]
    assert code.lines_to_nodes(["try:", "elif x", "excepts", "for", "a b"]) == ["try", "elif", "for"]
    assert code.imports_of("import a.b\nfrom ..c import d\n") == ["..c", "a.b"]
    assert code.code_tokens("x = 1")[:2] == ["Module", "Assign"] and code.code_tokens("x = (") == ["x", "=", "("]
    assert code.scopes("class A:\n  def m(self):\n    pass\n") == [("FunctionDef", "m", 2, 3), ("ClassDef", "A", 1, 3)]
    assert code.scopes_at("class A:\n  def m(self):\n    pass\n  x = 1\ny = 2\n", {3, 5}) == {"FunctionDef:m"}


def test_line_ranges():
    patch = "diff --git a/lib/x.py b/lib/x.py\n--- a\n+++ b\n@@ -3,3 +3,3 @@ f\n a\n-b\n+c\n+d\n e\n-g\ndiff --git a/n.txt b/n.txt\n@@ -1 +1 @@\n-a\n"
    assert code.line_ranges(patch) == {"lib/x.py": ({4, 6}, {4, 5})} and code.line_ranges(None) == {}


def test_contextual_operations():
    before, after = "def f(x):\n    return x\n", "def f(x):\n    if x:\n        y = g(x)\n    return x + 1\n"
    assert code.contextual_operations(before, after, {2}, {2, 3, 4}) == {"DEL_Return@FunctionDef", "ADD_If@FunctionDef", "ADD_Return@FunctionDef"}
    assert code.changed_nodes(after, {2, 3}) == {("If", "FunctionDef")}  # the statement as a whole, not its parts
    assert code.changed_nodes("x = [\n    f(a),\n    b,\n    c,\n]\n", {2}) == {("Name", "Call")}  # deepest where no statement changed as a whole
    assert code.changed_nodes("x = (\n    a +\n    b\n)\n", {2, 3, 4}) == {("Name", "BinOp")}
    assert code.changed_nodes("x = (", {1}) == set() and code.changed_nodes("", {1}) == set() and code.changed_nodes("x", set()) == set()


def test_frames(spark):
    df = spark.createDataFrame([("1", BEFORE, AFTER), ("2", None, None)], "id string, before string, after string")
    rows = {r.id: r for r in df.mapInPandas(code.certificates, code.CERTIFICATE_DDL).collect()}
    assert rows["1"].scopes == ["FunctionDef:f"] and rows["1"].ops == code.certificate(BEFORE, AFTER) and rows["1"].error is None
    assert rows["2"].ops == [] and rows["2"].delta == 0
    seq = spark.createDataFrame([("1", PATCH), ("2", None)], "id string, patch string").mapInPandas(code.patch_sequences, code.SEQUENCE_DDL)
    assert {r.id: list(r.tokens) for r in seq.collect()} == {"1": code.patch_sequence(PATCH), "2": []}
    changes = "id string, changes array<struct<file_path:string,before:string,after:string>>"
    given = [("1", [("a/b/m.py", BEFORE, BEFORE + "\n"), ("a/b/m.py", BEFORE + "\n", AFTER)]), ("2", None), ("3", [("n.txt", "a", "b"), (None, None, None)]), ("4", [("m.py", None, "x = (")])]
    got = {r.id: r for r in spark.createDataFrame(given, changes).mapInPandas(code.scoped_certificates, code.SCOPED_DDL).collect()}
    assert set(got) == {"1", "4"} and got["1"].file_module == "a/b" and got["1"].scopes_touched == ["FunctionDef:f"] and got["1"].scope_types == ["FunctionDef"]
    assert got["1"].hunk_count == 2 and got["4"].scopes_touched == [] and got["4"].lines_added == 1 and got["4"].file_module == "m.py" and got["4"].error is None


def test_function_names(spark):
    assert code.function_names("class A:\n  def m(self): pass\ndef f(): pass\n", "x.py") == ["A", "f", "m"]
    js = "class K {}\nconst g = async (a) => 1; function f(x) {}\nmodule.exports.h = 2; function f (y) {}"
    assert code.function_names(js, "x.js") == ["f", "g", "h", "K"] == code.function_names(js, "x.py") and code.function_names(None) == []
    ddl = "id string, events array<struct<type:string,file_path:string,before:string,after:string>>"
    rows = [("1", [("edit", "a.py", "def old(): 1", "def new(): 1"), ("function_call", None, None, None), (None, "a.py", "def old(): 1", "")]), ("2", None)]
    got = spark.createDataFrame(rows, ddl).mapInPandas(code.functions_of_events, code.FUNCTIONS_DDL).collect()
    assert {r.id: list(r.functions) for r in got} == {"1": ["new", "function_call", "old"], "2": []}

"""Edits of Python code as sets of typed operations, from sources or diffs. Parsing needs Python, so these run in Arrow batches."""

from __future__ import annotations

import ast
import re
import textwrap
from collections import Counter
from collections.abc import Iterator

import pandas as pd


def parsed(source: str | None) -> ast.Module | None:
    """The tree of a source; None where it is empty or does not parse."""
    try:
        return ast.parse(source) if source else None
    except (SyntaxError, ValueError, RecursionError):
        return None


def segment(lines: list[bytes], node: ast.AST) -> str:
    """The source of a node, its first 80 characters, line breaks as spaces; columns of the parser count bytes."""
    first, last = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
    if not first or not last:
        return ""
    start, end, out, size = node.col_offset, node.end_col_offset, [], 0
    for k in range(first, last + 1):
        line = lines[k - 1][: end if k == last else None][start if k == first else 0 :]
        out.append(line)
        size += len(line) + 1
        if size > 400:  # 80 characters take at most 320 bytes
            break
    return b" ".join(out).decode("utf-8", "ignore")[:80]


def nodes_of(source: str | None) -> set[tuple[str, int, str]]:
    """(type, line or 0, start of its text) of every node; empty where the source does not parse."""
    tree = parsed(source)
    lines = re.split(rb"\r\n|\r|\n", (source or "").encode("utf-8", "replace")) if tree else []
    return {(type(n).__name__, getattr(n, "lineno", 0), segment(lines, n)) for n in ast.walk(tree)} if tree else set()


# Operations with names of their own; others are the type in lower case and `_added`.
ADDED = {"If": "guard_clause_added", "Call": "call_added", "FunctionDef": "function_added", "AsyncFunctionDef": "function_added", "Return": "return_added"}


def edit_operations(before: str | None, after: str | None) -> tuple[list[tuple[str, str, str]], int]:
    """((operation, place, node type) sorted by side, type and line, and the number of nodes that differ) between two versions of a source.

    A node that moved to another line differs. A type on both sides is one more operation, `_modified`. Where neither side parses there are none."""
    a, b = nodes_of(before), nodes_of(after)
    new, gone = sorted(b - a), sorted(a - b)
    out = [(ADDED.get(kind, kind.lower() + "_added"), f"line {line}", kind) for kind, line, _ in new]
    out += [(kind.lower() + "_removed", f"line {line}", kind) for kind, line, _ in gone]
    out += [(kind.lower() + "_modified", "multiple", kind) for kind in sorted({n[0] for n in new} & {n[0] for n in gone})]
    return out, len(new) + len(gone)


def certificate(before: str | None, after: str | None) -> list[str]:
    """The kinds of operations between two versions, sorted, each as often as it occurs."""
    return sorted(op for op, _, _ in edit_operations(before, after)[0])


def scopes(source: str | None) -> list[tuple[str, str, int, int]]:
    """(FunctionDef or ClassDef, name, first line, last line) of functions and classes, the shortest first."""
    tree = parsed(source)
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))] if tree else []
    return sorted((("ClassDef" if isinstance(n, ast.ClassDef) else "FunctionDef", n.name, n.lineno, n.end_lineno or n.lineno) for n in found), key=lambda s: s[3] - s[2])


def scopes_at(source: str | None, lines: set[int]) -> set[str]:
    """`kind:name` of the innermost function or class around each of the lines that is in one."""
    around, left = set(), set(lines)
    for kind, name, first, last in scopes(source):
        inside = {x for x in left if first <= x <= last}
        if inside:
            around.add(f"{kind}:{name}")
            left -= inside
    return around


# Nodes of pure syntax: operators, contexts and the module.
SYNTAX = (ast.mod, ast.expr_context, ast.boolop, ast.operator, ast.unaryop, ast.cmpop)

# Words at the start of a line that tell of its kind where it can't be parsed.
LINE_WORDS = re.compile(r"(elif|except|assert|lambda|yield|return|raise|import|while|class|with|async|for|def|if)(?= |$)|(else|try)(?=:)")


def lines_to_nodes(lines: list[str]) -> list[str]:
    """Node types of a fragment, level by level: of its text as it is, or with the block, condition or function around it that makes it whole.

    Added blocks count, an added function doesn't. If nothing makes it whole, the first words of its lines that are keywords."""
    text = textwrap.dedent("\n".join(lines))
    bare = text.strip()
    block = "\n    pass" if bare.endswith(":") else ""
    wholes = [(text, True)]
    wholes += [(bare + block, True)] if block else []
    wholes += [("if True:\n    pass\n" + bare + block, True)] if bare.startswith(("elif ", "else:")) else []
    wholes += [("try:\n    pass\n" + bare + block, True)] if bare.startswith(("except", "finally")) else []
    wholes += [("def _f():\n" + textwrap.indent(text, "    "), False)] if bare.startswith(("return", "yield", "raise", "del ")) else []
    for whole, all_ in wholes if lines else []:
        tree = parsed(whole or "\n")
        if tree is not None:
            kinds = [type(n).__name__ for n in ast.walk(tree) if not isinstance(n, SYNTAX)]
            return kinds if all_ else [k for k in kinds if k not in ("FunctionDef", "arguments", "arg")]
    words = (LINE_WORDS.match(line.strip()) for line in lines)
    return [m[1] or m[2] for m in words if m]


HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def hunks(patch: str) -> Iterator[tuple[str, int, int, list[str], list[str]]]:
    """(file, first old line, first new line, removed lines, added lines) of each hunk of a unified diff."""
    path, old, new, minus, plus = None, 0, 0, [], []
    for line in [*(patch or "").split("\n"), "diff --git "]:
        head = HUNK.match(line)
        if head or line.startswith("diff --git "):
            if path and (minus or plus):
                yield path, old, new, minus, plus
            minus, plus = [], []
            if head:
                old, new = int(head[1]), int(head[3])
            else:
                m = re.match(r"diff --git a/(.+?) b/.+", line)
                path = m[1] if m else None
        elif line.startswith("-") and not line.startswith("---"):
            minus.append(line[1:])
        elif line.startswith("+") and not line.startswith("+++"):
            plus.append(line[1:])


def node_counts(source: str | None) -> Counter:
    tree = parsed(source)
    return Counter(type(n).__name__ for n in ast.walk(tree) if not isinstance(n, SYNTAX)) if tree else Counter()


def patch_sequence(patch: str, before: str = "", after: str = "") -> list[str]:
    """Operations of the Python hunks in order: DEL_ and the node types removed, then ADD_ and those added.

    Where no hunk can be parsed and versions of the file are given: the node types that are more, then fewer, in the new one."""
    out = []
    for path, _, _, minus, plus in hunks(patch):
        if path.endswith(".py"):
            out += ["DEL_" + n for n in lines_to_nodes(minus)] + ["ADD_" + n for n in lines_to_nodes(plus)]
    if not any(op[4:5].isupper() or op.endswith("comprehension") or op[4:] in SILENT | {"arguments"} for op in out) and (before or after):
        old, new = node_counts(before), node_counts(after)
        return ["ADD_" + n for n in sorted(new - old)] + ["DEL_" + n for n in sorted(old - new)] or out
    return out


def imports_of(source: str) -> list[str]:
    """Modules that a source imports, sorted."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            found.update(a.name for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            found.add("." * n.level + (n.module or ""))
    return sorted(found)


# How functions and classes are named in sources that are not Python, tried in this order.
NAMES = [
    re.compile(r"\bfunction\s+([A-Za-z_][\w]*)\s*\("),
    re.compile(r"\b([A-Za-z_][\w]*)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"),
    re.compile(r"\b(?:exports|module\.exports)\.([A-Za-z_][\w]*)\s*="),
    re.compile(r"\bclass\s+([A-Za-z_][\w]*)\b"),
]


def function_names(source: str | None, path: str | None = None) -> list[str]:
    """Names of functions and classes, each once: of a Python file level by level, else, or where it has none, by patterns, one after the other."""
    tree = parsed(source) if (path or "").endswith(".py") else None
    found = [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))] if tree else []
    return list(dict.fromkeys(found or [x for p in NAMES for x in p.findall(source or "")]))


FUNCTIONS_DDL = "id string, functions array<string>"


def functions_of_events(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (id, events array<struct<type, file_path, before, after>>): names in the new, else the old source of each event, then its type if that tells of a function."""
    for frame in frames:
        out = []
        for events in frame["events"]:
            names: list[str] = []
            for e in events if events is not None else []:
                names += function_names(e["after"] or e["before"], e["file_path"])
                names += [e["type"]] if "function" in (e["type"] or "").lower() else []
            out.append(names)
        yield pd.DataFrame({"id": frame["id"], "functions": out})


def code_tokens(source: str, most: int | None = None) -> list[str]:
    """Node types in reading order where the source parses, else words and signs."""
    try:
        return [type(n).__name__ for n in ast.walk(ast.parse(source or ""))][:most]
    except (SyntaxError, ValueError, RecursionError):
        return re.findall(r"[A-Za-z_]\w*|[^\s\w]", source or "")[:most]


def line_ranges(patch: str | None) -> dict[str, tuple[set[int], set[int]]]:
    """For each Python file of a unified diff: the numbers of the lines that it loses, in the old file, and gains, in the new one."""
    out: dict[str, tuple[set[int], set[int]]] = {}
    sides, old, new = None, 0, 0
    for line in (patch or "").splitlines():
        head = HUNK.match(line)
        if line.startswith("diff --git"):
            m = re.search(r" b/(.+\.py)$", line)
            sides = (m[1], set(), set()) if m else None
        elif sides and head:
            old, new = int(head[1]), int(head[3])
        elif sides and not line.startswith(("---", "+++", "@@")):
            gone, added = line.startswith("-"), line.startswith("+")
            if gone or added:
                found = out.setdefault(sides[0], (set(), set()))
                found[added].add(new if added else old)
            old, new = old + (not added), new + (not gone)
    return out


# Words of a line that stand for a node type.
KEYWORD_NODES = {
    "if": "If", "elif": "If", "else": "If", "for": "For", "while": "While", "with": "With", "try": "Try", "except": "ExceptHandler", "return": "Return", "raise": "Raise",
    "yield": "Yield", "assert": "Assert", "import": "Import", "lambda": "Lambda", "def": "FunctionDef", "class": "ClassDef",
}


def normal_operation(op: str) -> str:
    """ADD_ or DEL_ with a word, as the operation on its node type; others as they are."""
    side, sep, name = op.partition("_")
    return f"{side}_{KEYWORD_NODES[name]}" if sep and side in ("ADD", "DEL") and name in KEYWORD_NODES else op


def normal_operations(patch: str) -> list[str]:
    """The set of operations of a patch, sorted."""
    return sorted(set(map(normal_operation, patch_sequence(patch))))


# Nodes that say nothing by themselves, statements, and node types whose children name another parent.
SILENT = {"alias", "arg", "keyword"}
BLOCKS = (ast.stmt, ast.excepthandler)
PARENTS = {"AsyncFunctionDef": "FunctionDef", "ListComp": "comprehension", "SetComp": "comprehension", "DictComp": "comprehension", "GeneratorExp": "comprehension", "AnnAssign": "Assign", "AugAssign": "Assign"}


def changed_nodes(source: str | None, lines: set[int]) -> set[tuple[str, str]]:
    """(node type, type of its parent) of the nodes that a change of these lines is about.

    A node whose lines all changed counts if it is a statement within no such statement, or else lies in no counted statement and
    holds no other node like it. One of whose lines at least half changed counts if it holds no such node."""
    tree = parsed(source)
    if tree is None or not lines:
        return set()
    nodes, above = [tree], [-1]
    for k, n in enumerate(nodes):  # grows as it is read
        children = list(ast.iter_child_nodes(n))
        nodes += children
        above += [k] * len(children)
    last = max((getattr(n, "end_lineno", 0) or 0 for n in nodes), default=0)
    upto = [0] * (last + 1)
    for k in range(1, last + 1):
        upto[k] = upto[k - 1] + (k in lines)
    share = [0.0] * len(nodes)
    for k, n in enumerate(nodes):
        if getattr(n, "lineno", None) and n.end_lineno and type(n).__name__ not in SILENT:
            share[k] = (upto[n.end_lineno] - upto[n.lineno - 1]) / (n.end_lineno - n.lineno + 1)
    whole, half = [s >= 0.99 for s in share], [s >= 0.5 for s in share]
    whole_below, half_below, within = [False] * len(nodes), [False] * len(nodes), [False] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        whole_below[above[k]] |= whole[k] or whole_below[k]
        half_below[above[k]] |= half[k] or half_below[k]
    out = set()
    for k in range(1, len(nodes)):
        up = above[k]
        block = isinstance(nodes[k], BLOCKS)
        top = whole[k] and block and not (whole[up] and isinstance(nodes[up], BLOCKS))
        leaf = whole[k] and not block and not within[up] and not whole_below[k]
        part = half[k] and not whole[k] and not half_below[k]
        within[k] = within[up] or top
        if top or leaf or part:
            parent = type(nodes[up]).__name__
            out.add((type(nodes[k]).__name__, PARENTS.get(parent, parent)))
    return out


def contextual_operations(before: str | None, after: str | None, gone: set[int], added: set[int]) -> set[str]:
    """`DEL_node@parent` and `ADD_node@parent` of a change of one file."""
    return {f"DEL_{n}@{p}" for n, p in changed_nodes(before, gone)} | {f"ADD_{n}@{p}" for n, p in changed_nodes(after, added)}


def file_changes(changes) -> tuple[dict[str, tuple[str, str]], str]:
    """First and last version of each Python file, and the diffs of all changes as one patch, from (file, before, after) in order."""
    import difflib

    versions: dict[str, tuple[str, str]] = {}
    diffs = []
    for path, before, after in changes:
        before, after = before or "", after or ""
        if not (path or "").endswith(".py") or before == after:
            continue
        versions[path] = (versions[path][0] if path in versions else before, after)
        diffs.append(f"diff --git a/{path} b/{path}\n" + "".join(difflib.unified_diff(before.splitlines(True), after.splitlines(True), path, path)))
    return versions, "\n".join(diffs)


def scoped_certificate(patch: str, versions: dict[str, tuple[str, str]]) -> dict | None:
    """Operations, files, the scopes that lines of a patch are in, and its size. Files without a version have no scopes; None for a patch of no Python file."""
    ranges = line_ranges(patch)
    files = list(dict.fromkeys([*versions, *ranges]))
    if not files:
        return None
    touched: set[str] = set()
    contexts: set[str] = set()
    for path, (gone, added) in ranges.items():
        before, after = versions.get(path, ("", ""))
        touched |= scopes_at(before, gone) | scopes_at(after, added)
        contexts |= contextual_operations(before, after, gone, added)
    lines = patch.splitlines()
    plus, minus = (sum(x.startswith(s) and not x.startswith(s * 3) for x in lines) for s in "+-")
    return {
        "edit_cert": normal_operations(patch), "contextual_ops": sorted(contexts), "file_paths": files, "file_module": "/".join(files[0].split("/")[:2]), "scopes_touched": sorted(touched), "scope_types": sorted({s.split(":")[0] for s in touched}),
        "lines_added": plus, "lines_removed": minus, "patch_size": plus + minus, "hunk_count": sum(bool(HUNK.match(x)) for x in lines),
    }


SCOPED_DDL = "id string, edit_cert array<string>, contextual_ops array<string>, file_paths array<string>, file_module string, scopes_touched array<string>, scope_types array<string>, lines_added int, lines_removed int, patch_size int, hunk_count int, error string"
_SCOPED = [x.split()[0] for x in SCOPED_DDL.split(", ")]


def scoped_certificates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (id, changes array<struct<file_path, before, after>>): a row for each record that changes Python files, with the error of one that fails."""
    for frame in frames:
        out = []
        for key, changes in zip(frame["id"], frame["changes"], strict=True):
            try:
                versions, patch = file_changes((c["file_path"], c["before"], c["after"]) for c in (changes if changes is not None else []))
                found = scoped_certificate(patch, versions)
            except Exception as e:  # noqa: BLE001  one bad record must not end the job
                found = {"error": repr(e)}
            if found:
                out.append([key, *(found.get(n) for n in _SCOPED[1:])])
        yield pd.DataFrame(out, columns=_SCOPED).astype({n: "Int32" for n in ("lines_added", "lines_removed", "patch_size", "hunk_count")})


CERTIFICATE_DDL = "id string, ops array<string>, delta int, scopes array<string>, error string"


def certificates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (id, before, after): operations, differing nodes, touched scopes of the new version, and the error of a record that fails."""
    for frame in frames:
        out = []
        for key, before, after in zip(*(frame[c] for c in ("id", "before", "after")), strict=True):
            try:
                ops, delta = edit_operations(before, after)
                old = set((before or "").split("\n"))
                touched = {k for k, line in enumerate((after or "").split("\n"), 1) if line not in old}
                out.append((key, sorted(o[0] for o in ops), delta, sorted(scopes_at(after, touched)), None))
            except Exception as e:  # noqa: BLE001  one bad record must not end the job
                out.append((key, [], 0, [], repr(e)))
        yield pd.DataFrame(out, columns=["id", "ops", "delta", "scopes", "error"])


SEQUENCE_DDL = "id string, tokens array<string>"


def patch_sequences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (id, patch)."""
    for frame in frames:
        yield pd.DataFrame({"id": frame["id"], "tokens": [patch_sequence(p) for p in frame["patch"]]})

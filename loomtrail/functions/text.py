"""Rewriting and classifying text with column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ordered rewrite rules (Java regular expressions) and their replacements.
ANONYMISE_RULES: list[tuple[str, str]] = [
    (r"\b(?:sk-ant-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,}|hf_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{20,}|ya29\.[A-Za-z0-9_-]{20,})", "<token>"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "<token>"),
    (r"(?i)\b(Bearer|Basic)\s+[A-Za-z0-9_\-.=+/]{12,}", "$1 <token>"),
    (r"(?i)\b([A-Za-z0-9_-]*(?:api[_-]?key|token|secret|password|passwd|access[_-]?key)[\"']?\s*[=:]\s*[\"']?)[A-Za-z0-9_\-./+]{8,}", "$1<redacted>"),
    (r"\bgit@[\w.-]+:[A-Za-z0-9._-]+/", "git@<host>:<user>/"),
    (r"\b([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1"),
    (r"\b((?:https?|ssh|git)://(?:github\.com|gitlab\.com|bitbucket\.org)/)[A-Za-z0-9._-]+", "$1<user>"),
    (r"\b(https?://huggingface\.co/(?:datasets|spaces)/)[A-Za-z0-9._-]+", "$1<user>"),
    (r"\b(https?://huggingface\.co/)(?!datasets/|spaces/)[A-Za-z0-9._-]+", "$1<user>"),
    (r"\b(repos/)(?!<)[A-Za-z0-9._-]+", "$1<user>"),
    (r"\b((?:github|gitlab)\.com/)(?!<)[A-Za-z0-9._-]+", "$1<user>"),
    (r"\b(gh (?:repo|pr|issue|release|run|workflow|api)\s+(?:\w+\s+)*?(?:--repo[= ])?)[A-Za-z0-9._-]+/(?=[A-Za-z0-9._-]+)", "$1<user>/"),
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){3,}[0-9a-fA-F]{1,4}\b", "<ip>"),
    (r"/Users/[A-Za-z0-9._-]+", "~"),
    (r"/home/[A-Za-z0-9._-]+", "~"),
    (r"(?<![\w/])/root\b", "~"),
    (r"[A-Za-z]:\\Users\\[A-Za-z0-9._-]+", "~"),
    (r"(?i)%2fusers%2f[A-Za-z0-9._-]+", "~"),
    (r"-Users-[A-Za-z0-9_.]+", "-Users-anon"),
    (r"-home-[A-Za-z0-9_.]+", "-home-anon"),
    (r"/var/folders/[A-Za-z0-9_+-]{2}/[A-Za-z0-9_+-]+", "/var/folders/<tmp>"),
    (r"/claude-\d+/", "/claude-<uid>/"),
    (r"/Volumes/[^/\s'\"]+", "/Volumes/<volume>"),
    (r"\b[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\.local\b(?![\w.])", "<host>"),
]

# What must not be left after rewriting.
RESIDUALS: dict[str, str] = {
    "home path": r"/(?:Users|home)/(?!<)[A-Za-z0-9_.-]+",
    "windows home": r"[A-Za-z]:\\\\?Users\\\\?(?!<)[A-Za-z0-9_.-]+",
    "workspace slug": r"-Users-(?!anon\b)[A-Za-z0-9_.]+",
    "url-encoded home": r"(?i)%2FUsers%2F(?!%3C)[A-Za-z0-9_.-]+",
    "email": r"\b[A-Za-z][\w.+-]*@[A-Za-z][\w-]*\.[A-Za-z]{2,24}\b",
    "credential": r"\b(?:sk-[A-Za-z0-9-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})",
    "forge owner": r"(?:github\.com|gitlab\.com)/(?!<)[A-Za-z0-9._-]+",
    "repos owner": r"\brepos/(?!<)[A-Za-z0-9._-]+",
}

# Places where an identity stands; the group is the candidate.
CANDIDATES: list[str] = [
    r"--author[= ]+([A-Za-z0-9._-]{3,})",
    r"\b(?:user|owner|login|account|username)\s*[=:]\s*[\"']?([A-Za-z0-9._-]{3,})",
    r"/(?:Users|home)/([A-Za-z0-9_.-]{3,})",
    r"-Users-([A-Za-z0-9_.]{3,})",
    r"\b([A-Za-z0-9._-]{3,})@[A-Za-z][\w-]*\.[A-Za-z]{2,24}\b",
    r"\b(?:repos|github\.com|gitlab\.com)/([A-Za-z0-9._-]{3,})/",
]

# Words in such places that identify nobody.
NOT_IDENTITY: list[str] = """
anon user users home root admin runner none null true false local shared public main master origin redacted token
email host email> github gitlab the and for you yes not add pass with this that from into name base mon tue wed thu
fri repos repo self test data file path list all
""".split()


#: What a text must hold, in lower case, for the rule of the same place to match: any of these. None: tried always.
NEEDED: list[tuple[str, ...] | None] = [
    ("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "akia", "aiza", "hf_", "glpat-", "npm_", "ya29."),
    ("eyj",), ("bearer", "basic"), ("key", "token", "secret", "password", "passwd"), ("git@",), ("://",), ("://",), ("huggingface.co/",),
    ("huggingface.co/",), ("repos/",), ("github.com/", "gitlab.com/"), ("gh ",), ("@",), None, (":",), ("/users/",), ("/home/",), ("/root",),
    (":\\users\\",), ("%2fusers%2f",), ("-users-",), ("-home-",), ("/var/folders/",), ("/claude-",), ("/volumes/",), (".local",),
]


NEVER = r"\A(?!)"  # is tried once a text


def anonymise(text: Column, names: list[str] | None = None) -> Column:
    """The rules in order, then literal names, the longest first, as whole words.

    A rule is tried only on texts that hold what it needs: a search for a literal costs far less than the pattern. What
    rules put in place creates no such literal that wasn't there, so the text as given decides."""

    def rules(s: Column) -> Column:
        out = s["text"]
        for (pattern, replacement), needed in zip(ANONYMISE_RULES, NEEDED, strict=True):
            if needed is None:
                out = F.regexp_replace(out, pattern, replacement)
            else:
                there = reduce(lambda a, b: a | b, [s["low"].contains(n) for n in needed])
                out = F.regexp_replace(out, F.when(there, F.lit(pattern)).otherwise(F.lit(NEVER)), F.lit(replacement))
        return out

    # bound by a lambda, so that the lower-cased text is made once
    out = F.get(F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), rules), F.lit(0))
    for name in sorted(set(names or []), key=len, reverse=True):
        out = F.regexp_replace(out, r"(?<!\w)\Q" + name.replace(r"\E", "") + r"\E(?!\w)", "anon")
    return out


def over_strings(column: Column, kind: T.DataType, change) -> Column:
    """`change` at every string value of any nesting; keys stay."""
    if isinstance(kind, T.StringType):
        return change(column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: over_strings(x, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: over_strings(v, kind.valueType, change))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[over_strings(column[f.name], f.dataType, change).alias(f.name) for f in kind.fields])
        return F.when(column.isNotNull(), fields)
    return column


def strings_of(column: Column, kind: T.DataType) -> Column:
    """Every string value of any nesting, as one array."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return F.when(column.isNotNull(), F.array(column)).otherwise(none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(column, lambda x: strings_of(x, kind.elementType))), none)
    if isinstance(kind, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(column), lambda x: strings_of(x, kind.valueType))), none)
    if isinstance(kind, T.StructType):
        return F.concat(none, *[strings_of(column[f.name], f.dataType) for f in kind.fields])
    return none


def anonymise_frame(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return df.select(*[over_strings(F.col(f"`{f.name}`"), f.dataType, lambda c: anonymise(c, names)).alias(f.name) for f in df.schema.fields])


def mask(hit: Column) -> Column:
    """All but the first one or two characters of the last path part."""
    head, tail = F.regexp_extract(hit, r"^(.*/)?([^/]*)$", 1), F.regexp_extract(hit, r"^(.*/)?([^/]*)$", 2)
    keep = F.when(F.length(tail) > 3, 2).otherwise(1)
    return F.concat(head, F.left(tail, keep), F.repeat(F.lit("*"), F.greatest(F.length(tail) - keep, F.lit(0))))


def residual_counts(df: DataFrame) -> DataFrame:
    """kind, n: how many matches of each residual class all strings of df hold."""
    texts = df.select(F.explode(F.concat(F.array().cast("array<string>"), *[strings_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])).alias("s"))
    sums = texts.agg(*[F.coalesce(F.sum(F.regexp_count("s", F.lit(p))), F.lit(0)).alias(k) for k, p in RESIDUALS.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").cast("long").alias("n")) for k in RESIDUALS])).alias("r")).select("r.*")


def candidates(df: DataFrame, text: str, most: int = 12) -> DataFrame:
    """candidate, n: the most frequent words in places of identity."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in CANDIDATES]))
    rows = df.select(F.explode(found).alias("candidate")).where(~F.lower("candidate").isin(NOT_IDENTITY))
    return rows.groupBy("candidate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "candidate").limit(most)


# Names that decide the type of a file, tried in this order.
_FILE_TYPES = [
    ("CONFIG_PY", r"(?i)setup\.py|pyproject\.toml|setup\.cfg|settings\.py|conftest\.py|tox\.ini"),
    ("TEST_PY", r"(?i)(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$|tests?\.py$"),
    ("DOC", r"(?i)\.md$|\.rst$|README|CHANGELOG"),
    ("SRC_PY", r"\.py$"),
]
_REPRO = r"(?i)reproduc|repro_|repro\.py|(^|/)test_fix|(^|/)debug_"


def file_type(path: Column) -> Column:
    out = F.when(F.coalesce(path, F.lit("")) == "", "OTHER").when(path.rlike(_REPRO), "REPRO_PY")
    for name, pattern in _FILE_TYPES:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise("OTHER")


def without_env(line: Column) -> Column:
    """Leading KEY=VALUE words dropped, unless nothing remains; white space collapsed as words are joined again."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    n = F.size(words)
    plain = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(words, i).rlike(r"^[A-Z_][A-Z0-9_]*=.*"))
    first = F.get(plain, F.lit(0))
    return F.when((n == 0) | first.isNull(), line).otherwise(F.array_join(F.slice(words, first + 1, F.greatest(n, F.lit(1))), " "))


# Verbs of plain shell commands, and other verbs with their atoms.
SHELL_VERBS = "ls cd pwd mkdir rm mv cp touch cat echo grep find which head tail wc chmod export env source".split()
VERB_ATOMS = {
    "goto": "NAV", "scroll_up": "NAV", "scroll_down": "NAV", "find_file": "FIND_FILE", "find": "FIND_FILE",
    "search_file": "SEARCH", "search_dir": "SEARCH", "search": "SEARCH", "edit": "EDIT",
}
LATE_ATOMS = {
    "pip": "RUN_PIP", "pylint": "RUN_LINT", "flake8": "RUN_LINT", "mypy": "RUN_LINT", "ruff": "RUN_LINT", "black": "RUN_LINT",
    "sphinx-build": "RUN_DOCBUILD", "sphinx-apidoc": "RUN_DOCBUILD", "make": "RUN_MAKE", "sed": "SHELL_SED", "awk": "SHELL_AWK",
}
_PATH = r"([\w/._-]+\.(?:py|md|rst|cfg|toml|txt|yml|yaml))"
_TEST_SCRIPT = r"(?i)^(?:\./bin/test|\./tests/runtests\.py|\./run_multiple_times\.sh|django-admin|manage\.py|runtests\.py)"
_PY_RUN = r"^(python3?|pytest|pytest-\d|py\.test|unittest)\b"


def action_atom(action: Column) -> Column:
    """An action line as one atom of a small alphabet. The line is bound once, so that the rules don't each derive it again."""
    line = without_env(F.trim(F.split(F.trim(F.coalesce(action, F.lit(""))), "\n").getItem(0)))
    words = lambda s: F.struct(s.alias("line"), F.lower(F.regexp_extract(s, r"^(\S+)", 1)).alias("verb"), F.regexp_extract(F.regexp_replace(s, r"^\S+\s*", ""), _PATH, 1).alias("path"))
    found = F.transform(F.transform(F.array(line), words), lambda s: _line_atom(s["line"], s["verb"], s["path"]))
    return F.when(F.trim(F.coalesce(action, F.lit(""))) == "", "EMPTY").otherwise(F.get(found, F.lit(0)))


def _line_atom(line: Column, verb: Column, path: Column) -> Column:
    typed = lambda name, none: F.concat(F.lit(name), F.when(path == "", none).otherwise(file_type(path)))
    choose = lambda names: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), verb)
    runtime = F.when(line.startswith("pytest") | line.startswith("py.test"), "RUN_PYTEST_").otherwise("RUN_PYTHON_")
    return (
        F.when(line.startswith("#"), "COMMENT")
        .when(F.lower(line).contains("submit"), "SUBMIT")
        .when(line.startswith("exit_cost") | line.startswith("exit_error"), "EXIT_ERROR")
        .when(verb == "open", typed("OPEN_", "UNKNOWN"))
        .when(verb == "create", typed("CREATE_", "UNKNOWN"))
        .when(verb.isin(*VERB_ATOMS), choose(VERB_ATOMS))
        .when(line.rlike(_PY_RUN), F.concat(runtime, F.when(path == "", "ALL").otherwise(file_type(path))))
        .when(line.rlike(_TEST_SCRIPT), "RUN_TEST_SCRIPT")
        .when(verb.isin(*LATE_ATOMS), choose(LATE_ATOMS))
        .when(verb.isin(*SHELL_VERBS), F.concat(F.lit("SHELL_"), F.upper(verb)))
        .when(verb == "", "UNKNOWN_EMPTY")
        .otherwise(F.concat(F.lit("UNKNOWN_"), F.upper(verb)))
    )


def trace_atoms(steps: DataFrame, action: str = "action", state: str = "state") -> DataFrame:
    """steps and atom: bare EDIT and NAV get the type of the file that the step's state has open."""
    open_file = F.get_json_object(state, "$.open_file")
    known = F.when((open_file != "") & (open_file != "n/a"), open_file)
    bare = action_atom(F.col(action))
    return steps.withColumn("atom", F.when(bare.isin("EDIT", "NAV") & known.isNotNull(), F.concat(bare, F.lit("_"), file_type(known))).otherwise(bare))


def record_text(prompts: Column, details: Column, most_events: int = 30, most_chars: int = 2000) -> Column:
    """Prompts, then the string values of the first events' details (array<array<string>>), non-empty, joined by line feeds and cut."""
    parts = F.concat(prompts, F.flatten(F.slice(details, 1, most_events)))
    return F.left(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n"), F.lit(most_chars))

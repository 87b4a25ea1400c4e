"""Column builders: identifiers, paths, layers, scores and sizes.  No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spaced_name(name: Column) -> Column:
    """Spaces where camel and Pascal case begin a word."""
    return F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def name_tokens(name: Column) -> Column:
    """Camel, Pascal and snake case to lower-case words joined by a space."""
    return F.trim(F.lower(F.regexp_replace(spaced_name(name), "[^A-Za-z0-9]+", " ")))


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def path_prefixes(path: Column) -> Column:
    """``a/b/c.py`` gives [a/b, a, ""]: the directories from the nearest outwards."""
    parts = F.split(directory(path), "/")
    return F.when(directory(path) == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))


#: Paths of tests, whatever the case of letters.
TEST_PATHS = (
    r"(^|/)tests?/",
    r"(^|/)__tests__/",
    r"(^|/)specs?/",
    r"(^|/)testing/",
    r"(^|/)test_?helpers?/",
    r"(^|/)fixtures/",
    r"(^|/)mocks?/",
    r"(^|/)testdata/",
    r"(^|/)testutils?/",
    r"(^|/)test_[^/]+\.\w+$",
    r"(^|/)[^/]+_test\.\w+$",
    r"(^|/)[^/]+\.test\.\w+$",
    r"(^|/)[^/]+\.spec\.\w+$",
    r"(^|/)[^/]+Tests?\.\w+$",
    r"(^|/)conftest\.py$",
    r"(^|/)setup_tests?\.\w+$",
)
TEST_PATH = "(?i)" + "|".join(TEST_PATHS)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def within(path: Column, prefix: str) -> Column:
    """Directory-bounded prefix; every path is within the empty one."""
    bare = prefix.rstrip("/")
    return F.lit(True) if not bare else (path == bare) | path.startswith(f"{bare}/")


#: Names of functions that start a program, and path segments of layers.
ENTRY_NAMES = ("main", "run", "execute", "start", "cli", "app", "serve", "setup", "bootstrap", "entrypoint", "entry_point")
INFRASTRUCTURE = ("config", "configs", "configuration", "util", "utils", "utility", "utilities", "helper", "helpers", "middleware", "logging", "logger", "common", "shared", "base")
INTERNAL = ("internal", "_internal", "private", "_private", "impl", "_impl", "detail", "_detail")


def layer(name: Column, kind: Column, path: Column, parent: Column) -> Column:
    """constant, core_type, entry_point, infrastructure, internal or public_api; the first rule that holds."""
    kind, low = F.lower(kind), F.lower(name)
    entry = "|".join(ENTRY_NAMES)
    segments = F.split(F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")), "/")
    holds = lambda names: F.arrays_overlap(segments, F.array(*map(F.lit, names)))
    return (
        F.when(kind.isin("constant", "macro"), "constant")
        .when(kind.isin("struct", "enum", "type_alias"), "core_type")
        .when((kind == "function") & low.rlike(f"^({entry})(_|$)|_({entry})$"), "entry_point")
        .when(holds(INFRASTRUCTURE), "infrastructure")
        .when((F.coalesce(parent, F.lit("")) != "") | holds(INTERNAL), "internal")
        .otherwise("public_api")
    )


def score_norm(rank: Column) -> Column:
    """Logistic of minus the rank; NULL, NaN and infinities give 0."""
    bad = rank.isNull() | F.isnan(rank) | (F.abs(rank) == float("inf"))
    return F.when(bad, 0.0).otherwise(1 / (1 + F.exp(rank)))


def estimated_tokens(text: Column) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3.5))).cast("long")


def page_size_cap(n: Column) -> Column:
    return F.when(n < 100, 25).when(n < 500, 35).when(n < 2000, 45).otherwise(60)


def section_cap(n: Column) -> Column:
    """round-half-even(3 log10 n), within 3 and 15."""
    return F.greatest(F.lit(3), F.least(F.lit(15), F.bround(3 * F.log10(F.greatest(n, F.lit(1))), 0).cast("int")))


def page_count_cap(n: Column) -> Column:
    """Pages of a section: round-half-even(3 log10 n), within 2 and 8; 2 below six nodes."""
    return F.when(n < 6, 2).otherwise(F.greatest(F.lit(2), F.least(F.lit(8), F.bround(3 * F.log10(F.greatest(n, F.lit(1))), 0).cast("int"))))


def auto_resolution(n: Column) -> Column:
    return F.greatest(F.lit(0.3), 1 - 0.2 * F.log10(F.greatest(n, F.lit(1))))


def augmentation_fraction(priority: Column) -> Column:
    return F.least(F.lit(0.6), F.greatest(F.lit(0.1), 0.3 * priority))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """Leading slash, no trailing one, no query or fragment; ``/api``, ``/rest`` or ``/graphql`` with a version is stripped."""
    bare = F.regexp_replace(F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.regexp_replace(bare, "^/(api|rest|graphql)(/v[0-9]+)?", "")


def stripped_test_name(stem: Column) -> Column:
    """A file stem without the decoration of a test file, in small letters."""
    return F.regexp_replace(F.regexp_replace(F.lower(stem), "^test[_-]", ""), "[_-]test$", "")


def stripped_test_class(name: Column) -> Column:
    """A class name without Test before it, or what stands before its last Test if it ends in Test or Tests."""
    return F.when(name.startswith("Test"), F.substr(name, F.lit(5))).when(name.rlike("Tests?$"), F.regexp_replace(name, "Tests?$", "")).otherwise(name)


def is_test_node(path: Column, stem: Column) -> Column:
    """Whether a node of the test linker is a test: by directory anywhere in the path, or by its file's name."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return low.rlike("tests/|test/|__tests__/|spec/") | F.lower(F.coalesce(stem, F.lit(""))).rlike("^test[_-]|[_-]test$")


#: Types of documentation and code symbols, and their priorities.
LEGACY_DOCS = ("module_doc", "file_doc")
CODE_TYPES = ("class", "interface", "struct", "enum", "trait", "function", "constant", "type_alias", "macro")
EXPANSION_TYPES = (*CODE_TYPES, *LEGACY_DOCS)
IDENTITY_TYPES = ("class", "interface", "trait", "protocol", "enum", "struct", "record", "module", "namespace", "function")
SUPPORTING_TYPES = ("constant", "type_alias", "macro", "method", "property")
PRIORITY = {
    "class": 10, "interface": 10, "trait": 10, "protocol": 10,
    "enum": 9, "struct": 9, "record": 9,
    "module": 8, "namespace": 8,
    "function": 7,
    "constant": 6, "type_alias": 6, "macro": 6,
    "method": 3, "property": 2,
    "module_doc": 1, "file_doc": 1,
}


def is_doc_type(kind: Column) -> Column:
    return kind.isin(*LEGACY_DOCS) | kind.rlike("_(document|section|chunk)$")


def is_architectural_type(kind: Column) -> Column:
    return kind.isin(*CODE_TYPES) | is_doc_type(kind)


def looked_up(key: Column, table: dict[str, float], other: float | None = None) -> Column:
    """A value by key from a small fixed table."""
    if not table:
        return F.lit(other)
    out = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))[key]
    return out if other is None else F.coalesce(out, F.lit(other))


def type_priority(kind: Column) -> Column:
    return looked_up(F.lower(kind), PRIORITY, 0)


def locality(a: Column, b: Column) -> Column:
    """1 for paths of one top directory, 0.7 for others, 0.5 if one is missing."""
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(blank, 0.5).when(F.split(a, "/")[0] == F.split(b, "/")[0], 1.0).otherwise(0.7)


#: Words that say too little to look for alone.
LOW_VALUE = ("init", "main", "test", "tests", "setup", "config", "utils", "helper", "helpers", "common", "base", "abstract", "interface", "impl", "data", "model", "service", "factory", "manager", "handler", "controller", "view", "router", "routes", "api", "lib", "src", "app", "core")


def is_low_value(query: Column) -> Column:
    bare = F.trim(F.coalesce(query, F.lit("")))
    return (F.length(bare) < 4) | F.lower(bare).isin(*LOW_VALUE)


def type_args(args: Column) -> Column:
    """``<a, b>``; nothing for no arguments."""
    return F.when(F.coalesce(F.size(args), F.lit(0)) <= 0, "").otherwise(F.concat(F.lit("<"), F.array_join(args, ", "), F.lit(">")))


def target_sections(files: Column) -> Column:
    """ceil(1.2 log2 files), within 5 and 20; 5 below ten files."""
    return F.when(files < 10, 5).otherwise(F.greatest(F.lit(5), F.least(F.lit(20), F.ceil(1.2 * F.log2(F.greatest(files, F.lit(10))))))).cast("int")


def target_pages(n: Column) -> Column:
    """ceil(sqrt(n / 7)), within 8 and 200."""
    return F.greatest(F.lit(8), F.least(F.lit(200), F.ceil(F.sqrt(n / 7)))).cast("int")


def central_count(n: Column) -> Column:
    """How many central symbols a repository of n nodes is planned with."""
    return F.when(n >= 5000, 15).when(n >= 1000, 12).when(n >= 200, 8).otherwise(5)


def symbols_per_page(n: Column) -> Column:
    """By the larger of the numbers of nodes and files."""
    return F.when(n >= 5000, 50).when(n >= 2000, 40).when(n >= 500, 30).otherwise(25)


#: Words that open a line about parameters, results and the like.
TAG_WORDS = ("param", "arg", "type", "return", "returns", "raise", "raises", "throw", "throws", "see", "note", "todo", "example", "deprecated")


def first_line(text: Column, most: int = 120) -> Column:
    """The first line of a docstring that says something, cut to ``most`` characters with an ellipsis.

    Marks of comments go from both ends of every line.  A line says nothing if it is empty, a short heading that ends in a
    colon, or about one thing alone (a parameter, the result), as its first word tells.
    """
    blank = " \t\r\n"
    lines = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(blank + "\"'/")), "\n")
    bare = F.transform(lines, lambda x: F.rtrim(F.rtrim(F.ltrim(x, F.lit(blank + "*#/")), F.lit(blank + "*/")), F.lit(blank)))
    opens = lambda x: F.lower(F.element_at(F.split(F.ltrim(x, F.lit("@:")), r"\W", 2), 1))
    told = F.filter(bare, lambda x: (x != "") & ~opens(x).isin(*TAG_WORDS) & ~(x.endswith(":") & (F.length(x) < 15)))
    line = F.coalesce(F.get(told, F.lit(0)), F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.substr(line, F.lit(1), F.lit(most - 3)), F.lit("..."))).otherwise(line)


def plain_unicode(text: Column) -> Column:
    """Separators and control characters as spaces."""
    return F.regexp_replace(text, r"[\p{Z}\p{C}]", " ")


def relative_path(full: Column, root: str) -> Column:
    bare = root.rstrip("/")
    return F.when(full == bare, ".").when(full.startswith(f"{bare}/"), F.substr(full, F.lit(len(bare) + 2))).otherwise(full)


def first_lines(text: Column, most: int) -> Column:
    """At most ``most`` lines."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n")


def repository_id(repository: Column, branch: Column, commit: Column) -> Column:
    """repository:branch (main if blank), with the first eight characters of the commit if there is one."""
    path = F.regexp_replace(F.trim(F.coalesce(repository, F.lit(""))), "^/+|/+$", "")
    name = F.trim(F.coalesce(branch, F.lit("")))
    return F.concat_ws(":", path, F.when(name == "", "main").otherwise(name), F.when(F.coalesce(commit, F.lit("")) != "", F.substr(commit, F.lit(1), F.lit(8))))

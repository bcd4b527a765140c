"""Path predicates and path arithmetic as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names left out of change detection.
CHANGE_SKIP_DIRS = [".git", "node_modules", "dist", "out"]
# Test directory names left out of change detection.
CHANGE_TEST_DIRS = [
    "test", "tests", "__tests__", "__mocks__", "__snapshots__",
    "spec", "specs", "testing", "testdata", "fixtures",
]
# Directory names never indexed.
INDEX_SKIP_DIRS = [
    "node_modules", "dist", "build", "out", "coverage", ".git",
    "venv", ".venv", "target", "generated", ".next", ".turbo", "lib", "site-packages",
]
# Source suffixes, manifests and entry names per language.
SOURCE_SUFFIXES = {"typescript": [".ts", ".tsx"], "python": [".py"], "java": [".java"]}
MANIFEST_FILES = {
    "typescript": ["package.json"],
    "python": ["pyproject.toml", "setup.py"],
    "java": ["build.gradle", "build.gradle.kts", "pom.xml"],
}
LANGUAGE_PRIORITY = ["typescript", "python", "java"]
ENTRY_PATTERN = {
    "typescript": r"^index\.(ts|tsx|js)$",
    "python": r"^(__init__|main|cli)\.py$",
    "java": r"(Main|Application|App|Launcher)\.java$",
}
# Entry names in order of preference, per language.
ENTRY_PREFERENCE = {
    "typescript": ["index.ts", "index.js"],
    "python": ["main.py", "app.py", "cli.py", "__init__.py"],
}
JAVA_ENTRY_NAME = r"(Application|Main|App|Launcher)\.java$"
# Words that mark a document as an architecture claim.
CLAIM_WORDS = [
    "design", "设计", "overview", "概览", "总览", "全貌", "architecture", "架构",
    "concept", "概念", "层级", "分层", "hierarchy",
]
# Suffixes tried, in order, for a relative module specifier.
MODULE_SUFFIXES = ["", ".ts", ".tsx", ".js", "/index.ts", "/index.tsx", "/index.js"]


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def norm_path(path: Column) -> Column:
    """Forward slashes, no ``./`` at the start or between segments."""
    return F.regexp_replace(F.replace(slashed(path), F.lit("/./"), F.lit("/")), r"^\./", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory with its trailing slash removed; '' for a top-level file."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def dir_segments(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def fold_id(name: Column) -> Column:
    """Case, dots, dashes and underscores do not matter when ids are matched."""
    return F.regexp_replace(F.lower(name), r"[._-]", "")


def rel_under(root: Column, path: Column) -> Column:
    """``path`` relative to ``root``; '' when equal, unchanged when outside."""
    base = F.rtrim(slashed(root), F.lit("/"))
    full = F.rtrim(slashed(path), F.lit("/"))
    return (F.when(full == base, F.lit(""))
            .when(F.startswith(full, F.concat(base, F.lit("/"))),
                  F.substring(full, F.length(base) + 2, F.length(full)))
            .otherwise(full))


def ancestor_dirs(directory: Column) -> Column:
    """Every prefix directory of ``directory``, itself included."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def resolve_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; ``..`` above the top is dropped."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    stack = F.aggregate(
        parts, empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))))
    return F.array_join(stack, "/")


def join_path(directory: Column, target: Column) -> Column:
    return resolve_dots(F.concat_ws("/", directory, target))


# The names by which change detection and the call graph tell test files.
TEST_CHANGE_NAMES = [r"\.(test|spec)\.(c|m)?[jt]sx?$", r"^test_.*\.py$", r"_test\.py$", r"(Test|Tests|TestCase)\.java$"]


def is_test_change(path: Column) -> Column:
    """Test files as change detection sees them: the file name only."""
    name = basename(path)
    found = [name.rlike(p) for p in TEST_CHANGE_NAMES]
    return found[0] | found[1] | found[2] | found[3]


def is_test_call(path: Column) -> Column:
    """Test files as the call graph sees them: directories and suffixes."""
    return (path.rlike(r"(^|/)(__tests__|tests?)(/|$)")
            | path.rlike(r"(?i)\.(spec|test)\.[a-z]+$")
            | path.rlike(r"(?i)_test\.py$"))


def in_skipped_dir(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(dir_segments(path), F.array(*[F.lit(n) for n in names]))


def is_tracked_file(path: Column, cache_dir: str | None = None) -> Column:
    """Files that count for change detection."""
    keep = ~in_skipped_dir(path, CHANGE_SKIP_DIRS + CHANGE_TEST_DIRS) & ~is_test_change(path)
    if cache_dir:
        keep = keep & ~F.startswith(path, F.lit(cache_dir.rstrip("/") + "/"))
    return keep


def file_role(name: Column) -> Column:
    return (F.when(name.isin("index.ts", "index.js"), "entry")
            .when(name == "types.ts", "types")
            .when(name == "invariant.ts", "invariant")
            .when(name == "apply.ts", "assembly")
            .when(F.endswith(name, F.lit(".spec.ts")) | F.endswith(name, F.lit(".e2e.ts")), "test")
            .otherwise(""))


def _by_language(language: Column, values: dict[str, Column], other: Column) -> Column:
    out = None
    for lang, value in values.items():
        out = F.when(language == lang, value) if out is None else out.when(language == lang, value)
    return out.otherwise(other)


def is_entry_file(path: Column, language: Column) -> Column:
    name = basename(path)
    return _by_language(language, {k: name.rlike(p) for k, p in ENTRY_PATTERN.items()}, F.lit(False))


def is_source_file(path: Column, language: Column) -> Column:
    def any_suffix(suffixes: list[str]) -> Column:
        out = F.lit(False)
        for s in suffixes:
            out = out | F.endswith(path, F.lit(s))
        return out
    return _by_language(language, {k: any_suffix(v) for k, v in SOURCE_SUFFIXES.items()}, F.lit(False))


def language_of_path(path: Column) -> Column:
    return (F.when(path.rlike(r"\.tsx?$"), "typescript").when(path.rlike(r"\.py$"), "python")
            .when(path.rlike(r"\.java$"), "java").otherwise("unknown"))


def entry_preference(path: Column, language: Column, main_class: Column | None = None) -> Column:
    """Rank of a file as its node's entry; larger means less preferred."""
    name = basename(path)

    def ranked(names: list[str], value: Column) -> Column:
        out = F.when(value == names[0], F.lit(0))
        for i, n in enumerate(names[1:], 1):
            out = out.when(value == n, F.lit(i))
        return out.otherwise(F.lit(99))
    stem = F.regexp_replace(name, r"\.java$", "")
    named = F.when(name.rlike(JAVA_ENTRY_NAME), F.lit(1)).otherwise(F.lit(99))
    java = named if main_class is None else F.when(stem == main_class, F.lit(0)).otherwise(named)
    return _by_language(language, {
        "typescript": ranked(ENTRY_PREFERENCE["typescript"], path),
        "python": ranked(ENTRY_PREFERENCE["python"], name),
        "java": java,
    }, F.lit(99))


def is_claim_doc(path: Column) -> Column:
    stem = F.lower(F.regexp_replace(F.regexp_replace(basename(path), r"\.zh\.md$", ""), r"\.md$", ""))
    return stem.rlike("|".join(CLAIM_WORDS))


def doc_norm(path: Column) -> Column:
    return F.regexp_replace(F.lower(slashed(path)), r"^\./", "")


def locale_tag(rel: Column, tags: tuple[str, ...] = ("zh", "en")) -> Column:
    """Locale marker of a normalized path (``x.zh.md`` or ``zh/x.md``); NULL if none."""
    out = None
    for tag in tags:
        hit = rel.rlike(rf"(^|[/.]){tag}(-[a-z]+)?(\.|/)")
        out = F.when(hit, F.lit(tag)) if out is None else out.when(hit, F.lit(tag))
    return out.otherwise(F.lit(None).cast("string"))


def logical_key(rel: Column, tags: tuple[str, ...] = ("zh", "en")) -> Column:
    """The path with its first locale markers removed."""
    for tag in tags:
        rel = F.regexp_replace(rel, rf"^(.*?)\.{tag}(?:-[a-z]+)?(?=\.)", "$1")
    for tag in tags:
        rel = F.regexp_replace(rel, rf"^(|.*?/){tag}(?:-[a-z]+)?/", "$1")
    return rel


def locale_rank(tag: Column, language: str) -> Column:
    """Which variant a reader gets first."""
    order = [None, "en", "zh"] if language == "English" else ["zh", None, "en"]
    rank = F.lit(len(order))
    for i, t in enumerate(order):
        rank = F.when(tag.isNull() if t is None else tag == t, F.lit(i)).otherwise(rank)
    return rank

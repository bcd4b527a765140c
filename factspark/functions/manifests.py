"""Names and dependencies in package manifests, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty() -> Column:
    return F.array().cast("array<string>")


def json_keys(content: Column, section: str) -> Column:
    """Keys of one object section of a JSON manifest; empty when absent or malformed."""
    return F.coalesce(F.json_object_keys(F.get_json_object(content, f"$.{section}")), _empty())


def package_json_deps(content: Column) -> Column:
    return F.array_distinct(F.concat(json_keys(content, "dependencies"), json_keys(content, "peerDependencies")))


def pyproject_deps(content: Column, parse_specifiers: bool = False) -> Column:
    """Names on lines that start with a quoted name.

    By default a name with a version specifier does not count;
    ``parse_specifiers`` accepts it and keeps the bare name.
    """
    tail = r"[^\"'\n]*" if parse_specifiers else ""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(rf"(?m)^[ \t]*[\"']([A-Za-z0-9_.-]+){tail}[\"']"), 1))


def pom_artifacts(content: Column) -> Column:
    """Every artifact id in the file, its own and its parent's included."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"<artifactId>([^<]+)</artifactId>"), 1))


def manifest_deps(content: Column, language: Column, parse_specifiers: bool = False) -> Column:
    return (F.when(language == "typescript", package_json_deps(content))
            .when(language == "python", pyproject_deps(content, parse_specifiers))
            .when(language == "java", pom_artifacts(content)).otherwise(_empty()))


# Fixed values in the patterns below: section and element names of the manifest formats.
def pyproject_name(content: Column) -> Column:
    """Distribution name from the ``[project]`` or ``[tool.poetry]`` section; NULL if none."""
    sections = F.split(content, r"\n(?=[ \t]*\[[^\n]*\][ \t]*(?:\n|$))")
    named = F.filter(sections, lambda s: s.rlike(r"^\s*\[\s*(project|tool\.poetry)\s*\]"))
    names = F.transform(named, lambda s: F.regexp_extract(s, r"(?m)^[ \t]*name\s*=\s*[\"']([^\"']+)[\"']", 1))
    return F.get(F.filter(names, lambda n: n != ""), F.lit(0))


def pom_own_artifact(content: Column) -> Column:
    """The module's own artifact id: the first one outside ``<parent>``."""
    rest = F.regexp_replace(content, r"(?s)<parent>.*?</parent>", "")
    return F.nullif(F.regexp_extract(rest, r"<artifactId>\s*([^<]+?)\s*</artifactId>", 1), F.lit(""))


def pom_dependency_ids(content: Column) -> Column:
    """Artifact ids inside ``<dependencies>``; managed versions and plugins do not count."""
    rest = F.regexp_replace(content, r"(?s)<dependencyManagement>.*?</dependencyManagement>", "")
    blocks = F.regexp_extract_all(rest, F.lit(r"(?s)<dependencies>.*?</dependencies>"), 0)
    return F.array_distinct(F.flatten(F.transform(
        blocks, lambda b: F.regexp_extract_all(b, F.lit(r"<artifactId>\s*([^<]+?)\s*</artifactId>"), 1))))

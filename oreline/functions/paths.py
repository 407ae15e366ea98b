"""Path predicates and file classification as column expressions (no Python runs per row)."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import static as st


def key(path: Column) -> Column:
    return F.lower(path)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise("")


def extension(path: Column) -> Column:
    """From the last dot of the base name, in lower case; '' if there is none or it comes first."""
    return F.regexp_extract(key(basename(path)), r"(?s)^.+(\.[^.]*)$", 1)


def segments(path: Column) -> Column:
    return F.split(key(path), "/")


def folders(path: Column) -> Column:
    parts = segments(path)
    return F.slice(parts, 1, F.size(parts) - 1)


def has_segment(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def is_safe(path: Column) -> Column:
    """No empty, '.' or '..' segment, leading slash, backslash, control, bidi or line-separator character."""
    odd = path.rlike("[\\\\\\x00-\\x1F\\x7F-\\x9F\\u061C\\u200E\\u200F\\u2028-\\u202E\\u2066-\\u2069]")
    return (path != "") & ~odd & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def is_brief_safe(path: Column) -> Column:
    """is_safe and at most 1024 UTF-16 units."""
    return is_safe(path) & (F.length(F.encode(path, "UTF-16BE")) / 2 <= 1024)


def _ends(names: tuple[str, ...]) -> str:
    """Pattern of lower-case paths whose extension is one of names."""
    return r"[^/](?:" + "|".join(re.escape(n) for n in names) + ")$"


def language(path: Column) -> Column:
    low = key(path)
    return (
        F.when(low.rlike(r"\.pyi$|" + _ends((".py",))), "python").when(low.rlike(_ends(st.TYPESCRIPT)), "typescript").when(low.rlike(_ends(st.JAVASCRIPT)), "javascript")
        .when(low.rlike(_ends(st.RECOGNIZED)), "recognized-unsupported").otherwise("none")
    )


def is_test(path: Column) -> Column:
    base, lang = key(basename(path)), language(path)
    by_name = lang.isin("javascript", "typescript") & (base.contains(".test.") | base.contains(".spec."))
    python = (lang == "python") & (base.rlike(r"^test_.+\.py$") | base.rlike(r".+_test\.py$"))
    return has_segment(folders(path), st.TEST_SEGMENTS) | by_name | python


def is_excluded(path: Column) -> Column:
    return has_segment(segments(path), st.EXCLUDED)


def is_generated(path: Column) -> Column:
    return has_segment(segments(path), st.GENERATED)


def is_manifest(path: Column) -> Column:
    low, base = key(path), key(basename(path))
    return base.isin(*st.MANIFESTS) | (~low.contains("/") & (base.endswith(".csproj") | base.endswith(".sln")))


def is_lockfile(path: Column) -> Column:
    return key(basename(path)).isin(*st.LOCKFILES)


def is_ci(path: Column) -> Column:
    low = key(path)
    return (low.startswith(".github/workflows/") & (low.endswith(".yml") | low.endswith(".yaml"))) | low.isin(*st.CI_PATHS)


def is_dependency_update(path: Column) -> Column:
    return key(path).isin(*st.DEPENDENCY_UPDATES)


def is_template(path: Column) -> Column:
    low = key(path)
    return reduce(or_, (low.startswith(f) for f in st.TEMPLATE_FOLDERS)) | (low == st.TEMPLATE_FILE)


def is_coverage_config(path: Column) -> Column:
    base = key(basename(path))
    return base.isin(*st.COVERAGE_NAMES) | reduce(or_, (base.startswith(p) for p in st.COVERAGE_PREFIXES))


def is_environment_example(path: Column) -> Column:
    base = key(basename(path))
    return base.isin(*st.ENVIRONMENT_EXAMPLES) | base.rlike(st.CONFIG_EXAMPLE)


def is_configuration(path: Column) -> Column:
    base = key(basename(path))
    tools = base.rlike(st.TOOL_CONFIG) | base.rlike(st.TS_CONFIG) | base.isin(*st.TOOL_FILES) | base.rlike(st.COMPOSE)
    return is_ci(path) | is_dependency_update(path) | is_template(path) | is_coverage_config(path) | is_environment_example(path) | tools


def _scoped_pattern(name: str) -> str:
    """Pattern of lower-case paths of one kind of document: its folders, then its stems with a document extension or with none."""
    scopes, stems, whole = st.PRIORITY_DOCUMENTS[name]
    folder = "(?:" + "|".join(re.escape(f"{x}/") if x else "" for x in sorted(scopes, reverse=True)) + ")"
    ends = "(?:" + "|".join(map(re.escape, st.DOCUMENTS)) + ")"
    rest = f"{ends}?" if whole else rf"(?:[^/]*{ends}|[^/.]*)"
    return rf"{folder}(?:{'|'.join(map(re.escape, stems))}){rest}"


def is_scoped_document(path: Column, name: str) -> Column:
    return F.coalesce(key(path).rlike(f"^(?:{_scoped_pattern(name)})$"), F.lit(False))


def is_priority_document(path: Column) -> Column:
    return F.coalesce(key(path).rlike("^(?:" + "|".join(map(_scoped_pattern, st.PRIORITY_DOCUMENTS)) + ")$"), F.lit(False))


def is_declaration(path: Column) -> Column:
    return path.rlike(r"(?i)(?:\.d\.ts|\.pyi)$")


def plain_stem(path: Column) -> Column:
    return F.regexp_replace(key(basename(path)), r"(?:\.d)?\.[^.]+$", "")


def is_entry_point(path: Column) -> Column:
    low, base, stem = key(path), key(basename(path)), plain_stem(path)
    python = (base == "__main__.py") | (~low.contains("/") & stem.isin("main", "app", "cli"))
    return F.when(low.endswith(".py") | low.endswith(".pyi"), python).otherwise(stem.isin(*st.ENTRY_STEMS))


def area(path: Column) -> Column:
    """The first folder that isn't a wrapper; else 'root' or the stem."""
    dirs = folders(path)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain_stem(path), r"\.(?:test|spec)$", ""), r"^test_", ""), r"_test$", "")
    own = F.try_element_at(F.filter(dirs, lambda d: ~d.isin(*st.WRAPPERS)), F.lit(1))
    return F.coalesce(own, F.when(stem.isin(*st.ENTRY_STEMS, "__main__") | (F.size(dirs) == 0), "root").otherwise(stem))


def decision(path: Column, low: Column, base: Column, ext: Column, lang: Column) -> Column:
    """The first entry of the decision list that a path meets, 1 to 11."""
    stem = F.left(base, F.length(base) - F.length(ext))
    minified = ext.isin(*st.RECOGNIZED, *st.DOCUMENTS, ".pyi") & stem.rlike(r".+[._-](?:min|minified)$")
    return (
        F.when(is_excluded(path), 1).when(minified, 2).when(is_lockfile(path), 3).when(low.endswith(".map") | ext.isin(*st.BINARIES), 4).when(is_manifest(path), 5).when(is_configuration(path), 6)
        .when(is_priority_document(path), 7).when(lang == "recognized-unsupported", 8).when(lang != "none", 9).when(ext.isin(*st.DOCUMENTS), 10).otherwise(11)
    )


def with_classes(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """files with eligible, language, category, deep, is_test, tree_evidence, skip_reason, area, priority_document and entry_point.

    Intermediate columns keep the expressions small: each predicate is evaluated once.
    """
    p = F.col(path)
    rows = files.select("*", key(p).alias("_low"), key(basename(p)).alias("_base"), extension(p).alias("_ext"), language(p).alias("_lang"))
    found = F.struct(is_test(p).alias("_test"), decision(p, F.col("_low"), F.col("_base"), F.col("_ext"), F.col("_lang")).alias("_step"), is_generated(p).alias("_generated"), area(p).alias("area"), is_priority_document(p).alias("priority_document"), is_entry_point(p).alias("entry_point"))
    # a generator of one row: filters on the results stay above it, instead of taking copies of these expressions with them
    rows = rows.select("*", F.explode(F.array(found)).alias("_f")).select("*", "_f.*")
    step, large = F.col("_step"), F.col(size) > st.MAX_FILE_BYTES
    code, fits = step.isin(1, 2, 8, 9), step.isin(5, 6, 7, 9, 10)
    reason = F.when(step <= 3, "excluded").when(step == 4, "binary").when(step.isin(8, 11), "unsupported").when(large, "oversized")
    category = F.when(code, F.when(F.col("_test"), "test").otherwise("source")).when(step == 5, "manifest").when(step.isin(7, 10), "documentation").otherwise("configuration")
    return rows.select(
        *files.columns, (fits & ~large).alias("eligible"), F.when(code, F.col("_lang")).otherwise("none").alias("language"), category.alias("category"), ((step == 9) & ~F.col("_low").endswith(".d.ts") & ~F.col("_low").endswith(".pyi")).alias("deep"),
        (code & F.col("_test")).alias("is_test"), F.when((step == 1) & F.col("_generated"), "generated-directory").when(step == 3, "lockfile").alias("tree_evidence"), reason.alias("skip_reason"),
        "area", "priority_document", "entry_point",
    )

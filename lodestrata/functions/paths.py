"""Predicates and classifiers of repository paths, as columns over the path alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def segments(path: Column) -> Column:
    return F.split(path, "/")


def directories(path: Column) -> Column:
    parts = segments(path)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def parent(path: Column) -> Column:
    return F.array_join(directories(path), "/")


def suffix(path: Column) -> Column:
    """From the last dot, if something else than dots comes before it."""
    return F.regexp_extract(name(path), r"[^.].*?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """Lower-case name up to its first dot."""
    return F.element_at(F.split(F.lower(name(path)), r"\.", 2), 1)


def depth(path: Column) -> Column:
    return F.size(segments(path))


def starts_with_any(c: Column, values: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(v) for v in values])


def ends_with_any(c: Column, values: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(v) for v in values])


def is_safe(path: Column) -> Column:
    whole = F.length(path).between(1, C.MAX_PATH) & ~path.rlike(r"^/|\\|[\x00-\x1f\x7f]")
    return F.coalesce(whole & F.forall(segments(path), lambda s: ~s.isin("", ".", "..")), F.lit(False))


def ignored_position(parts: Column) -> Column:
    """1-based position of the first ignored directory, else 0; names of build output don't count below a source root."""
    start = F.struct(F.lit(False).alias("source"), F.lit(0).alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        ignored = s.isin(*C.IGNORED_DIRS) & ~(acc["source"] & s.isin(*C.OUTPUT_DIRS))
        at = F.when((acc["at"] == 0) & ignored, acc["i"] + 1).otherwise(acc["at"])
        return F.struct((acc["source"] | s.isin(*C.SOURCE_ROOTS)).alias("source"), at.alias("at"), (acc["i"] + 1).alias("i"))

    return F.aggregate(parts, start, step, lambda acc: acc["at"])


def ignored_root(path: Column, is_dir: Column) -> Column:
    """Path of the outermost ignored directory around (or, for a directory, at) path; null if none."""
    parts = segments(path)
    at = ignored_position(F.when(is_dir, parts).otherwise(directories(path)))
    return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at), "/"))


def is_ignored(path: Column) -> Column:
    return ignored_position(directories(path)) > 0


def language(path: Column) -> Column:
    own, ext = name(path), suffix(path)
    docker = F.when(own.startswith("Dockerfile.") | own.endswith(".dockerfile"), "Dockerfile")
    return F.coalesce(lookup(C.LANGUAGE_BY_NAME, own), docker, lookup(C.LANGUAGE_BY_EXTENSION, ext), lookup(C.LANGUAGE_BY_EXTENSION, F.lower(ext)))


def is_test(path: Column) -> Column:
    own, low, ext = name(path), F.lower(name(path)), suffix(path)
    bare = F.substring(own, 1, 10_000).substr(F.lit(1), F.length(own) - F.length(ext))
    java = (ext == ".java") & ends_with_any(bare, ("Test", "Tests", "IT"))
    others = ext.isin(".cs", ".kt", ".swift") & ends_with_any(bare, ("Test", "Tests"))
    by_name = stem(path).startswith("test_") | ends_with_any(stem(path), ("_test", "_spec")) | low.contains(".test.") | low.contains(".spec.")
    return F.exists(directories(path), lambda s: F.lower(s).isin(*C.TEST_DIRS)) | by_name | java | others


def is_generated(path: Column) -> Column:
    low = F.lower(name(path))
    return ends_with_any(low, C.GENERATED_SUFFIXES) | low.startswith("generated_")


def is_auxiliary(path: Column) -> Column:
    return path.rlike(C.AUXILIARY)


def category(path: Column) -> Column:
    own, low, ext, lang = name(path), F.lower(name(path)), F.lower(suffix(path)), language(path)
    named_config = own.isin(*C.CONFIG_NAMES) | starts_with_any(low, C.CONFIG_PREFIXES)
    code = lang.isNotNull() & ~F.coalesce(lang, F.lit("")).isin(*C.NOT_CODE)
    return (
        F.when(own.isin(*C.LOCKFILES), "lockfile")
        .when(ext.isin(*C.ASSETS), "asset")
        .when(ext.isin(*C.BINARIES), "binary")
        .when(is_generated(path), "generated")
        .when(stem(path).isin(*C.DOC_NAMES) | ext.isin(*C.DOC_SUFFIXES), "documentation")
        .when(code & is_test(path), "test")
        .when(code & (named_config | lang.isin("Dockerfile", "Makefile") | low.contains(".config.")), "config")
        .when(code, "source")
        .when(named_config | ext.isin(*C.CONFIG_SUFFIXES) | (F.element_at(segments(path), 1) == ".github"), "config")
        .when(ext.isin(*C.DATA_SUFFIXES), "data")
        .otherwise("other")
    )


def classified_language(path: Column) -> Column:
    """The language that counts for a file: none for assets and binaries."""
    ext = F.lower(suffix(path))
    return F.when(ext.isin(*C.ASSETS, *C.BINARIES) & ~name(path).isin(*C.LOCKFILES), None).otherwise(language(path))


def language_kind(lang: Column) -> Column:
    return F.when(lang.isin(*C.PROSE), "prose").when(lang.isin(*C.MARKUP), "markup").when(lang.isin(*C.DATA), "data").otherwise("programming")


def is_manifest(path: Column) -> Column:
    below = F.lower(F.element_at(F.concat(F.array(F.lit("")), directories(path)), -1))
    return name(path).isin(*C.MANIFEST_ECOSYSTEM) | name(path).rlike(C.REQUIREMENTS) | ((below == "requirements") & name(path).endswith(".txt"))


def is_top_level_doc(path: Column) -> Column:
    first = F.element_at(segments(path), 1)
    return ((depth(path) == 1) | ((depth(path) == 2) & first.isin(".github", "docs"))) & stem(path).isin(*C.DOC_STEMS)


def is_security_config(path: Column) -> Column:
    own = name(path)
    return own.isin(*C.SECURITY_CONFIGS) | starts_with_any(own, ("Dockerfile", ".env")) | ends_with_any(own, (".dockerfile", ".tf")) | path.rlike(r"^\.github/workflows/.")

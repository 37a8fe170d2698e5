"""Module identity: how a language spells the module that a file defines, and the one that an import names.

Every function takes and returns columns; all of it stays inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spelling of a module by language; all others are dotted (fixed values).
SPELLINGS = {"go": "package", "php": "namespace", "typescript": "relative", "tsx": "relative", "javascript": "relative", "jsx": "relative"}
#: Leading directories that no import writes, longest first where one begins another (fixed values).
SOURCE_ROOTS = (
    "src/main/java", "src/main/kotlin", "src/main/scala", "src/main/resources", "src/test/java", "src/test/kotlin", "src/test/scala", "app/src/main/java", "app/src/main/kotlin", "src", "lib",
)
#: A file of this name stands for its directory (fixed values).
INITIALISERS = ("__init__", "index", "mod")
#: Extensions that an import may write (fixed values).
IMPORT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
#: Receivers that mean the enclosing object (fixed values).
SELF_RECEIVERS = ("self", "this", "$this", "cls", "me", "static", "parent", "super")


def spelling(lang: Column) -> Column:
    return F.coalesce(reduce(lambda c, kv: c.when(lang == kv[0], kv[1]), SPELLINGS.items(), F), F.lit("dotted"))


def directory(path: Column) -> Column:
    """The package directory of a path; '.' at the root."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def without_root(path: Column) -> Column:
    """Drops one source root, never the whole path."""
    roots = "|".join(sorted(SOURCE_ROOTS, key=lambda r: -r.count("/")))
    return F.regexp_replace(path, rf"^(?:{roots})/(?=.)", "")


def without_index(path: Column) -> Column:
    return F.when(path == "index", F.lit(".")).otherwise(F.regexp_replace(path, r"/index$", ""))


def module_name(path: Column, lang: Column) -> Column:
    """The module that a path defines, as imports of it spell it; a spelling is a namespace of its own."""
    how, bare = spelling(lang), without_suffix(path)
    dotted = F.regexp_replace(without_root(bare), rf"(?:^|/)(?:{'|'.join(INITIALISERS)})$", "")
    return (
        F.when(how == "package", F.concat(F.lit("package:"), directory(path)))
        .when(how == "namespace", F.concat(F.lit("namespace:"), F.lower(bare)))
        .when(how == "relative", F.concat(F.lit("relative:"), without_index(bare)))
        .otherwise(F.replace(dotted, F.lit("/"), F.lit(".")))
    )


def normal_path(path: Column) -> Column:
    """A relative path without '.', '..' and empty parts; '..' beyond the start stays."""
    def step(held, part):
        up = (F.size(held) > 0) & (F.element_at(held, -1) != "..")
        return (
            F.when(part.isin("", "."), held)
            .when((part == "..") & up, F.slice(held, F.lit(1), F.size(held) - 1))
            .otherwise(F.concat(held, F.array(part)))
        )

    out = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(out == "", F.lit(".")).otherwise(out)


def relative_import(importer: Column, module: Column) -> Column:
    joined = normal_path(F.concat_ws("/", directory(importer), module))
    bare = F.regexp_replace(joined, rf"(?<=[^/])(?:{'|'.join(s.replace('.', '[.]') for s in IMPORT_SUFFIXES)})$", "")
    return F.when(module.startswith("."), without_index(bare)).otherwise(module)


def package_import(module: Column) -> Column:
    """A Go import path without host, owner and repository, where it has them."""
    parts = F.split(module, "/")
    return F.when((F.size(parts) > 3) & F.contains(F.get(parts, F.lit(0)), F.lit(".")), F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(1))), "/")).otherwise(module)


def dotted_import(importer: Column, module: Column) -> Column:
    """A module with leading dots against the importer's package: one dot is that package, each further one climbs."""
    tail = F.ltrim(module, F.lit("."))
    depth = F.length(module) - F.length(tail)
    folder = directory(importer)
    parts = F.filter(F.split(F.when(folder == ".", F.lit("")).otherwise(F.regexp_replace(without_root(F.concat(folder, F.lit("/_"))), "/?_$", "")), "/"), lambda p: p != "")
    base = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - depth + 1))
    return F.when(~module.startswith("."), module).otherwise(F.array_join(F.concat(base, F.when(tail == "", F.array().cast("array<string>")).otherwise(F.array(tail))), "."))


def resolve_module(importer: Column, lang: Column, module: Column) -> Column:
    """The module that an import in a file names, in the shape that module_name gives."""
    how = spelling(lang)
    return (
        F.when(how == "package", F.concat(F.lit("package:"), package_import(module)))
        .when(how == "namespace", F.concat(F.lit("namespace:"), F.lower(F.trim(F.replace(module, F.lit("\\"), F.lit("/")), F.lit("/")))))
        .when(how == "relative", F.concat(F.lit("relative:"), relative_import(importer, module)))
        .otherwise(dotted_import(importer, module))
    )


def tag(module: Column) -> Column:
    found = F.regexp_extract(module, r"^(package|namespace|relative):", 1)
    return found


def leaf(module: Column) -> Column:
    """The last segment of a module, in its own spelling."""
    tagged = tag(module) != ""
    return F.element_at(F.when(tagged, F.split(F.regexp_replace(module, r"^[a-z]+:", ""), "/")).otherwise(F.split(module, r"\.")), -1)


def receiver_names(module: Column, receiver: Column) -> Column:
    """Whether a receiver is a module's last segment; namespaces ignore letter case."""
    return F.when(tag(module) == "namespace", F.lower(leaf(module)) == F.lower(receiver)).otherwise(leaf(module) == receiver)


def submodule(module: Column, name: Column) -> Column:
    """The module one level below; an empty base leaves the name alone."""
    tagged = tag(module) != ""
    body = F.when(tagged, F.regexp_replace(module, r"^[a-z]+:", "")).otherwise(module)
    joined = F.when(body == "", name).otherwise(F.concat(body, F.when(tagged, F.lit("/")).otherwise(F.lit(".")), name))
    return F.when(tagged, F.concat(tag(module), F.lit(":"), joined)).otherwise(joined)

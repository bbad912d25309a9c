"""Column functions on names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(path: Column) -> Column:
    """The last part of a name from its last dot on; empty without one, or if the name only begins with it."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def resolved(path: Column, base: str = "/") -> Column:
    """The absolute path: ``base`` before a relative one, without empty, ``.`` and ``..`` parts."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    steps = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    walk = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))


def relative(path: Column, base: str) -> Column:
    """The way from ``base`` to a path, both absolute: up as far as they differ, then down; empty if they are the same."""
    own = F.filter(F.split(path, "/"), lambda x: x != "")
    root = F.array(*[F.lit(x) for x in base.split("/") if x]).cast("array<string>")
    same = F.zip_with(own, root, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    shared = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")))["n"]
    up = F.array_repeat(F.lit(".."), F.size(root) - shared)
    return F.array_join(F.concat(up, F.slice(own, shared + 1, F.size(own))), "/")


def truncated(source: Column, limit: int = 1500) -> Column:
    """The first ``limit`` characters and a note, null for nothing."""
    cut = F.concat(F.substring(source, 1, limit), F.lit("\n// ... truncated"))
    return F.when(F.coalesce(source, F.lit("")) == "", None).when(F.char_length(source) > limit, cut).otherwise(source)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def display_name(name: Column, path: Column) -> Column:
    """The name, else the last path segment, else the path, else ``unknown``."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(name), some(basename(path)), some(path), F.lit("unknown"))


def kind_of_label(labels: Column, known: tuple[str, ...] = ("Function", "Class", "Variable", "File", "Directory")) -> Column:
    """The first known label in lower case, else ``unknown``."""
    return F.coalesce(F.lower(F.try_element_at(F.filter(labels, lambda x: x.isin(list(known))), F.lit(1))), F.lit("unknown"))


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals and no grouping."""
    return F.format_string(f"%.{digits}f", x)


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws("#", path, name, line.cast("string"))

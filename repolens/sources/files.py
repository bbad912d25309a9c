"""Source files as a DataFrame: enumeration, ignore rules and hashes.  Reading runs in the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from repolens.functions.parsers import EXTENSIONS

#: Directories that are never indexed (fixed values).
IGNORED_DIRS = ("node_modules", "vendor", "dist", ".git", "build", "coverage")


def gitignore_regex(pattern: str) -> str | None:
    """A regular expression over relative paths for one line of an ignore file; None for blank lines and comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    only_dir = line.endswith("/")
    line = line.rstrip("/").removeprefix("\\")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            end = line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_dir else "(?:/.*)?$")


def ignored(rel: Column, gitignore: str = "") -> Column:
    """Whether a relative path is ignored: the last rule that fits decides, and ``!`` rules take paths back in."""
    verdict = F.lit(False)
    for line in [*gitignore.splitlines(), *IGNORED_DIRS]:
        keep = line.startswith("!")
        pattern = gitignore_regex(line[1:] if keep else line)
        if pattern:
            verdict = F.when(rel.rlike(pattern), F.lit(not keep)).otherwise(verdict)
    return verdict


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for lang in sorted(set(EXTENSIONS.values())):
        out = F.when(ext.isin([k for k, v in EXTENSIONS.items() if v == lang]), F.lit(lang)).otherwise(out)
    return out


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, hidden ones too; None if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    stream = fs.open(fs_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def root_gitignore(spark: SparkSession, root: str) -> str:
    """The text of the .gitignore in the root, empty if there is none."""
    return read_text(spark, f"{root}/.gitignore") or ""


def exists(spark: SparkSession, path: str) -> bool:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)


def glob_regex(pattern: str) -> str:
    """A regular expression over whole relative paths for a glob: ``*`` and ``?`` within a name, ``**/`` for any directories,
    ``{a,b}`` for either, ``[a-c]`` and ``[!a-c]`` for characters."""
    out, i, braces = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{" and "}" in pattern[i:]:
            out, braces = out + "(?:", braces + 1
        elif c in ",}" and braces:
            out, braces = out + ("|" if c == "," else ")"), braces - (c == "}")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def fits_globs(rel: Column, patterns: list[str], ignore: list[str] | None = None) -> Column:
    """Whether a relative path fits any of the globs and none of the ignored ones."""
    any_of = lambda globs: reduce(lambda a, b: a | b, [rel.rlike(glob_regex(g)) for g in globs], F.lit(False))
    return any_of(patterns) & ~any_of(ignore or [])


def glob(spark: SparkSession, root: str, patterns: str | list[str] = "**/*", ignore: list[str] | None = None, absolute: bool = True) -> DataFrame:
    """path, length, modified of the files under ``root`` whose path from there fits a glob and none of ``ignore``; contents
    are not read.  With ``absolute`` false paths are stated from ``root`` on."""
    root = rooted(spark, root)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = df.select(plain(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))
    rel = below(F.col("path"), root)
    df = df.where(fits_globs(rel, [patterns] if isinstance(patterns, str) else patterns, ignore))
    return df if absolute else df.withColumn("path", rel)


def plain(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, r"^file:/+", "/")


def rooted(spark: SparkSession, root: str) -> str:
    """The one name of a directory, as ``plain`` names the files in it: absolute, with its file system unless that is the
    local one, without a slash at its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "/", whole).rstrip("/")


def below(path: Column, root: str) -> Column:
    """The path from ``root`` on, which ``rooted`` has named; a file that isn't below it is an error."""
    base = root + "/"
    odd = F.raise_error(F.concat(path, F.lit(f" is not below {base}")))
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(odd)


def contents(raw: DataFrame, root: str) -> DataFrame:
    """path, rel, lang, source, content_hash of files (path, content)."""
    rows = raw.select(plain(F.col("path")).alias("path"), "content").withColumn("rel", below(F.col("path"), root))
    return rows.select("path", "rel", language(F.col("path")).alias("lang"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"), F.sha2("content", 256).alias("content_hash"))


def read_sources(spark: SparkSession, root: str, gitignore: str | None = None) -> DataFrame:
    """path, rel, lang, source, content_hash of the source files under ``root`` that no rule ignores."""
    root = rooted(spark, root)
    rules = root_gitignore(spark, root) if gitignore is None else gitignore
    pattern = "*.{" + ",".join(sorted(x[1:] for x in EXTENSIONS)) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return contents(raw.where(~ignored(below(plain(F.col("path")), root), rules)), root)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    uri = re.sub(r"^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def write_files(files: DataFrame, root: str) -> None:
    """Write files (rel, source) under ``root``, a folder that driver and executors share, each by the task that has it."""
    def run(rows: Iterator[Row]) -> None:
        fs, top = opened(root)
        made: set[str] = set()
        for r in rows:
            target = f"{top.rstrip('/')}/{r['rel']}"
            folder = target.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            with fs.open_output_stream(target) as out:
                out.write((r["source"] or "").encode())

    # a few blocks may hold all of them: a task for at least every core
    files.select("rel", "source").repartition(2 * files.sparkSession.sparkContext.defaultParallelism, "rel").foreachPartition(run)

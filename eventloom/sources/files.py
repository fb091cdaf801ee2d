"""Instruction and memory files, ignore rules and marked blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import text as T


def read_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Whole text files below a folder: ``path, content``."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def instruction_rules(files: DataFrame, key: str, content: str) -> DataFrame:
    """The rules of instruction texts: ``(key, line, section, rule, category)``.

    A rule is a list entry or a line of prose of at least 12 characters outside fenced code; its section is the heading
    above it. A constraint's words make it a constraint, a decision's a decision, else it is a convention. Front matter,
    comments and short lines are left out. Lines are numbered in their file, so only one file is ordered at a time.
    """
    bare = F.regexp_replace(F.regexp_replace(content, r"(?s)\A---\n.*?\n---\n", ""), r"(?s)<!--.*?-->", "")
    lines = files.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(bare, r"\r?\n")).alias("line", "raw"))
    down = Window.partitionBy("key").orderBy("line")
    fence = F.col("raw").rlike(r"^\s*```")
    marked = lines.withColumn("fences", F.sum(fence.cast("int")).over(down)).withColumn(
        "section", F.last(F.when(F.col("raw").rlike(r"^#{1,6} "), F.trim(F.regexp_replace("raw", r"^#{1,6} ", ""))), ignorenulls=True).over(down)
    )
    rule = F.trim(F.regexp_replace("raw", r"^\s*(?:[-*+]|[0-9]+[.)]|\[ \])\s+", ""))
    kept = marked.where((F.col("fences") % 2 == 0) & ~fence & ~F.col("raw").rlike(r"^#{1,6} ")).withColumn("rule", rule).where(F.length("rule") >= 12)
    category = F.when(F.col("rule").rlike(T.CONSTRAINT), "constraints").when(F.col("rule").rlike(T.DECISION), "decisions").otherwise("conventions")
    return kept.select(F.col("key").alias(key), "line", "section", "rule", category.alias("category"))


def memory_entries(files: DataFrame) -> DataFrame:
    """Memory files with front matter: ``path, name, kind, description, body``; files without it are left out."""
    head = F.regexp_extract("content", r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^\s*{name}:\s*(.*)$", 1)), F.lit(""))
    return files.where(head != "").select(
        "path", field("name").alias("name"), F.coalesce(field("type"), F.lit("note")).alias("kind"), field("description").alias("description"),
        F.btrim(F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n", ""), F.lit(" \t\r\n")).alias("body"),
    )


def import_plan(entries: DataFrame, held: DataFrame) -> DataFrame:
    """What an import does: ``key, content_hash, action`` with ``add`` for new hashes, ``replace`` for a held key with
    another hash, ``drop`` for held keys that are gone, ``keep`` for what is equal. Both sides have ``key, content_hash``."""
    new = entries.select("key", F.col("content_hash").alias("h")).dropDuplicates(["key"])
    old = held.select("key", F.col("content_hash").alias("o")).dropDuplicates(["key"])
    both = new.join(old, "key", "full")
    action = F.when(F.col("o").isNull(), "add").when(F.col("h").isNull(), "drop").when(F.col("h") == F.col("o"), "keep").otherwise("replace")
    return both.select("key", F.coalesce("h", "o").alias("content_hash"), action.alias("action"))


def ignore_pattern(rule: str) -> str:
    """One ignore rule as a pattern over whole relative paths: ``*``, ``?``, ``**``, anchors and folders."""
    body = rule.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out = ""
    for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", body):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.sub(r"([.^$+{}()|\[\]\\])", r"\\\1", part))
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if rule.endswith("/") else "(?:/.*)?$")


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that matches a path ignores it; ``!`` takes a path back, blank lines and ``#`` count not."""
    verdict = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            verdict = F.when(path.rlike(ignore_pattern(rule.removeprefix("!"))), F.lit(not rule.startswith("!"))).otherwise(verdict)
    return verdict


def _block(name: str) -> str:
    return rf"(?s)<!-- {re.escape(name)}:start -->\n?(.*?)\n?<!-- {re.escape(name)}:end -->"


def marked_block(text: Column, name: str) -> Column:
    """The text between a name's start and end marks; null without them."""
    return F.when(text.rlike(_block(name)), F.regexp_extract(text, _block(name), 1))


def with_block(text: Column, name: str, body: Column) -> Column:
    """The text with a name's block set to a body, at its end if it has none; a null body removes the block."""
    block = F.concat(F.lit(f"<!-- {name}:start -->\n"), body, F.lit(f"\n<!-- {name}:end -->"))
    parts = F.split(text, _block(name), 2)
    put = F.concat(F.get(parts, 0), F.coalesce(block, F.lit("")), F.coalesce(F.get(parts, 1), F.lit("")))
    return F.when(text.rlike(_block(name)), put).when(body.isNull(), text).otherwise(F.concat(text, F.lit("\n\n"), block))

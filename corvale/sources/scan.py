"""Repository scans: files under a folder, the filters that leave some out, and changes between scans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fnmatch import translate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.functions.text import csv_tokens, file_name, language_of, suffix

COUNTERS = ("visited", "scanned", "excluded_dir", "excluded_extension", "excluded_file", "excluded_pattern", "excluded_size", "excluded_decode")


@dataclass(frozen=True)
class Filters:
    """What a scan leaves out."""

    max_bytes: int
    dirs: frozenset[str] = field(default_factory=frozenset)
    extensions: frozenset[str] = field(default_factory=frozenset)
    files: frozenset[str] = field(default_factory=frozenset)
    patterns: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def from_settings(settings: dict[str, object]) -> Filters:
        """Reads scan settings; sizes, folders and extensions must be there."""
        size = int(settings.get("scan_max_file_size_bytes") or 0)
        text = {k: str(settings.get(f"scan_excluded_{k}") or "").strip() for k in ("dirs", "extensions", "files", "patterns")}
        missing = [n for n, there in (("scan_max_file_size_bytes", size > 0), ("scan_excluded_dirs", text["dirs"]), ("scan_excluded_extensions", text["extensions"])) if not there]
        if missing:
            raise ValueError(f"not configured: {', '.join(missing)}")
        return Filters(size, *(frozenset(csv_tokens(text[k], k == "extensions")) for k in text))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, bytes) of all files below root, by any store that Spark reads; paths are relative."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    return found.select(F.regexp_replace(path, f"^{re.escape(clean)}", "").alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("bytes"))


def reason(filters: Filters, path: Column, size: Column, readable: Column) -> Column:
    """Why a file is left out, the first filter that holds; null for one that is scanned."""
    low = F.lower(path)
    parents = F.slice(F.split(low, "/"), 1, F.size(F.split(low, "/")) - 1)
    among = lambda c, names: c.isin(*sorted(n.lower() for n in names)) if names else F.lit(False)
    in_dir = F.arrays_overlap(parents, F.array(*map(F.lit, sorted(d.lower() for d in filters.dirs)))) if filters.dirs else F.lit(False)
    by_pattern = F.lit(False)
    for pattern in sorted(filters.patterns):
        by_pattern = by_pattern | low.rlike("^" + _java(translate(pattern.lower().replace("\\", "/"))))
    return (
        F.when(in_dir, "excluded_dir")
        .when(among(suffix(path), filters.extensions), "excluded_extension")
        .when(among(file_name(low), filters.files) | among(low, filters.files), "excluded_file")
        .when(by_pattern, "excluded_pattern")
        .when(size > filters.max_bytes, "excluded_size")
        .when(~readable, "excluded_decode")
    )


def _java(pattern: str) -> str:
    """A Python regular expression of fnmatch in Java's spelling."""
    return pattern.replace(r"\Z", "$").replace(r"\z", "$")


def scan(files: DataFrame, filters: Filters, repo: str) -> DataFrame:
    """(repo_id, path, language, content, size_bytes, reason): scanned files have no reason, others no content."""
    readable = F.is_valid_utf8(F.col("bytes").cast("string"))
    why = reason(filters, F.col("path"), F.col("size_bytes"), F.coalesce(readable, F.lit(True)))
    rows = files.withColumn("reason", why)
    return rows.select(F.lit(repo).alias("repo_id"), "path", language_of(F.col("path")).alias("language"), F.when(F.col("reason").isNull(), F.col("bytes").cast("string")).alias("content"), "size_bytes", "reason")


def scanned(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NULL").drop("reason")


def counters(rows: DataFrame, filters: Filters) -> DataFrame:
    """One row of counters. Files below an excluded folder are not visited; the folder counts once, as pruned."""
    low = F.split(F.lower("path"), "/")
    barred = F.array(*map(F.lit, sorted(d.lower() for d in filters.dirs))).cast("array<string>")
    parents = F.slice(low, 1, F.size(low) - 1)
    first = F.array_min(F.filter(F.transform(barred, lambda d: F.array_position(parents, d)), lambda p: p > 0))
    pruned = rows.where("reason = 'excluded_dir'").select(F.array_join(F.slice(F.split("path", "/"), 1, first.cast("int")), "/").alias("dir")).distinct()
    kept = rows.where("reason IS DISTINCT FROM 'excluded_dir'")
    folders = kept.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("dir")).distinct()
    by_reason = [F.count_if(F.col("reason") == c).alias(c) for c in COUNTERS if c.startswith("excluded_") and c != "excluded_dir"]
    counts = kept.agg(F.count(F.lit(1)).alias("visited"), F.count_if(F.col("reason").isNull()).alias("scanned"), *by_reason)
    one = lambda a, b: a.join(F.broadcast(b), how="inner", on=F.lit(True))  # noqa: E731  single rows
    gone = pruned.agg(F.count(F.lit(1)).alias("excluded_dir"), F.count(F.lit(1)).alias("pruned_dirs"))
    return one(one(counts, gone), folders.agg(F.count(F.lit(1)).alias("visited_dirs")))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): changed for new paths and other contents, deleted for those that went. A rename is both."""
    digest = lambda df, name: df.select("path", F.sha2("content", 256).alias(name))
    both = digest(old, "before").join(digest(new, "after"), "path", "full_outer")
    change = F.when(F.col("after").isNull(), "deleted").when(F.col("before").isNull() | (F.col("before") != F.col("after")), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def parse_name_status(raw: str) -> tuple[list[str], list[str]]:
    """(changed, deleted) of NUL-separated status records: renames delete the source, copies do not."""
    tokens = iter([t for t in raw.split("\0") if t])
    changed: list[str] = []
    deleted: list[str] = []
    for status in tokens:
        first = next(tokens, None)
        second = next(tokens, None) if status[0] in "RC" else None
        if first is None or (status[0] in "RC" and second is None):
            break
        (deleted if status[0] in "DR" else changed).append(first) if status[0] != "C" else None
        if second is not None:
            changed.append(second)
    return changed, deleted


def name_status(records: DataFrame, column: str = "raw") -> DataFrame:
    """(path, change) rows of status texts, by folding over their tokens."""
    tokens = F.filter(F.split(column, "\0"), lambda t: t != "")
    none = F.array().cast("array<struct<path:string,change:string>>")
    start = F.struct(F.lit("").alias("code"), F.lit(None).cast("string").alias("source"), none.alias("out"))
    row = lambda p, c: F.struct(p.alias("path"), F.lit(c).alias("change"))

    def step(acc: Column, t: Column) -> Column:
        code, two = acc["code"], acc["code"].isin("R", "C")
        fresh = code == ""
        wait = two & acc["source"].isNull()
        done = (
            F.when((code == "D"), F.array_append(acc["out"], row(t, "deleted")))
            .when((code == "R"), F.concat(acc["out"], F.array(row(acc["source"], "deleted"), row(t, "changed"))))
            .otherwise(F.array_append(acc["out"], row(t, "changed")))
        )
        return F.struct(
            F.when(fresh, F.substring(t, 1, 1)).when(wait, code).otherwise("").alias("code"),
            F.when(~fresh & wait, t).alias("source"),
            F.when(fresh | wait, acc["out"]).otherwise(done).alias("out"),
        )

    return records.select(F.explode(F.aggregate(tokens, start, step)["out"]).alias("x")).select("x.path", "x.change")

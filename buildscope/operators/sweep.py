"""Fingerprints of folders brought up to date from the bottom, only where something below has changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


def parent(path: Column) -> Column:
    """The folder that a path lies in; that of a path without a slash is '', the root, which has none."""
    return F.when(path == "", None).when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def depth(path: Column) -> Column:
    """How many folders a path lies below the root."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def fingerprint(parts: Column) -> Column:
    """Of an array of (name, hash), in order of names."""
    return F.substring(F.sha2(F.array_join(F.transform(F.array_sort(parts), lambda x: F.concat(x["name"], F.lit(":"), x["hash"])), "|"), 256), 1, 16)


def bubble_up(files: DataFrame, folders: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows (path, fingerprint, rewritten) of the folders that are looked at.

    files: path, hash, of files that are known; folders: path, fingerprint as stored; changed: path, of files
    that were saved. Deepest first, a folder is looked at if a changed file lies in it or a folder in it was rewritten, and
    is rewritten if its fingerprint, of its files' hashes and of its folders' fingerprints, is not the one stored;
    above a folder that stays as it is nothing is looked at on its account. A folder without a known child is
    not rewritten. A level costs the children of the folders that are looked at there.
    """
    children = cut(files.select(parent(F.col("path")).alias("folder"), base(F.col("path")).alias("name"), "hash"))
    own = cut(folders.select("path", "fingerprint"))
    first = cut(changed.select(parent(F.col("path")).alias("path")).where("path is not null").distinct().withColumn("depth", depth(F.col("path"))))
    level = first.agg(F.max("depth")).first()[0]
    done, above = [], None
    while level is not None and level >= 0:
        here = first.where(F.col("depth") == level).select("path")
        here = here if above is None else here.unionByName(above).distinct()
        kept = own if not done else own.join(reduce(DataFrame.unionByName, done).where("rewritten").select("path"), "path", "left_anti").unionByName(reduce(DataFrame.unionByName, done).where("rewritten").select("path", "fingerprint"))
        inner = kept.where("path <> ''").select(parent(F.col("path")).alias("folder"), base(F.col("path")).alias("name"), F.col("fingerprint").alias("hash"))
        parts = children.unionByName(inner).join(here.withColumnRenamed("path", "folder"), "folder", "left_semi")
        new = parts.groupBy(F.col("folder").alias("path")).agg(fingerprint(F.collect_list(F.struct("name", "hash"))).alias("fingerprint"))
        stored = own.withColumnRenamed("fingerprint", "_stored")
        looked = here.join(new, "path", "left").join(stored, "path", "left").select("path", "fingerprint", (F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("_stored"))).alias("rewritten"))
        looked = cut(looked)
        done.append(looked)
        above = looked.where("rewritten and path <> ''").select(parent(F.col("path")).alias("path"))
        level -= 1
    return reduce(DataFrame.unionByName, done) if done else own.withColumn("rewritten", F.lit(False)).limit(0)

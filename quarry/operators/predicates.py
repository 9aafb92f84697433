"""Filters of the catalogue. Each is a Column condition, so that it reaches the scan where Catalyst can push it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import settle

#: Extensions and path prefixes of system files.
SYSTEM_EXTENSIONS = "exe dll sys drv ocx cpl efi scr ico cur ani manifest mui nls msi msp mst cat inf reg elf so bin dat pack idx".split()
SYSTEM_PREFIXES = ("windows/", "winnt/", "program files", "programdata/", "$recycle.bin/", "system volume information/", "boot/", "perflogs/", "recovery/")
KEPT_TREE = "windows.old/"
_UNITS = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4}


def low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name).cast("string"), F.lit("")))


def always() -> Column:
    return F.lit(True)


def size_filter(spec: str, size: str = "size") -> Column:
    """>=1.5kb, <3m, 12 ...: 1024-based, equality without a sign; a spec that can't be read holds always."""
    m = re.fullmatch(r"(>=|<=|==|>|<|=)?\s*(\d+(?:\.\d+)?)\s*([kmgt]?)b?", spec, re.I)
    if not m:
        return always()
    x, n = F.coalesce(F.col(size), F.lit(0)), float(m[2]) * 1024 ** _UNITS[m[3].lower()]
    bound = F.lit(int(n) if n == int(n) else n)
    sign = m[1] or "="
    return {">": x > bound, ">=": x >= bound, "<": x < bound, "<=": x <= bound}.get(sign, x == bound)


def parse_query(text: str | None) -> Column:
    """The mini-language: size: type:/category: ext:/extension: deleted: source: path:, all of which must hold; other
    words must all occur in name or path. Case is ignored. An unknown key is a word like any other."""
    found, words = [], []
    for token in (text or "").split():
        key, mark, value = token.partition(":")
        key, value = key.lower(), value.lower()
        if mark and key == "size":
            found.append(size_filter(value))
        elif mark and key in ("type", "category"):
            found.append(low("category") == value)
        elif mark and key in ("ext", "extension"):
            found.append(low("extension") == value)
        elif mark and key == "deleted":
            found.append(F.coalesce(F.col("isDeleted"), F.lit(False)) == F.lit(value in ("yes", "true", "1")))
        elif mark and key in ("source", "path"):
            found.append(low("source" if key == "source" else "originalPath").contains(value))
        else:
            words.append(token.lower())
    if words:
        both = F.concat(low("fileName"), F.lit(" "), low("originalPath"))
        found += [both.contains(w) for w in words]
    return reduce(Column.__and__, found) if found else always()


def path_text(path: str = "originalPath") -> Column:
    return F.translate(low(path), "\\", "/")


def is_system_file(extension: str = "extension", path: str = "originalPath") -> Column:
    """A system extension, or a system prefix at the start of the path or after any slash, unless in the kept old tree."""
    p = path_text(path)
    prefixed = reduce(Column.__or__, [p.startswith(x) | p.contains("/" + x) for x in SYSTEM_PREFIXES])
    return ~p.contains(KEPT_TREE) & (low(extension).isin(*SYSTEM_EXTENSIONS) | prefixed)


def is_high_priority(path: str = "originalPath") -> Column:
    p = path_text(path)
    return p.contains(KEPT_TREE) | p.startswith("users/") | p.contains("/users/")


def filter_files(files: DataFrame, keyword: str = "", categories: Iterable[str] = (), sources: Iterable[str] = (), validity: str = "all", hide_system: bool = False) -> DataFrame:
    """All given conditions hold; an empty set doesn't filter. A keyword with a colon is in the mini-language."""
    out = files
    if hide_system:
        out = out.filter(~is_system_file())
    if categories := list(categories):
        out = out.filter(F.col("category").isin(*categories))
    if sources := list(sources):
        out = out.filter(F.col("source").isin(*sources))
    valid = F.coalesce(F.col("isValid"), F.lit(False))
    if validity in ("valid", "invalid"):
        out = out.filter(valid if validity == "valid" else ~valid)
    keyword = keyword.strip().lower()
    if ":" in keyword:
        out = out.filter(parse_query(keyword))
    elif keyword:
        out = out.filter(low("fileName").contains(keyword) | low("originalPath").contains(keyword))
    return out


def is_recoverable(deleted: str, directory: str, size: str, runs: str, name: str) -> Column:
    """Deleted, no directory, has size, data and a name that isn't a metafile's."""
    n = F.coalesce(F.col(name), F.lit(""))
    return F.col(deleted) & ~F.col(directory) & (F.col(size) > 0) & (F.col(runs) > 0) & (n != "") & ~n.startswith("$")


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression: * and ? don't cross a slash."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif end > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] in "^!" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "^(?:" + "".join(out) + ")$"


def matches_any(name: str, patterns: str) -> Column:
    """A comma list of shell patterns, any of which matches, or whose text after a leading * ends the name; empty: all."""
    found = [p.strip() for p in patterns.split(",") if p.strip()]
    if not found:
        return always()
    one = lambda p: F.col(name).rlike(glob_pattern(p)) | (F.col(name).endswith(p[1:]) if p.startswith("*") else F.lit(False))
    return reduce(Column.__or__, map(one, found))


DELETE_REASON, RENAME_REASON, LOW_48 = 0x200, 0x3000, (1 << 48) - 1


def has_reason(column: str, mask: int) -> Column:
    return F.col(column).bitwiseAND(mask) != 0


def record_number(reference: str) -> Column:
    """The low 48 bits of a file reference."""
    return F.col(reference).bitwiseAND(F.lit(LOW_48))


def state_tab(tab: str, state: str = "state") -> Column:
    """all, success, partial, or failed: neither of the two."""
    s = F.coalesce(F.col(state), F.lit(""))
    return {"all": always(), "success": s == "success", "partial": s == "partial"}.get(tab, ~s.isin("success", "partial"))


def shares_disk(a: str, b: str) -> Column:
    """Whether two arrays of disks overlap: recovering onto the source is refused."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def within_caps(entries: DataFrame, order: list[str], depth: str = "depth", size: str = "size", most: int | None = None, most_bytes: int | None = None, most_depth: int | None = None) -> DataFrame:
    """The entries of a walk that its caps leave, in order: none below most_depth, most of them, and as many as fit in most_bytes.
    The caps are the caller's feature; without them nothing is cut. Of most, only the first ones are sorted on one task."""
    out = entries.filter(F.col(depth) <= most_depth) if most_depth is not None else entries
    out = out.orderBy(*order).limit(most) if most is not None else out
    if most_bytes is None:
        return out
    # totals of ranges first, so that no task sums all
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(out.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    inner = F.sum(size).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(before), "_part").withColumn("_sum", inner + F.col("_before")).filter(F.col("_sum") <= most_bytes).drop("_part", "_before", "_sum")

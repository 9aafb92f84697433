"""Joins of the catalogue. Small sides are left to the planner, which checks their size before it broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import settle


def manifest(records: DataFrame, files: DataFrame, record_key: str, file_key: str) -> DataFrame:
    """records with their file's columns; a record without a file stays."""
    return records.join(files, records[record_key] == files[file_key], "left")


def known_hashes(listed: DataFrame, column: str) -> DataFrame:
    """Distinct lower-case hashes of 64 digits; other lengths are ignored."""
    h = F.lower(F.trim(F.col(column)))
    return listed.select(h.alias("known")).filter(F.length("known") == 64).distinct()


def known(files: DataFrame, listed: DataFrame, hash_column: str, listed_column: str, keep: bool = True) -> DataFrame:
    """Files whose hash is listed (semi join), or isn't (anti join)."""
    hashes = known_hashes(listed, listed_column)
    return files.join(hashes, F.lower(files[hash_column]) == hashes["known"], "left_semi" if keep else "left_anti")


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rows = [F.desc_nulls_last(o) if isinstance(o, str) else o.desc_nulls_last() for o in order]
    w = Window.partitionBy(*keys).orderBy(*rows)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def names_without(events: DataFrame, files: DataFrame, name: str, other: str, seq: str) -> DataFrame:
    """The last event of each name that no file has."""
    last = events.groupBy(name).agg(F.max_by(F.struct(*[c for c in events.columns if c != name]), seq).alias("e")).select(name, "e.*")
    return last.join(files.select(F.col(other).alias("_other")).distinct(), F.col(name) == F.col("_other"), "left_anti")


def pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "inner")


def live_photo_pairs(names: DataFrame, column: str, seq: str) -> DataFrame:
    """(base, still, clip): the base name as it is, the extension in any case, the last name of each base."""
    ext, base = F.lower(F.regexp_extract(column, r"\.([^.]*)$", 1)), F.regexp_replace(column, r"\.[^.]*$", "")
    d = names.select(base.alias("base"), ext.alias("ext"), F.col(column).alias("n"), F.col(seq).alias("s"))
    side = lambda kinds, out: d.filter(F.col("ext").isin(*kinds)).groupBy("base").agg(F.max_by("n", "s").alias(out))
    return side(["heic", "heif"], "still").join(side(["mov"], "clip"), "base")


def range_join(points: DataFrame, ranges: DataFrame, point: str, start: str, length: str, bin_size: int | None = None) -> DataFrame:
    """points within [start, start + length): on bins of bin_size an equi-join, so that both sides shuffle and neither
    is compared with all of the other. Without bin_size the mean length, rounded up, of ranges is taken.
    A range of many bins is a row in each of them."""
    if bin_size is None:
        bin_size = int(ranges.agg(F.ceil(F.avg(length))).first()[0] or 1)
    bin_size = max(1, bin_size)
    p = points.withColumn("_bin", F.expr(f"floor(`{point}` / {bin_size})"))
    r = ranges.filter(F.col(length) > 0).withColumn("_bin", F.explode(F.sequence(F.expr(f"floor(`{start}` / {bin_size})"), F.expr(f"floor((`{start}` + `{length}` - 1) / {bin_size})"))))
    inside = (p[point] >= r[start]) & (p[point] < r[start] + r[length])
    return p.join(r, (p["_bin"] == r["_bin"]) & inside).drop("_bin")


def to_physical(points: DataFrame, chunks: DataFrame, point: str = "logical") -> DataFrame:
    """chunks(start, len, phys): physical = phys + (point - start); a point in no chunk is left out."""
    return range_join(points, chunks, point, "start", "len").withColumn("physical", F.col("phys") + F.col(point) - F.col("start"))


def chunk_catalogue(system: DataFrame, found: DataFrame) -> DataFrame:
    """Both, sorted by start; the system chunk wins where both begin."""
    both = system.withColumn("_p", F.lit(0)).unionByName(found.withColumn("_p", F.lit(1)))
    return first_by(both, ["start"], [F.col("_p")]).drop("_p").orderBy("start")


def as_of(targets: DataFrame, versions: DataFrame, key: str, at: str, version: str, value: list[str]) -> DataFrame:
    """targets(key, at) with the newest version at or before it, null where there is none.

    Both sides go through one shuffle on the key, ordered by time; each target looks back at the last version: no
    pairs are made. Of equal versions the greatest values win.
    """
    v = versions.select(F.col(key).alias("_k"), F.col(version).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(version).alias("version"), *[F.col(x) for x in value]).alias("_v"), F.lit(None).cast(targets.select(F.struct("*")).schema[0].dataType).alias("_row"))
    t = targets.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), F.struct(*targets.columns).alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    got = v.unionByName(t).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return got.select("_row.*", F.col("_last.version").alias(version), *[F.col(f"_last.{x}").alias(x) for x in value])


def rebuild_paths(edges: DataFrame, root: int, most: int, on_orphan: str = "name", lead: str = "", top_down: bool = False) -> DataFrame:
    """(child, path, depth) of edges(child, parent, name), one row per child, by joining steps upwards.

    on_orphan: what becomes of a chain that ends without the root (missing or self parent, a cycle, or more than most steps):
    name keeps the bare name, partial the part that was found, drop nothing. top_down is the same as drop: only what hangs
    from the root. Pointer doubling: k rounds reach 2**k steps, so a chain of most steps takes log2(most) joins; each round
    is written to the shared scratch folder, since it reads the one before twice.
    """
    e = edges.select("child", "parent", "name")
    # a step: from child to `up`, with the names between; finished once up is the root or nothing is above
    s = e.select("child", F.when(F.col("parent") == F.col("child"), F.lit(None)).otherwise(F.col("parent")).alias("up"), F.array("name").alias("names"), F.lit(1).alias("depth"))
    rounds = max(1, most.bit_length())
    open_ = F.col("up").isNotNull() & (F.col("up") != F.lit(root))
    for _ in range(rounds):
        s = settle(s)
        if s.filter(open_).isEmpty():
            break
        o = s.select(F.col("child").alias("_c"), F.col("up").alias("_up"), F.col("names").alias("_names"), F.col("depth").alias("_depth"))
        s = s.join(o, (s["up"] == o["_c"]) & (s["up"] != F.lit(root)), "left")
        on = F.col("_c").isNotNull()
        gone = ~on & (F.col("up") != F.lit(root))  # the parent has no row
        s = s.select(
            "child",
            F.when(on, F.col("_up")).when(gone, F.lit(None)).otherwise(F.col("up")).alias("up"),
            F.when(on, F.concat("_names", "names")).otherwise(F.col("names")).alias("names"),
            F.when(on, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"),
        )
        s = s.withColumn("up", F.when(F.col("depth") > 4 * most, F.lit(None)).otherwise(F.col("up")))
    whole = F.col("up").eqNullSafe(F.lit(root)) & (F.col("depth") <= most)
    path = F.concat(F.lit(lead), F.array_join("names", "/"))
    own = F.element_at("names", -1)
    out = s.withColumn("whole", whole)
    if top_down or on_orphan == "drop":
        return out.filter("whole").select("child", path.alias("path"), "depth")
    rest = own if on_orphan == "name" else path
    return out.select("child", F.when(F.col("whole"), path).otherwise(rest).alias("path"), F.when(F.col("whole"), F.col("depth")).otherwise(F.lit(1 if on_orphan == "name" else None)).alias("depth"))


def file_rows(inodes: DataFrame, names: DataFrame, extents: DataFrame, key: str) -> DataFrame:
    """inodes with their names (inner: a name without an inode is left out) and extents sorted by logical place."""
    runs = extents.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("logical", "physical", "length"))).alias("extents"))
    return names.join(inodes, key).join(runs, key, "left")


def slot_digest(slots: DataFrame, digests: DataFrame) -> DataFrame:
    """slots(slot) with the first digest(digest, slots array) that lists it."""
    listed = digests.select("digest", F.explode("slots").alias("slot")).groupBy("slot").agg(F.min("digest").alias("digest"))
    return slots.join(listed, "slot", "left")


def array_members(blocks: DataFrame) -> DataFrame:
    """blocks(uuid, role, path): members of each array in order of role, and whether a role is missing or taken twice."""
    g = blocks.groupBy("uuid").agg(F.array_sort(F.collect_list(F.struct("role", "path"))).alias("members"), F.max("role").alias("top"), F.countDistinct("role").alias("roles"), F.count(F.lit(1)).alias("n"))
    return g.select("uuid", "members", (F.col("roles") <= F.col("top")).alias("degraded"), (F.col("n") > F.col("roles")).alias("conflict"))

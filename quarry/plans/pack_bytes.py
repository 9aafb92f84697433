"""Queries on texts as bytes: pattern search, footers, containers, entropy, scores, parity, striped arrays."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import aggregates, carving, matching, raid, validate, windows
from quarry.plans.registry import query
from quarry.plans.tables import load
from quarry.runtime import settle
from quarry.sources import blocks, volumes

#: Bytes of patterns that a task holds.
PATTERN_BYTES = 32 << 20
PATTERNS = ("the", "he", "tion", "and the", "ción", "!!")


@query(
    "match_multi_pattern",
    "SELECT doc_id, p AS pattern, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{p}' AS p, unnest(list_filter(range(1, length(text) - {len(p) - 2}), lambda i: text[i:i + {len(p) - 1}] = '{p}')) AS o FROM documents WHERE contains(text, '{p}')" for p in PATTERNS
    )
    + ") GROUP BY doc_id, p",
)
def match_multi_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr("0L").alias("offset"), F.encode("text", "UTF-8").alias("payload"))
    return matching.counts(d, [(p.encode(), p) for p in PATTERNS], keys=("doc_id",)).withColumnRenamed("extension", "pattern")


@query(
    "match_first_header",
    """SELECT page_id, p AS pattern, count(*) AS n FROM (
      SELECT page_id, '<p' AS p, unnest(regexp_extract_all(html, '<p')) FROM pages UNION ALL SELECT page_id, '<a', unnest(regexp_extract_all(html, '<a')) FROM pages) GROUP BY ALL""",
)
def match_first_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "pages").select("page_id", F.expr("0L").alias("offset"), F.encode("html", "UTF-8").alias("payload"))
    found = matching.matches(d, [(p.encode(), p) for p in ("<p", "<p>", "<a href", "<a")], keys=("page_id",))
    return matching.first_headers(found, ("page_id",)).groupBy("page_id", F.col("extension").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query("match_last_footer", "SELECT page_id, CASE WHEN contains(html, '</p>') THEN length(html) - instr(reverse(html), '>p/<') + 1 ELSE 0 END AS size FROM pages")
def match_last_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", matching.last_end(F.col("html"), "</p>").cast("long").alias("size"))


@query(
    "join_contains_benchmark",
    "SELECT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text)",
)
def join_contains_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("part")).filter("part <> ''")
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr("0L").alias("offset"), F.encode("text", "UTF-8").alias("payload"))
    # the passages become patterns of the search, as many at a time as PATTERN_BYTES holds
    size = items.agg(F.coalesce(F.sum(F.octet_length("part")), F.lit(0)).alias("n")).first().n
    slices = max(1, -(-size // PATTERN_BYTES))
    found = []
    for i in range(slices):
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == i).collect()
        found.append(matching.matches(d, [(r.part.encode(), str(r.item_id)) for r in some], keys=("doc_id",)).select("doc_id", F.col("extension").cast("long").alias("item_id")))
    return reduce(DataFrame.unionByName, found).distinct()


@query("filter_ocr_keyword", "SELECT item_id FROM benchmark WHERE contains(lower(trim(text)), 'tion')")
def filter_ocr_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").filter(F.lower(F.trim("text")).contains("tion")).select("item_id")


def _number(x: str, order: str = "big", size: int = 4) -> str:
    """SQL of a whole number as bytes."""
    places = range(size) if order == "little" else range(size - 1, -1, -1)
    return "unhex(concat(" + ", ".join(f"lpad(hex(shiftright(CAST({x} AS BIGINT), {8 * i}) & 255), 2, '0')" for i in places) + "))"


def _bytes(*parts: str | bytes) -> str:
    """SQL of bytes after one another: literal ones, and expressions."""
    return "concat(" + ", ".join(f"X'{p.hex()}'" if isinstance(p, bytes) else p for p in parts) + ")"


_TEXT, _N = "encode(text, 'UTF-8')", "octet_length(encode(text, 'UTF-8'))"
#: Containers around a text: extension, bytes, what they hold.
CONTAINERS = (
    ("riff", _bytes(b"RIFF\0\0\0\0WAVE", _TEXT), "wav", "audio"),
    ("mp4", _bytes(b"\0\0\0\x18ftypheic", _TEXT), "heic", "image"),
    ("ole2", _bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(600) + "Workbook".encode("utf-16-le"), _TEXT), "xls", "document"),
    ("zip", _bytes(b"PK\3\4" + bytes(22) + b"\x08\0\0\0mimetypeapplication/epub+zip", _TEXT), "epub", "document"),
    ("tiff", _bytes(b"II*\0\x10\0\0\0CR\2\0", _TEXT), "cr2", "image"),
    ("jpg", _bytes(b"\xff\xd8", _TEXT), "jpg", "image"),
)
#: Files around a text: extension, bytes, size beyond the text's.
FILES = (
    ("riff", _bytes(b"RIFF", _number(f"{_N} + 4", "little"), b"WAVE", _TEXT), 12),
    ("djvu", _bytes(b"AT&TFORM", _number(_N), _TEXT), 12),
    ("png", _bytes(b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + bytes(17), _number(_N), b"IDAT", _TEXT, bytes(8) + b"IEND\xaeB`\x82"), 57),
    ("bmp", _bytes(b"BM", _number(f"{_N} + 54", "little"), bytes(4) + b"\x36\0\0\0\x28\0\0\0" + bytes(36), _TEXT), 54),
    ("mid", _bytes(b"MThd\0\0\0\6\0\1\0\1\0\x60MTrk", _number(_N), _TEXT), 22),
    ("pdf", _bytes(b"%PDF-1.4\n", _TEXT, b"\n%%EOF"), 15),
)


def _made(kinds: tuple, column: int) -> str:
    """SQL that takes a column of kinds in turn, by doc_id."""
    value = lambda x: x if column == 1 else f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE doc_id % {len(kinds)} " + " ".join(f"WHEN {i} THEN {value(k[column])}" for i, k in enumerate(kinds)) + " END"


def _wrapped(spark: SparkSession, sf_dir: str, kinds: tuple) -> DataFrame:
    return load(spark, sf_dir, "documents").selectExpr("doc_id", "source", f"{_made(kinds, 0)} AS extension", f"{_made(kinds, 1)} AS payload")


@query("classify_container", f"SELECT doc_id, {_made(CONTAINERS, 0)} AS extension, {_made(CONTAINERS, 2)} AS kind, {_made(CONTAINERS, 3)} AS category FROM documents")
def classify_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carving.classified(_wrapped(spark, sf_dir, CONTAINERS)).drop("source")


@query("carve_sizes", f"SELECT doc_id, {_made(FILES, 0)} AS extension, octet_length(encode(text)) + {_made(FILES, 2)} AS size FROM documents")
def carve_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from the files' own structure, with foreign bytes behind them."""
    files = _wrapped(spark, sf_dir, FILES).withColumn("payload", F.expr(f"concat(payload, X'{(bytes([17]) * 40).hex()}')"))
    return carving.sized(files).drop("source")


_STEP = 4096
#: A PDF reaches to the last mark in 500 MB: on one image all of them would end together.
_PLANTED = FILES[:-1]


@query(
    "carve_files",
    f"""WITH f AS (SELECT source, doc_id, {_made(_PLANTED, 0)} AS matched, octet_length(encode(text)) + {_made(_PLANTED, 2)} AS size FROM documents),
    o AS (SELECT *, coalesce(sum((size + {2 * _STEP - 1}) // {_STEP}) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {_STEP} AS "first" FROM f)
    SELECT source AS image, CAST("first" + 7 AS BIGINT) AS "offset", matched, CASE matched WHEN 'riff' THEN 'wav' ELSE matched END AS extension,
    CASE matched WHEN 'riff' THEN 'audio' WHEN 'mid' THEN 'audio' WHEN 'djvu' THEN 'document' ELSE 'image' END AS category, CAST(size AS BIGINT) AS size, 0.7::DOUBLE AS confidence FROM o""",
)
def carve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image per source: files of all documents, seven bytes into their first block, are found again."""
    files = _wrapped(spark, sf_dir, _PLANTED).withColumn("blocks", F.expr(f"(length(payload) + {2 * _STEP - 1}) div {_STEP}"))
    before = F.sum("blocks").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    at = files.withColumn("first", F.coalesce(before, F.lit(0))).withColumn("payload", F.expr(f"concat(X'{(bytes([17]) * 7).hex()}', payload, CAST(repeat('.', CAST(blocks * {_STEP} - length(payload) - 7 AS INT)) AS BINARY))"))
    one = at.select("source", "first", "payload", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("k"))
    image = one.select(F.col("source").alias("image"), ((F.col("first") + F.col("k")) * _STEP).alias("offset"), F.expr(f"substring(payload, CAST(k * {_STEP} + 1 AS INT), {_STEP})").alias("payload"))
    return carving.carve(settle(image), _STEP)


_ENTROPY = """SELECT {key}, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, CAST(sum(n) AS BIGINT) AS length
    FROM (SELECT {key}, ch, count(*) AS n FROM (SELECT {key}, unnest(string_split(t, '')) AS ch FROM ({source})) WHERE ch <> '' GROUP BY ALL) GROUP BY {key}"""


@query("entropy_text", _ENTROPY.format(key="doc_id", source="SELECT doc_id, text AS t FROM documents"))
def entropy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.entropy(load(spark, sf_dir, "documents"), ["doc_id"], "text")


_SAMPLES = "SELECT doc_id, pos, substr(text, CAST(n_chars * pos // 100 AS BIGINT) + 1, 100) AS t FROM documents, (VALUES (25), (50), (75)) p(pos)"


@query(
    "entropy_jump",
    f"""WITH e AS ({_ENTROPY.format(key="doc_id, pos", source=_SAMPLES)}), c AS (SELECT doc_id, pos, entropy, round(entropy - lag(entropy) OVER (PARTITION BY doc_id ORDER BY pos), 6) AS change FROM e)
    SELECT doc_id, pos, entropy, change, coalesce(abs(change) > 0.5, false) AS jump FROM c""",
)
def entropy_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.explode(F.array(F.lit(25), F.lit(50), F.lit(75))).alias("pos"))
    s = d.select("doc_id", "pos", F.expr("substring(text, CAST(n_chars * pos div 100 AS INT) + 1, 100)").alias("t"))
    e = aggregates.entropy(s, ["doc_id", "pos"], "t").select("doc_id", "pos", "entropy")
    return windows.jumps(e, ["doc_id"], ["pos"], "entropy", 0.5)


@query(
    "score_generic",
    """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text))[1:8192], '..')) AS byte FROM documents), n AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL),
    e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM n GROUP BY doc_id),
    s AS (SELECT doc_id, round(0.2 + CASE WHEN bits < 0.5 THEN 0.0 WHEN bits < 3 THEN 0.3 WHEN bits <= 7 THEN 0.5 ELSE 0.4 END, 6)::DOUBLE AS confidence FROM e)
    SELECT doc_id, confidence, confidence >= 0.4 AS valid FROM s""",
)
def score_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.lit("dat").alias("extension"), F.encode("text", "UTF-8").alias("payload"))
    return validate.validated(d).select("doc_id", "confidence", F.col("isValid").alias("valid"))


@query("agg_parity", "SELECT l_orderkey, bit_xor(l_partkey * 65536 + l_suppkey) AS parity FROM lineitem GROUP BY l_orderkey")
def agg_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raid.xor_parity(load(spark, sf_dir, "lineitem").withColumn("w", F.col("l_partkey") * 65536 + F.col("l_suppkey")), "l_orderkey", "w")


_LEVELS = ((0, 3), (1, 2), (5, 4), (6, 5), (10, 4))


@query(
    "raid_locate",
    """WITH s AS (SELECT event_id AS s FROM events), q AS (SELECT s, 4 - (s // 3) % 5 AS p FROM s)
    SELECT 0 AS level, s AS stripe, s % 3 AS disk, s // 3 AS row FROM s UNION ALL SELECT 1, s, 0, s FROM s
    UNION ALL SELECT 5, s, (s % 3) + CASE WHEN s % 3 >= 3 - (s // 3) % 4 THEN 1 ELSE 0 END, s // 3 FROM s
    UNION ALL SELECT 6, s, ((p + 1) % 5 + 1 + s % 3) % 5, s // 3 FROM q UNION ALL SELECT 10, s, s % 2 * 2, s // 2 FROM s""",
)
def raid_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").select(F.col("event_id").alias("stripe"))
    parts = []
    for level, members in _LEVELS:
        disk, row, _ = raid.locate(level, F.col("stripe"), members)
        parts.append(s.select(F.lit(level).alias("level"), "stripe", disk.cast("long").alias("disk"), row.cast("long").alias("row")))
    return reduce(DataFrame.unionByName, parts)


@query(
    "raid_read",
    """SELECT l AS level, row_number() OVER (PARTITION BY l ORDER BY doc_id) - 1 AS stripe, sha256(text) AS sha256 FROM documents, (VALUES (0), (1), (5), (10)) v(l)""",
)
def raid_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as stripes, written to the members of arrays and read back; level 1 and 10 without their first member."""
    n = F.row_number().over(Window.orderBy("doc_id")) - 1
    texts = settle(load(spark, sf_dir, "documents").select(n.cast("long").alias("stripe"), F.encode("text", "UTF-8").alias("payload")))
    count, out = texts.count(), []
    for level, members in _LEVELS:
        if level == 6:
            continue
        disk, row, _ = raid.locate(level, F.col("stripe"), members)
        written = texts.select(disk.cast("long").alias("disk"), row.cast("long").alias("row"), "payload")
        if level in (1, 10):
            written = written.unionByName(written.withColumn("disk", F.col("disk") + 1)).filter("disk > 0")
        read = raid.read_striped(written, level, members, count)
        out.append(read.select(F.lit(level).alias("level"), "stripe", F.sha2("payload", 256).alias("sha256")))
    return reduce(DataFrame.unionByName, out)


@query(
    "raid5_rebuild",
    """WITH d AS (SELECT doc_id // 2 AS row, doc_id % 2 AS place, text FROM documents), r AS (SELECT row, max(octet_length(encode(text))) AS size, 2 - row % 3 AS p FROM d GROUP BY row),
    s AS (SELECT row, size, p, k FROM r, range(2) t(k))
    SELECT s.row, CAST(CASE WHEN k >= p THEN k + 1 ELSE k END AS BIGINT) AS disk, s.size AS size, coalesce(sha256(text), '-') AS sha256 FROM s LEFT JOIN d ON d.row = s.row AND d.place = s.k""",
)
def raid5_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two texts to a row and their parity, on three disks; disk 1 is lost, and its blocks are rebuilt."""
    d = load(spark, sf_dir, "documents").selectExpr("doc_id div 2 AS row", "doc_id % 2 AS place", "encode(text, 'UTF-8') AS payload")
    p = F.lit(2) - F.col("row") % 3
    filled = d.withColumn("size", F.max(F.length("payload")).over(Window.partitionBy("row"))).withColumn("padded", F.expr("CAST(rpad(payload, size, X'00') AS BINARY)"))
    parity = raid.parities(filled.select("row", "place", F.col("padded").alias("payload")), "row", "place", 1)
    data = filled.select("row", F.when(F.col("place") >= p, F.col("place") + 1).otherwise(F.col("place")).alias("disk"), F.col("padded").alias("payload"))
    whole = data.unionByName(parity.select("row", p.alias("disk"), F.col("p0").alias("payload")))
    # a row with one text has a block of zeros
    missing = filled.select("row", "size").distinct().join(data.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max("disk").alias("have")), "row").filter("n = 1")
    other = F.when(F.col("have") == F.when(p == 0, 1).otherwise(0), F.when(p == 2, 1).otherwise(2)).otherwise(F.when(p == 0, 1).otherwise(0))
    whole = whole.unionByName(missing.select("row", other.cast("long").alias("disk"), F.expr("CAST(rpad(X'', size, X'00') AS BINARY)").alias("payload")))
    got = raid.rebuild_rows(whole.filter("disk <> 1"), 5, 3, 0)
    place = F.when(F.col("disk") > p, F.col("disk") - 1).otherwise(F.col("disk"))
    back = got.withColumn("place", place).join(filled.select("row", "place", F.length("payload").alias("own")), ["row", "place"], "left")
    digest = F.when(F.col("own").isNotNull(), F.sha2(F.expr("substring(payload, 1, own)"), 256)).otherwise("-")
    return back.select("row", F.col("disk").cast("long").alias("disk"), F.length("payload").alias("size"), digest.alias("sha256"))


@query("raid6_rebuild", "SELECT doc_id // 3 AS row, doc_id % 3 AS disk, true AS equal FROM documents")
def raid6_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three texts to a stripe row, filled up to one length: two are lost, rebuilt from P and Q, and compared."""
    d = load(spark, sf_dir, "documents").selectExpr("doc_id div 3 AS row", "doc_id % 3 AS disk", "encode(text, 'UTF-8') AS payload")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("disk")
        size = max(map(len, pdf["payload"]))
        cols = [np.frombuffer(b.ljust(size, b"\0"), np.uint8) for b in pdf["payload"]]
        got = raid.rebuild([None if i != 1 else c for i, c in enumerate(cols)], [raid.parity(cols, k) for k in (0, 1)])
        return pd.DataFrame({"row": pdf["row"], "disk": pdf["disk"], "equal": [bool((a == b).all()) for a, b in zip(got, cols)]})

    return d.groupBy("row").applyInPandas(solve, "row long, disk long, equal boolean")


@query("source_text_blocks", "SELECT source AS image, count(*) AS blocks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def source_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks.text_blocks(load(spark, sf_dir, "documents"), F.col("source"), "text")
    return b.groupBy("image").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("payload").cast("long")).alias("bytes"))


@query(
    "cache_counters",
    """WITH a AS (SELECT user_id, event_id AS seq, CAST(floor(value) AS BIGINT) % 12 AS sector FROM events),
    p AS (SELECT *, lag(seq) OVER (PARTITION BY user_id, sector ORDER BY seq) AS before FROM a),
    d AS (SELECT p.user_id, p.seq, p.before, count(DISTINCT o.sector) AS others FROM p LEFT JOIN a o ON o.user_id = p.user_id AND o.seq > p.before AND o.seq < p.seq GROUP BY ALL),
    h AS (SELECT user_id, before IS NOT NULL AND others < 5 AS hit FROM d)
    SELECT user_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE NOT hit) AS puts, greatest(count(*) FILTER (WHERE NOT hit) - 5, 0) AS evictions
    FROM h GROUP BY user_id""",
)
def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("value").cast("long") % 12).alias("sector"))
    return volumes.cache_counters(log, 5, by="user_id")

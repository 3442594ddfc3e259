"""Line dedup: lines that spread over many sites are boilerplate; sketches find them, exact counts settle them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Distinct sites from which a line is boilerplate.
SITES = 10
#: A document of which widespread lines hold this share, in whole numbers, is a copy: its sites don't count.
COPY, OF = 19, 20
#: Shorter lines are never removed.
LEAST_CHARS = 12
#: log2 of a sketch's registers, and the relative error (over three deviations) that calls for exact counts.
REGISTERS = 9
BAND = 0.25
SALTS = 16
_NOBODY = -(1 << 63)


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """(row, id, mark, site, pos, key, size, total): one row for each line long enough.

    row tells rows of docs apart, id and the hash of its text find it again; total is the length of all its lines.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NOBODY)).alias("id"),
        F.xxhash64("text").alias("mark"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("key"), F.length(F.trim(x)).alias("size"))).alias("lines"),
    )
    rows = rows.withColumn("total", F.aggregate("lines", F.lit(0).cast("long"), lambda t, x: t + x["size"]))
    return rows.select("row", "id", "mark", "site", "total", F.posexplode("lines").alias("pos", "line")).where(F.col("line.size") >= LEAST_CHARS).select("row", "id", "mark", "site", "pos", "line.key", "line.size", "total")


def widespread(lines: DataFrame) -> DataFrame:
    """(key): lines on at least SITES distinct sites, exactly.

    One HyperLogLog sketch of sites a line hash merges by aggregation, so a line that a third of all
    documents hold costs a task no more than another. Lines whose estimates leave the outcome open get
    exact distinct counts.
    """
    sketched = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", REGISTERS)).alias("sites"))
    far = materialize(sketched.where(F.col("sites") >= SITES * (1 - BAND)).select("key", (F.col("sites") > SITES * (1 + BAND)).alias("sure")), "spread")
    settled = _on_sites(lines.join(far.where("not sure").select("key"), "key", "left_semi"))
    return far.where("sure").select("key").unionByName(settled)


def _on_sites(lines: DataFrame) -> DataFrame:
    return lines.select("key", "site").distinct().groupBy("key").count().where(F.col("count") >= SITES).select("key")


def _holders(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines with one of the keys; a key of many lines is met by salt."""
    salt = F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS).cast("long"))
    flagged = keys.select("key", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])).alias("salt"))
    return lines.withColumn("salt", salt).join(flagged, ["key", "salt"], "left_semi").drop("salt")


def strip_boilerplate(docs: DataFrame, site: str = "source", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the columns it has, its texts without cross-site boilerplate lines, and two more,
    named by ``counts``: its lines and how many of them were removed.

    A line is what stands between line feeds, compared without the spaces around it. A line of
    LEAST_CHARS or more is widespread if at least SITES distinct sites hold it, and boilerplate if as
    many hold it in documents that aren't copies. A copy is a document of whose characters COPY / OF or
    more are in widespread lines: copies of a document on many sites, edited a little or not, would make
    boilerplate of all its lines, and are left to document dedup. Blocks of lines go whole. All
    occurrences go, in copies too. Null sites are one site; null texts stay null and have no lines; an
    emptied text is empty, not null; repeated rows are treated alike; no rows give none. Columns of docs
    with the names of the counts give way, others stay.
    """
    kept = [c for c in docs.columns if c not in counts]
    lines = materialize(_lines(docs, site), "lines")
    wide = materialize(_holders(lines, widespread(lines)), "wide")
    voters = wide.groupBy("row").agg(F.sum("size").alias("held"), F.first("total").alias("total")).where(F.col("held") * OF < F.col("total") * COPY).select("row")
    found = _on_sites(wide.join(voters, "row", "left_semi"))
    gone = _holders(wide, found).groupBy(F.col("id").alias("_lines_id"), F.col("mark").alias("_lines_mark")).agg(F.collect_set("pos").alias("_lines_gone"))
    match = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NOBODY)) == F.col("_lines_id")) & (F.xxhash64("text") == F.col("_lines_mark"))
    joined = docs.select(*kept).join(gone, match, "left")
    parts = F.split("text", "\n", -1)
    text = F.when(F.col("_lines_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_lines_gone", i)), "\n"))
    count = F.coalesce(F.size(parts), F.lit(0))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(count).cast("long").alias(counts[0]),
        F.when(F.col("_lines_gone").isNull(), 0).otherwise(F.size("_lines_gone")).cast("long").alias(counts[1]),
    )


ORACLE_SQL = f"""
WITH split AS (SELECT doc_id, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, site, pos, trim(parts[pos]) AS line
  FROM (SELECT doc_id, site, parts, unnest(range(1, len(parts) + 1)) AS pos FROM split)),
widespread AS (SELECT line FROM lines WHERE length(line) >= {LEAST_CHARS} GROUP BY line HAVING count(DISTINCT site) >= {SITES}),
voters AS (SELECT l.doc_id FROM lines l LEFT JOIN widespread w ON l.line = w.line GROUP BY l.doc_id
  HAVING sum(CASE WHEN w.line IS NULL THEN 0 ELSE length(l.line) END) * {OF} < sum(length(l.line)) * {COPY}),
boilerplate AS (SELECT l.line FROM lines l JOIN widespread w ON l.line = w.line JOIN voters v ON l.doc_id = v.doc_id
  GROUP BY l.line HAVING count(DISTINCT l.site) >= {SITES}),
judged AS (SELECT l.doc_id, l.pos, b.line IS NOT NULL AS gone, s.parts[l.pos] AS part
  FROM lines l LEFT JOIN boilerplate b ON l.line = b.line JOIN split s ON s.doc_id = l.doc_id)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

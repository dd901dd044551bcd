"""Cross-site line dedup by distinct-site spread (operator 4).

A line is boilerplate when it stands in documents of ``min_sites`` or more
distinct sites.  Every line hash gets a HyperLogLog sketch of its sites; Spark
merges the sketches by aggregation (each task one sketch a line, so a line on
a third of all documents costs a few sketches).  Estimates clearly above or
below the threshold decide; lines whose estimate is within the sketch's error
of it get exact distinct counts.  A boilerplate line stays in the first
document that has it (smallest doc_id; null comes last) and is removed
everywhere else.

DataFrame functions only.  Lines travel as hashes and positions, never as
text; removed positions go back to documents by one join on the document key,
and what lies between them is sliced out, in time linear in the lines.

Defined results: lines are compared trimmed of spaces; lines under
``min_words`` words always stay, which are the blank ones unless a caller asks
for more; null text stays null; a null site is one site; rows of one doc_id
are one document, whatever their texts, and so are rows whose doc_id is null; a
line repeated within its first document stays as often as it stood there; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.llm.common import KEY, SPACE, doc_key
from impressa.sources.sinks import stage

MIN_SITES = 3
MIN_WORDS = 1
LG_K = 10


def line_rows(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """(document key, pos, line, site) hashes for every line long enough to count."""
    word = SPACE.replace("[", "[^")
    enough = f"(?:{word}+{SPACE}+){{{min_words - 1}}}{word}" if min_words > 1 else word
    d = docs.select(*doc_key(), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0"))).alias("site"),
                    F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    return d.where(F.col("l").rlike(enough)).select(*KEY, "pos", "site", F.xxhash64(F.trim("l")).alias("line"))


def boilerplate(rows: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """Hashes of the lines on ``min_sites`` or more distinct sites."""
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    slack = max(1.0, min_sites * 4 * 1.04 / 2 ** (lg_k / 2))
    spread = stage(spread.where(F.col("sites") >= min_sites - slack), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + slack).select("line")
    exact = rows.join(near, "line", "left_semi").groupBy("line", "site").count().groupBy("line").count()
    sure = spread.where(F.col("sites") > min_sites + slack).select("line")
    return sure.unionByName(exact.where(F.col("count") >= min_sites).select("line"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines but those at the sorted positions ``gone``, joined: the slices between them, each taken once."""
    parts = F.array(F.struct(lines.alias("l"), F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines))).alias("p")))

    def joined(x):
        between = F.transform(F.sequence(F.lit(0), F.size(x["p"]) - 2),
                              lambda i: F.slice(x["l"], F.get(x["p"], i) + 2, F.get(x["p"], i + 1) - F.get(x["p"], i) - 1))
        return F.array_join(F.flatten(between), "\n")

    return F.get(F.transform(parts, joined), F.lit(0))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and n_lines, n_removed."""
    rows = stage(line_rows(docs, site, min_words), "line-rows")
    lines = stage(boilerplate(rows, min_sites), "line-boilerplate")
    hits = rows.join(lines, "line", "left_semi")
    doc = F.struct(KEY[1], KEY[0])
    first = stage(hits.groupBy("line").agg(F.min(doc).alias("first")), "line-first")
    gone = (hits.join(first, "line").where(doc != F.col("first"))
            .groupBy(*KEY).agg(F.sort_array(F.collect_set("pos")).alias("__llm_gone")))
    gone = stage(gone, "line-removed")
    lines = F.split("text", "\n")
    out = docs.select("*", *doc_key()).join(gone, KEY, "left")
    cut = F.when(F.col("__llm_gone").isNull(), F.col("text")).otherwise(_without(lines, F.col("__llm_gone")))
    keep = [cut.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*keep, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("__llm_gone"), F.lit(0)).cast("long").alias("n_removed"))


def clean(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` after line dedup, same columns; rows whose whole text went are dropped, n_chars follows the text."""
    out = dedup_lines(docs, **kw)
    changed = F.col("n_removed") > 0
    out = out.where(~(changed & (F.trim("text") == "")))
    cols = [F.when(changed, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
            if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_removed", "text")


#: The same rows in DuckDB SQL: exact spread, and no hashes.  ``{docs}`` is the table.
SQL = r"""
WITH d AS (SELECT *, row_number() OVER () AS rid FROM {docs}),
l AS (SELECT rid, doc_id, text, source, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
             unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL),
c AS (SELECT *, trim(line, ' ') AS k FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT k, min(doc_id) AS first_id FROM c GROUP BY k HAVING count(DISTINCT coalesce(source, chr(1))) >= 3),
g AS (SELECT c.rid, c.pos FROM c JOIN b USING (k) WHERE c.doc_id IS DISTINCT FROM b.first_id),
a AS (SELECT l.rid, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
             count(*) AS n_lines, count(g.pos) AS n_removed
      FROM l LEFT JOIN g ON l.rid = g.rid AND l.pos = g.pos GROUP BY l.rid)
SELECT d.doc_id, coalesce(a.n_lines, 0)::BIGINT AS n_lines, coalesce(a.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.text, '') END AS text
FROM d LEFT JOIN a USING (rid)
"""

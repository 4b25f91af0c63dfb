"""Removal of repeated passages, in DataFrame operations only: by overlapping three-line windows, and by runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

WINDOW = 3
RUN, REACH = 50, 16  # a repeated run of RUN words is always found; every REACH words in a row hold an anchor
MARK = 8  # one word hash in so many is an anchor wherever it stands
SPACES, BLANKS = "\\s+", " \t\n\x0b\f\r"


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _later(rows: DataFrame, name: str) -> DataFrame:
    """_d, _u, _at: of rows (doc_id, _t, at, h1, h2) the sorted places of each text whose hash has an earlier place."""
    first = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "_t", "at")).alias("first"))
    repeated = materialize(first.where("n > 1").select("h1", "h2", "first"), f"repeated-{name}")
    later = rows.join(repeated, ["h1", "h2"]).where(~F.struct("doc_id", "_t", "at").eqNullSafe(F.col("first")))
    places = later.groupBy("doc_id", "_t").agg(F.array_sort(F.collect_set("at")).alias("_at"))
    return materialize(places, f"removed-{name}").withColumnsRenamed({"doc_id": "_d", "_t": "_u"}).hint("merge")  # grows with the data: never broadcast


def _uncovered(units: str, window: int) -> Column:
    """The elements of the array `units` that no window of `window` elements from a place in _at covers."""
    n = F.size("_at")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_at", i - 1) + window)
    end = lambda i: F.when(i == n, F.size(units)).otherwise(F.get("_at", i))
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(units, begin(i) + 1, F.greatest(end(i) - begin(i), F.lit(0)))))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of docs, with repeated passages cut from text, then n_lines and n_removed.

    A passage is a window of `window` consecutive lines; its first occurrence, by doc_id and then by place, stays, and
    every later one is removed. The lines that removed windows cover are merged, so a longer repeated passage goes
    as a whole. Windows are compared by a 128-bit hash of their lines. Lines end at \\n and are compared as they are. A text of fewer
    lines than a window stays; a text whose lines are all covered becomes empty; null stays null with 0 lines.
    Rows with equal doc_id and text are one place and don't remove each other; a null doc_id comes first. Columns of
    docs named n_lines or n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_t"), _lines().alias("l"))
    starts = F.when(F.size("l") >= window, F.sequence(F.lit(0), F.size("l") - window)).otherwise(F.array().cast("array<int>"))
    own = F.transform("l", lambda x: F.xxhash64(x))
    other = F.transform("l", lambda x: F.xxhash64(F.lit(1), x, F.lit(2)))
    rows = rows.select("doc_id", "_t", own.alias("a"), other.alias("b"), starts.alias("s"))
    pair = lambda i: F.struct(F.xxhash64(*[F.get("a", i + j) for j in range(window)]).alias("h1"), F.xxhash64(F.lit(1), *[F.get("b", i + j) for j in range(window)]).alias("h2"))
    # posexplode_outer: of a plain posexplode Spark infers a filter on the array and computes the array again there.
    rows = rows.select("doc_id", "_t", F.posexplode_outer(F.transform("s", pair)).alias("at", "h")).where("at is not null").select("doc_id", "_t", "at", "h.h1", "h.h2")
    places = _later(rows, "windows")

    on = docs["doc_id"].eqNullSafe(places["_d"]) & (F.xxhash64(docs["text"]) == places["_u"])
    out = docs.join(places, on, "left").withColumn("_l", F.when(F.col("text").isNotNull(), _lines()))
    out = out.withColumn("_k", F.when(F.col("_at").isNotNull(), _uncovered("_l", window))).withColumn("n_lines", F.coalesce(F.size("_l"), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines")))
    out = out.withColumn("n_removed", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.size("_l") - F.size("_k")).cast("long"))
    return out.withColumn("text", F.when(F.col("_k").isNull(), F.col("text")).otherwise(F.array_join("_k", "\n"))).select(*docs.columns, "n_lines", "n_removed")


def dedup_passages(docs: DataFrame, run: int = RUN, reach: int = REACH) -> DataFrame:
    """All rows and columns of docs, with repeated runs of words cut from text, then n_words and n_words_removed.

    Words end at white space of any kind, so line breaks play no part. One word in MARK is an anchor, by its hash alone;
    of `reach` words in a row without one, that of least hash (of equal ones the first) is. A passage is the run - reach + 1 words
    from an anchor. So any `run` words that occur again hold a passage whose anchor both places share, and nothing shorter
    than a passage is ever cut. The first passage, by doc_id and then by place, stays, and the words that later ones cover go
    with the white space behind them. Of a repeated run up to reach - 1 words stay at either end. Passages are compared by a
    128-bit hash. Null stays null with 0 words; equal rows, a null doc_id and clashing columns are as in dedup_lines.
    """
    docs = docs.drop("n_words", "n_words_removed")
    size = run - reach + 1
    words = F.split(F.btrim("text", F.lit(BLANKS)), SPACES)
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("_t"), F.transform(words, lambda x: F.xxhash64(x)).alias("a"))
    # Each array is referred to twice or more below, so that Spark doesn't put its expression into the lambdas.
    marked = F.filter(F.transform("a", lambda x, i: F.when(x.bitwiseAND(F.lit(MARK - 1)) == 0, i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "_t", "a", F.concat(F.array(F.lit(-1)), marked, F.array(F.size("a"))).alias("m"))
    gap = lambda x, i: F.when(F.get("m", i + 1) - x > reach, F.sequence(x + 1, F.get("m", i + 1) - reach)).otherwise(F.array().cast("array<int>"))
    windows = F.flatten(F.transform("m", gap))
    rows = rows.select("doc_id", "_t", "a", "m", windows.alias("g"))
    part = lambda i: F.slice("a", i + 1, reach)
    least = F.transform("g", lambda i: (i + F.array_position(part(i), F.array_min(part(i))) - 1).cast("int"))
    rows = rows.select("doc_id", "_t", "a", F.array_distinct(F.concat("m", least)).alias("s"))
    pair = lambda p: F.struct(p.alias("at"), F.xxhash64(F.slice("a", p + 1, size)).alias("h1"), F.xxhash64(F.lit(1), F.slice("a", p + 1, size)).alias("h2"))
    whole = F.filter("s", lambda p: (p >= 0) & (p + size <= F.size("a")))
    rows = rows.select("doc_id", "_t", F.explode_outer(F.transform(whole, pair)).alias("h")).where("h is not null").select("doc_id", "_t", "h.at", "h.h1", "h.h2")
    rows = materialize(rows, "passages")
    places = _later(rows, "passages")
    forget(rows)

    on = docs["doc_id"].eqNullSafe(places["_d"]) & (F.xxhash64(docs["text"]) == places["_u"])
    # Each piece is a word and the white space behind it; what stands before the first word stays.
    body = F.ltrim("text", F.lit(BLANKS))
    lead = F.left("text", F.length("text") - F.length(body))
    out = docs.join(places, on, "left").withColumn("_l", F.when(F.col("_at").isNotNull(), F.split(body, r"(?<=\s)(?=\S)")))
    out = out.withColumn("_k", F.when(F.col("_at").isNotNull(), _uncovered("_l", size)))
    count = F.when(F.col("_l").isNotNull(), F.size("_l")).otherwise(F.when(body == "", F.lit(0)).otherwise(F.size(F.split(F.btrim("text", F.lit(BLANKS)), SPACES))))
    out = out.withColumn("n_words", F.when(F.col("text").isNull(), F.lit(0)).otherwise(count).cast("long"))
    out = out.withColumn("n_words_removed", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.size("_l") - F.size("_k")).cast("long"))
    return out.withColumn("text", F.when(F.col("_k").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join("_k", "")))).select(*docs.columns, "n_words", "n_words_removed")


SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS pos, l FROM l WHERE len(l) >= 3),
h AS (SELECT doc_id, pos, struct_pack(a := l[pos + 1], b := l[pos + 2], c := l[pos + 3]) AS k FROM w),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM h),
c AS (SELECT DISTINCT doc_id, pos + j AS pos FROM f, (SELECT unnest([0, 1, 2]) AS j) WHERE r > 1),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM l),
k AS (SELECT x.doc_id, coalesce(string_agg(line, chr(10) ORDER BY x.pos) FILTER (c.pos IS NULL), '') AS text, count(*) AS n_lines, count(c.pos) AS n_removed
      FROM x LEFT JOIN c USING (doc_id, pos) GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN k USING (doc_id)
"""

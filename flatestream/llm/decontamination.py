"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

An item of q distinct shingles is contained in a document if at least `percent` % of them occur there, so at most
`spare` = q - ceil(q * percent / 100) are missing. Of the item's spare + m least shingle hashes (its bottom MinHash values) a document that
contains it holds at least m. Documents are partitioned by the logarithm of their size: the longer the document, the
more values it must hold (m rises by one every four classes), as a chance hit is likelier there; a document that is too short
for an item is no candidate. So no contained item is lost, and the candidates are then counted exactly on the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A sketch or a table of items of more bytes than this isn't broadcast: the join with the documents is then a shuffle.
BROADCAST_BYTES = 32 << 20
#: Of such a sketch a bitmap with so many bits (32 MiB, whatever the sketch's size) is broadcast: only document hashes that may occur are shuffled.
BITMAP, BITMAP_ROW = 1 << 28, 1 << 15
SKETCH_ROW = 64
CLASSES_PER_HIT = 4


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _starts(words: Column, length: int) -> Column:
    return F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, hashed: Column, length: int) -> Column:
    return F.transform(_starts(words, length), lambda i: F.xxhash64(F.lit(length), *[F.get(hashed, i + j) for j in range(length)]))


def _texts(words: Column, length: int) -> Column:
    return F.transform(_starts(words, length), lambda i: F.array_join(F.slice(words, i + 1, length), " "))


def _bounded(df: DataFrame, row_bytes: Column) -> DataFrame:
    """df, to be broadcast if its measured size allows."""
    size = df.agg(F.sum(row_bytes).alias("size")).first()["size"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _maybe(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """The rows whose hash may occur in the sketch, by a bitmap of its hashes; none that occurs is lost."""
    place = F.pmod(F.col("hash"), F.lit(BITMAP))
    at = {"_row": F.floor(place / BITMAP_ROW), "_bit": F.pmod(place, F.lit(BITMAP_ROW))}
    bits = sketch.select("hash").withColumns(at).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumns(at).join(F.broadcast(bits), "_row")
    return found.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: one row for each item contained in a document.

    Words are runs of bytes other than white space, lower-cased; an item of 1 to k - 1 words is one shingle, sought among
    the documents' runs of as many words. Null, empty and blank texts contain nothing and are contained nowhere. If a
    doc_id or item_id occurs more than once, the pair has the greatest count of its rows. Rows with a null
    doc_id are left out. An empty table on either side gives no rows. Other columns are ignored.
    """
    items = benchmark.select("item_id", _words("text").alias("w")).where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(k)))
    hashed = F.transform("w", lambda w: F.xxhash64(w))
    by_length = [F.when(F.col("length") == n, _hashes(F.col("w"), F.col("h"), n)) for n in range(1, k + 1)]
    texts = [F.when(F.col("length") == n, _texts(F.col("w"), n)) for n in range(1, k + 1)]
    items = items.withColumn("h", hashed).select("item_id", "length", F.array_distinct(F.coalesce(*by_length)).alias("h"), F.array_distinct(F.coalesce(*texts)).alias("s"))
    items = items.withColumn("n_item", F.size("s")).withColumn("need", F.expr(f"(n_item * {percent} + 99) div 100"))
    items = materialize(items.withColumn("spare", F.col("n_item") - F.col("need")), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    most_hits = 1 + 31 // CLASSES_PER_HIT
    sketch = items.select("item_id", "n_item", "need", "spare", F.posexplode(F.slice(F.array_sort("h"), F.lit(1), (F.col("spare") + most_hits).cast("int"))).alias("place", "hash"))
    sketch = materialize(sketch, "sketch")
    held = _bounded(sketch, F.lit(SKETCH_ROW))

    own = docs.select("doc_id", _words("text").alias("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    found = [_hashes(F.col("w"), F.col("h"), n) for n in lengths or [k]]
    own = own.select("doc_id", F.concat(*found).alias("h")).withColumn("n", F.coalesce(F.size("h"), F.lit(0)))
    # explode_outer: of a plain explode Spark infers a filter on the array, pushes it below and computes the array again there.
    # The columns that take part in the join condition can't be null, for the same reason.
    size_class = F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")
    own = own.select("doc_id", "n", F.coalesce(F.lit(1) + F.floor(size_class / CLASSES_PER_HIT), F.lit(1)).alias("hits"), F.explode_outer("h").alias("hash"))
    own = _maybe(own, sketch) if held is sketch else own
    hits = own.join(held, "hash").where((F.col("n") >= F.col("need")) & (F.col("place") < F.col("spare") + F.col("hits")))
    hits = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("place").alias("got"), F.min(F.least("hits", F.col("need"))).alias("hits"))
    pairs = materialize(hits.where(F.col("got") >= F.col("hits")).select("doc_id", "item_id"), "contained")

    wanted = materialize(pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items")), "wanted")
    long = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "items", _words("text").alias("w"))
    long = long.select("doc_id", "items", F.array_distinct(F.concat(*[_texts(F.col("w"), n) for n in lengths or [k]])).alias("d"))
    both = long.select("doc_id", "d", F.explode("items").alias("item_id")).join(_bounded(items.select("item_id", "n_item", "need", "s"), F.octet_length(F.array_join("s", " ")) + 16 * F.size("s") + SKETCH_ROW), "item_id")
    both = both.withColumn("n_shared", F.size(F.array_intersect("d", "s"))).where(F.col("n_shared") >= F.col("need"))
    both = both.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("x"))
    return both.select("doc_id", "item_id", F.col("x.n_item").cast("long").alias("n_item"), F.col("x.n_shared").cast("long").alias("n_shared"), "x.containment")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose text contains no item, with all their columns; each row by its own text, whatever its doc_id, null too."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text"))
    found = contained_items(docs.select(key.alias("doc_id"), "text"), benchmark, k, percent).select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", key).join(materialize(found, "leaks"), "_key", "left_anti").drop("_key")


def sql(k: int = 5, percent: int = 80) -> str:
    words = "list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
items AS (SELECT item_id, least(len(w), {k}) AS n, unnest(list_distinct([array_to_string(w[j:j + least(len(w), {k}) - 1], ' ') FOR j IN range(1, len(w) - least(len(w), {k}) + 2)])) AS s FROM i WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
d AS (SELECT doc_id, {words} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM items),
docs AS (SELECT doc_id, n, unnest(list_distinct([array_to_string(w[j:j + n - 1], ' ') FOR j IN range(1, len(w) - n + 2)])) AS s FROM d, lengths WHERE len(w) >= n),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared * 100 >= n_item * {percent}
"""

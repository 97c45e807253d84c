"""Benchmark decontamination by size-partitioned MinHash containment search.

Only DataFrame operations. An item's sketch is the set of its shingles with the
smallest hashes; each of them is in a document with a probability equal to the
containment of the item in it, however long the document is. Items are
partitioned by size: a class has its own sketch size, the number of sketch
shingles that make a candidate, and the least document it can lie in.
Candidates are verified by the containment of all their shingles.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import stored

#: More sketch rows than this are not broadcast: about 32 bytes each.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``keys``, ``n`` (shingles with repeats) and ``s``: a row for each run of ``size`` words of ``text``, hashed."""
    rows = rows.select(*keys, F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") >= size)
    runs = rows.select(*keys, "h", (F.size("h") - (size - 1)).alias("n"), F.explode(F.sequence(F.lit(0), F.size("h") - size)).alias("i"))
    return runs.select(*keys, "n", F.xxhash64(*(F.get("h", F.col("i") + k) for k in range(size))).alias("s"))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key().alias("k"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _bounded(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """For a join: broadcast if it has at most ``limit`` rows, else Spark shuffles both sides."""
    return F.broadcast(table) if table.count() <= limit else table


def _sketches(items: DataFrame, sketch: int, threshold: float) -> DataFrame:
    """``item_id, m, s, need, least``: the sketch rows of each item, with its class's numbers."""
    size_class = F.floor(F.log2("m")).cast("int")
    wanted = F.least(F.lit(sketch) + 2 * F.col("class"), F.col("m"))
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("s", F.lit(1)), "s")
    ranked = items.withColumn("class", size_class).withColumn("k", wanted).withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("k"))
    # A quarter of the sketch: a text that holds 80 % of an item misses it about once in 10^6.
    need = F.greatest(F.lit(1), F.floor(F.col("k") * (0.3125 * threshold)).cast("int"))
    return ranked.select("item_id", "m", "s", need.alias("need"), F.ceil(F.col("m") * threshold).cast("long").alias("least"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Pairs ``doc_id, item_id, n_shared, n_item, containment`` of at least ``threshold``.

    Containment: the share of an item's distinct shingles of ``shingle`` words
    that the document has. ``docs``: ``doc_id, text``; ``benchmark``: ``item_id,
    text``; other columns are not read. Texts without so many words (null and
    empty ones too) match nothing: fewer words are no evidence of a leak. Rows
    of equal ``doc_id`` and text give one pair, of equal ``doc_id`` and other
    text one each; rows of equal ``item_id`` are one item with the shingles of
    all. An empty table gives no pairs. ``options`` are those of ``_matches``.
    """
    return _matches(docs, benchmark, **options).select("doc_id", "item_id", "n_shared", "n_item", "containment")


def _matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, sketch: int = 16) -> DataFrame:
    """The pairs of ``contaminated`` with the key (k, t) of the text that matches: id and hash."""
    items = _shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), ["item_id"], shingle).select("item_id", "s").distinct()
    items = stored(items.withColumn("m", F.count("*").over(Window.partitionBy("item_id"))), "items")
    sketches = stored(_sketches(items, sketch, threshold), "sketches")
    docs = _keyed(docs)

    hits = _shingles(docs, ["k", "t"], shingle).join(_bounded(sketches), "s").where(F.col("n") >= F.col("least"))
    pairs = hits.groupBy("k", "t", "item_id", "need", "m").agg(F.collect_set("s").alias("found")).where(F.size("found") >= F.col("need"))
    pairs = stored(pairs.select("k", "t", "item_id", "m"), "pairs")

    some = docs.join(_bounded(pairs.select("k", "t").distinct()), ["k", "t"], "left_semi")
    shared = _shingles(some, ["k", "t", "doc_id"], shingle).join(_bounded(items.select("item_id", "s")), "s").select("k", "t", "doc_id", "item_id", "s").distinct()
    counts = shared.groupBy("k", "t", "doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    out = counts.join(pairs, ["k", "t", "item_id"])
    return out.select("k", "t", "doc_id", "item_id", "n_shared", F.col("m").alias("n_item"), (F.col("n_shared") / F.col("m")).alias("containment")).where(F.col("containment") >= threshold)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no item of ``benchmark``.

    Rows are told by ``doc_id`` and text: another text of the same id, or of a
    null one, stays. ``options`` are those of ``contaminated``.
    """
    leaks = stored(_matches(docs, benchmark, **options).select(F.col("k").alias("__k"), F.col("t").alias("__t")).distinct(), "leaks")
    names = docs.columns
    keyed = docs.select("*", _key().alias("__k"), F.xxhash64(F.col("text").cast("string")).alias("__t"))
    return keyed.join(_bounded(leaks), ["__k", "__t"], "left_anti").select(*names)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS p FROM b WHERE len(w) >= 5)),
m AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
s AS (SELECT DISTINCT doc_id, text, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, text, w, unnest(generate_series(1, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
c AS (SELECT doc_id, text, item_id, count(*) AS n_shared FROM s JOIN i USING (s) GROUP BY doc_id, text, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM c JOIN m USING (item_id) WHERE n_shared / n_item >= 0.8
"""

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Size of a document: its words.  Sources in code-point order (null last) have weights
5, 2, 1, repeating, and share the sum of all sizes in proportion; a target stops at
``MOST_EPOCHS`` times its source's size and the excess goes to the others by weight
until none is above.  Whole epochs of a source come first (each document once per
epoch); the fraction that is left is drawn without replacement with the exponential
keys -ln(u) / w, smallest first, where u is an MD5 sum of the id in (0, 1) and w the
document's quality weight: 1 down to 0.25 as more of its words hold symbols.  The
prefix of the order whose middle words lie within the budget is taken, so a source
ends within half a document of its target.

The order isn't sorted as a whole: keys fall in ``BUCKETS`` ranges per source, range
sums give the range where the budget ends, that range is cut in ``BUCKETS`` again in the
same way, and only the range left, a 16-millionth of a source, is sorted.  A document
is taken by comparing its (key, id) with the last one taken of its source.  Sources are
the parameters of a mix: the driver has one row for each, and beyond ``BROADCAST_IDS`` of
them the joins on them are shuffled.

Defined results: null text has size 0; null is a source of its own; rows with the
same key and id (repeated rows) are taken or left together; sources without words
have target 0; an empty table gives an empty table; very long texts take memory in
proportion, as words are counted and never listed; extra columns pass through ``mix``,
whatever their names, but for mix_size and mix_taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, WORD_CLASS, store, uniform

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
BUCKETS = 4096
SEED = "mix"
SYMBOLS = r"[#*$%&|<>]"


def _measured(text: Column) -> tuple[Column, Column]:
    """Words of a text, and its quality weight."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD_CLASS + "+")).cast("long")
    # Without all other characters, a word with symbols is one run of them.
    with_symbols = F.regexp_count(F.regexp_replace(text, r"[^\x20\x09-\x0D#*$%&|<>]+", ""), F.lit(SYMBOLS + "+"))
    return size, F.when(size == 0, 1.0).otherwise(1.0 - 0.75 * with_symbols / size).cast("double")


def _key(doc_id: Column, quality: Column, seed: str) -> Column:
    return -F.log(uniform(doc_id, seed)) / quality


def _bucket(key: Column) -> Column:
    """Range of a key among ``BUCKETS`` squared."""
    return F.floor(F.lit(float(BUCKETS * BUCKETS)) * (1 - F.exp(-key)))


def shares(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """Target of each source: shares by weight of the total, none above ``most`` times its size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    left, total = dict(order), float(sum(n for _, n in order))
    out: dict[str | None, float] = {}
    while left:
        unit = total / sum(weight[s] for s in left)
        full = [s for s, n in left.items() if unit * weight[s] > most * n]
        if not full:
            return out | {s: unit * weight[s] for s in left}
        for s in full:
            out[s] = float(most * left.pop(s))
            total -= out[s]
    return out


def _of_source(df: DataFrame, sources: DataFrame, source: Column, name: str, few: bool, how: str = "inner") -> DataFrame:
    """Adds the row of its source to each row; null is a source."""
    return df.join(F.broadcast(sources) if few else sources, source.eqNullSafe(F.col(name)), how)


def _edge(rows: DataFrame, sources: DataFrame, range_: Column, few: bool) -> DataFrame:
    """``sources`` with ``edge``, the range where the budget ends, and ``before``, the words ahead of it.

    ``rows`` have source, size and the words already ``passed`` before them all.
    """
    sums = rows.groupBy("source", range_.alias("range")).agg(F.sum("size").alias("n"), F.max("passed").alias("passed"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("sofar", F.col("passed") + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    reached = _of_source(sums, sources, F.col("source"), "s", few).where("sofar < rest").groupBy("s").agg(F.max(F.struct("range", "sofar")).alias("e"))
    reached = reached.select(F.col("s").alias("es"), F.col("e.range").alias("edge"), F.col("e.sofar").alias("before"))
    return _of_source(sources.drop("edge", "before"), reached, F.col("s"), "es", few, "left").drop("es")


def plan(docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame, bool]:
    """(documents, sources, whether sources are few).

    documents: id, source, size, key and bucket of every row, stored.  sources: one row for
    each source ``s`` with source_size, target, epochs and the last (key, id) of the fraction.
    """
    size, quality = _measured(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), size.alias("size"), quality.alias("quality"))
    rows = rows.select("id", "source", "size", _key(F.col("id"), F.col("quality"), seed).alias("key")).withColumn("bucket", _bucket(F.col("key")))
    rows = store(rows).df
    # One row per source comes to the driver, as target shares need all of them at once.
    sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    targets, few = shares(sizes), len(sizes) <= BROADCAST_IDS
    table = []
    for s, n in sizes:
        epochs = int(targets[s] // n) if n else 0
        table.append((s, n, targets[s], epochs, targets[s] - epochs * n))
    sources = docs.sparkSession.createDataFrame(table, "s string, source_size long, target double, epochs int, rest double")

    # The range where the budget ends, then the range within it, from the sums of ranges.
    sources = store(_edge(rows.withColumn("passed", F.lit(0)), sources, F.floor(F.col("bucket") / BUCKETS), few)).df
    inside = _of_source(rows, sources, F.col("source"), "s", few).where(F.floor(F.col("bucket") / BUCKETS) == F.col("edge")).withColumn("passed", F.col("before"))
    sources = store(_edge(inside.select("source", "size", "bucket", "passed"), sources, F.col("bucket"), few)).df
    # Sort that range alone; rows with the same key and id count as one.
    inside = _of_source(rows, sources, F.col("source"), "s", few).where("bucket = edge")
    inside = inside.groupBy("s", "rest", "before", "key", "id").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("s").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = inside.withColumn("to", F.sum("n").over(upto) + F.col("before")).where("to - n / 2 < rest")
    last = taken.groupBy("s").agg(F.max(F.struct("key", "id")).alias("last")).withColumnRenamed("s", "ls")
    sources = _of_source(sources, last, F.col("s"), "ls", few, "left").drop("ls", "before", "rest")
    return rows, store(sources).df, few


def _taken(size: Column, key: Column, bucket: Column, doc_id: Column) -> Column:
    last = F.col("last")
    before = (key < last["key"]) | ((key == last["key"]) & F.coalesce(doc_id <= last["id"], doc_id.isNull()))
    extra = F.coalesce(bucket < F.col("edge"), F.lit(False)) | (F.coalesce(bucket == F.col("edge"), F.lit(False)) & F.coalesce(before, F.lit(False)))
    return (size * (F.col("epochs") + extra.cast("int"))).cast("long")


def decisions(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``."""
    rows, sources, few = plan(docs, seed)
    joined = _of_source(rows, sources, F.col("source"), "s", few, "left")
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target", _taken(F.col("size"), F.col("key"), F.col("bucket"), F.col("id")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs`` and ``mix_size``, ``mix_taken``."""
    _, sources, few = plan(docs, seed)
    kept = [c for c in docs.columns if c not in ("mix_size", "mix_taken")]
    size, quality = _measured(F.col("text"))
    # The columns of ``docs`` travel in one, so their names can't clash with others.
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), size.alias("size"), quality.alias("quality"))
    df = df.withColumn("key", _key(F.col("row")["doc_id"], F.col("quality"), seed)).withColumn("bucket", _bucket(F.col("key")))
    df = _of_source(df, sources.select("s", "epochs", "edge", "last"), F.col("row")["source"].cast("string"), "s", few, "left")
    df = df.withColumn("taken", _taken(F.col("size"), F.col("key"), F.col("bucket"), F.col("row")["doc_id"])).where("taken > 0")
    return df.select(*[F.col("row")[c].alias(c) for c in kept], F.col("size").alias("mix_size"), F.col("taken").alias("mix_taken"))

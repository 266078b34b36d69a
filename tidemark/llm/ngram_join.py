"""N-gram Jaccard join: every pair with Jaccard >= 3/4, lossless.

A document is the set of its distinct 5-word shingles (64-bit hashes).  The pigeonhole
runs over shingles in one global order: two sets with Jaccard >= 3/4 share 3/7 of their
sizes' sum, so of either set at most a quarter can come before the first shared
shingle, and the first |A| // 4 + 1 of each are the join keys, in size bands.  Bands are
powers of four; a document within 4/3 of the next band takes part in that one too, so
any two sizes that can match meet in a band.  The p shingles ahead of a key aren't shared
where the key is the first shared one, so a partner has at most (4 |A| - 7 p) / 3
shingles: the row of a key carries that bound, and pairs that break either one's bound
are never made.  Texts with many words of their own (far members of a group of copies)
have their own rare shingles first and thus bounds too small for each other.

The order is by how common a shingle is in the whole corpus, from a count sketch of
``COUNTERS`` cells summed over all documents: common passages come last and hardly
ever become keys.  The order changes only cost; any order is lossless, up to equal
64-bit hashes of different shingles or sets.

The dealt form of the pigeonhole, on segments of the parity bit sketch, isn't used to find
candidates: at 3/4 a segment holds 3.5 shingles, and 64 to 78 % of all pairs of a band of
sf0.01 share one (see the README).  Parity sketches prune the
candidates: the Hamming distance of two sketches never exceeds the symmetric difference.

Equal sets share their 64-bit set hash and count as one class.  Classes that share a
key are first compared with the central class of their keys (a star), verified exactly,
and linked; then the classes that share a key within their bounds and are still in
different components are compared, after the sketches, so no link is lost and a group
of copies costs a pair per member, not all pairs.  Keys that the count sketch calls common
are dealt to ``SALTS`` tasks; whatever is gathered of a key is a partial aggregate.
Components come from rounds of least-neighbour labels with pointer jumps.

Defined results: texts with 1 to 4 words are one shingle; null, empty and blank texts
have no shingles and no links; equal rows are linked; a row with a null doc_id can
link others, and components are named by their least non-null id (null if there is
none); ids may be of any type that can be ordered; very long texts take memory in
proportion; an empty table gives an empty table; extra columns are ignored by
``components`` and pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Stored, blocks, fresh, lowered, mix, shingle_sets, signed, store, tidy, trimmed

COUNTERS = 1 << 22
CHUNKS = 64
SKETCH_BITS = 1 << 16
#: A table of pairs up to this length is broadcast (32 bytes a row).
BROADCAST_PAIRS = 500_000
BAND_BITS = 2
#: A key is common if its cell of the count sketch holds so many, and so many times the average cell.
COMMON_KEY = 1000
COMMON_TIMES = 8
SALTS = 64
#: Classes whose keys a task remembers having sent, so that copies send them once.
REMEMBERED = 200_000
KEYS_SCHEMA = "key long, s long, n int, most int, salt int"


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def set_hash(u: np.ndarray) -> int:
    """64-bit hash of a set of shingles; the order doesn't matter."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.bitwise_xor.reduce(mix(u + np.uint64(1))) + np.sum(mix(u)) + np.uint64(len(u))], dtype=np.uint64)).view(np.int64)[0])


def band_keys(u: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join keys of a set of shingles in every band that it belongs to, with bounds and commonness.

    The bound is the largest set that can match if the key is the first shared one.
    """
    n = len(u)
    own = (n.bit_length() - 1) // BAND_BITS
    bands = [own, own + 1] if 4 * n >= 3 << BAND_BITS * (own + 1) else [own]
    common = counts[(u & np.uint64(len(counts) - 1)).astype(np.int64)]
    need = n // 4 + 1
    rough = common.astype(np.uint64) << np.uint64(44) | u >> np.uint64(20)
    if need < n:
        at = np.flatnonzero(rough <= np.partition(rough, need - 1)[need - 1])
        u, common = u[at], common[at]
    at = np.lexsort((u, common))[:need]
    u, common = u[at], common[at]
    most = (4 * n - 7 * np.arange(len(u))) // 3
    with np.errstate(over="ignore"):
        keys = np.concatenate([mix(u ^ mix(np.array([band + 1], dtype=np.uint64))) for band in bands])
    return keys, np.tile(most, len(bands)), np.tile(common, len(bands))


def parity_sketch(u: np.ndarray) -> np.ndarray:
    """Bits that each shingle flips one of: 1,024, and 4 times more per band from 1,024 shingles on."""
    size = 1024
    while size < SKETCH_BITS and size <= len(u):
        size *= 4
    bit = (mix(u) >> np.uint64(65 - size.bit_length())).astype(np.int64)
    odd = np.bincount(bit, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fingerprints(batches):
    """kind 0: doc_id, n, set hash of each document; kind 1: cells of the count sketch."""
    counts = np.zeros(COUNTERS, dtype=np.int32)
    mask = np.uint64(COUNTERS - 1)
    names = ["kind", "doc_id", "n", "s", "cells"]
    seen, ids = False, None
    for batch in batches:
        n, s, ids = [], [], batch.column(0).type
        for block in map(lowered, blocks(batch.column(1))):
            for u in shingle_sets(block):
                n.append(len(u))
                s.append(set_hash(u) if len(u) else None)
                if len(u):
                    seen = True
                    counts[(u & mask).astype(np.int64)] += 1  # a set hits a cell twice once in a million
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.nulls(len(n), pa.binary())], names=names)
    if seen:
        step = COUNTERS // CHUNKS
        packed = [zlib.compress(np.minimum(counts[k * step : (k + 1) * step], 65535).astype(np.uint16).tobytes(), 1) for k in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(CHUNKS, np.int32)), pa.nulls(CHUNKS, ids or pa.int64()), pa.array(np.arange(CHUNKS)), pa.nulls(CHUNKS, pa.int64()), pa.array(packed, pa.binary())], names=names)


def _add_cells(batches):
    """Sums the cells of each chunk that comes by; a task holds at most one sketch."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(cells), dtype=np.uint16).astype(np.uint32)
            sums[k] = sums[k] + x if k in sums else x
    keys = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([zlib.compress(np.minimum(sums[k], 0xFFFFF).astype(np.uint32).tobytes(), 1) for k in keys], pa.binary())], names=["n", "cells"])


def _corpus_counts(cells: DataFrame) -> np.ndarray:
    """The count sketch of the corpus: at most 16 MB, whatever the corpus."""
    counts = np.zeros(COUNTERS, dtype=np.uint32)
    step = COUNTERS // CHUNKS
    summed = cells.select("n", "cells").repartition(CHUNKS, "n").mapInArrow(trimmed(_add_cells), "n long, cells binary")
    for row in summed.collect():
        counts[row["n"] * step : (row["n"] + 1) * step] = np.frombuffer(zlib.decompress(row["cells"]), dtype=np.uint32)
    return counts


def _keys(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    common_key = max(COMMON_KEY, COMMON_TIMES * float(counts.mean(dtype=np.float64)))

    def emit(batches):
        counts, sent = shared.value, set()
        for batch in batches:
            for block in map(lowered, blocks(batch.column(0))):
                keys, most, common, owners, sizes, lens = [], [], [], [], [], []
                for u in shingle_sets(block):
                    s = set_hash(u) if len(u) else None
                    if s is None or s in sent:
                        continue
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(s)
                    for x, y in zip((keys, most, common), band_keys(u, counts)):
                        x.append(y)
                    owners.append(s)
                    sizes.append(len(u))
                    lens.append(len(keys[-1]))
                if keys:
                    s = np.repeat(np.array(owners, np.int64), lens)
                    salt = np.where(np.concatenate(common) > common_key, s % SALTS, -1)
                    yield pa.RecordBatch.from_arrays(
                        [signed(np.concatenate(keys)), pa.array(s), pa.array(np.repeat(sizes, lens).astype(np.int32)), pa.array(np.concatenate(most).astype(np.int32)), pa.array(salt.astype(np.int32))],
                        names=["key", "s", "n", "most", "salt"],
                    )

    return docs.select("text").mapInArrow(trimmed(emit), KEYS_SCHEMA)


def _sketches(docs: DataFrame) -> DataFrame:
    """s, n and bit sketch of each text given."""

    def emit(batches):
        for batch in batches:
            for block in map(lowered, blocks(batch.column(0))):
                rows = [(set_hash(u), len(u), parity_sketch(u)) for u in shingle_sets(block) if len(u)]
                if rows:
                    s, n, bits = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["s", "n", "bits"])

    return docs.select("text").mapInArrow(trimmed(emit), "s long, n long, bits array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """s and shingles of each text given."""

    def emit(batches):
        for batch in batches:
            for block in map(lowered, blocks(batch.column(0))):
                rows = [(set_hash(u), u.view(np.int64)) for u in shingle_sets(block) if len(u)]
                if rows:
                    s, sets = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["s", "u"])

    return docs.select("text").mapInArrow(trimmed(emit), "s long, u array<long>")


class _Texts:
    """One text for each class: that of its least id, or any text without an id."""

    def __init__(self, narrow: DataFrame, documents: DataFrame, involved: DataFrame):
        tagged = documents.join(_small(involved.withColumnRenamed("s", "c")), F.col("s") == F.col("c"), "left_semi")
        self.narrow = narrow
        self.named = store(tagged.where("doc_id is not null").groupBy("s").agg(F.min("doc_id").alias("id")))
        self.nameless = not tagged.where("doc_id is null").isEmpty()

    def table(self, make, wanted: DataFrame) -> Stored:
        """``make`` of the texts of the classes wanted, one row for each."""
        wanted = _small(wanted.select(F.col("s").alias("c")))
        ids = store(self.named.df.join(wanted, F.col("s") == F.col("c"), "left_semi").select("id").distinct())
        texts = self.narrow.join(_small(ids.df), F.col("doc_id") == F.col("id"), "left_semi")
        if self.nameless:
            texts = texts.unionByName(self.narrow.where("doc_id is null"))
        out = store(make(texts).join(wanted, F.col("s") == F.col("c"), "left_semi"))
        if not out.df.groupBy("s").count().where("count > 1").isEmpty():  # rows that share an id or have none
            out = store(out.df.dropDuplicates(["s"]))
        return out


def _verified(pairs: DataFrame, sketches: DataFrame, texts: _Texts) -> Stored:
    """The pairs (a, b) whose exact Jaccard similarity is at least 3/4.

    Pairs whose sizes or sketches differ too much go first; only the classes of the others
    have their whole sets built, and each set moves once for each of its pairs.
    """
    one, two = (sketches.select(F.col("s").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    # Sketches of two lengths aren't compared; such pairs are verified.
    near = (F.size("bitsa") != F.size("bitsb")) | (7 * differ <= F.col("na") + F.col("nb"))
    close = pairs.select("a", "b").join(two, "b").join(one, "a").where((4 * F.col("na") >= 3 * F.col("nb")) & (4 * F.col("nb") >= 3 * F.col("na")) & near)
    close = store(close.select("a", "b", "na", "nb"))
    wanted = store(close.df.select(F.col("a").alias("s")).union(close.df.select("b")).distinct())
    sets = texts.table(_sets, wanted.df)
    few = close.df.count() <= BROADCAST_PAIRS
    right = sets.df.select(F.col("s").alias("b"), F.col("u").alias("ub")).join(F.broadcast(close.df) if few else close.df, "b")
    centres = close.df.select(F.col("a").alias("c")).distinct()
    left = sets.df.join(F.broadcast(centres) if few else centres, F.col("s") == F.col("c"), "left_semi").select(F.col("s").alias("a"), F.col("u").alias("ua"))
    both = right.join(left, "a").withColumn("i", F.size(F.array_intersect("ua", "ub")))
    out = store(both.where("100 * i >= 75 * (na + nb - i)").select("a", "b"))
    sets.drop()
    close.drop()
    return out


def connected(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(s, root) for every end of an edge: root is the least id that edges lead to.

    Each round takes the least root among a node's neighbours and then jumps from root to
    root; stored tables between rounds keep the plan short and safe from lost executors.
    """
    both = store(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = store(both.df.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "s"))
    while True:
        old = labels.df
        near = both.df.join(old, F.col("b") == F.col("s")).groupBy("a").agg(F.min("root").alias("least"))
        # A root hears of what its members have seen, so whole trees merge in a round.
        seen = store(old.join(near, F.col("s") == F.col("a")).select("s", "root", F.least("root", "least").alias("to")))
        # Stored, as Spark splits a skewed side only of a join of plain shuffles.
        up = store(seen.df.groupBy("root").agg(F.min("to").alias("up")).withColumnRenamed("root", "r"))
        next_roots = seen.df.join(up.df, F.col("root") == F.col("r"), "left").select("s", F.col("root").alias("was"), F.least("to", "up").alias("mid"))
        jump = up.df.select(F.col("r").alias("r2"), F.col("up").alias("up2"))
        moved = store(next_roots.join(jump, F.col("mid") == F.col("r2"), "left").select("s", "was", F.least("mid", F.coalesce("up2", "mid")).alias("root")))
        seen.drop()
        up.drop()
        labels.drop()
        changed = not moved.df.where("root <> was").isEmpty()
        labels = store(moved.df.select("s", "root")) if changed else moved
        if not changed:
            both.drop()
            return labels.df.select("s", "root")
        moved.drop()


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a stored table of ids while it is within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _members(narrow: DataFrame, counts: np.ndarray) -> Stored:
    """(key, s, n, most) of the keys that several classes have, and of all common keys.

    One shuffle; a common key is dealt to ``SALTS`` tasks, and what it has is sorted out later.
    """
    keys = _keys(narrow, counts).withColumns({"lo": F.expr("min(s) over (partition by key, salt)"), "hi": F.expr("max(s) over (partition by key, salt)")})
    return store(keys.where("lo <> hi or salt >= 0").select("key", "s", "n", "most").distinct())


def _star(members: DataFrame) -> DataFrame:
    """(a, b): each class b with the centre that it shares most keys with.

    The centre of a key is the class that meets most others under its keys: of a group
    of near copies, the text that the others come from.
    """
    size = store(members.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    weight = store(members.join(size.df, F.col("key") == F.col("k")).groupBy("s").agg(F.sum("size").alias("weight")))
    weighed = members.join(_small(weight.df.withColumnRenamed("s", "c")), F.col("s") == F.col("c")).select("key", "s", "weight")
    centre = store(weighed.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("weight", "s"))["s"].alias("centre")))
    size.drop()
    shared = members.join(centre.df, F.col("key") == F.col("k")).where("centre <> s").groupBy("s", "centre").count()
    return shared.groupBy("s").agg(F.max_by("centre", F.struct("count", "centre")).alias("a")).select("a", F.col("s").alias("b"))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): the classes of different components that share a key within their bounds."""
    label = store(members.join(roots.withColumnRenamed("s", "c"), F.col("s") == F.col("c"), "left").select("key", "s", "n", "most", F.coalesce("root", "s").alias("root")))
    of_key = store(label.df.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("most").alias("bound")).where("lo <> hi"))
    alive = store(label.df.join(of_key.df, (F.col("key") == F.col("k")) & (F.col("n") <= F.col("bound")) & (F.col("most") >= F.col("least"))).select("key", "s", "n", "most", "root"))
    label.drop()
    of_key.drop()
    one, two = (alive.df.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("s", "n", "most", "root")]) for x in "ab")
    meet = "s_a < s_b and root_a <> root_b and n_a <= most_b and n_b <= most_a"
    out = store(one.join(two, "key").where(meet).select(F.col("s_a").alias("a"), F.col("s_b").alias("b")).distinct())
    alive.drop()
    return out.df


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, roots): doc_id, n, s of each row; (s, root) of each class with a link."""
    narrow = _narrow(docs)
    spark = docs.sparkSession
    kind = dict(narrow.dtypes)["doc_id"]
    prints = store(narrow.mapInArrow(trimmed(_fingerprints), f"kind int, doc_id {kind}, n long, s long, cells binary"))
    rows = prints.df.where("kind = 0").select("doc_id", "n", "s")
    counts = _corpus_counts(prints.df.where("kind = 1"))
    documents = store(rows)
    prints.drop()

    members = _members(narrow, counts)
    tidy(spark)
    if members.df.isEmpty():
        return documents.df, spark.createDataFrame([], "s long, root long")
    involved = store(members.df.select("s").distinct())
    texts = _Texts(narrow, documents.df, involved.df)
    sketches = texts.table(_sketches, involved.df)
    involved.drop()
    star = store(_star(members.df))
    links = _verified(star.df, sketches.df, texts)
    star.drop()
    roots = connected(links.df)
    tidy(spark)
    pairs = _apart(members.df, roots)
    members.drop()
    tidy(spark)
    if not pairs.isEmpty():
        more = _verified(pairs, sketches.df, texts)
        if not more.df.isEmpty():
            links = store(links.df.unionByName(more.df))
            roots = connected(links.df)
    sketches.drop()
    return documents.df, roots


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    documents, roots = classes(docs)
    named = documents.where("s is not null").groupBy("s").agg(F.min("doc_id").alias("least"))
    named = named.join(roots, "s", "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    # Both stored, so that the members of a large component can be split among tasks.
    named = store(named).df
    heads = store(named.groupBy("root").agg(F.min("least").alias("component_id"))).df
    of_class = named.join(heads, "root").select(F.col("s").alias("c"), "component_id")
    joined = documents.join(of_class, F.col("s") == F.col("c"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its least doc_id.

    Rows without shingles or without a doc_id stay; of several rows with the least id of
    their component one stays.
    """
    gone_id, twice_id = fresh(docs, "gone", "twice")
    found = store(components(docs))
    gone = store(found.df.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct())
    again = store(found.df.where("doc_id is not null and n_shingles > 0 and doc_id = component_id").groupBy(F.col("doc_id").alias(twice_id)).count().where("count > 1").drop("count"))
    found.drop()
    kept = docs.join(_small(gone.df), F.col("doc_id") == F.col(gone_id), "left_anti")
    if again.df.isEmpty():
        return kept
    marked = kept.join(_small(again.df), F.col("doc_id") == F.col(twice_id), "left")
    bad = F.col(twice_id).isNotNull()
    return marked.where(~bad).drop(twice_id).unionByName(marked.where(bad).dropDuplicates([twice_id]).drop(twice_id))

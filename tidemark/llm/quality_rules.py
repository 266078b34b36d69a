"""Quality rules: divergence of a document's histograms from language references.

Two histograms are taken of a document: character classes, and the common words of
four languages (each word of the list below, and one cell for all other words).  The
references are the same two histograms summed over the documents of a language that
pass the base rules (null languages under the name ``''``).  A language with at least
``LEAST_WORDS`` words in such documents has a reference of its own; smaller ones, which
would be compared with little but themselves, are compared with the sum over all.  The distance is
Jensen-Shannon's (base 2, 0 to 1).  A document fails the method if either distance is
above its threshold and its text is long enough for the histogram to mean something:
``MIN_CHARS`` characters in words for the classes, ``MIN_WORDS`` words for the common
words.  Shorter texts pass the method.

The threshold of the words is learned.  By chance alone the distance of n words falls
as 1 / sqrt(n), so it is scaled by sqrt(n), with n at most ``LONG_WORDS`` as topics keep
long texts apart from the reference.  The limit of a reference is the median of the
scaled distances of the documents compared with it that pass the base rules and the
classes, and ``SPREAD`` times what the median is above the lowest tenth: texts of
another kind are in the upper half and don't move it unless they are the most.
It is ``LEAST_LIMIT`` at least.

Base rules: fewer than 50 words, or more than half of the words inside 3-word windows
that occur twice or more in the text.

All of it is DataFrame functions.  Windows are compared by their 64-bit hashes within
one text.  Measures are taken in one pass over the texts and stored; references and limits
are tables of one row per language, joined to the measures (broadcast up to
``BROADCAST_LANGUAGES`` rows); the driver holds the sum over all alone.

Defined results: null and empty texts have no words, so they fail the base rules;
repeated rows get equal verdicts; very long texts take time n log n and memory in
proportion; extra columns are ignored by ``verdicts`` and pass through ``keep_good``,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, Stored, let, store, words_of

MIN_BASE_WORDS = 50
MIN_CHARS = 200
MIN_WORDS = 50
CLASS_LIMIT = 0.2
#: Limits of the scaled word distance: 2.6 is passed by 99.8 % of the documents of sf0.1 that pass base rules and classes.
LEAST_LIMIT = 2.6
SPREAD = 3.5
LONG_WORDS = 400
#: Width of the cells in which scaled distances are counted; there are sqrt(LONG_WORDS) / STEP of them at most.
STEP = 0.02
#: Words of a language's base-passing documents from which on it has a reference of its own.
LEAST_WORDS = 2_000
#: References of so many languages are broadcast (about 400 bytes each).
BROADCAST_LANGUAGES = 50_000
#: Weight of the uniform histogram mixed into a reference, against empty cells.
SMOOTHING = 1e-4

# Character classes as Java patterns; two more cells are the letters a-z and the rest.
CHARACTER_CLASSES = {
    "upper": r"[A-Z]+",
    "digit": r"[0-9]+",
    "stop": r"[.,;:'\-]+",
    "symbol": r"[#*$%&<>]+",
    "bar": r"[|]+",
    "wide": r"[^\x00-\x7F]+",
}
# Common words of English, German, French and Spanish.
COMMON_WORDS = ("the of and to in a is that der die und den von zu das mit de la le et les un une que el los en y las por").split()


_CLASS = {name: k for k, name in enumerate(CHARACTER_CLASSES)}
N_CLASSES = len(CHARACTER_CLASSES) + 2
N_CELLS = N_CLASSES + len(COMMON_WORDS) + 1


def _histogram(text: Column, words: Column, solid: Column) -> Column:
    """array<double>: class cells, a cell for each common word, other words.

    ``solid`` is the number of characters in words.
    """
    each = F.array(*[F.lit(w) for w in COMMON_WORDS])

    def classes(rare: Column) -> Column:
        # Characters of a class: what taking the class out shortens the text by.
        taken = [F.length(rare) - F.length(F.regexp_replace(rare, p, "")) for p in CHARACTER_CLASSES.values()]
        rest = F.length(rare)
        for c in taken:
            rest = rest - c
        return F.array(*taken, solid - F.length(rare), rest)

    def common(found: Column) -> Column:
        counts = F.transform(each, lambda x: F.size(found) - F.size(F.array_remove(found, x)))
        return F.concat(counts, F.array(F.size(words) - F.size(found)))

    rare = F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")
    counts = F.concat(let(rare, classes), let(F.filter(words, lambda w: w.isin(*COMMON_WORDS)), common))
    return F.transform(counts, lambda x: x.cast("double"))


def references(measured: DataFrame) -> tuple[DataFrame, list[float]]:
    """(lang, h) of the languages with a reference, stored, and the sum over all; each histogram scaled to 1."""
    cells = measured.where(~_base_failed()).select("lang", F.posexplode("m.h").alias("k", "x"))
    sums = store(cells.groupBy("lang", "k").agg(F.sum("x").alias("x")))
    of_lang = sums.df.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x")))["x"].alias("h"))
    own = store(of_lang.where(_sum(F.slice("h", N_CLASSES + 1, N_CELLS - N_CLASSES)) >= LEAST_WORDS).select("lang", _scaled_column("h").alias("h")))
    every = {r["k"]: r["x"] for r in sums.df.groupBy("k").agg(F.sum("x").alias("x")).collect()}
    sums.drop()
    return own.df, _scaled([every.get(k, 0.0) for k in range(N_CELLS)])


def _sum(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)


def _scaled_column(h: str) -> Column:
    def part(first: int, size: int) -> Column:
        cells = F.slice(h, first + 1, size)
        share = lambda total: F.transform(cells, lambda x: (1 - SMOOTHING) * F.when(total > 0, x / total).otherwise(1 / size) + SMOOTHING / size)
        return let(_sum(cells), share)

    return F.concat(part(0, N_CLASSES), part(N_CLASSES, N_CELLS - N_CLASSES))


def _scaled(h: list[float]) -> list[float]:
    out = []
    for part in (h[:N_CLASSES], h[N_CLASSES:]):
        total = sum(part)
        out += [(1 - SMOOTHING) * (x / total if total else 1 / len(part)) + SMOOTHING / len(part) for x in part]
    return out


def _distance(h: Column, reference: Column, first: int, size: int) -> Column:
    """Jensen-Shannon distance of cells [first, first + size) of h from the reference."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def cell(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return (term(p, m) + term(q, m)) / 2

    def of(part: Column, total: Column) -> Column:
        js = F.aggregate(F.zip_with(F.transform(part, lambda x: x / total), F.slice(reference, first + 1, size), cell), F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.sqrt(F.greatest(js, F.lit(0.0)))).otherwise(0.0)

    return let(F.slice(h, first + 1, size), lambda part: let(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), lambda total: of(part, total)))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds repeat: words in 3-word windows that occur twice or more in words.

    Windows are hashed; hashes that come back are those that equal their neighbour in
    sorted order, and the words covered by windows at positions p are 3, or the step
    from the last p.  Each step is a projection that names the last one's columns more
    than once, which keeps the optimiser from merging them and computing them again.
    """
    get, size = F.get, F.size
    none = F.expr("cast(array() as array<bigint>)")
    windows = F.when(size("words") >= 3, F.transform(F.sequence(F.lit(0), size("words") - 3), lambda i: F.xxhash64(get("words", i), get("words", i + 1), get("words", i + 2)))).otherwise(none)
    df = df.withColumn("win", windows)
    df = df.withColumns({"sorted": F.sort_array("win"), "fresh": size("win") - size(F.array_distinct("win"))})
    df = df.withColumn("twice", F.when(F.col("fresh") > 0, F.array_distinct(F.filter("sorted", lambda x, i: F.coalesce(get("sorted", i - 1) == x, F.lit(False))))).otherwise(none))

    def sorted_positions(win: Column) -> Column:
        def again(pairs: Column) -> Column:
            near = lambda z, j: F.coalesce(get(pairs, j - 1)["x"] == z["x"], F.lit(False)) | F.coalesce(get(pairs, j + 1)["x"] == z["x"], F.lit(False))
            return F.sort_array(F.transform(F.filter(pairs, near), lambda z: z["i"]))

        return let(F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), again)

    few = F.filter(F.transform("win", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda i: i.isNotNull())
    nowhere = F.expr("cast(array() as array<int>)")
    at = F.when(size("twice") == 0, nowhere).when(size("twice") <= 16, few).otherwise(sorted_positions(F.col("win")))
    steps = lambda at: F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(get(at, j + 1) - p, F.lit(3))))
    df = df.withColumn("repeat", F.aggregate(let(at, steps), F.lit(0), lambda a, x: a + x).cast("long"))
    return df.drop("win", "sorted", "fresh", "twice")


def _base_failed() -> Column:
    return (F.col("m.n_words") < MIN_BASE_WORDS) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))


def measure(docs: DataFrame, *keep: str) -> Stored:
    """The named columns of ``docs`` as one column ``row``, with lang and the measures m, stored."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    df = _with_repeats(df.withColumn("solid", F.length(F.array_join("words", ""))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CLASS))
    m = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.col("solid").cast("long").alias("word_chars"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.col("repeat").alias("n_repeat_words"),
        _histogram(F.col("text"), F.col("words"), F.col("solid")).alias("h"),
    )
    return store(df.select("row", "lang", m.alias("m")))


def _odd_classes() -> Column:
    return (F.col("m.word_chars") >= MIN_CHARS) & (F.col("d.c") > CLASS_LIMIT)


def _scaled_word_distance() -> Column:
    return F.col("d.w") * F.sqrt(F.least(F.col("m.n_words"), F.lit(LONG_WORDS)))


def word_limits(compared: DataFrame) -> DataFrame:
    """(ref, most): limit of the scaled word distance of each reference (null: the sum over all)."""
    good = compared.where(~_base_failed() & ~_odd_classes() & (F.col("m.n_words") >= MIN_WORDS))
    # Counts of cells, so neither the order of rows nor the number of documents matters.
    cells = good.groupBy("ref", F.ceil(_scaled_word_distance() / STEP).cast("int").alias("cell")).count()
    found = cells.groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("cell", "count"))).alias("cells"), F.sum("count").alias("total"))

    def quantile(q: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("cell"))
        step = lambda a, x: F.struct((a["seen"] + x["count"]).alias("seen"), F.coalesce(a["cell"], F.when(a["seen"] + x["count"] >= q * F.col("total"), x["cell"])).alias("cell"))
        return F.aggregate("cells", start, step)["cell"] * STEP

    found = found.withColumns({"low": quantile(0.1), "middle": quantile(0.5)})
    return found.select("ref", F.greatest(F.lit(LEAST_LIMIT), F.col("middle") + SPREAD * (F.col("middle") - F.col("low"))).alias("most"))


def judge(measured: DataFrame) -> DataFrame:
    """Adds the distances d (c, w), base_failed and kept."""
    own, general = references(measured)
    few = own.count() <= BROADCAST_LANGUAGES
    hint = F.broadcast if few else (lambda df: df)
    df = measured.join(hint(own.select(F.col("lang").alias("ref"), F.col("h").alias("own"))), F.col("lang") == F.col("ref"), "left")
    reference = F.coalesce("own", F.array(*[F.lit(x) for x in general]))
    distances = lambda z: F.struct(_distance(z["h"], z["r"], 0, N_CLASSES).alias("c"), _distance(z["h"], z["r"], N_CLASSES, N_CELLS - N_CLASSES).alias("w"))
    df = df.withColumn("d", let(F.struct(F.col("m.h").alias("h"), reference.alias("r")), distances)).drop("own")
    limits = store(word_limits(df)).df.select(F.col("ref").alias("of"), "most")
    df = df.join(hint(limits), F.col("ref").eqNullSafe(F.col("of")), "left")
    odd_words = (F.col("m.n_words") >= MIN_WORDS) & (_scaled_word_distance() > F.coalesce(F.col("most"), F.lit(LEAST_LIMIT)))
    return df.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~(_odd_classes() | odd_words))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the two distances, for every row."""
    symbols = F.col("m.h")[_CLASS["symbol"]] + F.col("m.h")[_CLASS["bar"]]
    return judge(measure(docs, "doc_id").df).select(
        "row.doc_id",
        "m.n_words",
        "m.word_chars",
        symbols.cast("long").alias("n_symbols"),
        "m.n_dup_lines",
        "m.n_repeat_words",
        "base_failed",
        "kept",
        F.col("d.c").alias("class_distance"),
        F.col("d.w").alias("word_distance"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass every rule, with the columns they came with."""
    return judge(measure(docs, *docs.columns).df).where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])

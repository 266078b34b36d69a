"""Language identification: scripts narrow the candidates, Viterbi labels the words.

Words here are runs of ASCII letters and of bytes above 127, lower-cased (A-Z).  A
word's score under a language is the sum of log probabilities of its byte trigrams
(space at either end), hashed to ``BUCKETS`` cells and smoothed.  The script of its
first letter narrows the candidates to the languages that use that script for at
least one word in 200.  A path through the words may change language at ``SWITCH``
nats each time; the best path labels spans.  A document's language is the label of
most words (ties: the path's better total, then the name).

Most texts need no search: if no run of words gains ``SWITCH`` nats against the best
single language, that language is the best path.  The others go through Viterbi
together, one word of each at a time.

Training takes whole texts of a bounded sample: for every value of ``lang``, about
``SAMPLE_DOCS`` documents picked by a hash of the id (all, where there are fewer).
Counts are summed per language; tasks pass on what they have when they hold tables of
``HELD_TABLES`` languages.  The model is a table of ``BUCKETS`` numbers (128 KB) per
language on the driver and each executor: it grows with the languages, not with the documents.

Defined results: a text that is null, empty or has no letter is ``und`` with score 0
(also every text, if there is nothing to learn from); repeated rows get equal
results; ids may be of any type, a null doc_id is predicted like any other; very long
texts take time and memory in proportion; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Block, blocks, lowered, trimmed

BUCKETS = 1 << 15
HELD_TABLES = 256
SAMPLE_DOCS = 4000
SWITCH = 14.0
SMOOTHING = 0.5
SCRIPT_SHARE = 0.005
VITERBI_WORDS = 2_000_000

# First code points of script ranges (a rough cut of the Unicode blocks), in order.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])

LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[128:] = True


def _first_scripts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of the code point that begins at each start."""
    at = lambda k: buf[np.minimum(starts + k, len(buf) - 1)].astype(np.int64)
    b0, b1, b2, b3 = at(0), at(1) & 63, at(2) & 63, at(3) & 63
    point = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
    return _SCRIPT_OF[np.searchsorted(_STARTS, point, side="right") - 1]


def _trigrams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each letter, first letter of each word, starts, ends) of a lowered block."""
    inside = LETTER[block.buf]
    starts, ends = block.edges(inside)
    if not len(starts):
        return np.zeros(0, np.int64), starts, starts, ends
    x = np.where(inside, block.buf, 32).astype(np.uint32)
    before, after = np.full_like(x, 32), np.full_like(x, 32)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts], after[ends - 1] = 32, 32
    cell = (before | x << 8 | after << 16) * np.uint32(0x9E3779B1) >> np.uint32(17)
    lens = ends - starts
    return cell[inside].astype(np.int64), np.cumsum(lens) - lens, starts, ends


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed

    def emissions(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words x languages, starts, ends); -1e4 under languages that the script rules out."""
        cells, first, starts, ends = _trigrams(block)
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32), starts, ends
        scores = np.add.reduceat(self.table[cells], first, axis=0)
        fits = self.allowed[_first_scripts(block.buf, starts)]
        scores[~fits & fits.any(axis=1, keepdims=True)] = -1e4
        return scores, starts, ends


def viterbi(emissions: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best label paths of several word sequences, one word of each at a time."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lens = np.array([len(emissions[i]) for i in order])
    base = np.concatenate(([0], np.cumsum(lens)))[:-1]
    every = np.concatenate([emissions[i] for i in order])
    width = every.shape[1]
    stay = np.ones((len(every), width), dtype=bool)
    jump = np.zeros(len(every), dtype=np.int16)
    value = every[base].astype(np.float64)
    last = np.empty(len(order), dtype=np.int64)
    # Sequences longer than t, for every t: the first so many of the order.
    longer = len(lens) - np.searchsorted(lens[::-1], np.arange(int(lens[0]) + 1), side="right")
    active = len(order)
    for t in range(1, int(lens[0]) + 1):
        still = int(longer[t])
        if still < active:
            last[still:active] = value[still:active].argmax(axis=1)
            active = still
        if not active:
            break
        at = base[:active] + t
        v = value[:active]
        top = v.argmax(axis=1)
        moved = v[np.arange(active), top][:, None] - switch
        stay[at] = v >= moved
        jump[at] = top
        value[:active] = np.maximum(v, moved) + every[at]
    now = last.copy()
    flat = np.empty(len(every), dtype=np.int64)
    for t in range(int(lens[0]) - 1, -1, -1):
        active = int(longer[t])
        at = base[:active] + t
        flat[at] = now[:active]
        if t:
            keep = stay[at, now[:active]]
            now[:active] = np.where(keep, now[:active], jump[at])
    back: list[np.ndarray] = [np.zeros(0, np.int64)] * len(order)
    for k, i in enumerate(order):
        back[i] = flat[base[k] : base[k] + lens[k]]
    return back


def _single(e: np.ndarray, switch: float) -> int | None:
    """The language that is the whole best path, if a bound can tell."""
    best = int(e.sum(axis=0, dtype=np.float64).argmax())
    if e.shape[1] == 1:
        return best
    own = e[:, best].copy()
    e[:, best] = -np.inf
    gain = np.cumsum(e.max(axis=1) - own, dtype=np.float64)
    e[:, best] = own
    low = np.minimum.accumulate(np.concatenate(([0.0], gain[:-1])))
    return best if (gain - low).max() < switch else None


def label_blocks(column: pa.Array, model: Model, block_bytes: int):
    """Yields (document index, labels or one label, starts, ends, block) of documents with words."""
    waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, Block]] = []
    held = 0

    def search():
        for (i, _, starts, ends, block), path in zip(waiting, viterbi([w[1] for w in waiting]) if waiting else []):
            yield i, path, starts, ends, block

    for block in map(lowered, blocks(column, block_bytes)):
        e, starts, ends = model.emissions(block)
        cuts = block.bounds(starts)
        for k in range(block.docs):
            a, b = int(cuts[k]), int(cuts[k + 1])
            if a == b:
                continue
            one = _single(e[a:b], SWITCH)
            if one is not None:
                yield block.first + k, one, starts[a:b], ends[a:b], block
            else:
                waiting.append((block.first + k, e[a:b].copy(), starts[a:b], ends[a:b], block))
                held += b - a
        if held * len(model.langs) > 4 * VITERBI_WORDS:
            yield from search()
            waiting, held = [], 0
    yield from search()


def _sample(train: DataFrame) -> tuple[list[str], DataFrame]:
    sizes = train.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return [], train
    parts = train.sparkSession.createDataFrame([(r["lang"], int(min(1.0, SAMPLE_DOCS / r["count"]) * 1_000_000)) for r in sizes], "l string, part int")
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1_000_000))
    return langs, train.join(F.broadcast(parts), F.col("lang") == F.col("l")).where(chance < F.col("part"))


def fit(docs: DataFrame, usable: Column | None = None) -> Model | None:
    """Learns from the rows of ``docs`` with a language (and ``usable`` true)."""
    train = docs.where(usable) if usable is not None else docs
    train = train.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    langs, picked = _sample(train)
    if not langs:
        return None
    place = {x: k for k, x in enumerate(langs)}
    cells = BUCKETS + len(_NAMES)

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            owner = np.array([place[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for block in map(lowered, blocks(batch.column(0))):
                found, first, starts, _ = _trigrams(block)
                scripts = _first_scripts(block.buf, starts) if len(starts) else starts
                cuts = block.bounds(starts)
                letters = np.append(first, len(found))
                for k in range(block.docs):
                    a, b = int(cuts[k]), int(cuts[k + 1])
                    if a < b:
                        if len(sums) >= HELD_TABLES and int(owner[block.first + k]) not in sums:
                            yield _packed(sums)
                            sums.clear()
                        x = sums.setdefault(int(owner[block.first + k]), np.zeros(cells, np.int64))
                        x[:BUCKETS] += np.bincount(found[letters[a] : letters[b]], minlength=BUCKETS)
                        x[BUCKETS:] += np.bincount(scripts[a:b], minlength=len(_NAMES))
        yield _packed(sums)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(x), dtype=np.int64)
        yield _packed(sums)

    schema = "k int, cells binary"
    summed = picked.select("text", "lang").mapInArrow(trimmed(count), schema).repartition(min(len(langs), 16), "k").mapInArrow(trimmed(add), schema)
    counts = np.zeros((len(langs), cells))
    for row in summed.collect():
        counts[row["k"]] += np.frombuffer(zlib.decompress(row["cells"]), dtype=np.int64)
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(langs, np.ascontiguousarray(logs.T.astype(np.float32)), np.ascontiguousarray((share >= SCRIPT_SHARE).T))


def _packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    keys = sorted(sums)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([zlib.compress(sums[k].tobytes(), 1) for k in keys], pa.binary())], names=["k", "cells"])


def _has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def _spans(labels: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: Block, i: int, langs: list[str]) -> list[dict]:
    """Runs of equal labels, in characters of the text."""
    k = i - block.first
    lo, hi = int(block.offsets[k]), int(block.offsets[k + 1])
    chars = np.concatenate(([0], np.cumsum((block.buf[lo:hi] & 0xC0) != 0x80)))
    cut = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
    stop = np.append(cut[1:], len(labels)) - 1
    return [{"start": int(chars[starts[a] - lo]), "stop": int(chars[ends[b] - lo]), "lang": langs[labels[a]]} for a, b in zip(cut, stop)]


def predict(docs: DataFrame, model: Model | None, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (share of words under that label), and the spans if asked for."""
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score, found = ["und"] * n, [0.0] * n, [[] for _ in range(n)]
            if model is not None:
                for i, labels, starts, ends, block in label_blocks(batch.column(1), model, max(1 << 16, (1 << 22) // len(model.langs))):
                    k = i - block.first
                    raw = block.buf[block.offsets[k] : block.offsets[k + 1]]
                    if not ((raw >= 97) & (raw <= 122)).any() and not _has_letter(raw.tobytes()):
                        continue
                    if isinstance(labels, int):
                        lang[i], score[i] = model.langs[labels], 1.0
                        labels = np.full(len(starts), labels) if spans else None
                    else:
                        votes = np.bincount(labels, minlength=len(model.langs))
                        lang[i], score[i] = model.langs[int(votes.argmax())], float(votes.max() / votes.sum())
                    if spans:
                        found[i] = _spans(labels, starts, ends, block, i, model.langs)
            out = [batch.column(0), pa.array(lang), pa.array(score, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                out, names = [*out, pa.array(found, kind)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {dict(narrow.dtypes)['doc_id']}, lang_pred string, score double"
    return narrow.mapInArrow(trimmed(run), schema + (", spans array<struct<start: int, stop: int, lang: string>>" if spans else ""))

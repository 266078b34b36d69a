"""LM scoring: a log-bilinear model trained with noise-contrastive estimation.

Tokens of a text are its words with A-Z lower-cased, and one end.  Their counts over
all training texts are gathered in a table (one row per word), which grows with the
corpus.  The ``HEAD`` most frequent words go to every executor; all other words of a
document meet their counts in a join on the word, none of which is frequent.

Every word of the head that training texts have ``LEAST_SEEN`` times has vectors of its
own, so the neural vocabulary grows with the corpus.  Prediction takes two levels.  Of the first
level are the ``VOCAB`` most frequent words, the end, ``GROUPS`` groups of the other words with
vectors (in order of frequency, cut at equal steps of the sum of the roots of their
counts), and ``BUCKETS`` classes of the words without, by their last two bytes.  The second
level is the word within its group.  A context of two entries of the first level predicts with
one vector h = C1 r[h1] + C2 r[h2] on both levels: score(w | h) = h . q[w] + b[w].
Training is one pass over all training texts in each of ``ROUNDS`` rounds: every partition runs
stochastic gradient steps of NCE in numpy, on the first level with noise shared by a batch (the unigram
distribution), within a group with ``NEAR_NOISE`` of its words; parameters
are averaged, weighted by tokens (a word's vectors within its group by its steps).  Scores are exact log probabilities: batched
matrix products give the normaliser of each pair of context entries once per worker, and that
of a token's group for each token.  Within a class, a word has its smoothed share of the class's
training tokens.

Steps are seeded by the texts of a task and averaged
over tasks, so the model, and in a small way the scores, depend on how the table is
dealt to tasks; the same files give the same model.

Base score: sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens.

Defined results: a null text counts as empty (its one token is the end); rows with a
null doc_id or with equal ids each get their own scores; ids may be of any type; very long
texts take time and memory in proportion; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store, trimmed

HEAD = 60_000
VOCAB = 400
BUCKETS = 64
GROUPS = 256
LEAST_SEEN = 30
SIZE = 16
BATCH = 4096
NOISE = 24
NEAR_NOISE = 4
RATE = 0.2
NEAR_RATE = 0.1
ROUNDS = 1
FLUSH = 300_000
#: Parameters that one task averages, and that the driver gets at most.
FAN = 16
#: Tokens whose groups are normalised at once.
NEAR_BATCH = 1 << 14
_END = VOCAB
_GROUP = VOCAB + 1 + BUCKETS  # the first group's entry
_START = _GROUP + GROUPS  # context before the first token; never predicted
WORDS = _START  # entries of the first level that can be predicted
FIRST_NEAR = _START + 1  # code of the first word of a group; smaller codes are entries


def tokens(raw: bytes | None) -> list[bytes]:
    """Words of a text; bytes.split cuts at exactly the six ASCII white-space characters."""
    return raw.lower().split() if raw else []


def bucket(word: bytes) -> int:
    return (word[-1] * 31 + (word[-2] if len(word) > 1 else 7)) % BUCKETS


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


class Codes(dict):
    """Word -> code of a model, looked up once for each word."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.model.code(word)
        return found


def _slices(batch: pa.RecordBatch, k: int, bytes_held: int = 4 << 20):
    """Row ranges of a batch with about so many bytes of text each."""
    lens = np.cumsum([len(x) if x is not None else 0 for x in _raw(batch.column(k))]) if batch.num_rows else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(lens, (lens[at - 1] if at else 0) + bytes_held, side="right"))
        to = max(at + 1, to)
        yield at, min(to, batch.num_rows)
        at = to


def _count(batches):
    """(word, b, n) partial counts; b is the word's bucket.  The end is the empty word."""
    held: Counter[bytes] = Counter()

    def flush():
        words = list(held)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([bucket(w) if w else -1 for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["word", "b", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in _raw(batch.column(0)):
            held.update(tokens(text))
            if len(held) > FLUSH:
                yield flush()
        held[b""] += batch.num_rows
        yield flush() if len(held) > FLUSH else flush_empty()
    yield flush()


def flush_empty() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], pa.binary()), pa.array([], pa.int32()), pa.array([], pa.int64())], names=["word", "b", "n"])


def with_vectors(head: list[tuple[bytes, int]]) -> int:
    """Number of the head's words that have vectors of their own."""
    return max(min(VOCAB, len(head)), sum(n >= LEAST_SEEN for _, n in head))


class Model:
    """Head counts, parameters and, on first use, normalisers."""

    def __init__(self, head: list[tuple[bytes, int]], end: int, total: int, distinct: int, bucket_tokens: np.ndarray, bucket_words: np.ndarray):
        self.counts = {w: n for w, n in head}
        near = np.array([n for _, n in head[VOCAB : with_vectors(head)]], dtype=np.float64)
        self.codes = {w: k if k < VOCAB else FIRST_NEAR + k - VOCAB for k, (w, _) in enumerate(head[: with_vectors(head)])}
        roots = np.cumsum(np.sqrt(near))
        self.group = np.minimum(GROUPS - 1, GROUPS * (roots - np.sqrt(near)) / roots[-1]).astype(np.int64) if len(near) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.group, np.arange(GROUPS + 1))
        self.entries = np.concatenate((np.arange(FIRST_NEAR), _GROUP + self.group))  # code -> entry
        self.sums = np.concatenate(([0.0], np.cumsum(near)))
        mass = np.diff(self.sums[self.first])
        self.near_bias = np.log(near / mass[self.group]).astype(np.float32) if len(near) else np.zeros(0, np.float32)
        self.near_noise = self.near_bias + np.float32(np.log(NEAR_NOISE))
        self.near_q = np.zeros((len(near), SIZE), dtype=np.float32)
        self.end, self.total, self.distinct = end, total, distinct
        self.bucket_tokens, self.bucket_words = bucket_tokens, bucket_words
        unigram = np.full(WORDS, 0.5)
        for k, (_, n) in enumerate(head[:VOCAB]):
            unigram[k] += n
        unigram[_END] += end
        unigram[VOCAB + 1 : _GROUP] += bucket_tokens
        unigram[_GROUP:] = np.where(mass > 0, mass, 1e-9)  # an empty group takes nothing
        self.noise = unigram / unigram.sum()
        rng = np.random.default_rng(7)
        self.r = rng.normal(0, 0.1, (_START + 1, SIZE)).astype(np.float32)
        self.c1 = np.eye(SIZE, dtype=np.float32)
        self.c2 = 0.5 * np.eye(SIZE, dtype=np.float32)
        self.q = rng.normal(0, 0.1, (WORDS, SIZE)).astype(np.float32)
        self.bias = np.log(self.noise).astype(np.float32)
        self._z: np.ndarray | None = None
        self.squares: list[np.ndarray] | None = None
        self.near_squares: np.ndarray | None = None
        self.near_steps = np.zeros(len(near))

    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def code(self, word: bytes) -> int:
        k = self.codes.get(word)
        return VOCAB + 1 + bucket(word) if k is None else k

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.c1, self.c2, self.q, self.bias, self.near_q, self.near_bias]

    def set_parameters(self, p: list[np.ndarray]) -> None:
        self.r, self.c1, self.c2, self.q, self.bias, self.near_q, self.near_bias = p
        self._z = None

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        return self.r @ self.c1, self.r @ self.c2

    def normalisers(self) -> np.ndarray:
        """log of the sum over words of exp(score), for every pair of context entries."""
        if self._z is None:
            one, two = self.left()
            z = np.empty((_START + 1, _START + 1), dtype=np.float32)
            for a in range(_START + 1):
                s = (one[a] + two) @ self.q.T + self.bias
                top = s.max(axis=1)
                z[a] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
            self._z = z
        return self._z

    def log10_probabilities(self, codes: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Normalised log10 P of ``codes`` after the entries h1 (the last) and h2 (the one before)."""
        one, two = self.left()
        z = self.normalisers()
        ids = self.entries[codes]
        s = np.einsum("ij,ij->i", one[h1] + two[h2], self.q[ids]) + self.bias[ids] - z[h1, h2]
        near = np.flatnonzero(codes >= FIRST_NEAR)
        near = near[np.argsort(codes[near], kind="stable")]
        words = codes[near] - FIRST_NEAR
        cuts = np.searchsorted(words, self.first)
        for g in np.flatnonzero(np.diff(cuts)):
            low, high = self.first[g], self.first[g + 1]
            for a in range(cuts[g], cuts[g + 1], NEAR_BATCH):
                at = near[a : min(a + NEAR_BATCH, cuts[g + 1])]
                t = (one[h1[at]] + two[h2[at]]) @ self.near_q[low:high].T + self.near_bias[low:high]
                own = t[np.arange(len(at)), codes[at] - FIRST_NEAR - low]
                top = t.max(axis=1)
                t -= top[:, None]
                s[at] += own - top - np.log(np.exp(t, out=t).sum(axis=1))
        return s / np.float32(np.log(10))


def contexts(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of several texts with their two context entries."""
    ids = np.concatenate(sequences)
    h1, h2 = np.empty_like(ids), np.empty_like(ids)
    h1[1:], h2[2:] = ids[:-1], ids[:-2]
    first = np.cumsum([0] + [len(x) for x in sequences[:-1]])
    h1[first] = _START
    h2[first] = _START
    second = first[np.array([len(x) > 1 for x in sequences])] + 1
    h2[second] = _START
    return ids, h1, h2


def _sums(index: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in ``index``, and the gradient rows of each added up."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # no head is larger
    where = index[order]
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    return where[first], np.add.reduceat(grad[order], first, axis=0)


def _summed(rows: int, index: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Gradient rows added up by index."""
    out = np.zeros((rows, *grad.shape[1:]), dtype=np.float32)
    where, sums = _sums(index, grad)
    out[where] = sums
    return out


def _near_step(m: Model, words: np.ndarray, h: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """NCE of words within their groups, an Adagrad step on the rows met; returns h's gradient.

    The noise of a group is shared by its words of the batch.
    """
    order = np.argsort(words.astype(np.uint16), kind="stable")
    words, h = words[order], h[order]
    g = m.group[words]  # groups are runs of words
    new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(words))))
    first, last = m.first[g[new]][:, None], m.first[g[new] + 1][:, None]
    low, high = m.sums[first], m.sums[last]
    noise = np.searchsorted(m.sums, low + rng.random((len(new), NEAR_NOISE)) * (high - low), side="right") - 1
    noise = np.clip(noise, first, last - 1)
    q, qn = m.near_q[words], m.near_q[noise][of]
    shift = m.near_bias - m.near_noise
    up = 1 / (1 + np.exp((np.einsum("ij,ij->i", h, q) + shift[words]).clip(-30, 30)))
    down = -1 / (1 + np.exp(-(np.einsum("ij,ikj->ik", h, qn) + shift[noise][of]).clip(-30, 30)))
    wide = np.ones((len(words), SIZE + 2), dtype=np.float32)  # h, and columns for the bias and the steps
    wide[:, :SIZE] = h
    own = wide * up[:, None]
    own[:, -1] = 1
    other = down[:, :, None] * wide[:, None, :]
    other[:, :, -1] = 1
    other = np.add.reduceat(other.reshape(len(words), -1), new, axis=0).reshape(-1, SIZE + 2)
    where, sums = _sums(np.concatenate((words, noise.ravel())), np.concatenate((own, other)))
    if m.near_squares is None:
        m.near_squares = np.ones((len(m.near_bias), SIZE + 1), dtype=np.float32)
    m.near_steps[where] += sums[:, -1]
    sums = sums[:, :-1]
    squares = m.near_squares[where] + sums * sums
    m.near_squares[where] = squares
    step = np.float32(NEAR_RATE) * sums / np.sqrt(squares)
    m.near_q[where] += step[:, :SIZE]
    m.near_bias[where] += step[:, SIZE]
    out = np.empty_like(h)
    out[order] = up[:, None] * q + np.einsum("ik,ikj->ij", down, qn)
    return out


def train_step(m: Model, codes: np.ndarray, h1: np.ndarray, h2: np.ndarray, rng: np.random.Generator) -> None:
    """One batch of NCE (data against NOISE samples shared by the batch), an Adagrad step."""
    ids = m.entries[codes]
    k = rng.choice(WORDS, NOISE, p=m.noise)
    log_noise = np.log(m.noise * NOISE).astype(np.float32)
    r1, r2 = m.r[h1], m.r[h2]
    h = r1 @ m.c1 + r2 @ m.c2
    q, qk = m.q[ids], m.q[k]
    up = 1 / (1 + np.exp((np.einsum("ij,ij->i", h, q) + m.bias[ids] - log_noise[ids]).clip(-30, 30)))
    down = -1 / (1 + np.exp(-(h @ qk.T + m.bias[k] - log_noise[k]).clip(-30, 30)))
    gh = up[:, None] * q + down @ qk
    near = np.flatnonzero(codes >= FIRST_NEAR)
    if len(near):
        gh[near] += _near_step(m, codes[near] - FIRST_NEAR, h[near], rng)
    gq = _summed(WORDS, ids, up[:, None] * h)
    gb = np.bincount(ids, up, WORDS).astype(np.float32)
    np.add.at(gq, k, down.T @ h)
    np.add.at(gb, k, down.sum(axis=0))
    gr = _summed(_START + 1, h1, gh @ m.c1.T) + _summed(_START + 1, h2, gh @ m.c2.T)
    grads = [gr, r1.T @ gh, r2.T @ gh, gq, gb]
    if m.squares is None:
        m.squares = [np.full_like(g, 1e-3) for g in grads]
    for p, g, s in zip(m.parameters(), grads, m.squares):
        g /= np.float32(len(ids))
        s += g * g
        p += np.float32(RATE) * g / np.sqrt(s)


def _pack(weight: float, m: Model) -> bytes:
    """Weights and weighted parameters of one task."""
    *shared, near_q, near_bias = m.parameters()
    parts = [[weight], *[p.ravel() * np.float64(weight) for p in shared], m.near_steps, (near_q * m.near_steps[:, None]).ravel(), near_bias * m.near_steps]
    return np.concatenate(parts).astype(np.float32).tobytes()


def _unpack(total: np.ndarray, m: Model) -> list[np.ndarray]:
    """Means of what tasks packed; a word no task met keeps what it has."""
    *shared, near_q, near_bias = m.parameters()
    out, at = [], 1
    for p in shared:
        out.append((total[at : at + p.size] / total[0]).reshape(p.shape).astype(np.float32))
        at += p.size
    steps, q, bias = np.split(total[at:], [len(near_bias), len(near_bias) + near_q.size])
    met, over = steps > 0, np.maximum(steps, 1)
    out.append(np.where(met[:, None], q.reshape(near_q.shape) / over[:, None], near_q).astype(np.float32))
    out.append(np.where(met, bias / over, near_bias).astype(np.float32))
    return out


def _levels(tasks: int) -> list[int]:
    """Numbers of averaging tasks, level by level, until the driver can take the rest."""
    out = [-(-tasks // FAN)]
    while out[-1] > FAN:
        out.append(-(-out[-1] // FAN))
    return out


def _train(docs: DataFrame, model: Model) -> None:
    """ROUNDS passes over all texts; one set of parameters per task, averaged by a tree."""
    for _ in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            from copy import copy

            m = copy(shared.value)
            m.set_parameters([p.copy() for p in m.parameters()])
            m.near_steps = np.zeros(len(m.near_bias))
            seen, seed = 0, 0
            for batch in batches:
                texts = _raw(batch.column(0))
                for a, b in _slices(batch, 0):
                    code = Codes(m).__getitem__
                    sequences = [np.array([*map(code, tokens(t)), _END], dtype=np.int64) for t in texts[a:b]]
                    ids, h1, h2 = contexts(sequences)
                    h1, h2 = m.entries[h1], m.entries[h2]
                    seed = zlib.crc32(ids[:4096].tobytes(), seed)
                    rng = np.random.default_rng(seed)
                    order = rng.permutation(len(ids))
                    for s in range(0, len(ids), BATCH):
                        pick = order[s : s + BATCH]
                        train_step(m, ids[pick], h1[pick], h2[pick], rng)
                        seen += len(pick)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seed & 0x7FFFFFFF], pa.int32()), pa.array([_pack(seen, m)], pa.binary())], names=["k", "p"])

        def average(batches):
            total, key = None, 0
            for batch in batches:
                for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = np.frombuffer(x, np.float32).astype(np.float64)
                    total, key = (x, k) if total is None else (total + x, key)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["k", "p"])

        schema = "k int, p binary"
        parts = docs.select("text").mapInArrow(trimmed(run), schema)
        for n in _levels(parts.rdd.getNumPartitions()):
            parts = parts.withColumn("k", F.col("k") % n).repartition(n, "k").mapInArrow(trimmed(average), schema)
        sums = parts.collect()
        if sums:
            model.set_parameters(_unpack(sum(np.frombuffer(bytes(r["p"]), np.float32).astype(np.float64) for r in sums), model))
        shared.unpersist()


def _most_frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The first ``size`` words by count, then by word.

    A histogram of counts (exact below 64, then 16 cells an octave) gives a count that
    about so many words reach; only those are sorted, so that a task doesn't send its
    own first ``size`` words to the driver.
    """
    cell = F.when(F.col("n") < 64, F.col("n")).otherwise((F.log2("n") * 16).cast("long")).cast("long")
    least, seen = 1, 0
    for r in counts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("least")).collect():
        seen, least = seen + r["words"], r["least"]
        if seen >= size:
            break
    return [(bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()]


def fit(docs: DataFrame, usable: Column) -> tuple[Model, DataFrame]:
    """(model, counts) from the rows of ``docs`` for which ``usable`` holds."""
    train = docs.where(usable).select(F.col("text").cast("string").alias("text"))
    counts = store(train.mapInArrow(trimmed(_count), "word binary, b int, n long").groupBy("word", "b").agg(F.sum("n").alias("n"))).df
    head = _most_frequent(counts.where("b >= 0"), HEAD)
    tokens_of, words_of = np.zeros(BUCKETS), np.zeros(BUCKETS)
    end = total = distinct = 0
    for r in counts.groupBy("b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        total += r["n"]
        distinct += r["v"]
        if r["b"] < 0:
            end = r["n"]
        else:
            tokens_of[r["b"]], words_of[r["b"]] = r["n"], r["v"]
    for w, n in head[: with_vectors(head)]:
        tokens_of[bucket(w)] -= n
        words_of[bucket(w)] -= 1
    model = Model(head, end, total, distinct, tokens_of, words_of)
    if total:
        _train(train, model)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        """One row for each text (word null), and one for each of its words outside the head."""
        m = shared.value
        end_base = float(np.log10((m.end + 0.5) / m.denominator()))
        row = 0
        for batch in batches:
            texts = _raw(batch.column(1))
            for a, b in _slices(batch, 1):
                # Words get numbers in the order they come; the last number is the end.
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                numbered = [list(map(number.__getitem__, tokens(t))) for t in texts[a:b]]
                distinct, end = list(number), len(number)
                counts = np.array([m.counts.get(w, -1) for w in distinct] + [m.end], dtype=np.int64)
                code = np.array([m.code(w) for w in distinct] + [_END], dtype=np.int64)
                near = counts >= 0
                classed = near & (code > VOCAB) & (code < _GROUP)
                base = np.where(near, np.log10((counts.clip(0) + 0.5) / m.denominator()), 0.0)
                base[end] = end_base
                at = (code - VOCAB - 1).clip(0, BUCKETS - 1)
                share = np.where(classed, np.log10((counts.clip(0) + 0.5) / (m.bucket_tokens[at] + 0.5 * (m.bucket_words[at] + 1))), 0.0)
                known_word = near.copy()
                known_word[end] = m.end > 0
                sizes = np.array([len(w) + 1 for w in numbered], dtype=np.int64)
                first = np.cumsum(sizes) - sizes
                flat_number = np.full(int(sizes.sum()), end, dtype=np.int64)
                for k, w in zip(first, numbered):
                    flat_number[k : k + len(w)] = w
                bases, shares, known = (np.add.reduceat(x[flat_number], first) for x in (base, share, known_word.astype(np.int64)))
                # Words outside the head, counted for each text.
                far = np.flatnonzero(~near[flat_number])
                pair, far_n = np.unique(np.repeat(np.arange(a, b), sizes)[far] * (end + 1) + flat_number[far], return_counts=True)
                far_doc, far_word = pair // (end + 1), [distinct[k] for k in (pair % (end + 1)).tolist()]
                flat, h1, h2 = contexts(np.split(code[flat_number], first[1:]))
                neural = np.add.reduceat(m.log10_probabilities(flat, m.entries[h1], m.entries[h2]).astype(np.float64), first)
                n = b - a
                rows = np.concatenate((np.arange(row, row + n), row + far_doc - a)).astype(np.int64)
                row += n
                far = len(far_word)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.concatenate((np.arange(a, b), far_doc)))),
                        pa.array(rows),
                        pa.array([None] * n + far_word, pa.binary()),
                        pa.array(np.concatenate((sizes, far_n)).astype(np.int64)),
                        pa.array(np.concatenate((known, np.zeros(far))).astype(np.int64)),
                        pa.array(np.concatenate((bases, np.zeros(far)))),
                        pa.array(np.concatenate((neural + shares, np.zeros(far)))),
                    ],
                    names=["doc_id", "row", "word", "n", "known", "base", "score"],
                )

    part = narrow.mapInArrow(trimmed(run), f"doc_id {kind}, row long, word binary, n long, known long, base double, score double")
    # A text is known by its id, its place in a task, and the sums that only depend on it.
    parts = store(part.withColumn("task", F.spark_partition_id()))
    per_class = F.array(*[F.lit(float(x)) for x in model.bucket_tokens + 0.5 * (model.bucket_words + 1)])
    tail = counts.where("b >= 0").select(F.col("word").alias("w"), F.col("n").alias("c"), "b")
    far = parts.df.where("word is not null").select("doc_id", "task", "row", "word", "n").join(tail, F.col("word") == F.col("w"), "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    b = F.coalesce(F.col("b"), _bucket_column(F.col("word")))
    sums = far.select("doc_id", "task", "row", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10((c + 0.5) / model.denominator())).alias("base"), (F.col("n") * F.log10((c + 0.5) / per_class[b])).alias("score"))
    sums = sums.groupBy("task", "row").agg(F.sum("known").alias("known2"), F.sum("base").alias("base2"), F.sum("score").alias("score2")).withColumnsRenamed({"task": "t", "row": "r"})
    texts = parts.df.where("word is null")
    joined = texts.join(sums, (F.col("task") == F.col("t")) & (F.col("row") == F.col("r")), "left")
    plus = lambda x: F.col(x) + F.coalesce(F.col(f"{x}2"), F.lit(0))
    return joined.select("doc_id", F.col("n").alias("n_tokens"), plus("known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("score").alias("score"))


def _bucket_column(word: Column) -> Column:
    """``bucket`` of a word that no training text has."""
    byte = lambda k: F.conv(F.hex(F.substring(word, k, 1)), 16, 10).cast("int")
    return ((byte(-1) * 31 + F.when(F.length(word) > 1, byte(-2)).otherwise(7)) % BUCKETS).cast("int")

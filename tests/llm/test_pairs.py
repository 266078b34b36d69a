import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, linededup, ngram_join
from tidemark.llm.common import shingle_sets
from tidemark.llm.oracles import OP3
from tidemark.llm.queries import op3_substring_dedup

from .conftest import sentence

DATA = Path("/root/testdata/sf0.001")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(j)] = find(i)
    out = []
    for k in range(len(rows)):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        out.append((rows[k][0], len(sets[k]), min(ids) if ids and sets[k] else rows[k][0]))
    return out


def edited(text, rate, rng):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < rate else w for w in text.split())


def test_join_equals_brute_force_on_copies_of_many_kinds(spark):
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = sentence(g, rng.choice([4, 12, 60, 250]))
        rows += [base, base.upper()] + [edited(base, rng.choice([0.005, 0.02, 0.04, 0.06]), rng) for _ in range(9)]
    passage = sentence(99, 40)
    rows += [passage + " " + sentence(200 + k, 25 + k) for k in range(20)]
    chain = sentence(50, 120).split()
    rows += [" ".join(chain[k * 6 : k * 6 + 80]) for k in range(6)]
    given = [(k * 3 % 997, t) for k, t in enumerate(rows)]
    found = ngram_join.components(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(components_by_force(given))


def test_join_of_a_hot_key_equals_brute_force(spark, monkeypatch):
    """A common passage with unlike rests, and copies of it too far from each other; all keys salted."""
    monkeypatch.setattr(ngram_join, "COMMON_KEY", 3)
    monkeypatch.setattr(ngram_join, "COMMON_TIMES", 0)
    rng = random.Random(5)
    passage = sentence(99, 60)
    rows = [passage + " " + sentence(300 + k, rng.choice([3, 10, 14, 20, 30])) for k in range(40)]
    rows += [edited(passage, rng.choice([0.01, 0.03, 0.05, 0.1]), rng) for _ in range(60)] + [passage] * 5
    rows += [" ".join(passage.split()[k : k + 50]) for k in range(8)]
    given = [(f"d{k:03}", t) for k, t in enumerate(rows)]
    found = ngram_join.components(spark.createDataFrame(given, "doc_id string, text string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(components_by_force(given))


def test_join_on_odd_rows(odd_docs, empty_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = ngram_join.components(odd_docs)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, components_by_force(rows)))
    assert ngram_join.components(empty_docs).count() == 0
    odd_docs = odd_docs.withColumns({c: F.lit("x") for c in ("gone", "__gone", "__twice", "__id")})
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, None, 5, 7, 8, 9, 10]))


def test_keys_are_lossless_and_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, ngram_join.COUNTERS, dtype=np.uint32)
    for n in (1, 2, 3, 5, 11, 12, 13, 47, 60, 64, 200, 260, 1000):
        for _ in range(10):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            gone = rng.integers(0, n // 7 + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, n // 7 + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                one, two = ({int(k): int(m) for k, m in zip(*ngram_join.band_keys(x, counts)[:2])} for x in (a, b))
                assert any(two[k] >= len(a) and one[k] >= len(b) for k in one.keys() & two.keys())
            one, two = ngram_join.parity_sketch(a), ngram_join.parity_sketch(b)
            flips = sum(bin(int(x ^ y) & (2**64 - 1)).count("1") for x, y in zip(one, two))
            assert len(ngram_join.parity_sketch(a)) != len(ngram_join.parity_sketch(b)) or flips <= len(a) + len(b) - 2 * both
            assert ngram_join.set_hash(a) == ngram_join.set_hash(a[::-1].copy()) and len(ngram_join.band_keys(a, counts)[0]) <= 2 * (n // 4 + 1)


def test_labels_reach_the_ends_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95)]
    found = ngram_join.connected(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["s"], r["root"]) for r in found.collect()} == {(k, 0) for k in range(41)} | {(100, 90), (90, 90), (95, 90)}


def test_contained_items_equal_brute_force(spark, odd_docs, empty_docs):
    items = [(1, sentence(1, 30)), (2, sentence(500, 30)), (3, sentence(501, 12)), (4, None), (5, " "), (6, "One"), (7, sentence(502, 200)), (7, sentence(503, 9))]
    texts = [sentence(600, 3000) + " " + sentence(500, 30).upper() + "\n" + sentence(601, 3000), sentence(501, 11), sentence(502, 160), sentence(502, 120), "x one y", None, ""]
    texts += [" ".join(w if k % 9 else "zz" for k, w in enumerate(sentence(500, 30).split())), sentence(700, 9000) + " " + sentence(503, 9)]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for d, t in rows:
        for i, q in items:
            words = (q or "").encode().lower().split()
            if not words:
                continue
            have = (t or "").encode().lower().split()
            n = min(5, len(words))
            a, b = {tuple(words[x : x + n]) for x in range(len(words) - n + 1)}, {tuple(have[x : x + n]) for x in range(len(have) - n + 1)}
            if len(a & b) >= 0.75 * len(a):
                want.add((d, i, len(a & b), len(a)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contained(docs, bench)
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found.collect()} == want
    left = decontaminate.drop_contaminated(odd_docs, bench)
    assert left.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, [2, 3, 4, None, None, 8, 9, 10]))  # 7 has the first item's words
    assert decontaminate.find_contained(empty_docs, bench).count() == 0
    assert decontaminate.find_contained(docs, bench.where("false")).count() == 0


def test_containment_in_blocks_of_items_and_ids_of_any_type(spark, monkeypatch):
    rng = random.Random(3)
    items = [(f"q{k}", sentence(800 + k, rng.choice([6, 20, 70, 150, 400, 900]))) for k in range(30)]
    docs = [(f"d{k}", sentence(900 + k, 40) + " " + edited(items[k % 30][1], rng.choice([0, 0.02, 0.05]), rng) + " " + sentence(950 + k, 9)) for k in range(90)] + [("long", " ".join(t for _, t in items) + " " + sentence(1, 300_000))]
    sets = {i: shingles(t) for i, t in items}
    want = {(d, i) for d, t in docs for have in [shingles(t)] for i, q in sets.items() if len(q & have) >= 0.75 * len(q)}
    docs, items = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    for size in (decontaminate.BLOCK_SHINGLES, 1000):
        monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", size)
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contained(docs, items).collect()} == want
    assert max(decontaminate.rate(n) for n in (128, 1000)) < 1 == decontaminate.rate(40)


def cut_by_force(rows):
    """(doc_id, text) -> text without the units that an earlier one repeats, unit by unit."""
    size, found = linededup.UNIT_WORDS, []
    word = re.compile(r"[　-퟿]|[^\x20\x09-\x0D　-퟿]+")
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    for r, (d, t) in enumerate(rows):
        if t is None:
            continue
        w = [(m.start(), m.end(), lower(m.group())) for m in word.finditer(t)]
        opens = [i == 0 or "\n" in t[w[i - 1][1] : w[i][0]] for i in range(len(w))]
        closes = [*opens[1:], True]
        for i in range(len(w) - size + 1):
            if opens[i] or closes[i + size - 1] or (len(w[i][2].encode()) + ord(w[i][2][-1])) % linededup.ANCHOR == 0:
                found.append((tuple(x[2] for x in w[i : i + size]), (d is None, d or 0, t, w[i][0]), r, w[i][0], w[i + size - 1][1]))
    first = {}
    for unit, rank, *_ in found:
        first[unit] = min(first.get(unit, rank), rank)
    gone = {r: set() for r in range(len(rows))}
    for unit, rank, r, a, b in found:
        if rank != first[unit]:
            gone[r] |= set(range(a, b))
    return [t if t is None else "".join(c for k, c in enumerate(t) if k not in gone[r]) for r, (_, t) in enumerate(rows)]


def test_repeated_passages_go_and_spans_rebuild_the_text(spark, odd_docs, empty_docs):
    passage, wide = sentence(1, 60), "这是一个很长的句子没有任何空格" * 5
    rows = [
        (5, f"{sentence(2, 40)}\n{passage}\nshort one"),
        (3, f"{sentence(3, 30)} {passage.upper()} {sentence(4, 30)}\nshort one"),
        (9, f"{passage}\t{sentence(5, 9)}\n{passage}"),
        (9, sentence(6, 80)),
        (9, f"{sentence(6, 10)} end"),
        (4, passage.replace(" ", "\n")),
        (8, None),
        (None, f"x {sentence(6, 70)}"),
        (11, f"前 {wide} 后"),
        (12, f"{wide}\nshort one"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    want = cut_by_force(rows)
    assert want[3] == rows[3][1] and want[7] != rows[7][1] and want[9] != rows[9][1] and len(want[0]) < len(rows[0][1]) - 200
    found = linededup.dedup(docs, offsets=True).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(d), str(t)) for (d, _), t in zip(rows, want))
    given = {(d, w): t for (d, t), w in zip(rows, want)}
    for r in found:
        before = given[r["doc_id"], r["text"]]
        assert (r["kept_spans"] is None) == (r["n_removed"] == 0)
        if r["kept_spans"] is not None:
            assert "".join(before[s["start"] : s["stop"]] for s in r["kept_spans"]) == r["text"]
            assert r["n_chars"] == len(r["text"])
    plain = linededup.dedup(docs)
    assert plain.columns == docs.columns and sorted(str(r["text"]) for r in plain.collect()) == sorted(map(str, want))


def test_dedup_looks_at_every_word(spark):
    """Passages go whole wherever they stand, even where no word of theirs was a place at which units began."""
    bare = " ".join(w for w in sentence(31, 900).split() if (len(w) + ord(w[-1])) % 4)
    passages = [" ".join(bare.split()[k * 40 : k * 40 + n]) for k, n in enumerate((32, 33, 40, 31))]
    rows = [(k, f"{sentence(40 + k, 50)} {p} {sentence(50 + k, 50)}") for k, p in enumerate(passages)]
    rows += [(10 + k, f"{sentence(60 + k, 50)} {p} {sentence(70 + k, 50)}") for k, p in enumerate(passages)]
    rows += [(20, "x " * 100 + "end"), (21, "start " + "x " * 40 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup(docs, offsets=True).collect()}
    for k, p in enumerate(passages):
        assert found[k] == (rows[k][1], 0)
        assert found[10 + k] == ((rows[4 + k][1].replace(p, ""), 1) if k < 3 else (rows[4 + k][1], 0))
    assert found[20] == ("x  end", 1) and found[21] == ("start  y", 1)


@pytest.mark.parametrize("anchor", [1, 4])
def test_dedup_of_edited_copies_equals_brute_force(spark, monkeypatch, anchor):
    rng = random.Random(6)
    base = [sentence(600 + k, rng.choice([40, 90, 300])).replace(" ", "\n", 2) for k in range(12)]
    rows = [(k, sentence(700 + k, rng.choice([0, 9])) + " " + edited(base[k % 12], rng.choice([0, 0.01, 0.03]), rng) + rng.choice([" ", "\n"]) + edited(base[k % 5], 0.01, rng)) for k in range(120)]
    rows += [(200 + k, " ".join(rng.choice(["a", "bc"]) for _ in range(400)) + " " + "d e f " * 30) for k in range(6)]
    monkeypatch.setattr(linededup, "ANCHOR", anchor)
    want = cut_by_force(rows)
    found = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), anchor=anchor).collect()}
    assert [found[d] for d, _ in rows] == want and sum(t != w for (_, t), w in zip(rows, want)) > 60


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_dedup_of_whole_documents_equals_sql(spark):
    """The query equals its SQL; the operator equals the SQL without its choice of words."""
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert OP3.count("where picked and words") == 1
    whole = linededup.dedup(spark.read.parquet(f"{DATA}/documents.parquet"), offsets=True).selectExpr("doc_id", "text", "n_removed", "array_join(transform(kept_spans, s -> concat(s.start, '-', s.stop)), ';') as kept_spans")
    for found, sql in ((op3_substring_dedup(spark, str(DATA)), OP3), (whole, OP3.replace("where picked and words", "where words"))):
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, db.execute(sql).fetchall()))


def test_dedup_of_odd_rows(spark, odd_docs, empty_docs):
    clashing = odd_docs.withColumns({c: F.lit("x") for c in ("kept_spans", "n_removed", "id", "th", "spans", "__id", "__th", "__spans", "h", "g")})
    odd = linededup.dedup(clashing)
    assert odd.columns == clashing.columns and {r["__spans"] for r in odd.collect()} == {"x"}
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(str(r["text"]) for r in odd.collect()) == sorted(map(str, cut_by_force(rows)))
    assert sorted(linededup.dedup(clashing, offsets=True).columns) == sorted(clashing.columns)
    assert linededup.dedup(empty_docs).count() == 0
    names = spark.createDataFrame([("b", sentence(1, 50)), ("a", sentence(1, 50))], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(names).collect()} == {"a": sentence(1, 50), "b": ""}


def test_dedup_of_a_very_long_text(spark):
    long = sentence(7, 300_000)
    docs = spark.createDataFrame([(1, long), (2, f"before {long} after")], "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in linededup.dedup(docs).collect()}
    assert found[1] == long and found[2].startswith("before") and found[2].endswith("after") and len(found[2]) < 200


def test_shingles_dont_cross_documents():
    import pyarrow as pa

    from tidemark.llm.common import blocks, lowered

    texts = ["a b c d e f", "", "a b", None, "A  b\tc\nd\x0be", "x" * 3_000_000 + " y z", "é b c d e"]
    sets = [u for b in blocks(pa.array(texts), 64) for u in shingle_sets(lowered(b))]
    assert [len(u) for u in sets] == [2, 0, 1, 0, 1, 1, 1]
    assert np.intersect1d(sets[0], sets[4]).size == 1 and not np.intersect1d(sets[4], sets[6]).size

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, language_id, license_scan, lm_scoring, mixing, quality_classifier, quality_rules
from tidemark.llm.common import fold_of

from .conftest import sentence


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ------------------------------------------------------------------ quality rules


def base_by_force(t):
    w, t = words(t), t or ""
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed)


def test_base_measures_equal_brute_force(spark, odd_docs, empty_docs):
    texts = [sentence(1, 60), "a b c " * 40, "a b a b a b a b", "x y z q x y z", " ".join("ab"[k % 2] + str(k // 40) for k in range(400)), "l one\n\nl one\n \nl one ", "*** a|b <c> 100% é&é", "aa " * 60, sentence(2, 50) + " " + sentence(2, 26), "a a a", "\x0ba\x0cb\rc", None, ""]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (docs, odd_docs):
        given = {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").collect()}
        for r in quality_rules.verdicts(df).where("doc_id is not null").collect():
            assert tuple(r[n] for n in names) == base_by_force(given[r["doc_id"]]), given[r["doc_id"]]
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.verdicts(empty_docs).count() == 0
    kept = quality_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} <= {1, None, 6, 7, 10}


def test_divergent_documents_go_and_clean_ones_stay(spark):
    clean = [(k, "The house of the garden and the river is in a town that " + sentence(k, 90), "en") for k in range(60)]
    junk = [(100, " ".join(w + "***" for w in sentence(7, 90).split()), "en"), (101, " | ".join(sentence(8, 90).split()), "en"), (102, "SHOUT " + sentence(9, 90).upper() + " !!!!", "en")]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()}
    assert all(kept[k] for k, _, _ in clean) and not kept[100] and not kept[101] and not kept[102]


def test_texts_of_another_language_or_without_common_words_go(spark):
    common = {"en": "the of and to in a is that".split(), "de": "der die und den von zu das mit".split()}

    def prose(k, lang, n):
        own = common[lang]
        return " ".join(own[(k + 5 * i) % len(own)] if (k + i) % 3 == 0 else w for i, w in enumerate(sentence(k, n).split()))

    good = [(k, prose(k, lang, 150 + k), lang) for k in range(120) for lang in [("en", "de")[k % 2]]]
    wrong = [(200, prose(1, "de", 250), "en"), (201, prose(2, "en", 250), "de"), (202, sentence(3, 250), "en"), (203, sentence(4, 250), "de")]
    docs = spark.createDataFrame(good + wrong, "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in quality_rules.verdicts(docs).collect()}
    assert all(rows[k]["kept"] for k, _, _ in good)
    for k, _, _ in wrong:
        assert not rows[k]["kept"] and not rows[k]["base_failed"] and rows[k]["class_distance"] <= quality_rules.CLASS_LIMIT


def verdict_by_force(rows):
    """doc_id -> kept, from histograms, references and limits computed anew."""
    R, out, h, base = quality_rules, {}, {}, {}

    def histogram(t):
        w = words(t)
        solid = "".join(w)
        rare = re.sub(r"[a-z\x20\x09-\x0D]+", "", t)
        taken = [sum(map(len, re.findall(p, rare))) for p in R.CHARACTER_CLASSES.values()]
        common = [w.count(x) for x in R.COMMON_WORDS]
        return [*taken, len(solid) - len(rare), len(rare) - sum(taken)], [*common, len(w) - sum(common)]

    def scaled(x):
        return [(1 - R.SMOOTHING) * (v / sum(x) if sum(x) else 1 / len(x)) + R.SMOOTHING / len(x) for v in x]

    def distance(x, r):
        if not sum(x):
            return 0.0
        p = [v / sum(x) for v in x]
        m = [(a + b) / 2 for a, b in zip(p, r)]
        kl = lambda y: sum(a * math.log2(a / b) for a, b in zip(y, m) if a)
        return math.sqrt(max(0, (kl(p) + kl(r)) / 2))

    for d, t, _ in rows:
        h[d], base[d] = histogram(t or ""), base_by_force(t)
    add = lambda ids: [[sum(c) for c in zip(*(h[d][k] for d in ids))] or [0] * len(h[rows[0][0]][k]) for k in (0, 1)]
    good = [(d, lang) for d, _, lang in rows if not base[d][5]]
    refs = {None: add([d for d, _ in good])}
    for lang in {x for _, x in good}:
        own = add([d for d, x in good if x == lang])
        if sum(own[1]) >= R.LEAST_WORDS:
            refs[lang] = own
    of = {d: lang if lang in refs else None for d, _, lang in rows}
    far = {d: [distance(h[d][k], scaled(refs[of[d]][k])) for k in (0, 1)] for d, _, _ in rows}
    odd = lambda d: base[d][1] >= R.MIN_CHARS and far[d][0] > R.CLASS_LIMIT
    reach = lambda d: far[d][1] * math.sqrt(min(base[d][0], R.LONG_WORDS))
    limit = {}
    for ref in refs:
        cells = sorted(math.ceil(reach(d) / R.STEP) for d, _ in good if of[d] == ref and not odd(d))
        if cells:
            at = lambda q: next(c for k, c in enumerate(cells) if k + 1 >= q * len(cells)) * R.STEP
            limit[ref] = max(R.LEAST_LIMIT, at(0.5) + R.SPREAD * (at(0.5) - at(0.1)))
    for d, _, _ in rows:
        out[d] = not base[d][5] and not odd(d) and not reach(d) > limit.get(of[d], R.LEAST_LIMIT)
    return out, set(refs)


def test_verdicts_equal_brute_force(spark):
    common = {"en": "the of and to in a is that".split(), "de": "der die und den von zu das mit".split(), "xx": ["que"], "one": ["la"], "": ["de"]}
    rows = []
    for k in range(150):
        lang = list(common)[k % 4 if k % 4 < 3 or k < 8 else 4]
        w = sentence(k, 30 + 7 * (k % 30)).split()
        rows.append((k, " ".join(common[lang][i % len(common[lang])] if (i * 7 + k) % (3 + k % 3) == 0 else x.upper() if k % 13 == 0 else x + "|" * (k % 17 == 0) for i, x in enumerate(w)), lang))
    rows += [(200, rows[1][1] * 3, "en"), (201, rows[2][1], "de"), (202, None, "en"), (203, " ".join("x y z".split() * 90), "de"), (204, sentence(9, 30_000), "en")]
    want, refs = verdict_by_force(rows)
    assert refs == {None, "en", "de", "xx", ""} and 10 < sum(want.values()) < 150
    docs = spark.createDataFrame([(d, t, lang or None) for d, t, lang in rows], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(docs).collect()} == want
    clashing = docs.withColumns({c: F.lit("x") for c in ("row", "m", "d", "ref", "most", "words", "kept", "__lang", "__text", "__words", "__m")})
    kept = quality_rules.keep_good(clashing)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()} == {d for d, k in want.items() if k} and {(r["m"], r["kept"], r["__m"]) for r in kept.collect()} == {("x", "x", "x")}


def test_distance_is_jensen_shannons(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    h = F.array(*[F.lit(x * 8) for x in p])
    got = spark.range(1).select(quality_rules._distance(h, F.array(*[F.lit(x) for x in q]), 0, 3)).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


# ------------------------------------------------------------------ language id

LANGS = {"en": "the house of the king and this other thing with that weather which they then gather", "de": "der schöne garten und die straße nicht über das mädchen sich auch einen schlüssel zwischen", "ru": "это большой дом который стоит на улице рядом с рекой и лесом где живут люди"}


def _language_rows():
    rows = []
    for k in range(120):
        lang = list(LANGS)[k % 3]
        w = LANGS[lang].split()
        rows.append((k, " ".join(w[(k * 7 + 3 * i) % len(w)] for i in range(30)), lang))
    return rows


def test_languages_are_learned_and_spans_found(spark, odd_docs, empty_docs):
    docs = spark.createDataFrame(_language_rows(), "doc_id long, text string, lang string")
    out = fold_of(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs, ~out)
    found = language_id.predict(docs, model).join(docs, "doc_id")
    assert found.where("lang_pred <> lang").count() == 0
    mixed = spark.createDataFrame([(1, f"{LANGS['en']} {LANGS['de']}")], "doc_id long, text string")
    spans = language_id.predict(mixed, model, spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and spans[0]["start"] == 0 and spans[1]["stop"] == len(mixed.first()["text"])
    assert abs(len(mixed.first()["text"][: spans[0]["stop"]].split()) - len(LANGS["en"].split())) <= 1
    odd = language_id.predict(odd_docs, model)
    assert odd.count() == odd_docs.count()
    assert {r["doc_id"] for r in odd.where("lang_pred = 'und' and score = 0").collect()} == {2, 3, 4, 9, None}
    assert language_id.predict(odd_docs, language_id.fit(empty_docs)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.predict(empty_docs, model).count() == 0


def test_every_language_is_learned_and_long_texts_are_labelled(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HELD_TABLES", 7)
    stem = lambda k: f"{'bcdfghjklm'[k % 10]}{'aeiou'[k // 10 % 5]}{'npqrst'[k // 50]}"
    rows = [(f"id{k}-{i}", " ".join(stem(k) * (1 + j % 3) for j in range(12)), f"l{k:03}") for k in range(200) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.langs) == 200
    assert language_id.predict(docs, model).join(docs, "doc_id").where("lang_pred <> lang").isEmpty()
    long = spark.createDataFrame([("a", f"{rows[0][1]} " * 20_000), ("b", f"{rows[0][1]} " * 9_000 + f"{rows[100][1]} " * 4_000)], "doc_id string, text string")
    assert [r["lang_pred"] for r in language_id.predict(long, model).orderBy("doc_id").collect()] == ["l000", "l000"]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    runs = [rng.normal(0, 3, (n, 3)) for n in (1, 5, 40, 40, 7)]

    def plain(e, c):
        value, back = e[0].copy(), []
        for x in e[1:]:
            step = value[:, None] - c * (1 - np.eye(3))
            back.append(step.argmax(axis=0))
            value = step.max(axis=0) + x
        path = [int(value.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def total(e, path, c):
        return sum(e[k, p] for k, p in enumerate(path)) - c * sum(a != b for a, b in zip(path, path[1:]))

    for e, path in zip(runs, language_id.viterbi(runs, 2.5)):
        assert total(e, list(path), 2.5) == pytest.approx(total(e, plain(e, 2.5), 2.5))
        one = language_id._single(e.copy(), 2.5)
        assert one is None or total(e, [one] * len(e), 2.5) == pytest.approx(total(e, plain(e, 2.5), 2.5))


# ------------------------------------------------------------------ quality classifier


def test_quality_is_learned(spark, odd_docs, empty_docs):
    rows = [(k, sentence(k, 60 + k % 40) if k % 3 else " ".join(w + "###" for w in sentence(k, 50).split())) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k, _ in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = fold_of(F.col("doc_id"), 5) == 0
    model = quality_classifier.fit(docs, labels, ~out)
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.predict(docs, model).where(out).collect()}
    assert scores and all((s >= 0.3) == (k % 3 != 0) and 0 <= s <= 1 for k, s in scores.items())
    odd = quality_classifier.predict(odd_docs, model)
    assert odd.count() == odd_docs.count() and odd.where("score is null or score < 0 or score > 1").isEmpty()
    assert quality_classifier.predict(empty_docs, model).count() == 0
    assert quality_classifier.fit(docs, labels.where("false"), ~out) is None
    assert quality_classifier.predict(docs, None).first()["score"] == 0.5


def kernel_by_force(model, x, y, new):
    """Ridge regression on the same features, solved by least squares on stacked rows."""
    f = model.features(x)
    a = np.vstack([f, math.sqrt(quality_classifier.RIDGE) * np.eye(f.shape[1])])
    a[-1, -1] = math.sqrt(1e-9)
    beta = np.linalg.lstsq(a, np.concatenate([y, np.zeros(f.shape[1])]), rcond=None)[0]
    return model.features(new) @ beta


def test_normal_equations_over_partitions_equal_least_squares(spark):
    rows = [(k, sentence(k, 20 + k % 60) + "#" * (k % 5 * 9)) for k in range(400)] + [(400, sentence(1, 200_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 < 2)) for k in range(400)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, F.lit(True))
    described = {r["doc_id"]: np.array(r["x"]) for r in quality_classifier._described(docs, "doc_id").collect()}
    half = {r["doc_id"] for r in labels.where(F.pmod(F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1_000_000)) % 2, F.lit(2)) == 0).collect()}
    x, y = np.array([described[k] for k in sorted(half)]), np.array([float(k % 5 < 2) for k in sorted(half)])
    every = np.array([described[k] for k, _ in rows])
    assert model.mean == pytest.approx(np.array([described[k] for k in range(400)]).mean(axis=0))
    assert model.raw(every) == pytest.approx(kernel_by_force(model, x, y, every), abs=1e-5)
    held = sorted((float(v), float(k % 5 < 2)) for k in range(400) if k not in half for v in model.raw(described[k][None]))
    knots, values = quality_classifier.isotonic(np.array([v for v, _ in held]), np.array([t for _, t in held]))
    want = np.clip(np.interp(model.raw(every), knots, values), 0, 1)
    found = {r["doc_id"]: r["score"] for r in quality_classifier.predict(docs, model).collect()}
    assert [found[k] for k, _ in rows] == pytest.approx(list(want), abs=1e-6)


def test_isotonic_fit_increases():
    x = np.array([1.0, 2, 3, 4, 5, 6])
    knots, values = quality_classifier.isotonic(x, np.array([0, 1, 0, 0, 1, 1.0]))
    assert list(values) == sorted(values) and values[0] == 0 and values[-1] == 1
    assert np.interp(3, knots, values) == pytest.approx(1 / 3)


# ------------------------------------------------------------------ mixing


def test_shares_stop_at_the_cap():
    t = mixing.shares([("b", 100), ("a", 10), (None, 1000), ("c", 0)])
    assert t["a"] == 30 and t["c"] == 0 and sum(t.values()) == pytest.approx(1110)
    assert t["b"] == pytest.approx(300) and t[None] == pytest.approx(780)


def test_the_mix_comes_near_its_targets(spark, odd_docs, empty_docs):
    rows = [(k, sentence(k, 5 + k % 60), f"s{k % 7 % 4}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.decisions(docs).collect()
    assert [tuple(r) for r in sorted(found)] == [tuple(r) for r in sorted(mixing.decisions(docs.repartition(7)).collect())]
    by = {}
    source = {k: s for k, _, s in rows}
    for r in found:
        assert r["size"] == len(words(rows[r["doc_id"]][1])) and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
        n = by.setdefault(source[r["doc_id"]], [0, r["target"], r["source_size"]])
        n[0] += r["taken"]
    want = mixing.shares([(s, n[2]) for s, n in by.items()])
    assert all(abs(n[0] - n[1]) <= 35 and n[1] == pytest.approx(want[s]) for s, n in by.items())
    mixed = {(r["doc_id"], r["mix_taken"]) for r in mixing.mix(docs).collect()}
    assert mixed == {(r["doc_id"], r["taken"]) for r in found if r["taken"]}
    odd_docs = odd_docs.withColumns({c: F.lit("x") for c in ("id", "bucket", "quality", "epochs", "edge", "last", "row", "__key", "__m", "__bucket")})
    odd = mixing.decisions(odd_docs).collect()
    assert len(odd) == odd_docs.count() and len({tuple(r) for r in odd if r["doc_id"] == 1}) == 1
    assert mixing.decisions(empty_docs).count() == 0 and mixing.mix(empty_docs).count() == 0
    assert mixing.mix(odd_docs).columns == [*odd_docs.columns, "mix_size", "mix_taken"]
    assert {(r["key"], r["__key"], r["last"]) for r in mixing.mix(odd_docs).collect()} == {("x", "x", "x")}


def mix_by_force(rows, seed):
    """doc_id -> words taken, from the whole order of each source's keys."""
    sizes, quality = {d: len(words(t)) for d, t, _ in rows}, {}
    for d, t, _ in rows:
        w = words(t)
        quality[d] = 1 - 0.75 * sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w) / len(w) if w else 1.0
    key = {d: -math.log((int(hashlib.md5(f"{d}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / quality[d] for d in sizes}
    of = {}
    for d, _, s in rows:
        of.setdefault(s, []).append(d)
    out = {}
    for s, target in mixing.shares([(s, sum(sizes[d] for d in ids)) for s, ids in of.items()]).items():
        n = sum(sizes[d] for d in of[s])
        epochs = int(target // n) if n else 0
        so_far, rest = 0, target - epochs * n
        for d in sorted(of[s], key=lambda d: (key[d], d)):
            so_far += sizes[d]
            out[d] = sizes[d] * (epochs + (so_far - sizes[d] / 2 < rest))
    return out


def test_the_mix_equals_brute_force(spark):
    rows = [(k, " ".join(w + "#" * (i % 5 < k % 4) for i, w in enumerate(sentence(k, k % 50).split())), [None, "a", "b", "c", "d"][k % 11 % 5]) for k in range(700)] + [(701, "x " * 300_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["taken"] for r in mixing.decisions(docs).collect()} == mix_by_force(rows, mixing.SEED)


# ------------------------------------------------------------------ LM scoring


def test_lm_scores(spark, odd_docs, empty_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 900)
    rows = [(k, " ".join(["the cat sat on the mat and the dog ran"] * 3) + " " + sentence(k, 30)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fold_of(F.col("doc_id"), 5) == 1
    model, counts = lm_scoring.fit(docs, ~out)
    c = Counter()
    held = {r["doc_id"] for r in docs.where(out).collect()}
    for k, t in rows:
        if k not in held:
            c.update([*t.lower().split(), ""])
    n, v = sum(c.values()), len(c)
    assert model.total == n and model.distinct == v
    for r in lm_scoring.score(docs, model, counts).collect():
        t = [*rows[r["doc_id"]][1].lower().split(), ""]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert -1e4 < r["score"] < 0
    odd = lm_scoring.score(odd_docs, model, counts)
    assert odd.count() == odd_docs.count()
    assert {r["n_tokens"] for r in odd.where("doc_id in (2, 3, 4)").collect()} == {1}
    assert lm_scoring.score(empty_docs, *lm_scoring.fit(empty_docs, F.lit(True))).count() == 0


def test_lm_probabilities_are_normalised_and_training_helps():
    rng = np.random.default_rng(0)
    head = [(f"w{k}".encode(), 1000 - k) for k in range(lm_scoring.VOCAB + 50)]
    m = lm_scoring.Model(head, 100, 10**6, 2000, np.full(lm_scoring.BUCKETS, 10.0), np.full(lm_scoring.BUCKETS, 3.0))
    first, last = lm_scoring.FIRST_NEAR, lm_scoring.FIRST_NEAR + 50
    assert len(m.entries) == last and len(set(m.group)) > 10
    every = np.concatenate((np.arange(lm_scoring._GROUP), np.arange(first, last)))  # every word, class and the end
    total = lambda: (10 ** m.log10_probabilities(every, np.full_like(every, 3), np.full_like(every, 5)).astype(float)).sum()
    assert total() == pytest.approx(1, abs=1e-4)
    ids = np.tile([1, 2, 3, first + 40, 5, 6, first + 45, 8], 2000)
    ids, h1, h2 = lm_scoring.contexts([ids])
    h1, h2 = m.entries[h1], m.entries[h2]
    before = m.log10_probabilities(ids, h1, h2).mean()
    for _ in range(60):
        lm_scoring.train_step(m, ids[:4096], h1[:4096], h2[:4096], rng)
    m._z = None
    assert m.log10_probabilities(ids, h1, h2).mean() > before + 0.5 and total() == pytest.approx(1, abs=1e-4)


def test_lm_words_are_told_apart_within_their_group_by_context():
    rng = np.random.default_rng(0)
    m = lm_scoring.Model([(f"w{k}".encode(), 1000) for k in range(lm_scoring.VOCAB + lm_scoring.GROUPS * 4)], 100, 10**6, 2000, np.full(lm_scoring.BUCKETS, 10.0), np.full(lm_scoring.BUCKETS, 3.0))
    one, two = lm_scoring.FIRST_NEAR, lm_scoring.FIRST_NEAR + 1
    assert m.group[0] == m.group[1]
    ids, h1, h2 = lm_scoring.contexts([np.tile([3, one, 9, two], 1024)])
    h1, h2 = m.entries[h1], m.entries[h2]
    for _ in range(300):
        lm_scoring.train_step(m, ids, h1, h2, rng)
    m._z = None
    score = lambda w, h: float(m.log10_probabilities(np.array([w]), np.array([h]), m.entries[np.array([two if h == 3 else one])])[0])
    assert score(one, 3) > score(two, 3) + 0.5 and score(two, 9) > score(one, 9) + 0.5


def test_lm_averaging_tree_narrows():
    assert [lm_scoring._levels(n) for n in (1, 16, 33, 300, 100_000)] == [[1], [1], [3], [19, 2], [6250, 391, 25, 2]]


def test_lm_parameters_are_averaged_by_steps():
    head = [(f"w{k}".encode(), 1000) for k in range(lm_scoring.VOCAB + 3)]
    tasks = [lm_scoring.Model(head, 1, 10, 10, np.zeros(lm_scoring.BUCKETS), np.zeros(lm_scoring.BUCKETS)) for _ in range(3)]
    for k, m in enumerate(tasks[1:]):
        m.near_steps = np.array([k, 3 * k + 1, 0.0])
        m.near_q = m.near_q + np.float32(k + 1)
        m.bias = m.bias + np.float32(k + 1)
    packed = sum(np.frombuffer(lm_scoring._pack(w, m), np.float32).astype(float) for w, m in zip((100, 300), tasks[1:]))
    *_, bias, near_q, near_bias = lm_scoring._unpack(packed, tasks[0])
    assert np.allclose(bias, tasks[0].bias + 1.75, atol=1e-4)
    assert np.allclose(near_q[:, 0], [2, 1.8, 0]) and np.allclose(near_bias, tasks[0].near_bias)


# ------------------------------------------------------------------ HTML, licences

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this thing now</div><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B&copy;</h1><p><b>First  para
graph.<br><p>Second <a href=x>link</a> text &lt;here&gt;.<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form>mail <input></form><aside>More</aside></article>
<div id="comments"><p>I like it</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "A & B©\nFirst para graph.\nSecond link text <here>.\none\ntwo\nc1\nc2"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text only"), (5, "u", PAGE[: PAGE.index("<table>")] + "<p>cut &amp; of<b"), (None, "u", "<p>a<p>b"), (1, "u", PAGE), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<body><nav><a>x</a></nav></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    found = {}
    for r in html_text.extract(df).collect():
        found[r["page_id"]] = r["text"]
        assert r["n_chars"] == len(r["text"])
    assert found == {1: want, 2: "", 3: "", 4: "plain text only", 5: "A & B©\nFirst para graph.\nSecond link text <here>.\none\ntwo\ncut & of", None: "a\nb", 6: "deep", 7: ""}
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.where("false")).count() == 0


def test_html_keeps_all_of_an_article_and_nothing_around_it():
    words = lambda n, w="word": " ".join([w] * n)
    parts = '<p class="related">rel</p><div class="legal notices">leg</div>x<math><mi>y</mi></math>z<p><label>name</label></p>'
    assert html_text.main_text(f"<article><p>{words(40)}</p>{parts}<div class=comments><p>no</p></div><p class='ad-slot'>buy</p></article>") == f"{words(40)}\nrel\nleg\nxyz\nname"
    stories = "<section><h2>Other</h2><ul>" + "<li><a href=x>Other story one</a></li>" * 5 + "</ul></section>"
    for one, two in (("<main><article>", "</article>"), ("<main><div>", "</div>"), ("<div class=page><div id=text>", "</div>")):
        page = f"<body><div><a href=/>Home</a> <a href=/b>B</a></div>{one}<h1>Title</h1><p>{words(80)}</p><p>{words(50, 'more')}</p>{two}{stories}</main></body>"
        assert html_text.main_text(page) == f"Title\n{words(80)}\n{words(50, 'more')}"
    assert html_text.main_text(f"<html><head><title>t</title><p>{words(30)}<p>second") == f"{words(30)}\nsecond"


def test_densities_equal_brute_force_on_pages_without_article():
    rng = np.random.default_rng(4)
    for _ in range(40):
        def grow(depth):
            tag = ["div", "p", "section", "span", "a", "ul"][int(rng.integers(0, 6))]
            inside = "".join(grow(depth - 1) if rng.random() < 0.6 and depth else " w" * int(rng.integers(0, 30)) for _ in range(int(rng.integers(1, 5))))
            return f"<{tag}>{inside}</{tag}>"

        tree = html_text.parse("<body>" + "".join(grow(3) for _ in range(4)) + "</body>")
        m = html_text.Measures(tree)
        n = len(tree.tags)
        under = lambda k: [j for j in range(n) if j != k and k in path(j)]
        path = lambda j: [j] + (path(tree.parents[j]) if tree.parents[j] >= 0 else [])
        own, stack = [0] * n, []
        for e in tree.events:
            if isinstance(e, str):
                own[stack[-1]] += len(e.replace(" ", ""))
            else:
                stack = [*stack, e] if e >= 0 else stack[:-1]
        linked = lambda k: "a" in [tree.tags[j] for j in path(k)]
        for k in range(n):
            below = [k, *under(k)]
            assert m.chars[k] == sum(own[j] for j in below) and m.tags[k] == len(below) - 1
            if tree.tags[k] != "a":
                assert m.link_tags[k] == sum(tree.tags[j] == "a" or linked(j) for j in below) - sum(linked(j) for j in [k]) * len(below) or linked(k)
                assert linked(k) or m.link_chars[k] == sum(own[j] for j in below if linked(j))
        dense = [k for k in range(1, n) if m.density[k] > 0]
        if dense:
            top = max(dense, key=lambda k: (m.density[k], -k))
            least = min(m.density[j] for j in path(top) if j >= m.body)
            sums = {k: sum(m.density[j] for j in range(n) if tree.parents[j] == k) for k in range(1, n) if m.density[k] >= least}
            best = max(sums, key=lambda k: (sums[k], m.density[k], -k))
            assert best in [j for j in under(html_text.article(tree))] + [html_text.article(tree)]


@pytest.mark.parametrize("page", ["<a" * 5_000_000, "<p>" + "<b></i>" * 1_400_000, "<a \">'" * 1_600_000, "<script>" + "</script" * 1_200_000, "&#" * 5_000_000, "<b>" * 1_000_000 + "</i>" * 1_000_000], ids=range(6))
def test_hostile_pages_of_ten_megabytes(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 60


def licences_by_force(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    places = [(i, name) for phrase, name in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({n for _, n in places})))


def labels_by_force(rows):
    """Labels of each text: every template tried at every start."""
    L, out = license_scan, {}
    w = {d: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for d, t in rows}
    idf = {x: math.log((len(rows) + 1) / (sum(x in set(v) for v in w.values()) + 0.5)) + 1e-6 for x in L.VOCABULARY}
    for d, v in w.items():
        found, best = {name for phrase, name in L.BASE.items() for i in range(len(v)) if v[i : i + len(phrase.split())] == phrase.split()}, 0.0
        best = 1.0 if found else 0.0
        for t in L._TEMPLATES:
            order = sorted(set(t.words), key=lambda x: (-idf[x], x))
            chosen = {x for x in order if idf[x] >= L.LEAST_IDF}
            chosen = chosen if len(chosen) >= L.AGREE else set(order[: L.AGREE])
            at = [(p, x) for p, x in enumerate(t.words) if x in chosen]
            for s in range(-len(t.words), len(v)):
                here = [idf[x] for p, x in at if 0 <= s + p < len(v) and v[s + p] == x]
                if len(here) >= min(L.AGREE, len(at)) and s + t.offset >= 0 and v[s + t.offset : s + t.offset + len(t.key)] == t.key:
                    found.add(t.label)
                    best = max(best, sum(here) / sum(idf[x] for _, x in at))
        out[d] = (",".join(sorted(found)), best)
    return out


def test_labels_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        label, text, key = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)]
        w = license_scan.split(text)
        w = w[int(rng.integers(0, 4)) :] if k % 3 else w
        w = [x if rng.random() > 0.05 * (k % 4) else "zz" for x in w]
        rows.append((k, sentence(k, 20) + " " + " ".join(w) + " software fee " + sentence(k + 100, 10)))
    rows += [(100, " ".join(license_scan.VOCABULARY)), (101, None), (102, "license " * 50)]
    want = labels_by_force(rows)
    assert len({x for x, _ in want.values()}) > 10
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: x for d, (x, _) in found.items()} == {d: x for d, (x, _) in want.items()}
    assert all(found[d][1] == pytest.approx(min(1, want[d][1])) for d in want)


def test_long_texts_of_licence_words_alone(spark):
    text = "free charge granted software " * 200_000 + "All rights reserved."
    r = license_scan.scan(spark.createDataFrame([(1, text), (2, "mit license " * 100_000)], "doc_id long, text string")).collect()
    assert (r[0]["n_words"], r[0]["n_base"], r[0]["labels"]) == (800_003, 1, "reserved") and "mit" not in r[0]["labels"]


def test_licences(spark, odd_docs, empty_docs):
    texts = {
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3. All rights reserved. all  RIGHTS-reserved": "gpl,reserved",
        "x\nLicensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "noninfringement merchantability tort. Reworded, but: released under our usual MIT License, as before. furnished sublicense": "mit",
        "the mit of a license": "",
        "general public licenses": "",
        "cc by cc by": "cc-by",
        sentence(5, 60): "",
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for df in (docs, odd_docs):
        given = {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").collect()}
        for r in license_scan.scan(df).where("doc_id is not null").collect():
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == licences_by_force(given[r["doc_id"]])
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
            assert r["labels"] == texts.get(given[r["doc_id"]], "") and (r["score"] > 0) == bool(r["labels"])
    assert license_scan.scan(odd_docs).count() == odd_docs.count() and license_scan.scan(empty_docs).count() == 0

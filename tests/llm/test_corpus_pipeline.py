import corpus_pipeline

import random

from pyspark.sql import functions as F

from tidemark.llm import mixing

from .conftest import sentence
from .test_documents import mix_by_force, verdict_by_force
from .test_pairs import components_by_force, cut_by_force, edited, shingles

CLEAN = "The house of the garden and the river is in a town that "


def test_stages_and_run(spark, tmp_path):
    line = "shared passage " + sentence(900, 60)
    leak = sentence(901, 40)
    rows = [(k, CLEAN + sentence(k, 90), "en", f"s{k % 3}") for k in range(40)]
    rows += [(50, rows[1][1], "en", "s0"), (51, rows[2][1] + " tail", "en", "s1")]
    rows += [(60, CLEAN + sentence(60, 70) + "\n" + line, "en", "s0"), (61, line + "\n" + CLEAN + sentence(61, 70), "en", "s1")]
    rows += [(70, CLEAN + sentence(70, 70) + " " + leak, "en", "s2"), (71, " ".join(w + "###" for w in sentence(71, 90).split()), "en", "s0"), (72, "short", "en", "s0")]
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        left.append({r["doc_id"]: r for r in docs.collect()})
    good = set(range(40)) | {50, 51, 60, 61, 70}
    assert set(left[0]) == good
    assert set(left[1]) == good - {50, 51}
    assert line in left[2][60]["text"] and line not in left[2][61]["text"] and left[2][61]["n_chars"] == len(left[2][61]["text"])
    assert set(left[3]) == set(left[2]) - {70}
    assert set(left[4]) <= set(left[3]) and all(0 < r["mix_taken"] <= 3 * r["mix_size"] for r in left[4].values())
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def pipeline_by_force(rows, items):
    """(doc_id, text, lang, source) -> doc_id -> (text, words, words taken), stage by stage."""
    kept, _ = verdict_by_force([r[:3] for r in rows])
    rows = [r for r in rows if kept[r[0]]]
    rows = [r for r, (d, _, component) in zip(rows, components_by_force([r[:2] for r in rows])) if d == component]
    rows = [(d, t, *rest) for (d, _, *rest), t in zip(rows, cut_by_force([r[:2] for r in rows]))]
    rows = [r for r in rows if not any(q and len(q & shingles(r[1])) >= 0.75 * len(q) for q in map(shingles, items))]
    taken = mix_by_force([(d, t, s) for d, t, _, s in rows], mixing.SEED)
    return {d: (t, len(t.split()), taken[d]) for d, t, _, s in rows if taken[d]}


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    passage, items = sentence(900, 70), [sentence(901, 40), sentence(902, 12), None, ""]
    rows = [(k, CLEAN + sentence(k, rng.choice([40, 90, 200])), ["en", "de"][k % 2], [None, "a", "b"][k % 3]) for k in range(90)]
    rows += [(100 + k, edited(rows[k][1], rng.choice([0, 0.01, 0.05]), rng), "en", "a") for k in range(20)]
    rows += [(200 + k, f"{CLEAN}{sentence(200 + k, 60)} {passage}\n{sentence(300 + k, 30)}", "en", "b") for k in range(6)]
    rows += [(300 + k, f"{CLEAN}{sentence(400 + k, 60)} {items[k % 2]} end", "de", "a") for k in range(6)]
    rows += [(400, None, "en", "a"), (401, "", None, None), (402, " ".join(w + "###" for w in sentence(71, 90).split()), "en", "a"), (403, CLEAN + sentence(403, 40_000), "en", "b")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: (r["text"], r["mix_size"], r["mix_taken"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = pipeline_by_force(rows, items)
    assert found == want and 50 < len(want) < 110


def test_stages_on_odd_rows(spark, odd_docs, empty_docs, tmp_path):
    """Nulls, empties, ties, repeated rows, a long text, clashing names; then no rows at all."""
    spark.createDataFrame([(1, sentence(500, 30)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clashing = odd_docs.withColumns({c: F.lit("x") for c in ("id", "row", "h", "gone", "__id", "__m", "kept_spans", "mix_size")})
    given = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clashing, str(tmp_path))
        wanted = clashing.columns if name != "mixing sources" else [*[c for c in clashing.columns if c != "mix_size"], "mix_size", "mix_taken"]
        assert out.columns == wanted, name
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= {d for d, _ in given} and {r["row"] for r in rows} <= {"x"}, name
        assert stage(spark, empty_docs, str(tmp_path)).count() == 0, name

import pytest

WORDS = "amber basil cedar delta ember fjord grove haven inlet jolly kayak lemon mango noble ocean pearl quilt river stone tulip umbra vivid willow xenon yacht zebra".split()


def sentence(k: int, n: int) -> str:
    """n words that hardly repeat in a row, a different run for each k."""
    out, x = [], k * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x // 65536 % 26] + str(x // 1024 % 97))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, ties, repeated rows, a long text, and extra columns with clashing names."""
    long = "\n".join(sentence(k, 40) for k in range(100))
    rows = [
        (1, sentence(1, 80), "en", "a", 5), (1, sentence(1, 80), "en", "a", 5), (2, None, "en", "b", 0), (3, "", None, None, 0), (4, "  \n\t ", "de", "a", 5), (None, sentence(2, 60), "en", "a", 9),
        (None, None, None, None, None), (5, "one", "en", "c", 3), (6, sentence(1, 80), None, "b", 5), (7, long, "de", "a", len(long)), (8, "été … ñandú", "fr", None, 3), (9, "12 34 !!", "en", "c", 3), (10, sentence(3, 70) + "\n" + sentence(4, 70), "de", "b", 1),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ["s", "n", "score", "size", "taken", "key", "lines", "kept", "component_id", "lang_pred", "row", "word"]
    return base.selectExpr("*", *[f"'x' as `{c}`" for c in clashes])


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("false")

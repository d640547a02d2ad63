import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ["row", "digest", "key", "size", "h", "epoch", "kept", "spans", "node", "cell", "score", "held_out", "keep_id", "target", "start", "n"]

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def odd_rows():
    """Nulls, empty and blank texts, ties, repeats, copies that differ in white space, a very long word and text."""
    words = BASE.split()
    return [
        (1, BASE, "en", "a"), (2, BASE.replace(" ", "\t\n "), "en", "a"), (3, " ".join(words[:-1]), "en", None),
        (4, None, None, None), (5, "", "en", "b"), (6, " \t\n", "en", "b"), (7, "one", "de", "b"), (8, "one", "de", "c"),
        (None, BASE, "en", "a"), (None, None, None, None), (9, "x" * 50_000, "en", "c"), (9, "x" * 50_000, "en", "c"),
        (10, " ".join(words[k % 24] + str(k // 240) for k in range(20_000)), "en", "a"), (11, "é ñ 語 😀 ▁   \x1c a", None, "d"),
        (12, BASE.upper(), "en", "a"), (13, "mail bob@x.org or 1.2.3.4 or +1 (555) 010-9999", "en", "d"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), *["clash"] * len(CLASHES)) for i, t, lang, s in odd_rows()]
    return spark.createDataFrame(rows, COLUMNS + "".join(f", {c} string" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"

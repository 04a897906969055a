"""Levels of plain, middling and hard prose; what is no prose; held-out order."""

import numpy as np

from tracewright.llm import reading as R
from tracewright.llm.graded import PASSAGES

EASY = "The dog ran to the big red box. My old list has a bad link. We like the new page and it is fast. "
MIDDLE = "The parser forwards the duplicate response before the scheduler starts. If a document is invalid, the manager should replace it and keep the default setting. "
HARD = "Insofar as the architectural configuration of the polymorphic alternative presupposes the corresponding representation, any probabilistic methodology cannot adequately guarantee the canonicalization of every deterministic infrastructure, thereby propagating its reconciliation. "
CODE = "```py\ndef f(x):\n    return x\n```\n"


def corpus(seed=1, n=120):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = (EASY, MIDDLE, HARD)[i % 3]
        s = base.split(". ")[:-1] if base is not HARD else [HARD.strip().rstrip(".")]
        rows.append((i, ". ".join(rng.choice(s) for _ in range(30 if base is not HARD else 8)) + ".", i % 3))
    return rows


def test_bands(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, band string")
    got = {r["doc_id"]: r["band"] for r in R.reading_levels(df).collect()}
    assert all(got[i] == ("basic", "intermediate", "advanced")[k] for i, _, k in rows)


def pair_share(score, years):
    pairs = [(i, j) for i in range(len(years)) for j in range(len(years)) if years[j] - years[i] >= R.PAIR_GAP]
    return np.mean([score[i] < score[j] for i, j in pairs])


def test_held_out_passages():
    """Every second passage trains; the order of the others, which the ranker never saw, is right."""
    train, test = R.graded_rows(PASSAGES[::2]), R.graded_rows(PASSAGES[1::2])
    model = R.fit_levels(*train)
    assert pair_share(model.score(test[0]), test[1]) > 0.93
    assert np.mean([R.band(g) == R.band(y) for g, y in zip(model.grade(test[0]), test[1])]) > 0.85


def test_the_ranker_decides():
    """Without what it learned from pairs nothing is told apart; sentence length alone ranks worse."""
    x, years = R.graded_rows()
    model = R.fit_levels(x, years)
    blind = R.fit_levels(x, np.zeros(len(years)))
    assert not blind.weights.any() and len({R.band(g) for g in blind.grade(x)}) == 1
    assert pair_share(model.score(x), years) > pair_share(x[:, 0], years)


def test_grades_are_no_function_of_the_features():
    """Passages of one year differ in features; passages alike in length of sentence differ in year."""
    x, years = R.graded_rows()
    assert len({tuple(r) for r in x[years == years[0]]}) > 1
    assert 0.5 < np.corrcoef(x[:, 0], years)[0, 1] < 0.97


def test_what_has_no_level():
    assert R.measures(None) is None and R.measures("") is None and R.measures("short text.") is None
    assert R.measures(CODE * 60) is None
    assert R.measures("# A heading with many words in it\n" * 60) is None
    assert R.measures("Le journal ne bloque plus le service et la page est dans une autre langue pour tous. " * 12) is None
    assert R.measures("- " + "\n- ".join([EASY.split(". ")[0]] * 20)) is not None


def test_code_beside_prose_doesnt_count():
    plain, mixed = R.measures(EASY * 8), R.measures(EASY * 4 + "\n\n" + CODE + "\n" + EASY * 4)
    assert np.allclose(plain, mixed)


def test_isotonic():
    assert R.isotonic(np.array([1.0, 3.0, 2.0, 4.0])).tolist() == [1.0, 2.5, 2.5, 4.0] and R.isotonic(np.array([])).tolist() == []


def test_frame(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, EASY * 8), (3, EASY * 8)], "doc_id long, text string")
    assert [r["doc_id"] for r in R.reading_levels(df).collect()] == [3]
    assert R.reading_levels(df.limit(0)).count() == 0

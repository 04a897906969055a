"""Defects of answers on planted cases."""

import random
import time

from tracewright.llm import answers as A
from tracewright.llm.common import bounded_sample

PROMPT = "Write a short description of this pull request for reviewers.\n\nTitle: Report duplicate retry in the parser\n\nFiles:\n- a/b.py (modified, +1/-2): restore the hidden record"
GOOD = [
    "The parser now reports each duplicate retry before the reader starts.",
    "The parser now reports each duplicate retry before the reader starts",
    "I cannot reproduce the crash on main, so this only adds a log line. The parser now logs it.",
    "Typo fix in the parser.",
    "```\nreturn x\n```",
]
BAD = {
    "empty": [None, "", "  \n", "​", "N/A", "<!-- -->", "### Summary\n\n### Key Changes\n", "{}", "```\n```", "null", "-"],
    "refusal": ["I'm sorry, but I can't help with that request.", "As a language model, I am unable to do this.", '{"error": "content could not be generated"}', "No answer: the model declined the task.", "<refused>"],
    "copied": ["Report duplicate retry in the parser", "> RESTORE THE HIDDEN RECORD", "Description: restore the hidden record"],
    "other_language": ["Le journal ne bloque plus le service et il est plus rapide.", "Die Anmeldung wurde schneller und wartet nicht auf die Sperre.", "この変更は正しい日付を再び表示します。"],
    "truncated": ["The parser now reports each duplicate retry before the", "This adds three things: first,", "It works.\n\n```\nreturn (x", "Done.\n### Key Changes\n\n-", "Rename `a_b"],
}


def model():
    base = ["The {0} now reports each {1} retry before the {2} starts.", "This moves the {1} record into the {0} and lets the {2} report any row.", "When the {0} finds a {1} row, it merges the record and reports the {2}."]
    words = ["parser", "reader", "writer", "cache", "queue"]
    return A.fit_terminal_model([b.format(a, m, z) for b in base for a in words for z in words for m in ("hidden", "stale", "duplicate")])


def test_defects():
    m, copies = model(), A.Copies(PROMPT)
    for text in GOOD:
        assert A.defect_of(text, copies, "en", m) is None, text
    for kind, texts in BAD.items():
        for text in texts:
            assert A.defect_of(text, copies, "en", m) == kind, (kind, text)


def test_request_language():
    assert A.request_language(PROMPT) == "en"
    assert A.request_language("Beschreibe diesen Pull Request kurz und nur mit den Angaben unten.\n") == "de"


def test_frame(spark):
    schema = "generation_id long, prompt string, description string, file_summaries array<struct<filename:string,summary:string>>, defect int"
    rows = [(1, PROMPT, None, None, 1), (1, PROMPT, None, None, 1), (2, PROMPT, GOOD[0], [("a.py", ""), ("b.py", GOOD[0])], 2), (3, None, "x" * 50_000 + ".", [], 3)]
    got = {tuple(r) for r in A.find_defects(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "", "empty"), (2, "a.py", "empty")}
    assert A.find_defects(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, sf):
    assert {r["defect"] for r in A.p2_found(spark, sf).collect()} <= {"empty", "refusal", "copied", "other_language", "truncated"}


def test_long_refusals():
    refusal = "I'm sorry, but I can't help with that request."
    assert A.is_refusal(refusal) and A.is_refusal(" ".join([refusal] * 60))
    assert not A.is_refusal(" ".join([refusal] + ["The change adds a parser for dates."] * 60))
    assert not A.is_refusal('{"description": "' + "The parser cannot read dates. The change adds a parser. It is tested. " * 40 + '"}')
    assert A.is_refusal('{"description": "' + (refusal + " ") * 60 + '"}')


def test_the_ratio_decides_what_is_copied():
    """Words of the request in another order have no new word, yet are no copy: only the compression tells."""
    words = "the parser reads a hidden record before any writer starts and reports each duplicate retry to the queue so that nobody waits for it".split()
    copies = A.Copies("Title: " + " ".join(words))
    mixed = words[::-1]
    assert copies.made_of(" ".join(words)) and not copies.made_of(" ".join(mixed))
    copies.share = lambda bare: 0.0
    assert copies.made_of(" ".join(mixed))


def test_long_answers_take_time_in_proportion():
    rng = random.Random(1)
    words = [f"w{rng.randrange(3000)}" for _ in range(100_000)]
    began = time.perf_counter()
    copies = A.Copies(" ".join(words))
    assert copies.made_of(" ".join(words)) and not copies.made_of(" ".join(rng.sample(words, len(words))))
    A.is_refusal("I am sorry " + " ".join(words))
    assert time.perf_counter() - began < 5


def test_more_refusals_and_none():
    for t in ("I am not able to write a description for this change.", "Unfortunately there is nothing I can do here.", "Please provide the diff so that I can summarize it.", "Lo siento, no puedo resumir este cambio.", "Leider kann ich diese Änderung nicht beschreiben.", '{"summary": "Unable to comply."}'):
        assert A.is_refusal(t), t
    for t in ("The server now refuses requests without a token.", "Users cannot delete the summary any more.", "The parser is unable to read dates, so this adds one.", "I removed the cache. It did not help.", "Reject content that the filter has not seen."):
        assert not A.is_refusal(t), t


def test_more_languages():
    for code, t in (("sv", "Tjänsten skriver inte längre tomma rader och den är snabbare."), ("cs", "Služba už nepíše prázdné řádky a je rychlejší, aby se nic neztratilo."), ("tr", "Servis artık boş satır yazmıyor ve bu değişiklik daha hızlı."), ("pl", "Usługa nie zapisuje już pustych wierszy i jest szybsza.")):
        assert A.language(t) == code, (t, A.language(t))


def test_the_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id AS k", "cast(id as string) AS t")
    some = [sorted(r["k"] for r in bounded_sample(df.repartition(n), "k", 50).collect()) for n in (1, 7)]
    assert some[0] == some[1] and len(some[0]) == 50
    assert bounded_sample(df, "k", 1000).count() == 500 and bounded_sample(df.limit(0), "k", 5).count() == 0

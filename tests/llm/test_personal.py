"""Personal items: planted ones, look-alikes, placeholders, skip edges."""

import re

from tracewright.llm import drawn as D
from tracewright.llm import personal as P

UNCLEAR = [
    ("Rowan Fielding, again", "Reviewed-by: Rowan Fielding"),
    ("Amber Falcon gave the hint.", "Signed-off-by: Amber Falcon <amber.falcon@mail.example.org>"),
]

CASES = {
    "Reviewed-by: Emil A. Perriyemi": {("name", "Emil A. Perriyemi")},
    "Cc: koskenqvarn [at] fernhouse [dot] example": {("email", "koskenqvarn [at] fernhouse [dot] example")},
    "Her social security number 000 83 8642 was printed on the badge.": {("id_number", "000 83 8642")},
    "Please ask Tariq Lindasan (+49 30 23125 977) before the rollout.": {("name", "Tariq Lindasan"), ("phone", "+49 30 23125 977")},
    "Delivery to 39 Cooper's Crescent fails with a 422.": {("address", "39 Cooper's Crescent")},
    "address_line1: Rua dos Herreros, 102": {("address", "Rua dos Herreros, 102")},
    "Reported-by: ingrid brightinova <brightinova67@post.tidehall.test>": {("name", "ingrid brightinova"), ("email", "brightinova67@post.tidehall.test")},
    "Clone with git@code.example:team55/tool.git first.": set(),
    "Pinned @kelp/argument@2.89.1 in the manifest.": set(),
    "The Dark Banner screen still shows the old total.": set(),
    "Ping @team-x when the Victoria Layout flag is on.": set(),
    "See 12 Road map items for the next release.": set(),
    "Started at 1699291471 on host 192.0.2.71.": set(),
    "Run 4471-5567 finished in 54 ms.": set(),
    "": set(),
}


def test_cases():
    field = P.fitted_field()
    for text, want in CASES.items():
        assert {(k, text[a:b]) for k, a, b in field.items(text)} == want, text


def test_repeats_flip_an_unclear_place():
    """Two planted cases that a skip edge decides: without it the unclear place is told wrongly."""
    field = P.fitted_field()
    alone = P.Field({k: v for k, v in field.weights.items() if not k.startswith("skip:")}, field.lexicon)
    for unclear, clear in UNCLEAR:
        text = f"{unclear}\n\n{clear}"
        found = lambda crf: [text[a:b] for k, a, b in crf.items(text) if a < len(unclear)]
        assert found(field) and not found(alone), unclear


def test_held_out_frames():
    """Frames that the fit has not seen, filled with fresh items."""
    field = P.fitted_field(documents=2500, held_out=2)
    frames, decoys = D.FRAMES[2::5], D.LOOKALIKES[2::5]
    hit = gold = found = 0
    for nodes, y, text in P._examples(field.lexicon, 400, 77, frames, decoys):
        want, got = {(n.start, n.end) for n, k in zip(nodes, y) if k}, {(a, b) for _, a, b in field.items(text)}
        hit, gold, found = hit + len(want & got), gold + len(want), found + len(got)
    assert hit / gold > 0.9 and hit / found > 0.9, (hit / gold, hit / found)


def test_names_off_the_lists():
    field = P.fitted_field()
    for name in ("Gareth Pritchard", "Xochitl Ramirez-Ortega", "Nguyễn Văn An", "Yevgenia Tkachenko", "Bartholomew Quill"):
        assert name.split()[0].lower() not in P.GIVEN
        for frame in ("Reviewed-by: {}", "I talked to {} about it.", "{} said that it fails."):
            text = frame.format(name)
            assert [text[a:b] for k, a, b in field.items(text) if k == "name"] == [name], text
    assert [(k, a) for k, a, _ in field.items("Reported-by: 王小明")] == [("name", 13)]
    assert [k for k, _, _ in field.items("Her NHS number 943 476 5919 was shown, she lives at 22 Acacia Mansions.")] == ["id_number", "address"]


def test_no_frame_is_taken_from_the_tables(sf):
    import duckdb

    con = duckdb.connect()
    texts = [r[0] for t, c in (("commits", "message"), ("issues", "body"), ("pull_requests", "body")) for r in con.execute(f"SELECT {c} FROM '{sf}/{t}.parquet' WHERE {c} IS NOT NULL").fetchall()]
    whole = "\n".join(texts)
    for frame in (*D.FRAMES, *D.LOOKALIKES):
        for part in re.split(r"\{\w\}|\\n", frame):
            assert len(part.split()) < 4 or part not in whole, frame


def test_placeholders_leave_the_rest():
    text = "Mr Jonas Tarnbrekke moved to 35 Weaver Lane last month.\r\n"
    assert P.mask(text, P.fitted_field().items(text)) == "Mr [NAME] moved to [ADDRESS] last month.\r\n"


def test_frame(spark):
    rows = [("a", "Reviewed-by: Mateo Solorno", "x"), ("a", "Reviewed-by: Mateo Solorno", "x"), ("b", None, None), ("c", "", None), (None, "x " * 60_000, None)]
    df = spark.createDataFrame(rows, "node_id string, text string, kind string")
    assert {tuple(r) for r in P.find_items(df).collect()} == {("a", "name", "Mateo Solorno")}
    masked = [r["text"] for r in P.mask_items(df).collect()]
    assert masked[0] == "Reviewed-by: [NAME]" and masked[2] is None and masked[3] == ""
    assert P.find_items(df.limit(0)).count() == 0


def test_query(spark, sf):
    assert {r["kind"] for r in P.p3_found(spark, sf).collect()} <= set(P.KINDS)

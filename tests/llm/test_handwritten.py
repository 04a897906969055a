"""Kinds of files, and winnowing against a plain version."""

import random

from tracewright.llm import handwritten as H


def patch(lines, sign="+"):
    return "@@ -0,0 +1,%d @@\n" % len(lines) + "\n".join(sign + x for x in lines)


HAND = ["def load(x):", "    # checks that files marked @generated are skipped", "    return x + 1", "TEMPLATE = \"// Code generated by {tool}. DO NOT EDIT.\""]


def test_kinds():
    cases = {
        ("src/a.py", patch(HAND)): None,
        ("src/minimap/min_heap.py", patch(HAND)): None,
        ("lib/third_rail/vendor_list.go", patch(["func A() int {", "\treturn 1", "}"])): None,
        ("yarn.lock", None): "generated",
        ("api/x_pb2.py", "[Patch not available]"): "generated",
        ("src/a.go", patch(["// Code generated by protoweave v1. DO NOT EDIT.", "var x = 1"])): "generated",
        ("a/b.js", patch(["// Datei automatisch erzeugt mit rpcloom, nicht von Hand ändern", "let x;"])): "generated",
        ("a/b.py", patch([f"    self.field_{i} = get('f{i}')" for i in range(12)])): "generated",
        ("web/static/a.min.js", ""): "minified",
        ("a/b.js", patch(["!function(e,t){" + "var a=b.c(d);if(!e)return f;" * 20 + "}"])): "minified",
        ("vendor/tinyrange/x.go", None): "vendored",
        ("src/tabkit.js", patch(["// tabkit v1.2.3 | (c) 2012 the tabkit authors | MIT License", "let x = 1;"])): "vendored",
        ("src/t.py", patch(["X = ["] + ["    57.3345, -64.3866, -85.7971, 2.3804,"] * 8 + ["]"])): "data_blob",
        ("web/img/a.png", patch(["x"])): "-",
        (None, None): None,
    }
    for (path, text), want in cases.items():
        assert H.kind_of(path, text) == want, path


def test_shared_runs_share_prints():
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    whole, part = " ".join(words), "X " + " ".join(words[150 : 150 + H.K + H.WINDOW]) + " y"
    a, b, c, d = H.fingerprints([whole, part, " ".join(reversed(words)), ""])
    assert set(a.tolist()) & set(b.tolist()) and not set(a.tolist()) & set(c.tolist()) and len(d) == 0
    assert sorted(H.fingerprints([whole])[0].tolist()) == sorted(a.tolist())
    assert set(H.fingerprints([whole.upper().replace(" ", "\n  ")])[0].tolist()) == set(a.tolist())


def test_copies_without_a_note(spark):
    rng = random.Random(2)
    body = lambda s: [f"    value_{s}_{rng.choice('abcdefgh')} = call({rng.choice('uvwxyz')}, key) or other" for _ in range(40)]
    lib = [x.replace("_lib_", "_") for x in body("lib")]
    rows = [(i, f"owner{i}/r", f"src/f{i}.py", patch(lib)) for i in range(3)] + [(9, "owner9/r", "src/own.py", patch(body("own"))), (9, "owner9/r", "src/own.py", patch(body("own"))), (10, "o/r", None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id long, repo string, path string, patch string, kind string")
    assert {tuple(r) for r in H.find_not_handwritten(df).collect()} == {(0, "vendored"), (1, "vendored"), (2, "vendored")}
    assert H.find_not_handwritten(df.limit(0)).count() == 0


def test_short_copies_without_a_note(spark):
    """Copies of which a patch shows too little for four fingerprints, or for one."""
    rng = random.Random(4)
    line = lambda: f"    {rng.choice('abcdefgh')}{rng.randrange(900)} = call({rng.choice('uvwxyz')}{rng.randrange(900)}, key) or other"
    middle, little = [line() for _ in range(4)], [line(), line()]
    rows = [(i, f"owner{i}/r", f"src/f{i}.py", patch(middle)) for i in range(3)] + [(10 + i, f"owner{i}/r", f"src/g{i}.py", patch(little, " ")) for i in range(3)]
    rows += [(20 + i, f"owner{i}/r", f"src/h{i}.py", patch(["}", "return"])) for i in range(3)] + [(30 + i, f"owner{i}/r", f"src/k{i}.py", patch([line() for _ in range(2)])) for i in range(3)]
    rows += [(40 + i, "owner0/r", f"src/m{i}.py", patch([x.upper() + "1" for x in middle])) for i in range(3)]
    prints, wholes = H.prints_and_wholes([H.shown(r[3]) for r in rows])
    assert 1 <= len(prints[0]) < H.LEAST and wholes[0] is None and wholes[3] is not None and wholes[6] is None
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, patch string")
    assert {tuple(r) for r in H.find_not_handwritten(df).collect()} == {(i, "vendored") for i in (0, 1, 2, 10, 11, 12)}


def test_a_hot_fingerprint_is_broadcast(spark, monkeypatch):
    """The same answer whether the recurring prints are broadcast or joined; without fingerprints no copy is known."""
    rng = random.Random(6)
    body = [f"    {rng.choice('abcdefgh')}{rng.randrange(900)} = call({rng.choice('uvwxyz')}{rng.randrange(900)}, key) or other" for _ in range(30)]
    rows = [(i, f"owner{i % 9}/r", f"src/f{i}.py", patch(body)) for i in range(150)]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, patch string")
    assert {tuple(r) for r in H.find_not_handwritten(df).collect()} == {(i, "vendored") for i in range(150)}
    monkeypatch.setattr(H, "HEAVY", 1)
    assert {tuple(r) for r in H.find_not_handwritten(df).collect()} == {(i, "vendored") for i in range(150)}
    assert H.find_not_handwritten(df, owners=10).count() == 0


def test_query(spark, sf):
    assert {r["kind"] for r in H.p4_found(spark, sf).collect()} <= {"generated", "minified", "vendored", "data_blob"}

"""The queries of the training-text operators and their SQL."""

from __future__ import annotations

from tracewright.llm import answers, consensus, handwritten, leakage, packing, personal, reading, splitting

_QUERIES = {
    "p1_found": consensus.p1_found,
    "p1_consensus": consensus.p1_consensus,
    "p1_raters": consensus.p1_raters,
    "p2_found": answers.p2_found,
    "p3_found": personal.p3_found,
    "p3_masked": personal.p3_masked,
    "p4_found": handwritten.p4_found,
    "p5_found": splitting.p5_found,
    "p5_pieces": splitting.p5_pieces,
    "p5_rebuilt": splitting.p5_rebuilt,
    "p6_assignment": packing.p6_assignment,
    "p6_use": packing.p6_use,
    "p7_found": leakage.p7_found,
    "p7_clean": leakage.p7_clean,
    "p8_found": reading.p8_found,
}

_SQL = {"p5_found": splitting.P5_FOUND_SQL, "p5_rebuilt": splitting.P5_REBUILT_SQL}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

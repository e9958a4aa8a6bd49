from __future__ import annotations

import random

from meritpool.llm import line_dedup
from tests.llm.helpers import docs_frame


def plain(rows, run):
    """Cuts runs that stand earlier in (doc_id, place); one row for each document."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    keep = {}
    for i in order:
        doc, text = rows[i]
        lines = (text or "").split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for at in range(len(solid) - run + 1):
            key = tuple(lines[k].strip(" ") for k in solid[at : at + run])
            if seen.setdefault(key, (doc, at)) != (doc, at):
                gone |= set(solid[at : at + run])
        keep[i] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((doc, keep[i], 0 if text is None else len(lines), len(gone)))
    return sorted(out, key=str)


def got(spark, rows, run):
    found = line_dedup.dedup_rows(docs_frame(spark, rows, extra=True), run)
    return sorted((tuple(r) for r in found.select("row.doc_id", "kept", "n_lines", "n_removed").collect()), key=str)


def test_against_plain_version(spark):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(25)] + ["", "  ", " pad ", "pad", "\t"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 14)))) for i in range(120)]
    shared = "\n".join(rng.choices(pool, k=9))
    rows += [(200 + i, f"own {i}\n{shared}\nend {i}") for i in range(12)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, shared), (303, "\n".join(["same"] * 12)),
             (304, "\n".join(f"x{i % 700}" for i in range(3000)))]
    for run in (2, 3, 5):
        assert got(spark, rows, run) == plain(rows, run)


def test_rows_of_one_document_do_not_repeat_each_other(spark):
    text = "a\nb\nc\nd"
    assert got(spark, [(1, text), (1, text)], 3) == [(1, text, 4, 0)] * 2
    assert got(spark, [], 3) == []


def test_dedup_keeps_columns_and_names(spark):
    docs = docs_frame(spark, [(1, "a\nb\nc"), (2, "x\na\nb\nc")], extra=True)
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a\nb\nc", 2: "x"}


def test_runs_no_python(spark):
    plan = line_dedup.dedup_rows(docs_frame(spark, [(1, "a\nb\nc")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

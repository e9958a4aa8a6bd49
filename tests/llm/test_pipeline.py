from __future__ import annotations

import random

import corpus_pipeline
from meritpool.llm import pieces, quality, simhash
from meritpool.llm.frames import ship
from meritpool.llm.queries import PIECES
from tests.llm.helpers import ODD, docs_frame, labels_frame, sentence
from tests.llm.test_decontamination import brute
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain_components


def test_stages_against_plain_versions(spark, tmp_path):
    ship(spark)
    rng = random.Random(4)
    items = [(i, sentence(rng, "de", 30)) for i in range(5)]
    rows = [(i, sentence(rng, n=rng.randint(60, 200)).replace(" a", "\na")) for i in range(120)]
    rows += [(200 + i, " ".join(f"{w}###" for w in sentence(rng).split())) for i in range(60)]
    rows += [(300 + i, rows[i][1]) for i in range(6)]
    rows += [(400 + i, f"{sentence(rng)} {items[i][1]} {sentence(rng)}") for i in range(5)]
    rows += [(500 + i, f"own {i}\nfirst shared line\nsecond shared line\nthird shared line\n{sentence(rng)}") for i in range(5)]
    folder = str(tmp_path)
    docs_frame(spark, rows + ODD, extra=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(30)]
    labels_frame(spark, labels).write.parquet(f"{folder}/labels.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [(r.doc_id, r.text) for r in quality.keep(docs, model).collect()]
    assert 0 < len(left) < len(rows) + len(ODD) and not any(d is not None and 200 <= d < 260 for d, _ in left)
    left = [(d, t) for d, t, _, _ in plain_lines(left, 3)]
    first = {(d, c) for d, _, c in plain_components(left) if d == c}
    left = [(d, t) for d, t in left if (d, d) in first]
    dirty = {d for d, _ in brute(items, left)}
    left = [(d, t) for d, t in left if d not in dirty]
    assert {400, 401, 402, 403, 404} <= dirty

    out = corpus_pipeline.run(spark, folder)
    vocabulary = pieces.read_model(PIECES)
    got = sorted(((r.doc_id, pieces.decode(vocabulary, r.ids)) for r in out.collect()), key=str)
    assert got == sorted(((d, t or "") for d, t in left), key=str)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    folder = str(tmp_path)
    docs_frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "an item of words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels_frame(spark, []).write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes and out.collect() == []
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_keep_first_rows(spark):
    ship(spark)
    text = "one two three four five"
    rows = [(3, text), (1, text), (1, text), (None, text), (7, "other words stand in here"), (None, "a b c d"), (9, None), (8, "")]
    kept = simhash.keep_first(docs_frame(spark, rows, extra=True))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, 7, 8, None, None]

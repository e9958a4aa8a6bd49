from __future__ import annotations

import random


def docs_frame(spark, rows, extra=False):
    """documents of (doc_id, text); with extra columns named as operators name theirs."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(d, t, None, None, None) for d, t in rows]
    if extra:
        schema += ", score string, fp int, component_id string, row int, pos string, hash string, row_number int, part string, label string, kept int, key string, doc int"
        full = [(*r, None, 1, "x", 2, None, "h", 3, "p", "l", 4, "k", 5) for r in full]
    return spark.createDataFrame(full, schema)


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


#: Texts that every operator must take.
ODD = [(None, "null id"), (-1, None), (-2, ""), (-3, " \n\t "), (-4, "wörd " * 30_000), (-5, "repeated row"), (-5, "repeated row"), (-6, "x" * 200_000)]

SYLLABLES = {"en": "the ing er on at is wh".split(), "de": "ung sch ein ü ch lich zu".split(), "fr": "eau oi é que la ment ç".split()}


def sentence(rng: random.Random, lang: str = "en", n: int = 60) -> str:
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))

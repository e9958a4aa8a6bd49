"""The index of letters against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from meritpool.functions.text import contains_text
from meritpool.operators import search
from tests.conftest import rows


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(8)
    made = ["".join(rng.choices("aAbBÉé 1", k=rng.randint(0, 9))) for _ in range(300)]
    made += ["", None, "aaa", "aa", "İstanbul", "straße", "a", "  b  "]
    return spark.createDataFrame(list(enumerate(made)), "id bigint, name string")


@pytest.mark.parametrize("query", ["a", "AB", "bé", "aab", "aaaa", "1 a", " ab ", "b b", "zzz", "ß", "é", "", None, "anbu"])
def test_the_index_finds_what_a_scan_finds(names, query):
    got = search.holding(names, search.name_index(names), query)
    assert rows(got) == rows(names.where(contains_text(F.col("name"), query)))


def test_a_search_reads_its_own_letters(spark, names, tmp_path):
    search.name_index(names).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for query, pushed in (("aab1", "In(letters, [aab,ab1])"), ("ab", "StringStartsWith(letters,ab)")):
        plan = search.holding(names, index, query)._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan

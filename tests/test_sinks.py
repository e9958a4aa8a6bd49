from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from meritpool import schemas
from meritpool.plans import reports as rp
from meritpool.plans import snapshot as sn
from meritpool.plans import summary as su
from meritpool.sources import tables as tb
from meritpool.sources import writers as wr
from meritpool.sources.commits import Store, Transaction
from tests.conftest import rows

SCHEMA = schemas.GROUPS.struct


def groups(spark, *codes):
    return tb.typed_rows(spark, schemas.GROUPS, ["id", "code", "name"],
                         [(i, c, c.upper()) for i, c in enumerate(codes, 1)])


def test_versions_follow_each_other(spark, tmp_path):
    root = str(tmp_path / "groups")
    assert wr.read_version(spark, root, SCHEMA).count() == 0
    assert wr.write_version(groups(spark, "a"), root) == 1
    old = wr.read_version(spark, root, SCHEMA)
    assert wr.write_version(old.unionByName(groups(spark, "b")), root) == 2
    now = wr.read_version(spark, root, SCHEMA)
    assert sorted(r.code for r in now.collect()) == ["a", "b"]


def test_aborted_version_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "groups")
    wr.write_version(groups(spark, "a"), root)
    bad = groups(spark, "b").withColumn("sort_order", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        wr.write_version(bad, root)
    assert [r.code for r in wr.read_version(spark, root, SCHEMA).collect()] == ["a"]


PERIOD_SCHEMA = "v string, academic_period_id bigint"


def test_period_is_replaced_also_by_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], PERIOD_SCHEMA)
    wr.replace_periods(df, path, [1, 2])
    wr.replace_periods(df.limit(0), path, [1])
    assert rows(wr.read_periods(spark, path, df.schema)) == [("b", 2)]
    wr.replace_periods(df.withColumn("v", F.lit("c")), path, [2])
    assert rows(wr.read_periods(spark, path, df.schema)) == [("c", 2)]


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], PERIOD_SCHEMA)
    wr.replace_periods(df, path, [1, 2])
    broken = df.withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        wr.replace_periods(broken, path, [1, 2])
    assert rows(wr.read_periods(spark, path, df.schema)) == [("a", 1), ("b", 2)]


def test_a_table_may_be_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], PERIOD_SCHEMA)
    wr.replace_periods(df, path, [1, 2])
    own = wr.read_periods(spark, path, df.schema)
    wr.replace_periods(own.withColumn("v", F.concat("v", "v")), path, [1])
    assert rows(wr.read_periods(spark, path, df.schema)) == [("aa", 1), ("b", 2)]


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    wr.append(groups(spark, "a"), path)
    wr.append(groups(spark, "b"), path)
    assert tb.read_table(spark, schemas.GROUPS, path).count() == 2


def test_landing_rows_have_their_own_key(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    head = "student_name,criterion_name,base_score,dynamic_bonus,total_score\n"
    body = "S,C,1.5,,1.5\nS,C,1.5,,1.5\n" + "".join(f"S{i},C,{i}.5,,1\n" for i in range(200))
    (folder / "a.csv").write_text(head + body, encoding="utf-8")
    (folder / "b.csv").write_text(head + "S,C,x,,1\nS,C,2,,1\n", encoding="utf-8")

    def read():
        return tb.read_landing(spark, schemas.STAGED_RESULTS, str(folder))

    good, bad = read()
    keys = {r.row_key for r in good.collect()}
    assert good.count() == len(keys) == 203
    assert [(r.base_score, r.rules) for r in bad.collect()] == [("x", ["base_score_type"])]
    assert good.where("student_name = 'S'").first().dynamic_bonus is None
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    again = {r.row_key for r in read()[0].collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert again == keys


CALCULATIONS, ITEMS = schemas.CALCULATIONS.name, schemas.ITEMS.name


@pytest.fixture()
def stored_periods(spark, star, tmp_path):
    """A store with an older snapshot and its items."""
    store = Store(spark, str(tmp_path / "store"))
    years = [r.id for r in star.periods.collect()]
    change = store.begin()
    change.replace_slices(CALCULATIONS, star.calculations.drop("id"), "academic_period_id", years)
    change.replace_slices(ITEMS, star.items, "academic_period_id", years)
    change.commit()
    return store


def test_rebuild_of_a_period(star, stored_periods):
    """Stored rows of the year are replaced, its items go, others stay, in one commit."""
    old, store = star.calculations.drop("id"), stored_periods
    log = sn.rebuild_period(star, 1997, store)
    assert store.version() == 2

    def stored():
        return store.read(CALCULATIONS, old.schema)

    expected = su.teacher_summary(star, periods=[1997])
    n = stored().where("academic_period_id = 1997").count()
    assert n == expected.count() > 0
    row = log.first()
    assert row.entity_id == "1997" and f'"inserted":{n}' in row.details
    others = "academic_period_id <> 1997"
    assert stored().where(others).count() == old.where(others).count()
    left = store.read(ITEMS, star.items.schema)
    assert left.where("academic_period_id = 1997").count() == 0 and left.count() > 0
    assert store.read(ITEMS, star.items.schema, version=1).count() == star.items.count()
    sn.rebuild_period(star, 2030, store)
    assert stored().where("academic_period_id = 2030").count() == 0


def test_a_failed_rebuild_leaves_calculations_and_items(star, stored_periods):
    store = stored_periods
    before = store.tables()
    stop = F.raise_error(F.lit("stop")).cast("decimal(12,4)")
    broken = replace(tables_of(star), results=star.results.withColumn("total_score", stop))
    with pytest.raises(Exception, match="stop"):
        sn.rebuild_period(broken, 1997, store)
    assert store.version() == 1 and store.tables() == before


def test_a_rebuild_that_fails_between_its_tables_shows_neither(star, stored_periods, monkeypatch):
    store = stored_periods
    plain = Transaction.replace_slices

    def failing(self, name, df, by, values):
        if name == ITEMS:
            raise RuntimeError("lost")
        plain(self, name, df, by, values)

    monkeypatch.setattr(Transaction, "replace_slices", failing)
    before = store.read(CALCULATIONS, star.calculations.drop("id").schema).where("academic_period_id = 1997")
    expected = rows(before)
    with pytest.raises(RuntimeError, match="lost"):
        sn.rebuild_period(star, 1997, store)
    assert rows(store.read(CALCULATIONS, before.schema).where("academic_period_id = 1997")) == expected
    assert store.read(ITEMS, star.items.schema).count() == star.items.count()


def tables_of(star):
    names = ("assignments", "results", "teachers", "periods", "settings")
    return tb.Tables(**{n: getattr(star, n) for n in names})


def test_appended_log_rows_head_the_list(spark, star):
    new = wr.log_rows(star.students, F.lit("create"), "students", F.col("id"))
    rows_ = wr.log_inserts(new, star.log)
    log = star.log.unionByName(rows_.select(*star.log.columns))
    n = star.students.count()
    newest = rp.recent_log(log).limit(min(n, 300)).collect()
    assert {r.entity_type for r in newest} == {"students"}


def test_exports(spark, star, tmp_path):
    wr.export(rp.results_export(star), str(tmp_path / "results"))
    back = spark.read.option("header", True).csv(str(tmp_path / "results"))
    assert back.columns == list(rp.RESULT_HEADINGS.values())
    assert back.count() == star.results.count()
    name = star.teachers.orderBy("id").first().full_name
    sheets = rp.card_export(star, star.calculation_history, teacher_name=name)
    wr.export_card(sheets, str(tmp_path / "card"), "parquet")
    items = spark.read.parquet(str(tmp_path / "card" / "Items"))
    assert items.columns == list(rp.CARD_ITEM_HEADINGS.values())
    assert items.count() == star.links.where("teacher_id = 0").count()
    assert spark.read.parquet(str(tmp_path / "card" / "Summary")).count() == 7


def test_log_rows(spark):
    df = spark.createDataFrame([("ann", 5, '{"a":1}'), (None, 0, None), ("", None, None)],
                               "who string, id int, d string")
    got = wr.log_rows(df, F.lit("create"), "student_result", F.col("id"), F.col("d"), F.col("who"))
    assert rows(got.drop("created_at")) == [
        ("ann", "system", "create", "student_result", "5", '{"a":1}'),
        ("system", "system", "create", "student_result", None, "{}"),
        ("system", "system", "create", "student_result", None, "{}"),
    ]


def test_lookup_tracks(spark):
    assert [r.value for r in rp.lookup_tracks(spark).collect()] == list(schemas.TRACKS)


def test_lists_come_in_their_order(spark, star):
    """Newest first by id; look-ups by name."""
    ids = [r.id for r in rp.recent_results(star, 50).collect()]
    assert ids == sorted(ids, reverse=True) and len(ids) == 50
    logged = [r.id for r in rp.recent_log(star.log).collect()]
    assert logged == sorted(logged, reverse=True)
    names = [r.full_name for r in rp.lookup_students(star.students).collect()]
    assert names == sorted(names)

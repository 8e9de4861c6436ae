"""Typed CSV source, catalogue, sinks and stages."""

import csv
import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.constants import DATASET_VERSIONS, NA_VALUES, Level
from panelforge.sources import csv_source, sinks
from panelforge.sources.catalog import table_schema
from panelforge.sources.csv_records import csv_records, ends_in_quotes
from panelforge.sources.plant_tables import PLANT_TABLES
from panelforge.sources.register_tables import REGISTER_TABLES
from panelforge.sources.reporting_tables import REPORTING_TABLES
from panelforge.sources.staging import NamedStages, shared_folder, stage

DDL = "id int, name string, amount double, at timestamp_ntz, ok boolean"
CSV = """id,name,amount,at,ok,extra
1,Werk,1.5,03/01/24 10:20:30,true,z
2.6,CONFIDENTIAL,none,03/01/75 00:00:00,false,z
x,"a, ""b""
c",-,12/31/99 00:00:00,maybe,z
,_,1e3,garbage,,z
"""


@pytest.fixture
def path(tmp_path):
    file = tmp_path / "table.csv"
    file.write_text(CSV)
    return str(file)


def read(spark, path, ddl=DDL, **kwargs):
    schema = T.StructType.fromDDL(ddl)
    return csv_source.read_typed_csv(spark, path, schema, NA_VALUES, "2025-06-01", **kwargs)


def test_values(spark, path):
    rows = [tuple(r) for r in read(spark, path).collect()]
    assert rows == [
        (1, "Werk", 1.5, dt.datetime(2024, 3, 1, 10, 20, 30), True),
        (3, None, None, dt.datetime(1975, 3, 1), False),
        (None, 'a, "b"\nc', None, None, None),
        (None, None, 1000.0, None, None),
    ]


def test_only_declared_columns_in_order(spark, path):
    frame = read(spark, path)
    assert frame.schema.simpleString() == T.StructType.fromDDL(DDL).simpleString()


def test_second_read_uses_the_copy(spark, path):
    first = read(spark, path).inputFiles()
    assert all(".parquet/" in name for name in first)
    assert read(spark, path).inputFiles() == first
    assert read(spark, path, reload=True).inputFiles() != first


def test_copy_of_another_schema_is_refused(spark, path):
    read(spark, path)
    changed = read(spark, path, DDL.replace("amount double", "amount string"))
    assert dict(changed.dtypes)["amount"] == "string"
    assert [r.amount for r in changed.collect()] == ["1.5", "none", None, "1e3"]


def test_bad_values_can_raise(spark, path):
    with pytest.raises(PySparkException, match="bad value in"):
        read(spark, path, errors="raise").collect()


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError, match="Only CSV"):
        read(spark, "/tmp/table.xlsx")


def test_today_settles_the_century_by_default(spark):
    frame = spark.createDataFrame([("01/01/00 00:00:00",), ("01/01/99 00:00:00",)], "t string")
    got = [r[0] for r in frame.select(csv_source.parse_short_date(F.col("t"))).collect()]
    assert got == [dt.datetime(2000, 1, 1), dt.datetime(1999, 1, 1)]


def test_local_times_ignore_the_session_zone(spark):
    frame = spark.createDataFrame([("03/10/24 02:30:00",), ("11/03/24 01:30:00",)], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in frame.select(csv_source.parse_short_date(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30)]


def test_catalogue_is_complete():
    assert (len(REPORTING_TABLES), len(REGISTER_TABLES), len(PLANT_TABLES)) == (20, 6, 6)
    assert len(DATASET_VERSIONS) == 13
    assert len(NA_VALUES) == 14
    assert len(table_schema("FACILITYREPORT")) == 50
    assert len(table_schema("2_ProductionFacility")) == 29
    assert table_schema("3i_StricterPermitConditions")["Article14(4)"].dataType == T.IntegerType()
    assert [level.key for level in Level][-1] == "Installation_Part_INSPIRE_ID"
    with pytest.raises(KeyError):
        table_schema("nothing")


def test_csv_sink_is_ordered_across_files(spark, tmp_path):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    folder = str(tmp_path / "out.csv")
    sinks.write_ordered_csv(frame.repartition(5), folder, ["id"])
    parts = sorted((tmp_path / "out.csv").glob("part-*"))
    values = [int(x) for p in parts for x in p.read_text().split()[1:]]
    assert values == list(range(1000))


def test_stage_goes_to_the_shared_folder(spark):
    staged = stage(spark.range(10), "numbers")
    assert staged.count() == 10
    assert all(shared_folder(spark) in f for f in staged.inputFiles())


def test_stage_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://head:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())


def test_parts_of_a_folder_may_order_columns_differently(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,name\n1,x\n")
    (folder / "b.csv").write_text("name,id\ny,2\n")
    (folder / "c.csv").write_text("")
    schema = T.StructType.fromDDL("id int, name string")
    for multi_line in (True, False):
        frame = csv_source.read_typed_csv(spark, str(folder), schema, multi_line=multi_line)
        assert sorted(map(tuple, frame.collect())) == [(1, "x"), (2, "y")]
    (folder / "d.csv").write_text("id\n3\n")
    with pytest.raises(PySparkException):
        csv_source.read_typed_csv(spark, str(folder), schema).count()


def test_copy_follows_its_source(spark, tmp_path):
    path = tmp_path / "t.csv"
    schema = T.StructType.fromDDL("id int")
    path.write_text("id\n1\n")
    assert csv_source.read_typed_csv(spark, str(path), schema).count() == 1
    path.write_text("id\n1\n2\n")
    assert csv_source.read_typed_csv(spark, str(path), schema).count() == 2
    # a copy whose write broke off is not taken as whole
    copy = tmp_path / "t.parquet"
    (copy / "_SUCCESS").unlink()
    for part in copy.glob("part-*"):
        part.unlink()
        break
    assert csv_source.read_typed_csv(spark, str(path), schema).count() == 2


def test_all_typed_tables_have_the_documented_columns():
    text = open(__file__.replace("tests/test_sources.py", "FIXTURES.md")).read()
    for tables in (REPORTING_TABLES, REGISTER_TABLES, PLANT_TABLES):
        for name in tables:
            schema = table_schema(name)
            assert name in text
            assert all(field.name in text for field in schema)
            assert len({f.name.lower() for f in schema}) == len(schema)


def test_one_large_file_with_line_breaks_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    fields = ["", "plain", 'say "hi"', "a,b", "two\nlines", "\n\n", 'end"\n"', "x\r\ny", "é\n,"]
    rows = [(str(k), rng.choice(fields), rng.choice(fields) * rng.randrange(1, 9)) for k in range(3000)]
    file = tmp_path / "large.csv"
    with open(file, "w", newline="") as handle:
        writer = csv.writer(handle)
        writer.writerow(["id", "a\nb", "c"])
        writer.writerows(rows[:1500])
        handle.write('5" pipe,a " quote,plain\r\n\r\n')  # quotes inside bare fields, an empty line
        writer.writerows(rows[1500:])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = csv_records(spark, [str(file)])
        assert records.rdd.getNumPartitions() > 8
        assert records.count() == 3003  # the header, all rows, and the empty line
        schema = T.StructType.fromDDL("id string, `a\nb` string, c string")
        got = csv_source.read_typed_csv(spark, str(file), schema).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [tuple(v or None for v in row) for row in rows] + [('5" pipe', 'a " quote', "plain")]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_states_of_lines():
    opens = ['a,"b', '"', '"a""', 'a,b"c,"d', '"a" x,"']
    closed = ["", "a,b", '","', 'a"b,c', '"a"', '""', '"a""b"', 'x" y,"z"', '"a" b"c,d']
    assert all(ends_in_quotes(line, False) for line in opens)
    assert not any(ends_in_quotes(line, False) for line in closed)
    assert [ends_in_quotes(x, True) for x in ("", "a", 'b",c', 'b""', 'b","', '"', '",""')] == [
        True, True, False, True, True, False, False
    ]


def test_named_relations_are_written_once(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(100).withColumn("v", F.col("id") % 7).write.parquet(source)

    def relation(least):
        return spark.read.parquet(source).where(F.col("v") >= least).groupBy("v").count()

    first, second = (NamedStages(spark, str(tmp_path / "named")) for _ in range(2))
    assert first.table(relation(3), "counts").count() == 4
    assert first.table(relation(3), "counts").count() == 4  # found again, by a later run too
    assert second.table(relation(3), "counts").count() == 4
    assert (len(first.written), len(second.written)) == (1, 0)
    assert second.table(relation(4), "counts").count() == 3  # another plan
    spark.range(5).withColumn("v", F.lit(9).cast("long")).write.mode("append").parquet(source)
    assert second.table(relation(3), "counts").count() == 5  # a changed source
    wide = [F.lit(k).alias(f"c{k}") for k in range(60)]
    for last in (1, 2):  # plans that differ only where their text would be cut
        got = second.table(spark.read.parquet(source).select(*wide, F.lit(last).alias("z")), "wide")
        assert got.first().z == last
    rows = spark.createDataFrame([(1,)], "a int")
    for _ in range(2):  # the content of such rows cannot be told from the plan
        assert second.table(rows, "rows").count() == 1
    assert len(second.written) == 6
    gone = second.written[0]
    second.drop()
    assert not second.written and not second._exists(gone)
    assert first._exists(first.written[0])


def test_an_unclosed_quote_in_the_last_range_keeps_its_rows(spark, tmp_path):
    file = tmp_path / "open.csv"
    file.write_text('a,b\n1,x\n2,"never closed\n3,y\n')
    rows = csv_records(spark, [str(file)]).orderBy("start", "at").collect()
    assert [r.text for r in rows] == ["a,b", "1,x", '2,"never closed\n3,y']


def test_csv_lines_are_scanned_twice_at_most(spark, tmp_path, monkeypatch):
    """Once for quotes (headers included), once for records; edges are cut out by line numbers."""
    from panelforge.sources import csv_records as module

    made = []
    for name in ("_join_lines", "_edge_lines"):
        kept = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, kept=kept, name=name: made.append(name) or kept(*a))
    file = tmp_path / "t.csv"
    file.write_text("a,b\n" + "".join(f'{i},"x, ""{i}""\nmore"\n' for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        records, heads = module.records_and_heads(spark, [str(file)])
        texts = [r.text for r in records.orderBy("start", "at").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert list(heads.values()) == ["a,b"]
    assert texts == ["a,b"] + [f'{i},"x, ""{i}""\nmore"' for i in range(3000)]
    assert made == ["_join_lines", "_edge_lines"]
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2

"""What the reports look like to the cluster: scans, joins, shuffles, skew."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from duebook import AsOf, CatalogTables, FrameTables, Period, StoredTables
from duebook.operators import claims
from duebook.plans import listing, production, receivables
from duebook.schema import DATES, TABLES
from duebook.plans.places import with_places
from duebook.session import cluster_settings, shared_folder
from duebook.sources import write_tables
from trade_tables import TradeTables
from tests.ledger_rows import random_tables, stored

BUILDS = contract.builds()
REPORTS = [n for n in BUILDS if n[0] == "r"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return stored(spark, random_tables(seed=3), tmp_path_factory.mktemp("ledger"))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(rows, mode="formatted"):
    return rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", [*REPORTS, "a1_proc_summary", "a12_trans", "l18_payplan_link"])
def test_no_query_leaves_the_jvm_or_pairs_everything(tables, name):
    text = plan(BUILDS[name](tables), "simple")
    if name.startswith("r14"):  # running totals, over the sums of a patient and day
        window = text[text.index("Window ["):]
        assert "patnum" in window.splitlines()[0] and "functions=[sum(" in window
        text = text.replace("Window [", "")
    for node in ("Python", "Pandas", "Cartesian", "NestedLoop", "Window", "SortAggregate",
                 "ObjectHashAggregate", "ExistingRDD"):
        assert node not in text, node


@pytest.mark.parametrize("name", [*REPORTS, "a1_proc_summary", "a12_trans", "l18_payplan_link"])
def test_sums_are_combined_before_the_shuffle(tables, no_broadcast, name):
    lines = plan(BUILDS[name](tables), "simple").splitlines()
    for above, shuffle, below in zip(lines, lines[1:], lines[2:]):
        if "HashAggregate" in above and "Exchange" in shuffle:
            assert "HashAggregate" in below


@pytest.mark.parametrize("name", REPORTS)
def test_generated_code_stays_small_enough_to_be_compiled(spark, sf_dir, name):
    """The JVM leaves methods of more than 8000 bytes to the interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the code of the whole plan
    try:
        rows = contract.queries()[name](spark, sf_dir)
        debug = getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$")
        code = getattr(debug, "MODULE$").codegenString(rows._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_a_month_of_claims_is_read_not_the_history(tables):
    text = plan(claims.claims_paid(tables, Period.between("2001-06-01", "2001-06-30")))
    pushed = [line for line in text.splitlines() if "PushedFilters" in line and "payplannum" in line]
    assert len(pushed) == 2
    for line in pushed:
        assert "GreaterThanOrEqual(datecp,2001-06-01)" in line
        assert "LessThanOrEqual(datecp,2001-06-30)" in line
        assert "EqualTo(payplannum,0)" in line and "In(status" in line


def test_scans_are_narrow(tables):
    text = plan(receivables.receivables_total(tables, AsOf.on("2001-06-30")))
    read = [line for line in text.splitlines() if "ReadSchema" in line]
    assert read and not any("clinicnum" in line for line in read)
    assert sum("procstatus" in line and "procfee" not in line for line in read) == 1


def test_rows_without_a_reference_stay_out_of_the_join(tables, no_broadcast):
    text = plan(claims.claims_receivable(tables, AsOf.on("2001-06-30")), "simple")
    assert text.count("SortMergeJoin") == 1 and "LeftSemi" in text
    assert len(re.findall(r"Exchange hashpartitioning\(procnum", text)) == 2
    free = text[text.index("Union"):text.index("SortMergeJoin")]
    assert "Exchange" not in free and "EqualTo(procnum,0)" in free


def test_clinic_names_are_joined_to_sums(tables, no_broadcast):
    text = plan(receivables.receivables_by_clinic(tables, AsOf.on("2001-06-30")), "simple")
    top_join = text.index("SortMergeJoin")
    assert "HashAggregate(keys=[clinicnum" in text[top_join:]
    assert "HashAggregate" not in text[:top_join]


def test_a_hot_procedure_is_split_over_tasks(spark, tmp_path):
    """A third of all claim lines on one procedure: the join cuts that partition up."""
    lines = spark.range(0, 300_000, 1, 12).selectExpr(
        "id + 1 AS claimprocnum", "if(id % 3 = 0, 7L, id) AS procnum", "id % 50 AS patnum",
        "1L AS clinicnum", "DATE'2001-06-01' AS procdate", "DATE'2001-06-02' AS datecp",
        "1 AS status", "CAST(1 + rand(1) * 1e6 AS DECIMAL(12,2)) AS inspayamt",
        "CAST(0 AS DECIMAL(12,2)) AS inspayest",
        "CAST(rand(2) * 1e6 AS DECIMAL(12,2)) AS writeoff",
        "0L AS payplannum",
    )
    lines.write.parquet(f"{tmp_path}/claimproc")
    spark.range(300_000).selectExpr("id AS procnum", "2 AS procstatus").write.parquet(
        f"{tmp_path}/procedurelog"
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = claims.claims_paid(
            StoredTables(spark, str(tmp_path)), Period.between("2001-06-01", "2001-06-30")
        )
        tasks = rows.selectExpr("*", "spark_partition_id() AS task").groupBy("task").agg(
            F.expr("count(*) AS n"), F.expr("count_if(procnum = 7) AS hot"),
            F.expr("sum(prikey + tranamount + woamount) AS used"),
        ).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert sum(t.n for t in tasks) == 300_000 and sum(t.hot for t in tasks) == 100_001
    assert max(t.hot for t in tasks) < 30_000


def test_written_tables_give_the_same_and_skip_by_date(spark, sf_dir, tmp_path):
    source = TradeTables(spark, sf_dir)
    write_tables(source, str(tmp_path))
    copy = StoredTables(spark, str(tmp_path))
    for name, columns in TABLES.items():
        assert copy.read(name, *columns).exceptAll(source.read(name, *columns)).isEmpty(), name
        assert copy.frame(name, []).count() == source.read(name, *columns).count(), name
    window = Period.between("2001-04-01", "2001-06-30")
    pairs = [(production.production_by_month(t, window)) for t in (source, copy)]
    assert sorted(map(str, pairs[0].collect())) == sorted(map(str, pairs[1].collect()))
    assert set(DATES) <= set(TABLES)


@pytest.mark.parametrize("fmt", ["orc", "csv", "json"])
def test_other_formats_and_the_catalog(spark, tables, tmp_path, fmt):
    for name, columns in TABLES.items():
        kept = [c for c in columns if c != "secdatetentry"]
        rows = tables.read(name, *(columns if fmt == "orc" else kept))
        rows.write.format(fmt).option("header", "true").save(f"{tmp_path}/{name}")
    names = ("patient", "procedurelog", "claimproc", "adjustment", "paysplit")
    other = StoredTables(spark, str(tmp_path), fmt)
    day = AsOf.on("2001-06-30")
    want = sorted(map(str, listing.transactions(tables, day).collect()))
    assert sorted(map(str, listing.transactions(other, day).collect())) == want
    for name in names:
        other.frame(name, []).createOrReplaceTempView(name)
    catalog = CatalogTables(spark)
    assert sorted(map(str, listing.transactions(catalog, day).collect())) == want
    for name in names:
        spark.catalog.dropTempView(name)


def write_text(path, *lines):
    path.mkdir(parents=True)
    (path / "rows.txt").write_text("\n".join(lines) + "\n")


def test_csv_columns_are_found_by_name(spark, tmp_path):
    write_text(tmp_path / "clinic", "description,extra,clinicnum", "North,x,1", "South,y,2")
    source = StoredTables(spark, str(tmp_path), "csv")
    assert sorted(source.read("clinic", "clinicnum", "description").collect()) == [(1, "North"), (2, "South")]
    write_text(tmp_path / "payment", "dateentry", "2001-01-01")
    with pytest.raises(ValueError, match="paynum"):
        source.read("payment", "paynum")
    bare = tmp_path / "bare"
    write_text(bare / "clinic", "1,North", "2,South")
    with pytest.raises(ValueError, match="clinicnum"):  # no header: the first row is none
        StoredTables(spark, str(bare), "csv").read("clinic", "clinicnum")
    plain = StoredTables(spark, str(bare), "csv", header="false")
    assert sorted(plain.read("clinic", "clinicnum", "description").collect()) == [(1, "North"), (2, "South")]


@pytest.mark.parametrize("fmt, lines", [
    ("csv", ["adjnum,procnum,patnum,provnum,clinicnum,adjdate,procdate,adjamt", "1,0,1,1,1,2001-01-01,2001-01-01,12x"]),
    ("json", ['{"adjnum": 1, "adjamt": "12x"}']),
])
def test_bad_values_raise(spark, tmp_path, fmt, lines):
    write_text(tmp_path / "adjustment", *lines)
    with pytest.raises(Exception, match="(?i)malformed|cannot|invalid"):
        StoredTables(spark, str(tmp_path), fmt).read("adjustment", "adjnum", "adjamt").collect()
    lenient = StoredTables(spark, str(tmp_path), fmt, mode="PERMISSIVE")
    assert lenient.read("adjustment", "adjnum", "adjamt").count() == 1


@pytest.mark.parametrize("name", ["l18a_linked_proc_fee", "l18b_linked_adj_fee"])
def test_facts_are_cut_to_the_links_before_they_are_summed(spark, tables, no_broadcast, name):
    """Below each sum of claims, payments or adjustments lies a join with the links."""
    depths, open_sums = [], []
    for line in plan(BUILDS[name](tables), "simple").splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        open_sums = [s for s in open_sums if s[0] < depth]
        if "functions=[partial_sum" in line:
            open_sums.append((depth, []))
        for _, seen in open_sums:
            seen.append(line)
            depths.append(seen)
    for seen in depths:
        if any("FileScan" in line and re.search("claimproc|paysplit|adjustment", line) for line in seen):
            assert any("Join" in line for line in seen)


def test_settings_follow_the_input():
    small, large = cluster_settings(10**9), cluster_settings(100 * 10**12)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 128 * 1024**2
    assert "spark.shuffle.push.enabled" not in small
    tasks = 100 * 10**12 // int(large["spark.sql.files.maxPartitionBytes"])
    assert tasks * int(large["spark.sql.shuffle.partitions"]) < 200_000_000
    assert large["spark.shuffle.push.enabled"] == "true"


def test_overflow_raises_whatever_the_default(spark):
    """Under the settings given here; without them, reading tables warns."""
    from pyspark.errors import ArithmeticException

    with pytest.raises(ArithmeticException):
        spark.sql("SELECT sum(x) FROM VALUES (9223372036854775807L), (1L) t(x)").collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        rows = spark.createDataFrame([(1, "x")], "clinicnum long, description string")
        with pytest.warns(UserWarning, match="ansi"):
            FrameTables({"clinic": rows}).read("clinic", "clinicnum")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_places_are_given_range_by_range(spark, tmp_path):
    """A thousand ranges, some of them empty; only one row per range goes through the running sum, and
    no rows are paired but by their range."""
    rows = spark.range(0, 20_000, 1, 1000).where("id < 3000 or id > 5000 and id % 7 > 0")
    got = with_places(rows, path=f"{tmp_path}/places")
    text = plan(got, "simple")
    assert "NestedLoop" not in text and "Cartesian" not in text and "BroadcastHashJoin" in text
    window = text[text.index("Window ["):]
    assert "HashAggregate(keys=[_range" in window and "Window [" not in window[1:]
    found = sorted(map(tuple, got.collect()))
    assert [place for _, place in found] == list(range(1, rows.count() + 1))
    assert [i for i, _ in found] == [r.id for r in rows.collect()]


def test_places_follow_the_sort(spark):
    rows = spark.range(0, 5000, 1, 8).selectExpr("id * 7919 % 5000 AS k", "'x' AS _n", "id AS position")
    got = with_places(rows.orderBy("k"), "place")
    assert sorted((r.k, r.place) for r in got.collect()) == [(k, k + 1) for k in range(5000)]
    empty = with_places(rows.where("k < 0").orderBy("k"))
    assert empty.collect() == []


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf({"spark.master": "spark://x:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_folder(Session()) == "hdfs:///shared"
    Session.conf = Conf({"spark.master": "local[4]"})
    assert shared_folder(Session()).startswith("file://")

"""Tables laid out by patient and procedure, and sets of tables published as a whole."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from duebook import AsOf, BucketedTables, FrameTables, Period, PublishedTables, StoredTables
from duebook.operators import claims, installments, splits
from duebook.plans import listing
from duebook.schema import TABLES
from duebook.sources import publish_tables, write_buckets
from duebook.sources.layout import COPIES, hot_buckets
from tests.ledger_rows import random_tables, stored
from tests.test_plans import no_broadcast, plan  # noqa: F401

BUILDS = contract.builds()
FACTS = ("procedurelog", "claimproc", "adjustment", "paysplit")


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    return stored(spark, random_tables(seed=8, gaps=0.05), tmp_path_factory.mktemp("plain"))


@pytest.fixture(scope="module")
def bucketed(spark, source, tmp_path_factory):
    write_buckets(source, spark, "ledger_buckets", 4, str(tmp_path_factory.mktemp("buckets")))
    yield BucketedTables(spark, "ledger_buckets")
    spark.sql("DROP DATABASE ledger_buckets CASCADE")


@pytest.mark.parametrize("name", [
    "l02_claim_ar", "l04_claim_month", "l18_payplan_link", "l19_payplan_discount", "l20_patpay_ar", "a7_adj_by_proc",
    "a8_claim_by_proc", "a9_split_by_proc", "r01_ar_detailed", "r03_ar_detailed_clinic", "r07_prod_month_detailed",
    "r09_transactions", "p6_transactions_clinic", "r12_aging_of_ar", "r13_custom_aging",
])
def test_reports_are_the_same(source, bucketed, name):
    want, got = BUILDS[name](source), BUILDS[name](bucketed)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tables_are_the_same(source, bucketed):
    for name, columns in TABLES.items():
        want = source.read(name, *columns)
        assert bucketed.read(name, *columns).exceptAll(want).isEmpty(), name
        assert bucketed.read(name, *columns).count() == want.count(), name
        for key in COPIES.get(name, ()):
            copy = bucketed.read(name, *columns, by=key)
            assert want.filter(f"{key} != 0").exceptAll(copy).isEmpty(), (name, key)


def shuffled(text):
    """The tables below each exchange of a plan."""
    lines, found = text.splitlines(), []
    for i, line in enumerate(lines):
        depth = len(line) - len(line.lstrip(" :+-"))
        if "Exchange" in line:
            below = []
            for other in lines[i + 1:]:
                if len(other) - len(other.lstrip(" :+-")) <= depth:
                    break
                below.append(other)
            found.append({t for t in TABLES for b in below if f"ledger_buckets.{t}" in b})
    return found


def test_names_meet_transactions_where_they_lie(bucketed, no_broadcast):  # noqa: F811
    for clinic in (None, 3):
        text = plan(listing.transactions(bucketed, AsOf.on("2001-06-30"), clinic), "simple")
        assert "Exchange" not in text and text.count("SortMergeJoin") == 4


def test_settled_references_need_no_join(bucketed, no_broadcast):  # noqa: F811
    month = Period.between("2001-04-01", "2001-06-30")
    for rows in (claims.claims_receivable(bucketed, AsOf.on("2001-06-30")), claims.claims_paid(bucketed, month),
                 splits.splits_in_period(bucketed, month)):
        text = plan(rows, "simple")
        assert "Join" not in text and "Exchange" not in text


def test_sums_by_procedure_move_links_only(bucketed, no_broadcast):  # noqa: F811
    """Links and plans are moved to the procedures; of the facts no row is, before it is a sum."""
    for rows in (installments.linked_procedure_fees(bucketed), installments.linked_discounts(bucketed, AsOf.on("2001-06-30"))):
        moved = shuffled(plan(rows, "simple"))
        assert moved and not any(tables & set(FACTS) for tables in moved)


def test_a_hot_key_is_refused(spark, source):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 5L, id) AS patnum")
    assert hot_buckets(rows, "patnum", 8, uneven=2, few=1) and not hot_buckets(rows, "patnum", 8, uneven=2)
    assert not hot_buckets(spark.range(4000).selectExpr("id AS patnum"), "patnum", 8, uneven=2, few=1)
    with pytest.raises(ValueError, match="times the mean"):
        write_buckets(source, spark, "never_made", 4, uneven=0.1, few=1)
    assert "never_made" not in [d.name for d in spark.catalog.listDatabases()]


class Failing(FrameTables):
    """Tables of which one can't be read."""

    def frame(self, name, columns):
        rows = super().frame(name, columns)
        return rows.selectExpr("*", "raise_error('lost') AS _lost").drop("patnum").withColumnRenamed(
            "_lost", "patnum") if name == "paysplit" else rows


def test_a_set_is_published_as_a_whole(spark, source, tmp_path):
    path, day = str(tmp_path), AsOf.on("2001-06-30")
    with pytest.raises(ValueError, match="nothing"):
        PublishedTables(spark, path)
    names = ["procedurelog", "adjustment", "paysplit", "patient", "claimproc"]
    publish_tables(source, spark, path, names)
    old = PublishedTables(spark, path)
    want = sorted(map(str, listing.transactions(source, day).collect()))
    frames = {n: source.read(n, *TABLES[n]) for n in names}
    frames["procedurelog"] = frames["procedurelog"].limit(0)
    with pytest.raises(Exception, match="lost"):
        publish_tables(Failing(frames), spark, path, names)
    assert sorted(map(str, listing.transactions(PublishedTables(spark, path), day).collect())) == want
    publish_tables(FrameTables(frames), spark, path, names)
    assert PublishedTables(spark, path).read("procedurelog", "procnum").isEmpty()
    assert sorted(map(str, listing.transactions(old, day).collect())) == want  # a reader keeps to its set
    assert isinstance(old, StoredTables)

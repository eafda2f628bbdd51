"""Day groups kept between reports, against reports over the ledger."""

from __future__ import annotations

import pytest

from duebook import AsOf, FrameTables
from duebook.plans import aging
from duebook.plans.kept import KeptDayGroups
from duebook.schema import TABLES
from tests.ledger_rows import random_tables, stored

DAYS = [AsOf.on("2001-06-30"), AsOf.on("2001-03-15", inclusive=False), AsOf.series(["2001-02-28", "2001-05-31", "2001-06-30"])]


def folder(path):
    (path / "ledger").mkdir()
    return path / "ledger"


def rows_of(report):
    return sorted(map(str, report.collect()))


def same(kept, tables):
    for day in DAYS:
        assert rows_of(kept.aging_balances(day)) == rows_of(aging.aging_balances(tables, day)), day
    day = DAYS[0]
    assert rows_of(kept.aging_of_receivables(tables, day)) == rows_of(aging.aging_of_receivables(tables, day))


def test_changed_patients_are_merged(spark, tmp_path):
    source = stored(spark, random_tables(seed=9, gaps=0.05), folder(tmp_path))
    frames = {name: source.read(name, *columns) for name, columns in TABLES.items()}
    kept = KeptDayGroups(spark, f"{tmp_path}/kept")
    with pytest.raises(ValueError, match="no day groups"):
        kept.groups()
    kept.write(source)
    same(kept, source)

    changed = spark.createDataFrame([(3,), (7,), (8,), (None,)], "patnum long")
    mine = "patnum IS NULL OR patnum IN (3, 7, 8)"
    new = dict(frames)
    new["paysplit"] = frames["paysplit"].where("NOT (patnum <=> 3 AND splitnum % 2 = 0)")
    new["adjustment"] = frames["adjustment"].selectExpr(
        *(f"CAST(if(patnum = 7 OR patnum IS NULL, adjamt * -2, adjamt) AS DECIMAL(14,4)) AS {c}" if c == "adjamt" else c
          for c in frames["adjustment"].columns))
    new["claimproc"] = frames["claimproc"].where("NOT (patnum <=> 8)")
    # Only the changed patients' rows and what they refer to are handed over.
    few = {**new, **{n: new[n].where(mine) for n in ("claimproc", "adjustment", "paysplit")},
           "payplancharge": new["payplancharge"].where("guarantor IS NULL OR guarantor IN (3, 7, 8)")}
    kept.merge(FrameTables(few), changed)
    same(kept, FrameTables(new))
    assert all("/kept/" in f for f in kept.aging_balances(DAYS[0]).inputFiles())

    # Again, a patient changed before, who loses most rows.
    gone = {**new, **{n: new[n].where("NOT (patnum <=> 3)") for n in ("claimproc", "adjustment", "paysplit")}}
    gone["payplancharge"] = new["payplancharge"].where("NOT (guarantor <=> 3)")
    kept.merge(FrameTables(gone), spark.createDataFrame([(3,)], "patnum long"))
    same(kept, FrameTables(gone))


def test_a_part_counts_once_it_is_whole(spark, tmp_path):
    source = stored(spark, random_tables(seed=10, size=60), folder(tmp_path))
    kept = KeptDayGroups(spark, f"{tmp_path}/kept")
    kept.write(source)
    want = rows_of(kept.groups())
    broken = spark.createDataFrame([(3,)], "patnum long").selectExpr("CAST(raise_error('lost') AS BIGINT) AS patnum")
    with pytest.raises(Exception, match="lost"):
        kept.merge(source, broken)
    assert rows_of(KeptDayGroups(spark, f"{tmp_path}/kept").groups()) == want
    kept.write(source)
    assert rows_of(kept.groups()) == want

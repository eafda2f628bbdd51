"""

Each query reads the ledger tables derived from the whole test tables. Money is DECIMAL in
the library and turned into DOUBLE here, on both sides of the comparison.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import oracle  # noqa: E402
from duebook import AsOf, Period, StoredTables  # noqa: E402
from duebook.sources import Tables, write_tables  # noqa: E402
from duebook.functions.money import in_dollars  # noqa: E402
from duebook.operators import (  # noqa: E402
    balances, charges, claims, installments, ledgers, linked, splits,
)
from duebook.plans import aging, listing, production, receivables  # noqa: E402
from duebook.plans.kept import KeptDayGroups  # noqa: E402
from duebook.plans.places import with_places  # noqa: E402
from duebook.session import new_folder  # noqa: E402
from trade_tables import TradeTables  # noqa: E402
from duebook.schema import INS_EST, INS_PAY, PLAN_OFFSET, PLAN_TOTAL, TABLES, WRITEOFF  # noqa: E402

INCLUSIVE = AsOf.on("2001-06-30")
EXCLUSIVE = AsOf.on("2001-07-01", inclusive=False)
QUARTER = Period.between("2001-04-01", "2001-06-30")
HALF_YEAR = AsOf.series(
    ["2001-01-31", "2001-02-28", "2001-03-31", "2001-04-30", "2001-05-31", "2001-06-30"]
)

Build = Callable[[Tables], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]


def _as_doubles(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        *(f"CAST(`{f.name}` AS DOUBLE) AS `{f.name}`" if isinstance(f.dataType, T.DecimalType)
          else f"`{f.name}`" for f in rows.schema.fields)
    )


def _report(build: Callable, *args) -> Build:
    return lambda tables: _as_doubles(build(tables, *args))


def _scan(name: str) -> Build:
    return _report(lambda tables: tables.read(name, *TABLES[name]))


def _rows(build: Callable, *args, fields: str, money: str) -> Build:
    """A ledger branch: the columns that mean something there, money as dollars."""
    amounts = money.split()

    def query(tables):
        return in_dollars(build(tables, *args).select(*fields.split(), *amounts), *amounts)

    return _report(query)


_BASE = "trantype prikey patnum trandate"
_FULL = "trantype prikey procnum patnum clinicnum trandate procdate"
_ESTIMATES = "instotest inspayest inswoest"
_SUMS = (*balances.INS_BUCKETS, *balances.PAT_BUCKETS, "TotalPayments", "TotalBalance",
         "TotalPayPlan", "InsPayEst", "InsWoEst")
_FIVE = ("tranamount", "payplanamount", "instotest", "inspayest", "inswoest")


def _procedure_sums(tables, as_of, by_clinic=False):
    keys = ["clinicnum"] if by_clinic else []
    ledger = ledgers.receivable(tables, as_of, with_clinic=by_clinic)
    return in_dollars(balances.procedure_summary(ledger, keys), *_FIVE)


def _bucket_sums(tables, as_of, by_clinic=False):
    keys = ["clinicnum"] if by_clinic else []
    ledger = ledgers.receivable(tables, as_of, with_clinic=by_clinic)
    return in_dollars(balances.receivable_sums(ledger, as_of, keys), *_SUMS)


def _day_groups(tables, as_of):
    names = ("TranType", "PriKey", "patnum", "TranDate", "TranAmount", "PayPlanAmount",
             "InsWoEst", "InsPayEst")
    return aging.aging_day_groups(tables, as_of).toDF(*names)


def _in_order(build: Build) -> Build:
    """The rows with their places, as the report hands them out."""
    return lambda tables: with_places(build(tables)).withColumn("position", F.col("position").cast("int"))


class _Lacking(Tables):
    """Another source's tables, one of them without rows."""

    def __init__(self, tables: Tables, name: str):
        self.tables, self.name = tables, name

    def _without(self, name, rows):
        return rows.filter("false") if name == self.name else rows

    def frame(self, name, columns):
        return self._without(name, self.tables.frame(name, columns))

    def read(self, name, *columns, **how):
        return self._without(name, self.tables.read(name, *columns, **how))

    def among(self, name, key, wanted, *columns):
        return self._without(name, self.tables.among(name, key, wanted, *columns))

    def split(self, name, key, *columns, **how):
        return tuple(self._without(name, rows) for rows in self.tables.split(name, key, *columns, **how))

    def referring(self, reference, *columns, **how):
        if reference.target == self.name:
            return super().referring(reference, *columns, **how)
        return self._without(reference.name, self.tables.referring(reference, *columns, **how))


def _kept(tables: Tables) -> DataFrame:
    """The A/R aging from day groups kept before any adjustment was made, and merged since with the
    patients that have one."""
    adjusted = tables.read("adjustment", "patnum")
    kept = KeptDayGroups(adjusted.sparkSession, new_folder(adjusted.sparkSession, "day-groups"))
    kept.write(_Lacking(tables, "adjustment"))
    kept.merge(tables, adjusted)
    return kept.aging_of_receivables(tables, INCLUSIVE)


def _written(name: str) -> Build:
    """A table after ``write_tables`` and reading it back."""
    def query(tables):
        spark = tables.read(name, "adjnum").sparkSession
        path = new_folder(spark, "written")
        write_tables(tables, path, [name])
        return StoredTables(spark, path).read(name, *TABLES[name])

    return _report(query)


def builds() -> dict[str, Build]:
    """One entry per operator and report, over any source of the ledger tables."""
    q, x = INCLUSIVE, EXCLUSIVE
    scans = {f"s{i:02d}_{name}": _scan(name) for i, name in enumerate(TABLES, start=1)}
    scans["s12_written_adjustment"] = _written("adjustment")
    branches = {
        "l01_proc": _rows(charges.procedure_charges, q, fields=_BASE, money="tranamount"),
        "l01b_proc_undated": _rows(
            charges.procedure_charges, q, False, False, fields=_BASE, money="tranamount"),
        "l02_claim_ar": _rows(
            claims.claims_receivable, q, True, fields=_FULL, money=f"tranamount {_ESTIMATES}"),
        "l02x_claim_ar_exclusive": _rows(
            claims.claims_receivable, x, True, fields=_FULL, money=f"tranamount {_ESTIMATES}"),
        "l03_claim_prod": _rows(
            claims.claims_production, q, True, fields=_FULL, money=f"tranamount woamount {_ESTIMATES}"),
        "l04_claim_month": _rows(
            claims.claims_paid, QUARTER, True, fields=_FULL, money="tranamount woamount"),
        "l05_claim_listing": _rows(
            claims.claims_paid, x, True, INS_PAY, fields=f"{_BASE} clinicnum",
            money="tranamount woamount"),
        "l06_claim_aging": _rows(
            claims.claims_aging, q, fields=_BASE, money="tranamount inspayest inswoest"),
        "l07_inspay": _rows(claims.claim_events, q, [INS_PAY], fields=_BASE, money="tranamount"),
        "l08_writeoff": _rows(claims.claim_events, q, [WRITEOFF], fields=_BASE, money="tranamount"),
        "l09_writeoff_est": _rows(
            claims.writeoff_estimates, q, fields=_BASE, money="tranamount"),
        "l10_ins_est": _rows(claims.claim_events, q, [INS_EST], fields=_BASE, money="tranamount"),
        "l11_adj_procdate": _rows(
            charges.adjustments_by_service, q, True, fields=_FULL, money="tranamount"),
        "l12_adj_adjdate": _rows(
            charges.adjustments_by_entry, q, fields=f"{_BASE} agedprocnum agedprocdate",
            money="tranamount"),
        "l13_pp_offset": _rows(
            installments.plan_totals, q, False, [PLAN_OFFSET], fields=_BASE, money="tranamount"),
        "l13c_pp_offset_clinic": _rows(
            installments.plan_totals, x, True, [PLAN_OFFSET], fields=f"{_BASE} clinicnum",
            money="tranamount"),
        "l14_pp_total": _rows(
            installments.plan_totals, q, False, [PLAN_TOTAL], fields=_BASE, money="payplanamount"),
        "l14c_pp_total_clinic": _rows(
            installments.plan_totals, x, True, [PLAN_TOTAL], fields=f"{_BASE} clinicnum",
            money="payplanamount"),
        "l15_pp_complete": _rows(
            installments.plans_completed, q, fields=_BASE, money="tranamount"),
        "l16_pp_charge": _rows(installments.plan_charges, q, fields=_BASE, money="payplanamount"),
        "l17_pp_charge_credit": _rows(
            installments.plan_entries, q, fields=_BASE, money="tranamount"),
        "l18a_linked_proc_fee": _rows(
            installments.linked_procedure_fees, fields="linknum procnum patnum agedate",
            money="fee"),
        "l18b_linked_adj_fee": _rows(
            installments.linked_adjustment_fees, fields="linknum procnum patnum agedate",
            money="fee"),
        "l18_payplan_link": _rows(
            installments.linked_production, q, fields=_BASE, money="tranamount"),
        "l19_payplan_discount": _rows(
            installments.linked_discounts, q, fields=_BASE, money="tranamount"),
        "l20_patpay_ar": _rows(
            splits.splits_entered, q, True, fields=f"{_BASE} clinicnum procdate",
            money="tranamount payplanamount"),
        "l21_patpay_month": _rows(
            splits.splits_in_period, QUARTER, fields=f"{_BASE} clinicnum procdate",
            money="tranamount payplanamount"),
        "l22_patpay_listing": _rows(
            splits.splits_listed, x, fields=f"{_BASE} clinicnum", money="tranamount"),
        "l23_patpay_aging": _rows(
            splits.splits_paid, q, fields=f"{_BASE} procdate",
            money="tranamount payplanamount"),
        "l24_patpay_custom": _rows(splits.splits_earned, q, fields=_BASE, money="tranamount"),
    }
    sums = {
        "u1_ledger_ar": _rows(
            ledgers.receivable, q, fields="trantype procnum patnum procdate",
            money=" ".join(_FIVE)),
        "u1_ledger_prod": _rows(
            ledgers.production, q, fields="trantype patnum",
            money="tranamount woamount payplanamount instotest"),
        "u1_ledger_month": _rows(
            ledgers.month, QUARTER, fields="trantype patnum clinicnum trandate",
            money="tranamount woamount payplanamount"),
        "u1_ledger_custom": _rows(
            ledgers.custom_aging, q, fields="trantype patnum trandate", money="tranamount"),
        "a1_proc_summary": _report(_procedure_sums, q),
        "a1c_proc_summary_clinic": _report(_procedure_sums, x, True),
        "a2_ar_buckets": _report(_bucket_sums, q),
        "a2c_ar_buckets_clinic": _report(_bucket_sums, x, True),
        "a7_adj_by_proc": _rows(
            linked.adjustment_by_procedure, fields="procnum patnum provnum clinicnum",
            money="adjamt"),
        "a8_claim_by_proc": _rows(
            linked.claims_by_procedure, fields="procnum", money="inspay writeoff"),
        "a9_split_by_proc": _rows(linked.splits_by, "procnum", fields="procnum", money="splitamt"),
        "a10_split_by_adj": _rows(linked.splits_by, "adjnum", fields="adjnum", money="splitamt"),
        "a12_trans": _report(_day_groups, q),
        "a13_trans_sums": _report(aging.aging_charges, q),
        "x3_tsums_clamped": _report(aging.aging_charges, q, True),
        "x2_guar_aging": _report(aging.aging_balances, q),
        "a14_custom_sums": _report(aging.custom_aging_charges, q),
    }
    reports = {
        "r01_ar_detailed": _report(receivables.receivables_by_patient, q),
        "r02_ar_summary": _report(receivables.receivables_total, q),
        "r03_ar_detailed_clinic": _report(receivables.receivables_by_clinic_and_patient, x),
        "r04_ar_summary_clinic": _report(receivables.receivables_by_clinic, x),
        "r05_prod_detailed": _report(production.production_by_patient, q),
        "r06_prod_summary": _report(production.production_total, q),
        "r07_prod_month_detailed": _report(production.production_by_month_and_patient, QUARTER),
        "r08_prod_month_summary": _report(production.production_by_month, QUARTER),
        "r09_transactions": _report(listing.transactions, x),
        "r10_tranbyproc": _rows(
            ledgers.aging, q, fields=f"{_BASE} agedprocnum agedprocdate",
            money="tranamount payplanamount inswoest inspayest"),
        "r12_aging_of_ar": _report(aging.aging_of_receivables, q),
        "r12_aging_kept": _report(_kept),
        "r13_custom_aging": _report(aging.custom_aging, q),
        "o1_aging_of_ar_order": _in_order(_report(aging.aging_of_receivables, q)),
        "o1_custom_aging_order": _in_order(_report(aging.custom_aging, q)),
        "p6_transactions_clinic": _report(listing.transactions, x, 3),
        "r14_aging_series": _report(aging.aging_of_receivables, HALF_YEAR),
        "r14_custom_series": _report(aging.custom_aging, HALF_YEAR),
        "r14_ar_series": _report(receivables.receivables_total, HALF_YEAR),
        "r14_ar_clinic_series": _report(receivables.receivables_by_clinic, HALF_YEAR),
        "r14_prod_series": _report(production.production_total, HALF_YEAR),
    }
    return {**scans, **branches, **sums, **reports}


def _over_trade(build: Build) -> Query:
    return lambda spark, sf_dir: build(TradeTables(spark, sf_dir))


def _text_queries() -> tuple[dict[str, Query], dict[str, str]]:
    """The text operators and their pipeline, where the package is there."""
    try:
        import corpus_pipeline
        from duebook.llm import queries as text
    except ImportError:
        return {}, {}
    answers = text.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        answers["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**text.queries(), "pipeline": corpus_pipeline.run}, answers


def queries() -> dict[str, Query]:
    """Every operator and report over the ledger tables derived from a test folder, and the
    text operators over the test tables themselves."""
    return {**{name: _over_trade(build) for name, build in builds().items()}, **_text_queries()[0]}


def oracle_sql() -> dict[str, str]:
    """The SQL answers; a query without one is tested against a plain version of itself."""
    return {**oracle.sql(), **_text_queries()[1]}


def entry(spark: SparkSession) -> DataFrame:
    """The receivables totals as of the report date."""
    return queries()["r02_ar_summary"](spark, "/root/testdata/sf0.001")

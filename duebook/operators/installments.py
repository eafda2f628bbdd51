"""Payment plans: what was moved into them, what they charge and what is linked to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.money import ZERO, units
from duebook.operators.charges import GROSS_FEE
from duebook.operators.linked import claims_by_procedure, splits_by
from duebook.operators.rows import each_entry, ledger_rows, place, union_all
from duebook.params import AsOf, Period
from duebook.schema import (
    COMPLETE, CREDIT, DEBIT, LINK_ADJUSTMENT, LINK_PROCEDURE, NO_DATE, PLAN_CHARGE, PLAN_COMPLETE,
    PLAN_LINK, PLAN_OFFSET, PLAN_TOTAL, PLANNED,
)
from duebook.sources.base import Tables

_PLAN_AMOUNT = units("completedamt")
_DUE = f"{units('principal')} + {units('interest')}"


def plan_totals(
    tables: Tables,
    scope: AsOf | Period,
    with_clinic: bool = False,
    kinds: Sequence[str] = (PLAN_OFFSET, PLAN_TOTAL),
) -> DataFrame:
    """The plan's full amount taken off the ledger (offset) and, while the plan is open,
    listed as plan money (total). Plans carry no clinic; the patient's stands in."""
    rows = tables.read("payplan", "payplannum", "patnum", "payplandate", "completedamt", "isclosed")
    rows = rows.filter("completedamt != 0")
    if with_clinic:
        rows = rows.join(tables.read("patient", "patnum", "clinicnum"), "patnum", "left")
    options = {
        PLAN_OFFSET: ("true", {"owed": f"-{_PLAN_AMOUNT}", "planned": ZERO}),
        PLAN_TOTAL: ("isclosed = 0", {"owed": ZERO, "planned": _PLAN_AMOUNT}),
    }
    entries = [(options[k][0], {"kind": f"'{k}'", **options[k][1]}) for k in kinds]
    return ledger_rows(
        each_entry(scope.select(rows, "payplandate"), entries),
        [*scope.keys, *place(with_clinic)], "entry.kind",
        prikey="payplannum", patnum="patnum", trandate="payplandate", procdate="payplandate",
        tranamount="entry.owed", payplanamount="entry.planned",
    )


def plans_completed(tables: Tables, as_of: AsOf) -> DataFrame:
    """The plan's full amount taken off the ledger, whatever its date."""
    rows = tables.read("payplan", "payplannum", "patnum", "payplandate", "completedamt")
    return ledger_rows(
        as_of.spread(rows.filter("completedamt != 0")), as_of.keys, PLAN_COMPLETE,
        prikey="payplannum", patnum="patnum", trandate="payplandate", procdate="payplandate",
        tranamount=f"-{_PLAN_AMOUNT}",
    )


def plan_charges(tables: Tables, as_of: AsOf, look_ahead: int = 10) -> DataFrame:
    """Charges of non-insurance plans due up to some days past the report date, booked to
    the guarantor."""
    own_plans = tables.read("payplan", "payplannum", "plannum").filter("plannum = 0")
    rows = tables.read(
        "payplancharge", "payplanchargenum", "payplannum", "guarantor", "chargedate",
        "chargetype", "principal", "interest",
    ).filter(f"chargetype = {DEBIT} AND principal + interest != 0")
    rows = rows.join(own_plans, "payplannum", "left_semi")
    return ledger_rows(
        as_of.due(rows, "chargedate", look_ahead), as_of.keys, PLAN_CHARGE,
        prikey="payplanchargenum", patnum="guarantor", trandate="chargedate",
        procdate="chargedate", payplanamount=_DUE,
    )


def plan_entries(tables: Tables, as_of: AsOf) -> DataFrame:
    """Charges and credits of all plans: credits take principal off, debits of plans
    without insurance add principal and interest, others count for nothing. Insurance
    plans are booked to the patient, the rest to the guarantor."""
    plans = tables.read("payplan", "payplannum", "plannum")
    rows = tables.read(
        "payplancharge", "payplanchargenum", "payplannum", "patnum", "guarantor", "chargedate",
        "chargetype", "principal", "interest",
    ).filter(f"chargetype IN ({DEBIT}, {CREDIT})").join(plans, "payplannum", "left")
    debit = f"if(plannum = 0, {_DUE}, {ZERO})"
    return ledger_rows(
        as_of.select(rows, "chargedate"), as_of.keys, PLAN_COMPLETE,
        prikey="payplanchargenum", patnum="if(plannum > 0, patnum, guarantor)",
        trandate="chargedate",
        tranamount=f"if(chargetype = {DEBIT}, {debit}, -{units('principal')})",
    )


_LINK = ("payplannum", "amountoverride", "secdatetentry")
_PROCEDURE = ("procnum", "patnum", "provnum", "clinicnum", "procdate", "procstatus", "procfee",
              "unitqty", "baseunits", "discount", "discountplanamt")
# What a link moves into its plan: the override where one is set, else what is left.
_MOVED = f"-if(amountoverride = 0, fee, {units('amountoverride')})"
# Links that move their procedure: all but those of a plan that waits for completed work.
_COUNTED = f"NOT (dynamicpayplantpoption = 1 AND procstatus != {COMPLETE})"
# Links whose planned procedure a dynamic plan already counts as done, at a discount.
_DISCOUNTED = (f"isdynamic = 1 AND dynamicpayplantpoption = 2 AND procstatus = {PLANNED} "
               "AND (discount != 0 OR discountplanamt != 0)")


def _links(tables: Tables, kind: int, target: str) -> DataFrame:
    """Links of one kind, with the key they point at under the name ``target``."""
    links = tables.read("payplanlink", "payplanlinknum", "linktype", "fkey", *_LINK)
    return links.filter(f"linktype = {kind}").selectExpr(
        "payplanlinknum AS linknum", f"fkey AS {target}", *_LINK
    )


def procedure_worth(tables: Tables, wanted: DataFrame) -> DataFrame:
    """What is left of the ``wanted`` procedures (``fee``): their gross fee less the
    adjustments, insurance money and payments on them. Claims, payments and adjustments are
    cut to the wanted procedures before anything is grouped, so what is shuffled grows with
    the links, not with the facts; rows that name no procedure go with that cut. An
    adjustment counts where patient, provider and clinic are those of its procedure. All
    joins are by procedure alone, so one placement serves them."""
    wanted = wanted.filter("procnum != 0").select("procnum").distinct()
    procedures = tables.among("procedurelog", "procnum", wanted, *_PROCEDURE)
    own = procedures.selectExpr("procnum", "patnum AS pat", "provnum AS prov", "clinicnum AS clinic")
    adjusted = tables.read(
        "adjustment", "procnum", "patnum", "provnum", "clinicnum", "adjamt", by="procnum")
    same = "patnum = pat AND provnum = prov AND clinicnum = clinic"
    credits = union_all([
        claims_by_procedure(tables, wanted).selectExpr("procnum", "inspay + writeoff AS credit"),
        splits_by(tables, "procnum", wanted).selectExpr("procnum", "splitamt AS credit"),
        adjusted.join(own, "procnum").selectExpr(
            "procnum", f"if({same}, {units('adjamt')}, {ZERO}) AS credit"),
    ]).groupBy("procnum").agg(F.expr("sum(credit) AS credit"))
    return procedures.join(credits, "procnum", "left").selectExpr(
        "procnum", "patnum", "procdate", "procstatus", "discount", "discountplanamt",
        f"{GROSS_FEE} + coalesce(credit, {ZERO}) AS fee",
    )


def _linked_procedures(tables: Tables, valued: bool) -> DataFrame:
    """Links with their plan and procedure, ``valued`` by what is left of it."""
    plans = tables.read("payplan", "payplannum", "isdynamic", "dynamicpayplantpoption")
    links = _links(tables, LINK_PROCEDURE, "procnum")
    if valued:
        procedures = procedure_worth(tables, links)
    else:
        procedures = tables.read(
            "procedurelog", "procnum", "patnum", "procdate", "procstatus", "discount",
            "discountplanamt", by="procnum",
        )
    return links.join(plans, "payplannum").join(procedures, "procnum")


def linked_procedure_fees(tables: Tables) -> DataFrame:
    """What is left of each procedure linked to a plan, per link."""
    rows = _linked_procedures(tables, valued=True).filter(_COUNTED)
    return rows.selectExpr("linknum", "procnum", "patnum", "procdate AS agedate", "fee")


def linked_procedures(
    tables: Tables, as_of: AsOf, moved: bool = True, discounted: bool = True
) -> DataFrame:
    """Procedures moved into plans, and the discounts on those only planned so far, out of
    one pass over the links."""
    entries = []
    if moved:
        entries.append((_COUNTED, {"day": "to_date(secdatetentry)", "amount": _MOVED}))
    if discounted:
        discount = f"{units('discount')} + {units('discountplanamt')}"
        entries.append((_DISCOUNTED, {"day": "procdate", "amount": discount}))
    rows = as_of.select(_linked_procedures(tables, valued=moved), "procdate")
    return ledger_rows(
        each_entry(rows, entries), as_of.keys, PLAN_LINK,
        prikey="linknum", patnum="patnum", trandate="entry.day", tranamount="entry.amount",
    )


def adjustment_worth(tables: Tables, wanted: DataFrame) -> DataFrame:
    """What is left of the ``wanted`` adjustments after the payments on them."""
    wanted = wanted.filter("adjnum != 0").select("adjnum").distinct()
    adjustments = tables.read("adjustment", "adjnum", "patnum", "adjamt")
    return (
        adjustments.join(wanted, "adjnum", "left_semi")
        .join(splits_by(tables, "adjnum", wanted), "adjnum", "left")
        .selectExpr(
            "adjnum", "patnum", f"{units('adjamt')} + coalesce(splitamt, {ZERO}) AS fee"
        )
    )


def _linked_adjustments(tables: Tables) -> DataFrame:
    links = _links(tables, LINK_ADJUSTMENT, "adjnum")
    return links.join(adjustment_worth(tables, links), "adjnum")


def linked_adjustment_fees(tables: Tables) -> DataFrame:
    """What is left of each adjustment linked to a plan, per link. It has no age of its
    own."""
    return _linked_adjustments(tables).selectExpr(
        "linknum", f"{ZERO} AS procnum", "patnum", f"DATE'{NO_DATE}' AS agedate", "fee"
    )


def linked_adjustments(tables: Tables, as_of: AsOf) -> DataFrame:
    """Adjustments moved into plans; having no age, they count on any report date."""
    return ledger_rows(
        as_of.spread(_linked_adjustments(tables)), as_of.keys, PLAN_LINK,
        prikey="linknum", patnum="patnum", trandate="to_date(secdatetentry)", tranamount=_MOVED,
    )


def linked_production(tables: Tables, as_of: AsOf, discounted: bool = False) -> DataFrame:
    """Production moved into plans, and the discounts on it where asked for."""
    return linked_procedures(tables, as_of, discounted=discounted).unionByName(
        linked_adjustments(tables, as_of)
    )


def linked_discounts(tables: Tables, as_of: AsOf) -> DataFrame:
    """Discounts on planned procedures that a dynamic plan already counts as done."""
    return linked_procedures(tables, as_of, moved=False)

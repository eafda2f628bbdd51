"""Query name -> (the ``report_day`` step, the final select)."""

from __future__ import annotations

INCLUSIVE = "SELECT DATE '2001-06-30' AS q, DATE '2001-06-30' AS upto"
EXCLUSIVE = "SELECT DATE '2001-07-01' AS q, DATE '2001-06-30' AS upto"
SERIES = """
SELECT q, q AS upto FROM (VALUES (DATE '2001-01-31'), (DATE '2001-02-28'), (DATE '2001-03-31'),
                                 (DATE '2001-04-30'), (DATE '2001-05-31'), (DATE '2001-06-30')) v(q)
"""


def dbl(*pairs: str) -> str:
    """``name`` or ``expression AS name``, as DOUBLE."""
    shown = []
    for pair in pairs:
        expression, _, name = pair.rpartition(" AS ")
        shown.append(f"CAST({expression or name} AS DOUBLE) AS \"{name}\"")
    return ", ".join(shown)


def sums(*names: str) -> str:
    return dbl(*(f"SUM({n}) AS {n}" for n in names))


ANSWERS: dict[str, tuple[str, str]] = {}


def answer(name: str, body: str, scope: str = INCLUSIVE) -> None:
    ANSWERS[name] = (scope, body)


# --- the tables -------------------------------------------------------------------------

answer("s01_procedurelog", f"""
SELECT procnum, patnum, provnum, clinicnum, procdate, unitqty, baseunits, procstatus,
       {dbl("procfee", "discount", "discountplanamt")} FROM procedurelog""")
answer("s02_claimproc", f"""
SELECT claimprocnum, procnum, patnum, clinicnum, procdate, datecp, status, payplannum,
       {dbl("inspayamt", "inspayest", "writeoff", "insesttotaloverride", "writeoffest",
            "writeoffestoverride")} FROM claimproc""")
answer("s03_claimsnapshot", f"SELECT claimprocnum, {dbl('writeoff')} FROM claimsnapshot")
answer("s04_adjustment", f"""
SELECT adjnum, procnum, patnum, provnum, clinicnum, adjdate, procdate, {dbl("adjamt")}
FROM adjustment""")
answer("s05_payplan", f"""
SELECT payplannum, patnum, plannum, payplandate, {dbl("completedamt")}, isclosed, isdynamic,
       dynamicpayplantpoption FROM payplan""")
answer("s06_payplancharge", f"""
SELECT payplanchargenum, payplannum, patnum, guarantor, chargedate, chargetype,
       {dbl("principal", "interest")} FROM payplancharge""")
answer("s07_payplanlink", f"""
SELECT payplanlinknum, payplannum, linktype, fkey, {dbl("amountoverride")}, secdatetentry
FROM payplanlink""")
answer("s08_paysplit", f"""
SELECT splitnum, paynum, patnum, procnum, adjnum, clinicnum, payplannum, datepay, procdate,
       {dbl("splitamt")}, unearnedtype FROM paysplit""")
answer("s09_payment", "SELECT paynum, dateentry FROM payment")
answer("s10_patient", "SELECT patnum, fname, lname, middlei, clinicnum FROM patient")
answer("s11_clinic", "SELECT clinicnum, description FROM clinic")

# --- single branches --------------------------------------------------------------------

answer("l01_proc", f"""
SELECT 'Proc' AS trantype, procnum AS prikey, patnum, procdate AS trandate,
       {dbl("gross AS tranamount")} FROM work_asof""")
answer("l01b_proc_undated", f"""
SELECT 'Proc' AS trantype, procnum AS prikey, patnum, procdate AS trandate,
       {dbl("gross AS tranamount")} FROM work""")
_CLAIM_AR = f"""
SELECT 'Claimproc' AS trantype, claimprocnum AS prikey, procnum, patnum, clinicnum,
       datecp AS trandate, procdate,
       {dbl("tranamount", "instotest", "inspayest", "inswoest")} FROM claim_ar"""
answer("l02_claim_ar", _CLAIM_AR)
answer("l02x_claim_ar_exclusive", _CLAIM_AR, EXCLUSIVE)
answer("l03_claim_prod", f"""
SELECT 'Claimproc' AS trantype, claimprocnum AS prikey, procnum, patnum, clinicnum,
       datecp AS trandate, procdate,
       {dbl("tranamount", "woamount", "instotest", "inspayest", "inswoest")} FROM claim_prod""")
answer("l04_claim_month", f"""
SELECT 'Claimproc' AS trantype, claimprocnum AS prikey, procnum, patnum, clinicnum,
       datecp AS trandate, procdate, {dbl("tranamount", "woamount")} FROM claim_month""")
answer("l05_claim_listing", f"""
SELECT 'InsPay' AS trantype, claimprocnum AS prikey, patnum, clinicnum, datecp AS trandate,
       {dbl("tranamount", "woamount")} FROM claim_list""", EXCLUSIVE)
answer("l06_claim_aging", f"""
SELECT 'Claimproc' AS trantype, claimprocnum AS prikey, patnum, datecp AS trandate,
       {dbl("tranamount", "inspayest", "inswoest")} FROM claim_aging""")
for _name, _tag, _rows in (
    ("l07_inspay", "InsPay", "ins_pay"), ("l08_writeoff", "Writeoff", "wo_rows"),
    ("l09_writeoff_est", "WriteoffEst", "wo_est"), ("l10_ins_est", "InsEst", "ins_est"),
):
    answer(_name, f"""
SELECT '{_tag}' AS trantype, claimprocnum AS prikey, patnum, datecp AS trandate,
       {dbl("tranamount")} FROM {_rows}""")
answer("l11_adj_procdate", f"""
SELECT 'Adj' AS trantype, adjnum AS prikey, procnum, patnum, clinicnum, procdate AS trandate,
       procdate, {dbl("adjamt AS tranamount")} FROM adj_service""")
answer("l12_adj_adjdate", f"""
SELECT 'Adj' AS trantype, adjnum AS prikey, patnum, adjdate AS trandate,
       procnum AS agedprocnum, procdate AS agedprocdate, {dbl("adjamt AS tranamount")}
FROM adj_entry""")
for _suffix, _clinic in (("", ""), ("_clinic", "clinicnum, ")):
    _c = "c" if _clinic else ""
    _scope = EXCLUSIVE if _clinic else INCLUSIVE
    answer(f"l13{_c}_pp_offset{_suffix}", f"""
SELECT 'PPOffset' AS trantype, payplannum AS prikey, patnum, {_clinic}payplandate AS trandate,
       {dbl("-completedamt AS tranamount")} FROM plan_asof""", _scope)
    answer(f"l14{_c}_pp_total{_suffix}", f"""
SELECT 'PPTotal' AS trantype, payplannum AS prikey, patnum, {_clinic}payplandate AS trandate,
       {dbl("completedamt AS payplanamount")} FROM plan_asof WHERE isclosed = 0""", _scope)
answer("l15_pp_complete", f"""
SELECT 'PPComplete' AS trantype, payplannum AS prikey, patnum, payplandate AS trandate,
       {dbl("-completedamt AS tranamount")} FROM plan_money""")
answer("l16_pp_charge", f"""
SELECT 'PPCharge' AS trantype, payplanchargenum AS prikey, guarantor AS patnum,
       chargedate AS trandate, {dbl("payplanamount")} FROM pp_charge""")
answer("l17_pp_charge_credit", f"""
SELECT 'PPComplete' AS trantype, payplanchargenum AS prikey, patnum, chargedate AS trandate,
       {dbl("tranamount")} FROM pp_entry""")
answer("l18a_linked_proc_fee", f"""
SELECT linknum, procnum, patnum, agedate, {dbl("fee")} FROM proc_fee""")
answer("l18b_linked_adj_fee", f"""
SELECT linknum, CAST(procnum AS BIGINT) AS procnum, patnum, agedate, {dbl("fee")} FROM adj_fee""")
for _name, _rows in (("l18_payplan_link", "moved"), ("l19_payplan_discount", "discounted")):
    answer(_name, f"""
SELECT 'PayPlanLink' AS trantype, payplanlinknum AS prikey, patnum, trandate,
       {dbl("tranamount")} FROM {_rows}""")
for _name, _rows in (("l20_patpay_ar", "split_entered"), ("l21_patpay_month", "split_month")):
    answer(_name, f"""
SELECT 'PatPay' AS trantype, splitnum AS prikey, patnum, clinicnum, datepay AS trandate, procdate,
       {dbl("plainamt AS tranamount", "planamt AS payplanamount")} FROM {_rows}""")
answer("l23_patpay_aging", f"""
SELECT 'PatPay' AS trantype, splitnum AS prikey, patnum, datepay AS trandate, procdate,
       {dbl("plainamt AS tranamount", "planamt AS payplanamount")} FROM split_paid""")
answer("l22_patpay_listing", f"""
SELECT 'PatPay' AS trantype, splitnum AS prikey, patnum, clinicnum, datepay AS trandate,
       {dbl("amount AS tranamount")} FROM split_paid""", EXCLUSIVE)
answer("l24_patpay_custom", f"""
SELECT 'PatPay' AS trantype, splitnum AS prikey, patnum, datepay AS trandate,
       {dbl("amount AS tranamount")} FROM split_paid
WHERE unearnedtype <> 301 AND unearnedtype <> 325""")

# --- ledgers and sums -------------------------------------------------------------------

answer("u1_ledger_ar", f"""
SELECT tag AS trantype, procnum, patnum, procdate,
       {dbl("amt AS tranamount", "planamt AS payplanamount", "instot AS instotest",
            "insest AS inspayest", "woest AS inswoest")} FROM led_ar""")
answer("u1_ledger_prod", f"""
SELECT tag AS trantype, patnum, {dbl("amt AS tranamount", "wo AS woamount",
       "planamt AS payplanamount", "instot AS instotest")} FROM led_prod""")
answer("u1_ledger_month", f"""
SELECT tag AS trantype, patnum, clinicnum, d AS trandate,
       {dbl("amt AS tranamount", "wo AS woamount", "planamt AS payplanamount")} FROM led_month""")
answer("u1_ledger_custom", f"""
SELECT tag AS trantype, patnum, d AS trandate, {dbl("amt AS tranamount")} FROM led_custom""")

_FIVE = dbl("amt AS tranamount", "planamt AS payplanamount", "instot AS instotest",
            "insest AS inspayest", "woest AS inswoest")
answer("a1_proc_summary", f"""
SELECT patnum, procdate, tag AS trantype, procnum, {_FIVE} FROM proc_sums""")
answer("a1c_proc_summary_clinic", f"""
SELECT clinicnum, patnum, procdate, tag AS trantype, procnum, {_FIVE} FROM proc_sums_clinic""",
       EXCLUSIVE)
_BEFORE = dbl(
    "InsOver120", "Ins_91_120", "Ins_61_90", "Ins_31_60", "Ins_0_30", "PatOver120", "Pat_91_120",
    "Pat_61_90", "Pat_31_60", "Pat_0_30", "TotalPayments", "TotalBalance", "TotalPayPlan",
    "InsPayEst", "InsWoEst",
)
answer("a2_ar_buckets", f"SELECT patnum, {_BEFORE} FROM ar_sums")
answer("a2c_ar_buckets_clinic", f"SELECT clinicnum, patnum, {_BEFORE} FROM ar_sums_clinic", EXCLUSIVE)
answer("a7_adj_by_proc", f"SELECT procnum, patnum, provnum, clinicnum, {dbl('adjamt')} FROM adj_proc")
answer("a8_claim_by_proc", f"SELECT procnum, {dbl('inspay', 'writeoff')} FROM claim_proc")
answer("a9_split_by_proc", f"SELECT procnum, {dbl('splitamt')} FROM split_proc")
answer("a10_split_by_adj", f"SELECT adjnum, {dbl('splitamt')} FROM split_adj")
answer("a12_trans", f"""
SELECT tag AS "TranType", CAST(0 AS BIGINT) AS "PriKey", patnum, d AS "TranDate",
       {dbl("amt AS TranAmount", "planamt AS PayPlanAmount", "woest AS InsWoEst",
            "insest AS InsPayEst")} FROM day_group""")
_AGED = dbl("ChargesOver90", "Charges_61_90", "Charges_31_60", "Charges_0_30", "TotalCredits",
            "BalTotal", "InsWoEst", "InsPayEst", "PayPlanDue")
answer("a13_trans_sums", f"SELECT patnum, {_AGED} FROM charge_sum")
answer("x3_tsums_clamped", f"SELECT patnum, {_AGED} FROM clamped_sum")
answer("x2_guar_aging", f"""
SELECT patnum, {dbl("BalOver90", "Bal_61_90", "Bal_31_60", "Bal_0_30", "BalTotal", "InsWoEst",
                    "InsPayEst", "PayPlanDue")} FROM aged""")
answer("a14_custom_sums", f"""
SELECT patnum, {dbl("Charges_0_30", "Charges_31_60", "Charges_61_90", "ChargesOver90",
       "TotalCharges", "Credits_0_30", "Credits_31_60", "Credits_61_90", "CreditsOver90",
       "TotalCredits", "BalTotal")} FROM custom_sum""")

# --- reports ----------------------------------------------------------------------------

_AR = (
    "InsOver120", "Ins_91_120", "Ins_61_90", "Ins_31_60", "Ins_0_30", "PatOver120", "Pat_91_120",
    "Pat_61_90", "Pat_31_60", "Pat_0_30", "TotalArBalance", "TotalApBalance", "TotalPayPlan",
    "InsPayEst", "InsWoEst",
)
_PROD = (
    "RawProduction", "TotWo", "PosAdj", "NegAdj", "NetProduction", "TotInsPaymt", "PatPaymts",
    "NetCollections", "TotBalance", "InsAR", "PatAR", "PatAP", "PPOwed",
)
_MONTH = tuple(m for m in _PROD if m not in ("InsAR", "PatAR", "PatAP"))


def _prod_totals(names: tuple[str, ...]) -> str:
    return dbl(*(f"SUM({n}) AS {'PayPaymts' if n == 'PatPaymts' else n}" for n in names))


answer("r01_ar_detailed", f"SELECT patnum, {dbl(*_AR)} FROM ar_detail")
answer("r02_ar_summary", f"SELECT {sums(*_AR)} FROM ar_detail")
answer("r03_ar_detailed_clinic", f"""
SELECT q AS ar_date, clinicnum, patnum, {dbl(*_AR)} FROM ar_detail_clinic""", EXCLUSIVE)
_BY_CLINIC = f"""
SELECT q AS ar_date, clinicnum, description AS "ClinicName", {sums(*_AR)}
FROM ar_detail_clinic LEFT JOIN clinic USING (clinicnum)
GROUP BY q, clinicnum, description"""
answer("r04_ar_summary_clinic", _BY_CLINIC, EXCLUSIVE)
answer("r05_prod_detailed", f"SELECT patnum, {dbl(*_PROD)} FROM prod_detail")
answer("r06_prod_summary", f"SELECT {_prod_totals(_PROD)} FROM prod_detail")
answer("r07_prod_month_detailed", f"""
SELECT TranMonth AS "TranMonth", clinicnum, patnum, {dbl(*_MONTH)} FROM prod_month""")
answer("r08_prod_month_summary", f"""
SELECT TranMonth AS "TranMonth", clinicnum AS "ClinicNum", description AS "ClinicName",
       {_prod_totals(_MONTH)}
FROM prod_month LEFT JOIN clinic USING (clinicnum) GROUP BY TranMonth, clinicnum, description""")
answer("r09_transactions", f"""
SELECT p.fname || ' ' || p.lname AS pat_name, p.clinicnum AS pat_clinic, t.tag AS "TranType",
       t.pk AS "PriKey", t.patnum, t.clinicnum, t.d AS "TranDate",
       {dbl("t.amt AS TranAmount", "t.wo AS WoAmount")}
FROM led_list t LEFT JOIN patient p ON p.patnum = t.patnum""", EXCLUSIVE)
answer("r10_tranbyproc", f"""
SELECT tag AS trantype, pk AS prikey, patnum, d AS trandate,
       {dbl("amt AS tranamount", "planamt AS payplanamount", "woest AS inswoest",
            "insest AS inspayest")}, agedproc AS agedprocnum, ageddate AS agedprocdate
FROM led_aging""")
answer("r12_aging_of_ar", f"""
SELECT lname || ', ' || fname || ' ' || middlei AS "patName",
       {dbl("Bal_0_30 AS bal_0_30", "Bal_31_60 AS bal_31_60", "Bal_61_90 AS bal_61_90",
            "BalOver90 AS balover90", "BalTotal AS baltotal", "InsWoEst AS inswoest",
            "InsPayEst AS inspayest", "BalTotal - InsPayEst - InsWoEst AS $pat")}
FROM aged JOIN patient USING (patnum)
WHERE GREATEST(Bal_0_30, Bal_31_60, Bal_61_90, BalOver90) >= 0.005""")
answer("r13_custom_aging", f"""
SELECT fname, lname, patnum, {dbl("Bal_0_30", "Bal_31_60", "Bal_61_90", "BalOver90", "BalTotal")}
FROM (SELECT r.patnum AS patnum, w[1] AS BalOver90, w[2] AS Bal_61_90, w[3] AS Bal_31_60,
             w[4] AS Bal_0_30, ROUND(r.TotalCharges - r.TotalCredits, 3) AS BalTotal FROM custom_paid)
JOIN patient USING (patnum)
WHERE BalTotal > 0 AND (Bal_0_30 <> 0 OR Bal_31_60 <> 0 OR Bal_61_90 <> 0 OR BalOver90 <> 0)""")
answer("r14_ar_series", f"SELECT q AS as_of, {sums(*_AR)} FROM ar_detail GROUP BY q", SERIES)
answer("r14_ar_clinic_series", _BY_CLINIC, SERIES)
answer("r14_prod_series", f"SELECT q AS as_of, {_prod_totals(_PROD)} FROM prod_detail GROUP BY q",
       SERIES)

# --- clinic, order, series and the written table --------------------------------------------

_ADJUSTMENT = ANSWERS["s04_adjustment"][1]
answer("s12_written_adjustment", _ADJUSTMENT)
answer("r12_aging_kept", ANSWERS["r12_aging_of_ar"][1])
answer("p6_transactions_clinic", ANSWERS["r09_transactions"][1] + "\nWHERE t.clinicnum = 3", EXCLUSIVE)
_PLACE = "CAST(row_number() OVER (ORDER BY lower(lname), lower(fname), patnum) AS INT) AS position"
for _name, _report in (("o1_aging_of_ar_order", "r12_aging_of_ar"), ("o1_custom_aging_order", "r13_custom_aging")):
    answer(_name, ANSWERS[_report][1].replace("SELECT ", f"SELECT {_PLACE}, ", 1))

#: Series of reports whose steps know one day: one statement per day, put together.
BY_DAY = {"r14_aging_series": "r12_aging_of_ar", "r14_custom_series": "r13_custom_aging"}
DAYS = ("2001-01-31", "2001-02-28", "2001-03-31", "2001-04-30", "2001-05-31", "2001-06-30")

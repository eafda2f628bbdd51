"""Named steps. ``report_day`` holds the report days: q is the date itself, upto the last day
that still counts (q, or the day before where q is exclusive)."""

from __future__ import annotations

RELATIONS: dict[str, str] = {}

# --- the eleven tables out of the test tables (FIXTURES.md §2) ------------------------

RELATIONS["li"] = """
SELECT l_orderkey, l_linenumber,
       CAST(MAX(l_extendedprice) AS DECIMAL(12,2)) AS price,
       CAST(MAX(l_discount) AS DECIMAL(12,2)) AS disc,
       MAX(l_suppkey) AS suppkey, MIN(l_returnflag) AS rf,
       CAST(MIN(l_shipdate) AS DATE) AS sd
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

RELATIONS["firstline"] = """
SELECT l_orderkey AS fk, MIN(l_orderkey * 10 + l_linenumber) AS fproc,
       ARG_MIN(sd, l_linenumber) AS fdate, ARG_MIN(suppkey, l_linenumber) + 1 AS fprov
FROM li GROUP BY l_orderkey
"""

RELATIONS["ord"] = """
SELECT o_orderkey AS k, o_custkey + 1 AS pat, CAST(c_nationkey + 1 AS BIGINT) AS cl,
       CAST(o_orderdate AS DATE) AS od, CAST(o_totalprice AS DECIMAL(12,2)) AS tp,
       o_orderstatus AS st
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
"""

RELATIONS["procedurelog"] = """
SELECT procnum, pat AS patnum, suppkey + 1 AS provnum, cl AS clinicnum, sd AS procdate,
       CAST(CASE WHEN procnum % 97 = 0 THEN 0 ELSE price END AS DECIMAL(12,2)) AS procfee,
       CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 1 END AS unitqty,
       CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS baseunits,
       CASE WHEN rf = 'R' THEN 1 ELSE 2 END AS procstatus,
       CAST(CASE WHEN l_linenumber % 3 = 0 THEN CAST(price * disc AS DECIMAL(12,2)) ELSE 0 END
            AS DECIMAL(12,2)) AS discount,
       CAST(CASE WHEN l_linenumber = 5 THEN 25 ELSE 0 END AS DECIMAL(12,2)) AS discountplanamt
FROM (SELECT *, l_orderkey * 10 + l_linenumber AS procnum FROM li)
LEFT JOIN ord ON l_orderkey = k
"""

RELATIONS["claimproc"] = """
SELECT procnum AS claimprocnum, procnum, patnum, clinicnum, procdate,
       procdate + CAST(procnum % 90 AS INT) AS datecp,
       CASE procnum % 11 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 5 THEN 4 WHEN 6 THEN 5
                         WHEN 7 THEN 7 WHEN 8 THEN 2 ELSE 1 END AS status,
       CAST(procfee * 0.50 AS DECIMAL(12,2)) AS inspayamt,
       CAST(procfee * 0.55 AS DECIMAL(12,2)) AS inspayest,
       CAST(procfee * 0.10 AS DECIMAL(12,2)) AS writeoff,
       CASE WHEN procnum % 50 = 1 THEN procnum ELSE 0 END AS payplannum,
       CAST(CASE WHEN procnum % 10 = 3 THEN CAST(procfee * 0.45 AS DECIMAL(12,2)) ELSE -1 END
            AS DECIMAL(12,2)) AS insesttotaloverride,
       CAST(CASE WHEN procnum % 10 = 4 THEN -1 ELSE CAST(procfee * 0.08 AS DECIMAL(12,2)) END
            AS DECIMAL(12,2)) AS writeoffest,
       CAST(CASE WHEN procnum % 10 = 6 THEN CAST(procfee * 0.07 AS DECIMAL(12,2)) ELSE -1 END
            AS DECIMAL(12,2)) AS writeoffestoverride
FROM procedurelog WHERE procnum % 3 <> 0
UNION ALL
SELECT k * 10 + 9, 0, pat, cl, od, od + 20, 4, CAST(tp * 0.02 AS DECIMAL(12,2)), 0, 0, 0, -1, -1, -1
FROM ord WHERE k % 11 = 0
"""

RELATIONS["claimsnapshot"] = """
SELECT claimprocnum,
       CAST(CASE WHEN claimprocnum % 4 = 0 THEN -1
                 ELSE CAST(inspayest * 0.15 AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS writeoff
FROM claimproc WHERE status = 0 AND claimprocnum % 5 <> 0
"""

RELATIONS["adjustment"] = """
SELECT k + 1 AS adjnum,
       CASE WHEN k % 4 = 0 THEN COALESCE(fproc, 0) ELSE 0 END AS procnum,
       pat AS patnum,
       CASE WHEN k % 4 = 0 THEN COALESCE(fprov, 0) ELSE 0 END AS provnum,
       cl AS clinicnum, od AS adjdate,
       CASE WHEN k % 4 = 0 THEN COALESCE(fdate, od) ELSE od END AS procdate,
       CASE WHEN k % 6 = 0 THEN CAST(tp * 0.01 AS DECIMAL(12,2))
            ELSE CAST(tp * -0.03 AS DECIMAL(12,2)) END AS adjamt
FROM ord LEFT JOIN firstline ON fk = k WHERE k % 2 = 0
"""

RELATIONS["payplan"] = """
SELECT k + 1 AS payplannum, pat AS patnum,
       CAST(CASE WHEN k % 100 = 0 THEN 1 ELSE 0 END AS BIGINT) AS plannum,
       od AS payplandate, CAST(tp * 0.20 AS DECIMAL(12,2)) AS completedamt,
       CASE st WHEN 'F' THEN 1 ELSE 0 END AS isclosed,
       CASE WHEN k % 75 = 0 THEN 1 ELSE 0 END AS isdynamic,
       CASE k % 75 WHEN 0 THEN 2 WHEN 25 THEN 1 ELSE 0 END AS dynamicpayplantpoption
FROM ord WHERE k % 25 = 0
"""

RELATIONS["payplancharge"] = """
SELECT payplannum * 10 + n AS payplanchargenum, payplannum, patnum,
       CASE WHEN payplannum % 7 = 0 THEN 1 ELSE patnum END AS guarantor,
       payplandate + CAST(30 * n AS INT) AS chargedate,
       CASE n WHEN 5 THEN 1 ELSE 0 END AS chargetype,
       CAST(completedamt * 0.20 AS DECIMAL(12,2)) AS principal,
       CAST(completedamt * 0.01 AS DECIMAL(12,2)) AS interest
FROM payplan, (SELECT n_nationkey AS n FROM nation WHERE n_nationkey < 6)
"""

RELATIONS["payplanlink"] = """
SELECT payplannum * 10 + 1 AS payplanlinknum, payplannum, 2 AS linktype, fproc AS fkey,
       CAST(CASE WHEN payplannum % 4 = 0 THEN CAST(completedamt * 0.50 AS DECIMAL(12,2)) ELSE 0 END
            AS DECIMAL(12,2)) AS amountoverride,
       CAST(payplandate AS TIMESTAMP) AS secdatetentry
FROM payplan JOIN firstline ON fk = payplannum - 1
UNION ALL
SELECT payplannum * 10 + 2, payplannum, 1, adjnum, 0, CAST(payplandate AS TIMESTAMP)
FROM payplan JOIN adjustment ON adjnum = payplannum
"""

RELATIONS["paysplit"] = """
SELECT k + 1 AS splitnum, k + 1 AS paynum, pat AS patnum,
       CASE WHEN k % 3 = 0 THEN COALESCE(fproc, 0) ELSE 0 END AS procnum,
       CASE WHEN k % 10 = 0 THEN k + 1 ELSE 0 END AS adjnum,
       cl AS clinicnum,
       CASE WHEN k % 25 = 0 THEN k + 1 ELSE 0 END AS payplannum,
       od + CAST(30 + k % 45 AS INT) AS datepay, od AS procdate,
       CAST(tp * 0.35 AS DECIMAL(12,2)) AS splitamt,
       CASE k % 20 WHEN 7 THEN 301 WHEN 9 THEN 325 ELSE 0 END AS unearnedtype
FROM ord LEFT JOIN firstline ON fk = k
"""

RELATIONS["payment"] = """
SELECT k + 1 AS paynum, od + CAST(35 + k % 40 AS INT) AS dateentry FROM ord WHERE k % 13 <> 0
"""

RELATIONS["patient"] = """
SELECT c_custkey + 1 AS patnum, c_mktsegment AS fname, c_name AS lname,
       CASE WHEN c_custkey % 5 <> 0 THEN 'M' END AS middlei,
       CAST(c_nationkey + 1 AS BIGINT) AS clinicnum
FROM customer WHERE c_custkey % 200 <> 199
"""

RELATIONS["clinic"] = """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS clinicnum, n_name AS description
FROM nation WHERE n_nationkey <> 24
"""

RELATIONS["win"] = "SELECT DATE '2001-04-01' AS s, DATE '2001-06-30' AS e"

# --- charges and adjustments -----------------------------------------------------------

RELATIONS["work"] = """
SELECT procnum, patnum, clinicnum, procdate, procfee * (unitqty + baseunits) AS gross
FROM procedurelog WHERE procstatus = 2 AND procfee <> 0
"""

RELATIONS["work_asof"] = "SELECT q, upto, work.* FROM work JOIN report_day ON procdate <= upto"

RELATIONS["adj_service"] = """
SELECT q, upto, adjnum, procnum, patnum, clinicnum, procdate, adjamt
FROM adjustment JOIN report_day ON procdate <= upto WHERE adjamt <> 0
"""

RELATIONS["adj_entry"] = """
SELECT adjnum, procnum, patnum, clinicnum, adjdate, procdate, adjamt
FROM adjustment WHERE adjamt <> 0
"""

# --- claims -----------------------------------------------------------------------------

RELATIONS["claim_ok"] = """
SELECT c.* FROM claimproc c LEFT JOIN procedurelog p ON p.procnum = c.procnum
WHERE c.status IN (0, 1, 4, 5, 7) AND (p.procstatus = 2 OR c.procnum = 0)
"""

RELATIONS["claim_state"] = """
SELECT q, upto, c.*, (status <> 0 AND datecp <= upto) AS paid,
       (status = 0 OR (datecp > upto AND status = 1)) AS waiting
FROM claim_ok c CROSS JOIN report_day
"""

RELATIONS["claim_worth"] = """
SELECT q, upto, claimprocnum, procnum, patnum, clinicnum, datecp, procdate,
       CASE WHEN paid AND payplannum = 0 THEN -inspayamt ELSE 0 END AS pay,
       CASE WHEN paid THEN -writeoff ELSE 0 END AS wo_all,
       CASE WHEN paid AND payplannum = 0 THEN -writeoff ELSE 0 END AS wo_offplan,
       CASE WHEN waiting THEN writeoff ELSE 0 END AS inswoest,
       CASE WHEN waiting THEN inspayest ELSE 0 END AS inspayest
FROM claim_state WHERE procdate <= upto
"""

RELATIONS["claim_ar"] = """
SELECT *, pay + wo_all AS tranamount, inspayest + inswoest AS instotest FROM claim_worth
WHERE pay + wo_all <> 0 OR inswoest <> 0 OR inspayest <> 0
"""

RELATIONS["claim_prod"] = """
SELECT *, pay AS tranamount, wo_offplan AS woamount, inspayest + inswoest AS instotest
FROM claim_worth WHERE pay <> 0 OR wo_offplan <> 0 OR inswoest <> 0 OR inspayest <> 0
"""

RELATIONS["claim_month"] = """
SELECT * FROM (
  SELECT claimprocnum, procnum, patnum, clinicnum, datecp, procdate,
         CASE WHEN counted THEN -inspayamt ELSE 0 END AS tranamount,
         CASE WHEN counted THEN -writeoff ELSE 0 END AS woamount
  FROM (SELECT c.*, status <> 0 AND datecp BETWEEN s AND e AND payplannum = 0 AS counted
        FROM claim_ok c, win WHERE procdate <= e))
WHERE NOT (tranamount = 0 AND woamount = 0)
"""

RELATIONS["claim_list"] = """
SELECT claimprocnum, patnum, clinicnum, datecp, pay AS tranamount, wo_offplan AS woamount
FROM claim_worth WHERE NOT (pay = 0 AND wo_offplan = 0)
"""

RELATIONS["claim_aging"] = """
SELECT * FROM (
  SELECT claimprocnum, patnum, datecp,
         CASE status WHEN 0 THEN 0
              ELSE -writeoff - CASE payplannum WHEN 0 THEN inspayamt ELSE 0 END END AS tranamount,
         CASE WHEN waiting AND procdate <= upto THEN writeoff ELSE 0 END AS inswoest,
         CASE WHEN waiting AND procdate <= upto THEN inspayest ELSE 0 END AS inspayest
  FROM claim_state)
WHERE tranamount <> 0 OR inswoest <> 0 OR inspayest <> 0
"""

RELATIONS["ins_pay"] = """
SELECT claimprocnum, patnum, datecp, -inspayamt AS tranamount
FROM claimproc JOIN report_day ON datecp <= upto
WHERE payplannum = 0 AND inspayamt <> 0 AND status IN (1, 4, 5, 7)
"""

RELATIONS["wo_rows"] = """
SELECT claimprocnum, patnum, datecp, -writeoff AS tranamount
FROM claimproc JOIN report_day ON datecp <= upto WHERE writeoff <> 0 AND status IN (1, 4, 5, 7)
"""

RELATIONS["wo_est"] = """
SELECT claimprocnum, patnum, datecp, tranamount FROM (
  SELECT c.claimprocnum, c.patnum, c.datecp,
         COALESCE(-NULLIF(sent.writeoff, -1), 0) AS tranamount
  FROM claimproc c JOIN report_day ON c.datecp <= upto
  LEFT JOIN (SELECT claimprocnum, MAX(writeoff) AS writeoff FROM claimsnapshot GROUP BY ALL) sent
    ON sent.claimprocnum = c.claimprocnum
  WHERE c.status = 0)
WHERE tranamount <> 0
"""

RELATIONS["ins_est"] = """
SELECT claimprocnum, patnum, datecp, -inspayest AS tranamount
FROM claimproc JOIN report_day ON datecp <= upto WHERE inspayest <> 0 AND status = 0
"""

# --- plans ------------------------------------------------------------------------------

RELATIONS["plan_money"] = """
SELECT payplannum, payplan.patnum, patient.clinicnum, payplandate, completedamt, isclosed
FROM payplan LEFT JOIN patient USING (patnum) WHERE completedamt <> 0
"""

RELATIONS["plan_asof"] = "SELECT q, upto, m.* FROM plan_money m JOIN report_day ON payplandate <= upto"

RELATIONS["pp_charge"] = """
SELECT payplanchargenum, guarantor, chargedate, principal + interest AS payplanamount
FROM payplancharge c JOIN payplan p ON p.payplannum = c.payplannum, report_day
WHERE plannum = 0 AND chargetype = 0 AND principal + interest <> 0 AND chargedate <= q + 10
"""

RELATIONS["pp_entry"] = """
SELECT payplanchargenum, CASE WHEN p.plannum > 0 THEN c.patnum ELSE c.guarantor END AS patnum,
       chargedate,
       CASE chargetype WHEN 1 THEN -principal
            ELSE CASE p.plannum WHEN 0 THEN principal + interest ELSE 0 END END AS tranamount
FROM payplancharge c JOIN report_day ON chargedate <= upto
LEFT JOIN payplan p ON p.payplannum = c.payplannum
WHERE chargetype IN (0, 1)
"""

RELATIONS["adj_proc"] = """
SELECT procnum, patnum, provnum, clinicnum, SUM(adjamt) AS adjamt
FROM adjustment GROUP BY ALL
"""

RELATIONS["claim_proc"] = """
SELECT procnum,
       -SUM(COALESCE(CASE WHEN status IN (1, 4, 7) THEN inspayamt
                          ELSE COALESCE(NULLIF(insesttotaloverride, -1), inspayest) END, 0)) AS inspay,
       -SUM(COALESCE(CASE WHEN status IN (1, 4, 7) THEN writeoff
                          ELSE COALESCE(NULLIF(writeoffestoverride, -1), NULLIF(writeoffest, -1))
                          END, 0)) AS writeoff
FROM claimproc WHERE status <> 2 GROUP BY procnum
"""

RELATIONS["split_proc"] = """
SELECT procnum, -SUM(splitamt) AS splitamt FROM paysplit WHERE payplannum = 0 GROUP BY procnum
"""

RELATIONS["split_adj"] = """
SELECT adjnum, -SUM(splitamt) AS splitamt FROM paysplit WHERE payplannum = 0 GROUP BY adjnum
"""

RELATIONS["proc_fee"] = """
SELECT payplanlinknum AS linknum, pr.procnum, pr.patnum, pr.procdate AS agedate,
       procfee * (unitqty + baseunits) + COALESCE(a.adjamt, 0) + COALESCE(c.inspay, 0)
         + COALESCE(c.writeoff, 0) + COALESCE(s.splitamt, 0) AS fee
FROM payplanlink l
JOIN payplan pp ON pp.payplannum = l.payplannum
JOIN procedurelog pr ON pr.procnum = l.fkey
LEFT JOIN adj_proc a ON a.procnum = pr.procnum AND a.patnum = pr.patnum
                    AND a.provnum = pr.provnum AND a.clinicnum = pr.clinicnum
LEFT JOIN claim_proc c ON c.procnum = pr.procnum
LEFT JOIN split_proc s ON s.procnum = pr.procnum
WHERE l.linktype = 2 AND (dynamicpayplantpoption <> 1 OR procstatus = 2)
"""

RELATIONS["adj_fee"] = """
SELECT payplanlinknum AS linknum, 0 AS procnum, a.patnum, DATE '0001-01-01' AS agedate,
       a.adjamt + COALESCE(s.splitamt, 0) AS fee
FROM payplanlink l JOIN adjustment a ON a.adjnum = l.fkey
LEFT JOIN split_adj s ON s.adjnum = a.adjnum
WHERE l.linktype = 1
"""

RELATIONS["moved"] = """
SELECT payplanlinknum, v.patnum, CAST(secdatetentry AS DATE) AS trandate,
       -CASE amountoverride WHEN 0 THEN v.fee ELSE amountoverride END AS tranamount
FROM payplanlink
JOIN (SELECT * FROM proc_fee UNION ALL SELECT * FROM adj_fee) v ON v.linknum = payplanlinknum
JOIN report_day ON agedate <= upto
"""

RELATIONS["discounted"] = """
SELECT payplanlinknum, pr.patnum, procdate AS trandate, discount + discountplanamt AS tranamount
FROM procedurelog pr
JOIN payplanlink l ON l.fkey = pr.procnum AND l.linktype = 2
JOIN payplan pp ON pp.payplannum = l.payplannum
JOIN report_day ON procdate <= upto
WHERE procstatus = 1 AND isdynamic = 1 AND dynamicpayplantpoption = 2
  AND NOT (discount = 0 AND discountplanamt = 0)
"""

# --- patient payments -------------------------------------------------------------------

RELATIONS["split_open"] = """
SELECT s.*, CASE WHEN s.payplannum = 0 THEN -splitamt ELSE 0 END AS plainamt,
       CASE WHEN s.payplannum <> 0 THEN -splitamt ELSE 0 END AS planamt
FROM paysplit s LEFT JOIN payplan p ON p.payplannum = s.payplannum
WHERE splitamt <> 0 AND (s.payplannum = 0 OR p.isclosed = 0)
"""

RELATIONS["split_entered"] = """
SELECT q, upto, s.* FROM split_open s JOIN payment USING (paynum)
JOIN report_day ON datepay <= upto AND dateentry <= upto
"""

RELATIONS["split_month"] = "SELECT s.* FROM split_open s JOIN win ON datepay BETWEEN win.s AND e"

RELATIONS["split_paid"] = """
SELECT splitnum, patnum, clinicnum, datepay, procdate, unearnedtype, -splitamt AS amount,
       CASE payplannum WHEN 0 THEN -splitamt ELSE 0 END AS plainamt,
       CASE WHEN payplannum <> 0 THEN -splitamt ELSE 0 END AS planamt
FROM paysplit JOIN report_day ON datepay <= upto WHERE splitamt <> 0
"""

# --- ledgers ----------------------------------------------------------------------------

RELATIONS["led_ar"] = """
SELECT q, upto, 'Proc' AS tag, procnum, patnum, clinicnum, procdate, gross AS amt,
       0 AS planamt, 0 AS instot, 0 AS insest, 0 AS woest FROM work_asof
UNION ALL
SELECT q, upto, 'Claimproc', procnum, patnum, clinicnum, procdate, tranamount, 0, instotest,
       inspayest, inswoest FROM claim_ar
UNION ALL
SELECT q, upto, 'Adj', procnum, patnum, clinicnum, procdate, adjamt, 0, 0, 0, 0 FROM adj_service
UNION ALL
SELECT q, upto, 'PPOffset', payplannum, patnum, clinicnum, payplandate, -completedamt, 0, 0, 0, 0
FROM plan_asof
UNION ALL
SELECT q, upto, 'PPTotal', payplannum, patnum, clinicnum, payplandate, 0, completedamt, 0, 0, 0
FROM plan_asof WHERE isclosed = 0
UNION ALL
SELECT q, upto, 'PatPay', splitnum, patnum, clinicnum, procdate, plainamt, planamt, 0, 0, 0
FROM split_entered
"""

RELATIONS["led_prod"] = """
SELECT q, 'Proc' AS tag, patnum, gross AS amt, 0 AS wo, 0 AS planamt, 0 AS instot FROM work_asof
UNION ALL SELECT q, 'Claimproc', patnum, tranamount, woamount, 0, instotest FROM claim_prod
UNION ALL SELECT q, 'Adj', patnum, adjamt, 0, 0, 0 FROM adj_service
UNION ALL SELECT q, 'PPOffset', patnum, -completedamt, 0, 0, 0 FROM plan_asof
UNION ALL SELECT q, 'PPTotal', patnum, 0, 0, completedamt, 0 FROM plan_asof WHERE isclosed = 0
UNION ALL SELECT q, 'PatPay', patnum, plainamt, 0, planamt, 0 FROM split_entered
"""

RELATIONS["led_month"] = """
SELECT 'Proc' AS tag, patnum, clinicnum, procdate AS d, gross AS amt, 0 AS wo, 0 AS planamt
FROM work, win WHERE procdate BETWEEN s AND e
UNION ALL
SELECT 'Claimproc', patnum, clinicnum, datecp, tranamount, woamount, 0 FROM claim_month
UNION ALL
SELECT 'Adj', patnum, clinicnum, procdate, adjamt, 0, 0
FROM adjustment, win WHERE adjamt <> 0 AND procdate BETWEEN s AND e
UNION ALL
SELECT 'PPOffset', patnum, clinicnum, payplandate, -completedamt, 0, 0
FROM plan_money, win WHERE payplandate BETWEEN s AND e
UNION ALL
SELECT 'PPTotal', patnum, clinicnum, payplandate, 0, 0, completedamt
FROM plan_money, win WHERE payplandate BETWEEN s AND e AND isclosed = 0
UNION ALL
SELECT 'PatPay', patnum, clinicnum, datepay, plainamt, 0, planamt FROM split_month
"""

RELATIONS["led_list"] = """
SELECT 'Proc' AS tag, procnum AS pk, patnum, clinicnum, procdate AS d, gross AS amt, 0 AS wo
FROM work_asof
UNION ALL
SELECT 'InsPay', claimprocnum, patnum, clinicnum, datecp, tranamount, woamount FROM claim_list
UNION ALL SELECT 'Adj', adjnum, patnum, clinicnum, procdate, adjamt, 0 FROM adj_service
UNION ALL SELECT 'PatPay', splitnum, patnum, clinicnum, datepay, amount, 0 FROM split_paid
"""

RELATIONS["led_aging"] = """
SELECT 'Proc' AS tag, procnum AS pk, patnum, procdate AS d, gross AS amt, 0 AS planamt,
       0 AS woest, 0 AS insest, 0 AS agedproc, DATE '0001-01-01' AS ageddate FROM work
UNION ALL
SELECT 'Claimproc', claimprocnum, patnum, datecp, tranamount, 0, inswoest, inspayest, 0,
       DATE '0001-01-01' FROM claim_aging
UNION ALL
SELECT 'Adj', adjnum, patnum, adjdate, adjamt, 0, 0, 0, procnum, procdate FROM adj_entry
UNION ALL
SELECT 'PatPay', splitnum, patnum, datepay, plainamt, planamt, 0, 0, 0, DATE '0001-01-01'
FROM split_paid
UNION ALL
SELECT 'PPCharge', payplanchargenum, guarantor, chargedate, 0, payplanamount, 0, 0, 0,
       DATE '0001-01-01' FROM pp_charge
UNION ALL
SELECT 'PPComplete', payplannum, patnum, payplandate, -completedamt, 0, 0, 0, 0,
       DATE '0001-01-01' FROM plan_money
"""

RELATIONS["led_custom"] = """
SELECT 'Proc' AS tag, patnum, procdate AS d, gross AS amt FROM work_asof
UNION ALL SELECT 'InsPay', patnum, datecp, tranamount FROM ins_pay
UNION ALL SELECT 'Writeoff', patnum, datecp, tranamount FROM wo_rows
UNION ALL SELECT 'WriteoffEst', patnum, datecp, tranamount FROM wo_est
UNION ALL SELECT 'Adj', patnum, adjdate, adjamt FROM adj_entry JOIN report_day ON adjdate <= upto
UNION ALL SELECT 'PPComplete', patnum, chargedate, tranamount FROM pp_entry
UNION ALL SELECT 'PayPlanLink', patnum, trandate, tranamount FROM moved
UNION ALL SELECT 'PayPlanLink', patnum, trandate, tranamount FROM discounted
UNION ALL
SELECT 'PatPay', patnum, datepay, amount FROM split_paid WHERE unearnedtype NOT IN (301, 325)
UNION ALL SELECT 'InsEst', patnum, datecp, tranamount FROM ins_est
"""

# --- receivables ------------------------------------------------------------------------


def _proc_sums(keys: str) -> str:
    return f"""
SELECT {keys}, patnum, procdate, tag, procnum, SUM(amt) AS amt, SUM(planamt) AS planamt,
       SUM(instot) AS instot, SUM(insest) AS insest, SUM(woest) AS woest
FROM (SELECT * REPLACE (CASE WHEN tag IN ('Proc', 'Claimproc') OR tag = 'Adj' AND procnum <> 0
                             THEN 'ProcSum' ELSE tag END AS tag) FROM led_ar)
GROUP BY {keys}, patnum, procdate, tag, procnum
"""


def _ar_sums(keys: str, source: str) -> str:
    bands = ["0_30", "31_60", "61_90", "91_120", "Over120"]
    ins = ["InsOver120" if b == "Over120" else f"Ins_{b}" for b in bands]
    pat = ["PatOver120" if b == "Over120" else f"Pat_{b}" for b in bands]
    sums = [f"COALESCE(SUM(instot) FILTER (band = {i}), 0) AS {n}" for i, n in enumerate(ins)]
    sums += [
        f"COALESCE(SUM(amt - instot) FILTER (band = {i} AND tag IN ('ProcSum', 'PPOffset', 'Adj')),"
        f" 0) AS {n}" for i, n in enumerate(pat)
    ]
    return f"""
SELECT {keys}, patnum, {", ".join(sums)},
       -COALESCE(SUM(amt) FILTER (tag = 'PatPay'), 0) AS TotalPayments,
       ROUND(SUM(amt), 2) AS TotalBalance, SUM(planamt) AS TotalPayPlan,
       SUM(insest) AS InsPayEst, SUM(woest) AS InsWoEst
FROM (SELECT *, CASE WHEN q - procdate > 120 THEN 4 WHEN q - procdate > 90 THEN 3
                     WHEN q - procdate > 60 THEN 2 WHEN q - procdate > 30 THEN 1 ELSE 0 END AS band
      FROM {source})
GROUP BY {keys}, patnum
"""


def _waterfall(source: str, buckets: list[str], strict: int, paid: str, digits: int) -> str:
    """Each row's buckets as rows, oldest first, with the running total before each; the
    ``strict`` youngest ones compare with < in place of <=. Gives r (the row) and w (what
    stays open, oldest first)."""
    last = len(buckets) - 1
    return f"""
SELECT any_value(o) AS r, list(open_amt ORDER BY n) AS w FROM (
  SELECT rid, o, n, ROUND(CASE
           WHEN n = 0 THEN CASE WHEN pay >= b THEN 0 ELSE b - pay END
           WHEN n > {last - strict} AND pay < older THEN b
           WHEN n <= {last - strict} AND pay <= older THEN b
           WHEN older + b <= pay THEN 0
           ELSE older + b - pay END, {digits}) AS open_amt
  FROM (SELECT rid, o, n, b, pay, COALESCE(SUM(b) OVER (
                 PARTITION BY rid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older
        FROM (SELECT rid, o, o.{paid} AS pay, unnest(range({last + 1})) AS n,
                     unnest([{", ".join(f"o.{b}" for b in buckets)}]) AS b
              FROM (SELECT row_number() OVER () AS rid, o FROM {source} o))))
GROUP BY rid
"""


RELATIONS["proc_sums"] = _proc_sums("q, upto")
RELATIONS["proc_sums_clinic"] = _proc_sums("q, upto, clinicnum")
RELATIONS["ar_sums"] = _ar_sums("q, upto", "proc_sums")
RELATIONS["ar_sums_clinic"] = _ar_sums("q, upto, clinicnum", "proc_sums_clinic")

_OPEN = "TotalBalance <> 0 OR InsPayEst + InsWoEst <> 0 OR TotalPayPlan <> 0"
_PAT = ["PatOver120", "Pat_91_120", "Pat_61_90", "Pat_31_60", "Pat_0_30"]


def _ar_detail(keys: list[str], source: str) -> str:
    copied = ["InsOver120", "Ins_91_120", "Ins_61_90", "Ins_31_60", "Ins_0_30"]
    return f"""
SELECT {", ".join(f"r.{k} AS {k}" for k in keys)},
       {", ".join(f"r.{c} AS {c}" for c in copied)},
       {", ".join(f"w[{i}] AS {c}" for i, c in enumerate(_PAT, 1))},
       CASE WHEN r.TotalBalance > 0 THEN r.TotalBalance ELSE 0 END AS TotalArBalance,
       CASE WHEN r.TotalBalance < 0 THEN r.TotalBalance ELSE 0 END AS TotalApBalance,
       r.TotalPayPlan AS TotalPayPlan, r.InsPayEst AS InsPayEst, r.InsWoEst AS InsWoEst
FROM {source}
"""


RELATIONS["ar_open"] = f"SELECT * FROM ar_sums WHERE {_OPEN}"
RELATIONS["ar_open_clinic"] = f"SELECT * FROM ar_sums_clinic WHERE {_OPEN}"
RELATIONS["ar_paid"] = _waterfall("ar_open", _PAT, 2, "TotalPayments", 2)
RELATIONS["ar_paid_clinic"] = _waterfall("ar_open_clinic", _PAT, 2, "TotalPayments", 2)
RELATIONS["ar_detail"] = _ar_detail(["q", "patnum"], "ar_paid")
RELATIONS["ar_detail_clinic"] = _ar_detail(["q", "clinicnum", "patnum"], "ar_paid_clinic")

# --- production -------------------------------------------------------------------------

RELATIONS["prod_detail"] = """
SELECT q, patnum, RawProduction, TotWo, PosAdj, NegAdj,
       RawProduction + TotWo + PosAdj + NegAdj AS NetProduction, TotInsPaymt, PatPaymts,
       TotInsPaymt + PatPaymts AS NetCollections, TotBalance, InsAR,
       CASE WHEN acc > 0 THEN acc ELSE 0 END AS PatAR,
       CASE WHEN acc < 0 THEN acc ELSE 0 END AS PatAP, PPOwed
FROM (
  SELECT q, patnum,
         ROUND(SUM(CASE WHEN tag IN ('Proc', 'PPOffset') THEN amt ELSE 0 END), 2) AS RawProduction,
         ROUND(SUM(wo), 2) AS TotWo,
         ROUND(SUM(CASE WHEN tag = 'Adj' THEN GREATEST(amt, 0) ELSE 0 END), 2) AS PosAdj,
         ROUND(SUM(CASE WHEN tag = 'Adj' THEN LEAST(amt, 0) ELSE 0 END), 2) AS NegAdj,
         ROUND(SUM(CASE tag WHEN 'Claimproc' THEN amt ELSE 0 END), 2) AS TotInsPaymt,
         ROUND(SUM(CASE tag WHEN 'PatPay' THEN amt ELSE 0 END), 2) AS PatPaymts,
         ROUND(SUM(amt + wo), 2) AS TotBalance, ROUND(SUM(instot), 2) AS InsAR,
         ROUND(SUM(amt + wo - instot), 2) AS acc, ROUND(SUM(planamt), 2) AS PPOwed
  FROM led_prod GROUP BY q, patnum)
"""

RELATIONS["prod_month"] = """
SELECT strftime(d, '%Y-%m') AS TranMonth, clinicnum, patnum,
       ROUND(SUM(CASE WHEN tag IN ('Proc', 'PPOffset') THEN amt ELSE 0 END), 2) AS RawProduction,
       ROUND(SUM(wo), 2) AS TotWo,
       ROUND(SUM(CASE WHEN tag = 'Adj' THEN GREATEST(amt, 0) ELSE 0 END), 2) AS PosAdj,
       ROUND(SUM(CASE WHEN tag = 'Adj' THEN LEAST(amt, 0) ELSE 0 END), 2) AS NegAdj,
       ROUND(SUM(wo + CASE WHEN tag IN ('Proc', 'PPOffset', 'Adj') THEN amt ELSE 0 END), 2) AS NetProduction,
       ROUND(SUM(CASE tag WHEN 'Claimproc' THEN amt ELSE 0 END), 2) AS TotInsPaymt,
       ROUND(SUM(CASE tag WHEN 'PatPay' THEN amt ELSE 0 END), 2) AS PatPaymts,
       ROUND(SUM(CASE WHEN tag IN ('Claimproc', 'PatPay') THEN amt ELSE 0 END), 2) AS NetCollections,
       ROUND(SUM(amt + wo), 2) AS TotBalance, ROUND(SUM(planamt), 2) AS PPOwed
FROM led_month GROUP BY ALL
"""

# --- the two agings ---------------------------------------------------------------------

RELATIONS["day_group"] = """
SELECT tag2 AS tag, patnum, amt, planamt, woest, insest,
       CASE WHEN agedproc <> 0 AND amt < 0 THEN ageddate ELSE d END AS d
FROM (
  SELECT patnum, agedproc, d, tag2, side, SUM(amt) AS amt, SUM(planamt) AS planamt,
         SUM(woest) AS woest, SUM(insest) AS insest, MIN(ageddate) AS ageddate
  FROM (SELECT *, CASE agedproc WHEN 0 THEN tag ELSE 'SumByProcAndDate' END AS tag2,
               CASE WHEN agedproc IS DISTINCT FROM 0 THEN 0 WHEN amt >= 0 THEN 1 ELSE -1 END AS side
        FROM led_aging)
  GROUP BY patnum, agedproc, d, tag2, side)
"""

RELATIONS["charge_sum"] = """
SELECT patnum,
       COALESCE(SUM(amt) FILTER (charge AND old > 90), 0) AS ChargesOver90,
       COALESCE(SUM(amt) FILTER (charge AND old BETWEEN 61 AND 90), 0) AS Charges_61_90,
       COALESCE(SUM(amt) FILTER (charge AND old BETWEEN 31 AND 60), 0) AS Charges_31_60,
       COALESCE(SUM(amt) FILTER (charge AND old BETWEEN 0 AND 30), 0) AS Charges_0_30,
       COALESCE(-SUM(amt) FILTER (amt < 0 AND NOT special AND old >= 0), 0) AS TotalCredits,
       COALESCE(SUM(amt) FILTER (old >= 0), 0) AS BalTotal,
       SUM(woest) AS InsWoEst, SUM(insest) AS InsPayEst, SUM(planamt) AS PayPlanDue
FROM (SELECT *, tag IN ('WriteoffOrig', 'SumByProcAndDate') AS special, special OR amt > 0 AS charge,
             q - d AS old FROM day_group, report_day)
GROUP BY patnum
"""

RELATIONS["clamped_sum"] = """
SELECT patnum, GREATEST(ChargesOver90, 0) AS ChargesOver90, GREATEST(Charges_61_90, 0) AS Charges_61_90,
       GREATEST(Charges_31_60, 0) AS Charges_31_60, GREATEST(Charges_0_30, 0) AS Charges_0_30,
       TotalCredits + GREATEST(-ChargesOver90, 0) + GREATEST(-Charges_61_90, 0)
         + GREATEST(-Charges_31_60, 0) + GREATEST(-Charges_0_30, 0) AS TotalCredits,
       BalTotal, InsWoEst, InsPayEst, PayPlanDue
FROM charge_sum
"""

_CHARGES = ["ChargesOver90", "Charges_61_90", "Charges_31_60", "Charges_0_30"]
RELATIONS["aged_paid"] = _waterfall("clamped_sum", _CHARGES, 2, "TotalCredits", 3)

RELATIONS["aged"] = """
SELECT r.patnum AS patnum, w[1] AS BalOver90, w[2] AS Bal_61_90, w[3] AS Bal_31_60,
       w[4] AS Bal_0_30, ROUND(r.BalTotal, 3) AS BalTotal, ROUND(r.InsWoEst, 3) AS InsWoEst,
       ROUND(r.InsPayEst, 3) AS InsPayEst, ROUND(r.PayPlanDue, 3) AS PayPlanDue
FROM aged_paid
"""

RELATIONS["custom_sum"] = """
SELECT patnum,
       COALESCE(SUM(amt) FILTER (amt > 0 AND old <= 30), 0) AS Charges_0_30,
       COALESCE(SUM(amt) FILTER (amt > 0 AND old BETWEEN 31 AND 60), 0) AS Charges_31_60,
       COALESCE(SUM(amt) FILTER (amt > 0 AND old BETWEEN 61 AND 90), 0) AS Charges_61_90,
       COALESCE(SUM(amt) FILTER (amt > 0 AND old > 90), 0) AS ChargesOver90,
       COALESCE(SUM(amt) FILTER (amt > 0), 0) AS TotalCharges,
       COALESCE(-SUM(amt) FILTER (amt < 0 AND old <= 30), 0) AS Credits_0_30,
       COALESCE(-SUM(amt) FILTER (amt < 0 AND old BETWEEN 31 AND 60), 0) AS Credits_31_60,
       COALESCE(-SUM(amt) FILTER (amt < 0 AND old BETWEEN 61 AND 90), 0) AS Credits_61_90,
       COALESCE(-SUM(amt) FILTER (amt < 0 AND old > 90), 0) AS CreditsOver90,
       COALESCE(-SUM(amt) FILTER (amt < 0), 0) AS TotalCredits, SUM(amt) AS BalTotal
FROM (SELECT led_custom.*, q - d AS old FROM led_custom JOIN patient USING (patnum), report_day)
GROUP BY patnum
"""

RELATIONS["custom_paid"] = _waterfall("custom_sum", _CHARGES, 2, "TotalCredits", 3)

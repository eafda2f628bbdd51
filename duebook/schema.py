"""Column contracts: the eleven input tables, the ledger, and the fixed codes."""

from __future__ import annotations

MONEY = "decimal(14,4)"

# Input tables. The first column is the table's unique key.
TABLES: dict[str, dict[str, str]] = {
    "procedurelog": {
        "procnum": "bigint", "patnum": "bigint", "provnum": "bigint", "clinicnum": "bigint",
        "procdate": "date", "procfee": MONEY, "unitqty": "int", "baseunits": "int",
        "procstatus": "int", "discount": MONEY, "discountplanamt": MONEY,
    },
    "claimproc": {
        "claimprocnum": "bigint", "procnum": "bigint", "patnum": "bigint", "clinicnum": "bigint",
        "procdate": "date", "datecp": "date", "status": "int", "inspayamt": MONEY,
        "inspayest": MONEY, "writeoff": MONEY, "payplannum": "bigint",
        "insesttotaloverride": MONEY, "writeoffest": MONEY, "writeoffestoverride": MONEY,
    },
    "claimsnapshot": {"claimprocnum": "bigint", "writeoff": MONEY},
    "adjustment": {
        "adjnum": "bigint", "procnum": "bigint", "patnum": "bigint", "provnum": "bigint",
        "clinicnum": "bigint", "adjdate": "date", "procdate": "date", "adjamt": MONEY,
    },
    "payplan": {
        "payplannum": "bigint", "patnum": "bigint", "plannum": "bigint", "payplandate": "date",
        "completedamt": MONEY, "isclosed": "int", "isdynamic": "int",
        "dynamicpayplantpoption": "int",
    },
    "payplancharge": {
        "payplanchargenum": "bigint", "payplannum": "bigint", "patnum": "bigint",
        "guarantor": "bigint", "chargedate": "date", "chargetype": "int", "principal": MONEY,
        "interest": MONEY,
    },
    "payplanlink": {
        "payplanlinknum": "bigint", "payplannum": "bigint", "linktype": "int", "fkey": "bigint",
        "amountoverride": MONEY, "secdatetentry": "timestamp_ntz",
    },
    "paysplit": {
        "splitnum": "bigint", "paynum": "bigint", "patnum": "bigint", "procnum": "bigint",
        "adjnum": "bigint", "clinicnum": "bigint", "payplannum": "bigint", "datepay": "date",
        "procdate": "date", "splitamt": MONEY, "unearnedtype": "int",
    },
    "payment": {"paynum": "bigint", "dateentry": "date"},
    "patient": {
        "patnum": "bigint", "fname": "string", "lname": "string", "middlei": "string",
        "clinicnum": "bigint",
    },
    "clinic": {"clinicnum": "bigint", "description": "string"},
}

# The date each table is cut on.
DATES = {
    "procedurelog": "procdate", "claimproc": "datecp", "adjustment": "procdate",
    "payplan": "payplandate", "payplancharge": "chargedate", "paysplit": "datepay",
    "payment": "dateentry",
}

# One row per transaction. Positive amounts are owed to the practice, negative ones
# are paid or credited. Money is whole units (see functions/money.py). `prikey` is
# the key of the row's own source table; `procnum` is what the row is grouped under
# (the procedure where there is one, else the row's own key).
LEDGER: dict[str, str] = {
    "trantype": "string", "prikey": "bigint", "procnum": "bigint", "patnum": "bigint",
    "clinicnum": "bigint", "trandate": "date", "procdate": "date", "tranamount": "bigint",
    "woamount": "bigint", "payplanamount": "bigint", "instotest": "bigint",
    "inspayest": "bigint", "inswoest": "bigint", "agedprocnum": "bigint", "agedprocdate": "date",
}
LEDGER_MONEY = ("tranamount", "woamount", "payplanamount", "instotest", "inspayest", "inswoest")

# Transaction tags.
PROC = "Proc"
CLAIM = "Claimproc"
ADJ = "Adj"
PLAN_OFFSET = "PPOffset"
PLAN_TOTAL = "PPTotal"
PLAN_COMPLETE = "PPComplete"
PLAN_CHARGE = "PPCharge"
PLAN_LINK = "PayPlanLink"
PAT_PAY = "PatPay"
INS_PAY = "InsPay"
INS_EST = "InsEst"
WRITEOFF = "Writeoff"
WRITEOFF_EST = "WriteoffEst"
WRITEOFF_ORIG = "WriteoffOrig"
PROC_SUM = "ProcSum"
PROC_AND_DATE = "SumByProcAndDate"

# Procedure status.
PLANNED, COMPLETE = 1, 2
# Claim line status.
NOT_RECEIVED, RECEIVED, PREAUTH, SUPPLEMENTAL, CAP_CLAIM, CAP_COMPLETE = 0, 1, 2, 4, 5, 7
CLAIM_STATUSES = (NOT_RECEIVED, RECEIVED, SUPPLEMENTAL, CAP_CLAIM, CAP_COMPLETE)
PAID_STATUSES = (RECEIVED, SUPPLEMENTAL, CAP_CLAIM, CAP_COMPLETE)
# What a payment-plan link points at.
LINK_ADJUSTMENT, LINK_PROCEDURE = 1, 2
# Payment-plan charge kinds.
DEBIT, CREDIT = 0, 1
# Money that was never filled in, and the date that means "none".
UNSET = -1
NO_DATE = "0001-01-01"
# Unearned-income types left out of the custom aging; a site's own ids.
UNEARNED_TYPES = (301, 325)
# Upper age in days of each aging bucket; older rows fall in the last one.
AR_EDGES = (30, 60, 90, 120)
AGING_EDGES = (30, 60, 90)

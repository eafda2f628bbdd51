"""Hand-written and random ledger tables as DataFrames and as DuckDB tables."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from duebook import StoredTables
from duebook.schema import TABLES

Q = dt.date(2001, 6, 30)

_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "date": pa.date32(), "string": pa.string(),
    "decimal(14,4)": pa.decimal128(14, 4), "timestamp_ntz": pa.timestamp("us"),
}
_BLANK = {
    "bigint": 0, "int": 0, "date": Q, "string": "x", "decimal(14,4)": Decimal("0.00"),
    "timestamp_ntz": dt.datetime(2001, 6, 30),
}
# What an untouched column holds where the type's blank would hide the row.
_USUAL = {
    ("procedurelog", "procstatus"): 2, ("procedurelog", "unitqty"): 1,
    ("procedurelog", "procfee"): Decimal("100.00"),
    ("claimproc", "status"): 1, ("claimproc", "insesttotaloverride"): Decimal("-1.00"),
    ("claimproc", "writeoffest"): Decimal("-1.00"),
    ("claimproc", "writeoffestoverride"): Decimal("-1.00"),
    ("patient", "middlei"): "M", ("payplanlink", "linktype"): 2,
}


def arrow_tables(**given) -> dict[str, pa.Table]:
    """Rows given per table as dicts; columns left out take their usual value."""
    tables = {}
    for name, types in TABLES.items():
        key = next(iter(types))
        rows = [{key: i, **row} for i, row in enumerate(given.get(name, []), start=1)]
        columns = {
            c: [_value(row.get(c, _USUAL.get((name, c), _BLANK[t])), t) for row in rows]
            for c, t in types.items()
        }
        schema = pa.schema([(c, _ARROW[t]) for c, t in types.items()])
        tables[name] = pa.table(columns, schema=schema)
    return tables


def _value(value, kind: str):
    if kind.startswith("decimal") and value is not None:
        return Decimal(str(value)).quantize(Decimal("0.0001"))
    return value


def stored(spark, tables: dict[str, pa.Table], folder) -> StoredTables:
    for name, table in tables.items():
        (folder / name).mkdir()
        pq.write_table(table, folder / name / "rows.parquet")
    return StoredTables(spark, str(folder))


def database(tables: dict[str, pa.Table]) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(f"{name}_rows", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_rows")
    return con


# Columns that a ledger may leave empty: references, places and days.
_GAPS = {
    "procedurelog": ("provnum", "clinicnum", "procdate"),
    "claimproc": ("procnum", "clinicnum", "payplannum", "procdate", "datecp"),
    "adjustment": ("procnum", "provnum", "clinicnum", "adjdate", "procdate"),
    "payplan": ("plannum", "payplandate"),
    "payplancharge": ("payplannum", "chargedate"),
    "payplanlink": ("payplannum", "fkey", "secdatetentry"),
    "paysplit": ("paynum", "procnum", "adjnum", "clinicnum", "payplannum", "datepay", "procdate", "unearnedtype"),
    "payment": ("dateentry",),
    "patient": ("clinicnum",),
}


def random_tables(seed: int, size: int = 300, gaps: float = 0.0, fine: float = 0.0) -> dict[str, pa.Table]:
    """Ledgers with every code, dates on and around each cut-off, sentinel and dangling
    references, negative amounts, and a third of the rows on one patient, one clinic, one
    procedure, one plan or on the 0 reference. ``gaps`` is the share of NULLs in the columns
    that may be empty, ``fine`` that of amounts with parts of a cent."""
    r = random.Random(seed)
    people, works, plans = range(1, 13), range(1, size + 1), range(1, 31)

    def hot(values, usual=None):
        return (usual if usual is not None else values[0]) if r.random() < 1 / 3 else r.choice(values)

    def day():
        near = r.choice([0, 30, 31, 60, 61, 90, 91, 120, 121, -1, 1, 29, -10, -11])
        return Q - dt.timedelta(days=near if r.random() < 0.5 else r.randint(-40, 200))

    def money(low=0):
        if r.random() < fine:
            return r.choice([0.004, 0.0045, 0.0005, r.randint(low * 10000, 3000000) / 10000])
        return 0 if r.random() < 0.1 else r.choice([r.randint(low, 30) * 10, r.randint(low * 100, 30000) / 100])

    def ref(values):
        return 0 if r.random() < 1 / 3 else hot(values)

    def unset(amount):
        return -1 if r.random() < 0.5 else amount

    procedures = [
        dict(patnum=hot(people), provnum=r.randint(1, 3), clinicnum=hot(range(1, 5)), procdate=day(),
             procfee=money(), unitqty=r.randint(1, 3), baseunits=r.choice([0, 0, 1]),
             procstatus=r.choice([1, 2, 2, 2]), discount=money(), discountplanamt=money())
        for _ in works
    ]

    def on_procedure(number):
        found = procedures[number - 1] if number else None
        if found and r.random() < 0.7:
            return {k: found[k] for k in ("patnum", "provnum", "clinicnum")}
        return dict(patnum=hot(people), provnum=r.randint(1, 3), clinicnum=hot(range(1, 5)))

    adjustments = []
    for _ in works:
        number = ref(works)
        adjustments.append(dict(procnum=number, adjdate=day(), procdate=day(), adjamt=money(-20),
                                **on_procedure(number)))
    tables = dict(
        procedurelog=procedures,
        claimproc=[
            dict(procnum=ref(range(1, size + 20)), patnum=hot(people), clinicnum=hot(range(1, 5)),
                 procdate=day(), datecp=day(), status=r.choice([0, 0, 1, 1, 1, 2, 4, 5, 7]),
                 inspayamt=money(-5), inspayest=money(), writeoff=money(),
                 payplannum=r.choice([0, 0, 0, r.choice(plans)]), insesttotaloverride=unset(money()),
                 writeoffest=unset(money()), writeoffestoverride=unset(money()))
            for _ in works
        ],
        claimsnapshot=[dict(claimprocnum=i, writeoff=unset(money())) for i in works if i % 3],
        adjustment=adjustments,
        payplan=[
            dict(patnum=hot(people), plannum=r.choice([0, 0, 1]), payplandate=day(),
                 completedamt=money(), isclosed=r.randint(0, 1), isdynamic=r.randint(0, 1),
                 dynamicpayplantpoption=r.randint(0, 2))
            for _ in plans
        ],
        payplancharge=[
            dict(payplannum=hot(range(1, 34)), patnum=hot(people), guarantor=hot(people, 3),
                 chargedate=day(), chargetype=r.choice([0, 0, 1, 2]), principal=money(),
                 interest=money())
            for _ in works
        ],
        payplanlink=[
            dict(payplannum=r.choice(plans), linktype=r.choice([1, 2, 2]), fkey=hot(works),
                 amountoverride=money() if r.random() < 0.4 else 0,
                 secdatetentry=dt.datetime.combine(day(), dt.time(r.randint(0, 23), 30)))
            for _ in works
        ],
        paysplit=[
            dict(paynum=hot(range(1, size)), patnum=hot(people), procnum=ref(works),
                 adjnum=ref(works), clinicnum=hot(range(1, 5)), payplannum=ref(range(1, 33)),
                 datepay=day(), procdate=day(), splitamt=money(-5),
                 unearnedtype=r.choice([0, 0, 301, 325, 7]))
            for _ in works
        ],
        payment=[dict(paynum=i, dateentry=day()) for i in range(1, size) if i % 9],
        patient=[
            dict(patnum=i, fname=r.choice(["Ann", "bob"]), lname=r.choice(["Lee", "lee", "Ray"]),
                 middlei=r.choice([None, "M"]), clinicnum=r.randint(1, 4))
            for i in people if i != 5
        ],
        clinic=[dict(clinicnum=i, description=f"clinic {i}") for i in (1, 2, 3)],
    )
    for name, columns in _GAPS.items():
        for row in tables[name]:
            row.update({c: None for c in columns if r.random() < gaps})
    return arrow_tables(**tables)

"""Every transaction up to a date, with the patient's name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duebook.functions.money import dollars
from duebook.operators import ledgers
from duebook.operators.rows import union_all
from duebook.params import AsOf
from duebook.sources.base import Tables


def transactions(tables: Tables, as_of: AsOf, clinic: int | None = None) -> DataFrame:
    """Transactions of all clinics or of one. The names are joined to each source by itself, where
    tables laid out by patient (``BucketedTables``) lie beside them and nothing is moved. Elsewhere
    rows meet the names by a shuffle; a patient with a large share of the rows makes one large
    join partition, which AQE splits on the transaction side."""
    sources = ledgers.listing(tables, as_of)
    if clinic is not None:
        sources = [rows.filter(f"clinicnum = {int(clinic)}") for rows in sources]
    people = tables.read("patient", "patnum", "fname", "lname", "clinicnum", by="patnum").selectExpr(
        "patnum", "concat(fname, ' ', lname) AS pat_name", "clinicnum AS pat_clinic"
    )
    return union_all([rows.join(people, "patnum", "left") for rows in sources]).selectExpr(
        *as_of.keys, "pat_name", "pat_clinic", "trantype AS TranType", "prikey AS PriKey",
        "patnum", "clinicnum", "trandate AS TranDate", f"{dollars('tranamount')} AS TranAmount",
        f"{dollars('woamount')} AS WoAmount",
    )

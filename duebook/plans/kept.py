"""Day groups kept between reports: a report reads them instead of the ledger."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.operators import ledgers
from duebook.operators.balances import day_groups
from duebook.params import AsOf
from duebook.plans import aging
from duebook.sources.base import Tables
from duebook.sources.manifest import add_entry, entries

#: Day groups as they count on any day: their rows say from when and until when they do.
_ANY_DAY = AsOf.series(["9999-12-31"]).moving()
_ALL, _SOME = "all", "some"


class KeptDayGroups:
    """The day groups of the A/R aging below ``path``, in parts. The first holds all patients; each later
    one those whose ledger rows have changed since, and takes the place of their groups in all parts
    before. The groups don't depend on a report day. A part counts from the moment its entry is in the
    manifest, and a reader takes the parts that are there then."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, tables: Tables) -> None:
        """All patients' groups, in place of whatever was kept."""
        self._add(_ALL, day_groups(ledgers.aging(tables, _ANY_DAY), _ANY_DAY.keys), None)

    def merge(self, tables: Tables, patients: DataFrame) -> None:
        """New groups for ``patients`` (column patnum). ``tables`` hold all their rows, and what those
        refer to; rows of others are left out, and needn't be there. A plan charge is a row of its
        guarantor. A patient without rows keeps none."""
        patients = patients.select("patnum").distinct()
        ledger = ledgers.aging(tables, _ANY_DAY)
        changed = patients.withColumnRenamed("patnum", "_changed")
        rows = ledger.join(changed, ledger.patnum.eqNullSafe(F.col("_changed")), "left_semi")
        self._add(_SOME, day_groups(rows, _ANY_DAY.keys), patients)

    def _add(self, kind: str, groups: DataFrame, patients: DataFrame | None) -> None:
        folder = f"{kind}-{uuid.uuid4().hex}"
        groups.drop("prikey").write.option("compression", "zstd").parquet(f"{self.path}/{folder}/groups")
        if patients is not None:
            patients.write.parquet(f"{self.path}/{folder}/patients")
        add_entry(self.spark, self.path, folder)

    def groups(self) -> DataFrame:
        """The groups in force."""
        folders = entries(self.spark, self.path)
        whole = [i for i, folder in enumerate(folders) if folder.startswith(_ALL)]
        if not whole:
            raise ValueError(f"no day groups are kept below {self.path}")
        parts = folders[whole[-1]:]

        def read(i: int, name: str) -> DataFrame:
            return self.spark.read.parquet(f"{self.path}/{parts[i]}/{name}").withColumn("_part", F.lit(i))

        groups = reduce(DataFrame.unionAll, [read(i, "groups") for i in range(len(parts))])
        if len(parts) > 1:
            changed = reduce(DataFrame.unionAll, [read(i, "patients") for i in range(1, len(parts))])
            last = changed.groupBy(F.col("patnum").alias("_changed")).agg(F.max("_part").alias("_last"))
            groups = groups.join(last, groups.patnum.eqNullSafe(F.col("_changed")), "left").where(
                "_last IS NULL OR _part >= _last").drop("_changed", "_last")
        return groups.drop("_part")

    def aging_balances(self, as_of: AsOf) -> DataFrame:
        return aging.balances_of(self.groups(), as_of)

    def aging_of_receivables(self, tables: Tables, as_of: AsOf) -> DataFrame:
        """The report, for any day or series, from the kept groups and the patients' names."""
        return aging.receivables_of(self.groups(), tables, as_of)

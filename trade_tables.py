"""The ledger tables derived from the order-and-lineitem test tables (FIXTURES.md §2).

Every lookup is a left join on a unique key, so leaving one out when none of its columns
is asked for gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.schema import UNSET
from duebook.params import AsOf, Period
from duebook.sources.base import ON_COMPLETE_WORK, Reference, Tables

# The test tables hold whole cents (FIXTURES.md §2).
CENTS = "decimal(12,2)"


def _share(amount: str, fraction: str) -> str:
    return f"CAST({amount} * {fraction} AS {CENTS})"


def _later(day: str, days: str) -> str:
    return f"date_add({day}, CAST({days} AS INT))"


class TradeTables(Tables):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files: dict[str, DataFrame] = {}

    def frame(self, name: str, columns: Sequence[str]) -> DataFrame:
        return getattr(self, f"_{name}")(set(columns))

    def _file(self, name: str) -> DataFrame:
        if name not in self._files:  # reading the schema touches the file: once will do
            self._files[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._files[name]

    # --- helpers over the source rows ---------------------------------------------

    def _orders(self, with_clinic: bool = False) -> DataFrame:
        orders = self._file("orders").selectExpr(
            "o_orderkey AS k", "o_custkey AS cust", "o_custkey + 1 AS patnum",
            "CAST(o_orderdate AS DATE) AS od", f"CAST(o_totalprice AS {CENTS}) AS tp",
            "o_orderstatus AS st",
        )
        if with_clinic:
            homes = self._file("customer").selectExpr(
                "c_custkey AS cust", "CAST(c_nationkey + 1 AS BIGINT) AS clinicnum"
            )
            orders = orders.join(homes, "cust", "left")
        return orders

    def _lines(self, at: str) -> DataFrame:
        """One row per (order, line); the source repeats that pair. They lie by ``at``, the column they are
        joined on next, so that they are shuffled once: by order (k), or by procedure (procnum), without
        the rows that name none."""
        rows = self._file("lineitem").selectExpr(
            "l_orderkey AS k", "l_linenumber AS line", "l_orderkey * 10 + l_linenumber AS procnum",
            "l_extendedprice", "l_discount", "l_suppkey", "l_returnflag", "l_shipdate",
        )
        if at == "k":
            return self._once(rows.repartition("k"), "k", "line")
        # A number below ten tells the pair from its procedure, which is then all that is grouped by;
        # files without other numbers are left unread by the second part.
        plain = self._once(rows.filter("k IS NOT NULL AND line >= 0 AND line <= 9"), "procnum").selectExpr(
            "(procnum - pmod(procnum, 10)) div 10 AS k", "CAST(pmod(procnum, 10) AS INT) AS line", "*")
        others = self._once(rows.filter("line < 0 OR line > 9").repartition("procnum"), "procnum", "k", "line")
        return plain.unionByName(others)

    @staticmethod
    def _once(rows: DataFrame, *pair: str) -> DataFrame:
        return rows.groupBy(*pair).agg(
            F.expr(f"CAST(max(l_extendedprice) AS {CENTS}) AS price"),
            F.expr(f"CAST(max(l_discount) AS {CENTS}) AS disc"),
            F.expr("max(l_suppkey) AS suppkey"),
            # The lowest flag is 'R': as numbers, since strings would make it a sort
            # aggregation.
            F.expr("min(if(l_returnflag < 'R', 0, if(l_returnflag = 'R', 1, 2))) = 1 "
                   "AS returned"),
            F.expr("CAST(min(l_shipdate) AS DATE) AS sd"),
        )

    def _first_lines(self, orders: str) -> DataFrame:
        """Lowest line of each order that meets ``orders``, in a single aggregation: the
        sort key puts the line number before the tie-break among repeated lines."""
        lines = self._file("lineitem").selectExpr(
            "l_orderkey AS k", "CAST(l_linenumber AS BIGINT) AS line",
            "CAST(l_shipdate AS DATE) AS sd", "l_suppkey AS supp",
        )
        return lines.filter(orders).groupBy("k").agg(
            F.expr("min(k * 10 + line) AS f_procnum"),
            F.expr("min_by(sd, line * 1000000L + unix_date(sd)) AS f_procdate"),
            F.expr("min_by(supp, line * 1000000000000L - supp) + 1 AS f_provnum"),
        )

    # --- the eleven tables ---------------------------------------------------------

    def read(
        self, name: str, *columns: str, by: str | None = None, scope: AsOf | Period | None = None
    ) -> DataFrame:
        if by != "procnum" or name not in ("procedurelog", "claimproc"):
            return super().read(name, *columns, by=by, scope=scope)
        return self._typed(name, self._by_procedure(name)(set(columns), "procnum"), columns)

    def among(self, name: str, key: str, wanted: DataFrame, *columns: str) -> DataFrame:
        if key != "procnum" or name not in ("procedurelog", "claimproc"):
            return super().among(name, key, wanted, *columns)
        return self._typed(name, self._by_procedure(name)(set(columns), key, wanted), columns)

    def _by_procedure(self, name: str) -> Callable[..., DataFrame]:
        # Claims paid by total name no procedure.
        return self._procedurelog if name == "procedurelog" else self._claim_lines

    def _procedurelog(
        self, need: set[str], at: str = "k", wanted: DataFrame | None = None
    ) -> DataFrame:
        """Lines with their owners; the ``wanted`` procedures are chosen before those are joined."""
        lines = self._lines(at)
        if wanted is not None:
            lines = lines.join(wanted, "procnum", "left_semi")
        number = "k * 10 + line" if at == "k" else at
        owner = [c for c in ("patnum", "clinicnum") if c in need]
        if owner:
            orders = self._orders("clinicnum" in need).select("k", *owner)
            lines = lines.join(orders, "k", "left")
        return lines.selectExpr(
            f"{number} AS procnum", *owner, "suppkey + 1 AS provnum", "sd AS procdate",
            f"if(({number}) % 97 = 0, CAST(0 AS {CENTS}), price) AS procfee",
            "if(line % 4 = 0, 2, 1) AS unitqty", "if(line = 7, 1, 0) AS baseunits",
            "if(returned, 1, 2) AS procstatus",
            f"if(line % 3 = 0, CAST(price * disc AS {CENTS}), 0) AS discount",
            "if(line = 5, 25, 0) AS discountplanamt",
        )

    def split(
        self, name: str, key: str, *columns: str, scope: AsOf | Period | None = None
    ) -> tuple[DataFrame, DataFrame]:
        if (name, key) != ("claimproc", "procnum"):
            return super().split(name, key, *columns, scope=scope)
        need = set(columns)  # the two parts come from sources of their own
        return (self._typed(name, self._claim_totals(need), columns),
                self._typed(name, self._claim_lines(need), columns))

    def referring(
        self, reference: Reference, *columns: str, where: str = "true", scope: AsOf | Period | None = None
    ) -> DataFrame:
        if reference != ON_COMPLETE_WORK:
            return super().referring(reference, *columns, where=where, scope=scope)
        free, _ = self.split(reference.name, reference.key, *columns, scope=scope)
        held = reference.held(self).select(reference.key)
        bound = self.among(reference.name, reference.key, held, *columns)
        return free.filter(where).unionByName(bound.filter(where))

    def _claimproc(self, need: set[str]) -> DataFrame:
        totals = self._claim_totals(need)
        wanted = [c for c in totals.columns if c in need]
        return self._claim_lines(need).select(*wanted).unionByName(totals.select(*wanted))

    def _claim_totals(self, need: set[str]) -> DataFrame:
        place = ["clinicnum"] if "clinicnum" in need else []
        return self._orders(bool(place)).filter("k % 11 = 0").selectExpr(
            "k * 10 + 9 AS claimprocnum", "0L AS procnum", "patnum", *place, "od AS procdate",
            "date_add(od, 20) AS datecp", "4 AS status", f"{_share('tp', '0.02')} AS inspayamt",
            f"CAST(0 AS {CENTS}) AS inspayest", f"CAST(0 AS {CENTS}) AS writeoff",
            "0L AS payplannum", f"CAST({UNSET} AS {CENTS}) AS insesttotaloverride",
            f"CAST({UNSET} AS {CENTS}) AS writeoffest",
            f"CAST({UNSET} AS {CENTS}) AS writeoffestoverride",
        )

    def _claim_lines(
        self, need: set[str], at: str = "k", wanted: DataFrame | None = None
    ) -> DataFrame:
        owner = [c for c in ("patnum", "clinicnum") if c in need]
        lines = self._procedurelog({*owner, "procnum"}, at, wanted).filter("procnum % 3 != 0")

        def unless_unset(test: str, amount: str) -> str:
            return f"if({test}, {amount}, CAST({UNSET} AS {CENTS}))"

        return lines.selectExpr(
            "procnum AS claimprocnum", "procnum", *owner, "procdate",
            f"{_later('procdate', 'procnum % 90')} AS datecp",
            "element_at(array(0, 0, 1, 1, 1, 4, 5, 7, 2, 1, 1), CAST(procnum % 11 AS INT) + 1) "
            "AS status",
            f"{_share('procfee', '0.50')} AS inspayamt",
            f"{_share('procfee', '0.55')} AS inspayest",
            f"{_share('procfee', '0.10')} AS writeoff",
            "if(procnum % 50 = 1, procnum, 0L) AS payplannum",
            f"{unless_unset('procnum % 10 = 3', _share('procfee', '0.45'))} AS insesttotaloverride",
            f"{unless_unset('procnum % 10 != 4', _share('procfee', '0.08'))} AS writeoffest",
            f"{unless_unset('procnum % 10 = 6', _share('procfee', '0.07'))} AS writeoffestoverride",
        )

    def _claimsnapshot(self, need: set[str]) -> DataFrame:
        waiting = self._claim_lines(set(), "procnum").filter("status = 0 AND claimprocnum % 5 != 0")
        return waiting.selectExpr(
            "claimprocnum",
            f"if(claimprocnum % 4 = 0, CAST({UNSET} AS {CENTS}), {_share('inspayest', '0.15')}) "
            "AS writeoff",
        )

    def _adjustment(self, need: set[str]) -> DataFrame:
        place = ["clinicnum"] if "clinicnum" in need else []
        rows = self._orders(bool(place)).filter("k % 2 = 0")
        attached = []
        if need & {"procnum", "procdate", "provnum"}:
            rows = rows.join(self._first_lines("k % 4 = 0"), "k", "left")
            attached = [
                "coalesce(f_procnum, 0L) AS procnum", "coalesce(f_procdate, od) AS procdate",
                "coalesce(f_provnum, 0L) AS provnum",
            ]
        return rows.selectExpr(
            "k + 1 AS adjnum", "patnum", *place, *attached, "od AS adjdate",
            f"if(k % 6 = 0, {_share('tp', '0.01')}, {_share('tp', '-0.03')}) AS adjamt",
        )

    def _payplan(self, need: set[str]) -> DataFrame:
        return self._orders().filter("k % 25 = 0").selectExpr(
            "k", "k + 1 AS payplannum", "patnum", "if(k % 100 = 0, 1L, 0L) AS plannum",
            "od AS payplandate", f"{_share('tp', '0.20')} AS completedamt",
            "if(st = 'F', 1, 0) AS isclosed", "if(k % 75 = 0, 1, 0) AS isdynamic",
            "CASE k % 75 WHEN 0 THEN 2 WHEN 25 THEN 1 ELSE 0 END AS dynamicpayplantpoption",
        )

    def _payplancharge(self, need: set[str]) -> DataFrame:
        return self._payplan(set()).selectExpr("*", "explode(sequence(0, 5)) AS n").selectExpr(
            "payplannum * 10 + n AS payplanchargenum", "payplannum", "patnum",
            "if(payplannum % 7 = 0, 1L, patnum) AS guarantor",
            f"{_later('payplandate', '30 * n')} AS chargedate",
            "if(n = 5, 1, 0) AS chargetype", f"{_share('completedamt', '0.20')} AS principal",
            f"{_share('completedamt', '0.01')} AS interest",
        )

    def _payplanlink(self, need: set[str]) -> DataFrame:
        plans = self._payplan(set())
        entered = "CAST(payplandate AS TIMESTAMP_NTZ) AS secdatetentry"
        to_procedure = plans.join(self._first_lines("k % 25 = 0"), "k").selectExpr(
            "payplannum * 10 + 1 AS payplanlinknum", "payplannum", "2 AS linktype",
            "f_procnum AS fkey",
            f"if(payplannum % 4 = 0, {_share('completedamt', '0.50')}, 0) AS amountoverride",
            entered,
        )
        # Adjustments sit on the even orders and share the plan's number.
        to_adjustment = plans.filter("k % 2 = 0").selectExpr(
            "payplannum * 10 + 2 AS payplanlinknum", "payplannum", "1 AS linktype",
            "payplannum AS fkey", "0 AS amountoverride", entered,
        )
        return to_procedure.unionByName(to_adjustment)

    def _paysplit(self, need: set[str]) -> DataFrame:
        place = ["clinicnum"] if "clinicnum" in need else []
        rows = self._orders(bool(place))
        attached = []
        if "procnum" in need:
            rows = rows.join(self._first_lines("k % 3 = 0"), "k", "left")
            attached = ["coalesce(f_procnum, 0L) AS procnum"]
        return rows.selectExpr(
            "k + 1 AS splitnum", "k + 1 AS paynum", "patnum", *place, *attached,
            "if(k % 10 = 0, k + 1, 0L) AS adjnum", "if(k % 25 = 0, k + 1, 0L) AS payplannum",
            f"{_later('od', '30 + k % 45')} AS datepay", "od AS procdate",
            f"{_share('tp', '0.35')} AS splitamt",
            "CASE k % 20 WHEN 7 THEN 301 WHEN 9 THEN 325 ELSE 0 END AS unearnedtype",
        )

    def _payment(self, need: set[str]) -> DataFrame:
        return self._orders().filter("k % 13 != 0").selectExpr(
            "k + 1 AS paynum", f"{_later('od', '35 + k % 40')} AS dateentry"
        )

    def _patient(self, need: set[str]) -> DataFrame:
        return self._file("customer").filter("c_custkey % 200 != 199").selectExpr(
            "c_custkey + 1 AS patnum", "c_mktsegment AS fname", "c_name AS lname",
            "if(c_custkey % 5 = 0, NULL, 'M') AS middlei",
            "CAST(c_nationkey + 1 AS BIGINT) AS clinicnum",
        )

    def _clinic(self, need: set[str]) -> DataFrame:
        return self._file("nation").filter("n_nationkey != 24").selectExpr(
            "CAST(n_nationkey + 1 AS BIGINT) AS clinicnum", "n_name AS description"
        )

"""Raw-table stand-ins built from the driver's tables.

The reference reads five hospital tables that the driver does not have.
These functions only *shape* driver rows into the raw schemas the
cleaners expect (string codes, ``YYYYMMDD`` dates, ``HHMM``/``HHMMSS``
times, padded and mixed-case text); they do none of the cleaning, joining
or aggregation, which the library then runs on them. Roles:

* emergency notes  <- ``events``: arrival = ``ts``; note written
  ``floor(value*60)`` seconds later (so the wait proxy tracks ``value``);
  file number = ``user_id``; triage letter = first letter of ``event_type``.
* triage           <- ``events``: triage time = note time.
* appointments     <- ``orders``: attendance from ``o_orderstatus``
  (F attended, P no-show, O an out-of-domain code); area, appointment
  numbers from the order key; time of day from the key.
* encounters       <- ``lineitem``: one per line, same appointment key as
  its order; reservation and registration from ``l_shipdate``.
* patients         <- ``customer``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str, balance: bool = False) -> DataFrame:
    from careflow.sources.io import read_table
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", balance=balance)


def _s(c):
    return F.col(c).cast("string")


def note_time(ts: str = "ts", value: str = "value"):
    return F.timestamp_add("SECOND", F.floor(F.col(value) * 60).cast("long"), F.col(ts))


def raw_notes(events: DataFrame) -> DataFrame:
    nt = note_time()
    return events.select(
        F.concat(F.lit(" "), _s("user_id"), F.lit(" ")).alias("Expediente"),
        _s("event_id").alias("ClaveIngreso"),
        F.date_format("ts", "yyyyMMdd").alias("Llegada_Fecha"),
        F.date_format("ts", "HHmm").alias("Llegada_Hora"),
        F.date_format(nt, "yyyyMMdd").alias("Fecha"),
        F.date_format(nt, "HHmmss").alias("Hora"),
        F.lower("event_type").alias("Especialidad"),
        F.upper(F.substring("event_type", 1, 1)).alias("Triage"),
    )


def raw_triage(events: DataFrame) -> DataFrame:
    nt = note_time()
    return events.select(
        _s("user_id").alias("Expediente"),
        _s("event_id").alias("ClaveIngreso"),
        F.date_format(nt, "yyyyMMdd").alias("Fecha"),
        F.date_format(nt, "HHmmss").alias("Hora"),
        F.concat(F.lower(F.substring("event_type", 1, 1)), F.lit(" ")).alias("Triage"),
    )


def raw_appointments(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        (k % 10).cast("string").alias("area"),
        _s("o_orderkey").alias("cve_num"),
        (k % 7).cast("string").alias("cve_mbo"),
        _s("o_custkey").alias("med"),
        F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")).alias("esp"),
        F.when(k % 2 == 0, F.lit("p")).otherwise(F.lit("s")).alias("tpo_cita"),
        F.when(F.col("o_totalprice") > 400000, F.lit("C")).alias("conflicto"),
        F.when(k % 3 == 0, F.lit("A")).alias("agregada"),
        F.when(k % 11 == 0, F.lit("U")).alias("ultimahora"),
        (k % 4).cast("string").alias("buffer"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("a_fecha"),
        (F.lit(800) + (k % 10) * 100).cast("string").alias("hra_ini"),
        (F.lit(830) + (k % 10) * 100).cast("string").alias("hra_fin"),
        ((k % 7) * 15).cast("string").alias("dur"),
        F.when(F.col("o_orderstatus") == "F", F.lit("a"))
         .when(F.col("o_orderstatus") == "P", F.lit("I"))
         .otherwise(F.lit("o")).alias("asistencia"),
    )


def raw_encounters(lineitem: DataFrame) -> DataFrame:
    k = F.col("l_orderkey")
    return lineitem.select(
        (k % 10).cast("string").alias("p_area"),
        _s("l_orderkey").alias("p_res_cve_num"),
        (k % 7).cast("string").alias("p_res_cve_mbo"),
        _s("l_partkey").alias("p_num_exp"),
        F.lower("l_linestatus").alias("p_status"),
        F.when(F.col("l_returnflag") == "A", F.lit("f"))
         .when(F.col("l_returnflag") == "N", F.lit("m")).alias("p_sexo"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("p_res_fec"),
        F.lit("0800").alias("p_res_hra"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("p_fec_reg"),
        (F.col("l_linenumber") * 100).cast("string").alias("p_hra_reg"),
    )


def raw_patients(customer: DataFrame) -> DataFrame:
    ck = F.col("c_custkey")
    return customer.select(
        F.concat(_s("c_custkey"), F.lit(" ")).alias("m_num_exp"),
        F.when(F.col("c_acctbal") < 0, F.lit("b")).otherwise(F.lit("a")).alias("m_status"),
        F.when(ck % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("m_sexo"),
        F.when(ck % 5 == 0, F.concat((F.col("c_nationkey") * 5).cast("string"), F.lit("A")))
         .otherwise((F.col("c_nationkey") * 6).cast("string")).alias("m_edad"),
        F.date_format(F.date_add(F.lit("1940-01-01").cast("date"), ((ck * 37) % 25000).cast("int")),
                      "yyyyMMdd").alias("m_fec_nac"),
        F.lower("c_mktsegment").alias("m_ciu"),
        (ck % 50).cast("string").alias("m_col"),
        F.lpad((ck % 100).cast("string"), 3, "0").alias("m_cp"),
        _s("c_nationkey").alias("m_edo"),
        F.when(F.col("c_nationkey") == 0, F.lit("n/a")).otherwise(F.lit("MX")).alias("m_pai"),
    )


class Inputs:
    """Lazy access to the driver tables and the raw stand-ins."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str, balance: bool = False) -> DataFrame:
        return table(self.spark, self.sf_dir, name, balance)

    def notes(self):
        return raw_notes(self.t("events", balance=True))

    def triage(self):
        return raw_triage(self.t("events", balance=True))

    def appointments(self):
        return raw_appointments(self.t("orders", balance=True))

    def encounters(self):
        return raw_encounters(self.t("lineitem", balance=True))

    def patients(self):
        return raw_patients(self.t("customer"))

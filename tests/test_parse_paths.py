"""Plain and odd text take different paths through the cleaners; both must agree with Python."""

from datetime import datetime

from pyspark.sql import functions as F

from careflow.functions import parse as P
from careflow.functions import text as T

ODD = ["", " ", "a", " a", "a b", "\x00a\x7f", " é ", "ñ", "\t\n", "x\x1fy ", "~!", None]


def test_strip_of_plain_and_odd_text(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, s string")
    for r in df.select("s", T.strip_text("s").alias("p"), T.unicode_trim("s").alias("t")).collect():
        if r["s"] is None:
            assert r["p"] is None and r["t"] is None
        else:
            assert r["t"] == r["s"].strip()
            assert r["p"] == ("".join(c for c in r["s"] if c not in T.CONTROL_CHARS).strip() or None)


def test_times_from_digits(spark):
    rows = ["20240229235959", "20230229000000", "20240101240000", "20240101006000", "20240101000060", "00000101000000",
            "16770921001244", "16770921001243", "22620411234716", "22620411234717", "99991231235959", "2024", "20240101",
            "202401010000000", "2024-01-01T10:10:10", "2024010112000x", "20240101120000\n", "", None]
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["s"]: r["t"] for r in df.select("s", P._ts_from_digits(F.col("s")).cast("string").alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    ends = (datetime(1677, 9, 21, 0, 12, 44), datetime(2262, 4, 11, 23, 47, 16))
    for s in rows:
        try:
            t = datetime.strptime(s, "%Y%m%d%H%M%S") if s and len(s) == 14 and s.isdigit() else None
        except ValueError:
            t = None
        assert got[s] == (str(t) if t and ends[0] <= t <= ends[1] else None), s


def test_parsing_names_no_pattern(spark):
    """A pattern's formatter took a third of a cleaner's time."""
    plan = spark.sql("select '20240101' d, '0800' t").select(P.parse_datetime("d", "t"))
    assert "yyyyMMdd" not in plan._jdf.queryExecution().logical().toString()

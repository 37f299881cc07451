"""Data-quality and profiling reports.

Each report is computed for all requested columns together: one
aggregate row with a field per (column, measure), then unpivoted into one
report row per column. Group-wise parts (distinct values, examples) use
aggregations with map-side combine; percentages are left unrounded
(display rounding is presentation).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from careflow.functions.text import blank_to_null
from careflow.operators.ordering import attach_scalars
from careflow.operators.projection import with_accent_key
from careflow.operators.selection import select_quantiles


def _rows(one_row: DataFrame, names: Sequence[str], measures: Sequence[str], key: str = "column") -> DataFrame:
    """Turn fields ``{name}__{measure}`` of a one-row frame into one row per name."""
    structs = [F.struct(F.lit(n).alias(key), *[F.col(f"`{n}__{m}`").alias(m) for m in measures]) for n in names]
    return one_row.select(F.explode(F.array(*structs)).alias("__r")).select("__r.*")


def missing_summary(df: DataFrame, blanks_as_missing: bool = False) -> DataFrame:
    """Q1/Q2: per column missing count, % and type (blank text counts as
    missing with ``blanks_as_missing``), sorted by % descending."""
    cols = df.columns
    src = df
    if blanks_as_missing:
        src = df.select(*[blank_to_null(c).alias(c) if isinstance(df.schema[c].dataType, StringType)
                          else F.col(f"`{c}`") for c in cols])
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"{c}__missing_count") for c in cols]
    one = src.agg(*aggs)
    rep = _rows(one.select("*"), cols, ["missing_count"])
    n = one.select("__n")
    types = df.sparkSession.createDataFrame([(c, df.schema[c].dataType.simpleString()) for c in cols],
                                            "column string, dtype string")
    rep = attach_scalars(rep, n).join(F.broadcast(types), "column")
    rep = rep.withColumn("missing_pct", F.col("missing_count") * 100.0 / F.col("__n")).drop("__n")
    return rep.select("column", "missing_count", "missing_pct", "dtype").orderBy(F.desc("missing_pct"), "column")


def shape_and_duplicates(df: DataFrame, name: str = "table") -> DataFrame:
    """Q3: rows, columns and fully duplicated rows (rows - distinct rows)."""
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    distinct = df.distinct().agg(F.count(F.lit(1)).alias("distinct_rows"))
    out = attach_scalars(total, distinct)
    return out.select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"),
                      (F.col("rows") - F.col("distinct_rows")).alias("duplicated_rows"))


def key_duplicates(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """Q4: duplicated business keys (nulls form a key value) and % of rows
    inside them; ``missing columns`` status when a key column is absent."""
    label = " + ".join(keys)
    if any(k not in df.columns for k in keys):
        return df.sparkSession.createDataFrame(
            [(name, label, "missing columns", None, None)],
            "table string, key string, status string, duplicated_keys bigint, pct_rows_in_duplicated_keys double")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    rep = counts.agg(F.sum((F.col("__c") > 1).cast("long")).alias("duplicated_keys"),
                     F.sum(F.when(F.col("__c") > 1, F.col("__c")).otherwise(0)).alias("__dup_rows"),
                     F.sum("__c").alias("__rows"))
    return rep.select(F.lit(name).alias("table"), F.lit(label).alias("key"), F.lit("ok").alias("status"),
                      F.coalesce("duplicated_keys", F.lit(0)).cast("long").alias("duplicated_keys"),
                      (F.col("__dup_rows") * 100.0 / F.col("__rows")).alias("pct_rows_in_duplicated_keys"))


def grain_check(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """Q5: rows vs distinct keys; the grain holds when they are equal."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    keys_n = df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("distinct_keys"))
    out = attach_scalars(rows, keys_n)
    return out.select(F.lit(name).alias("table"), F.lit(" + ".join(keys)).alias("key"), "rows", "distinct_keys",
                      (F.col("rows") == F.col("distinct_keys")).alias("grain_ok"))


def date_validation(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    """Q6: per date column rows, missing, %, min and max."""
    cols = [c for c in columns if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__missing_dates"),
                 F.min(c).alias(f"{c}__min_date"), F.max(c).alias(f"{c}__max_date")]
    one = df.agg(*aggs)
    rep = _rows(one, cols, ["missing_dates", "min_date", "max_date"])
    rep = attach_scalars(rep, one.select(F.col("__n").alias("rows")))
    return rep.select(F.lit(name).alias("table"), "column", "rows", "missing_dates",
                      (F.col("missing_dates") * 100.0 / F.col("rows")).alias("missing_pct"), "min_date", "max_date")


def rule_checks(df: DataFrame, rules: Sequence[tuple[str, Callable[[Column], Column], str]],
                name: str = "table") -> DataFrame:
    """Q7: (column, predicate, description) rules -> count and % of rows
    where the predicate holds (null counts as false); absent columns skipped.
    Predicates receive the column parsed as a number (P8 rules)."""
    from careflow.functions.parse import safe_numeric
    rules = [r for r in rules if r[0] in df.columns]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, (c, pred, _) in enumerate(rules):
        x = F.col(c) if not isinstance(df.schema[c].dataType, StringType) else safe_numeric(c)
        aggs.append(F.sum(F.coalesce(pred(x.cast("double")), F.lit(False)).cast("long")).alias(f"r{i}__count"))
    one = df.agg(*aggs)
    rep = _rows(one, [f"r{i}" for i in range(len(rules))], ["count"], key="__rule")
    meta = df.sparkSession.createDataFrame([(f"r{i}", c, d) for i, (c, _, d) in enumerate(rules)],
                                           "__rule string, column string, rule string")
    rep = attach_scalars(rep.join(F.broadcast(meta), "__rule"), one.select("__n"))
    return rep.select(F.lit(name).alias("table"), "column", "rule", "count",
                      (F.col("count") * 100.0 / F.col("__n")).alias("pct"))


def domain_check(df: DataFrame, domains: dict, name: str = "table", examples: int = 10) -> DataFrame:
    """Q8: invalid count, % and up to ``examples`` distinct invalid values
    (smallest first) per column with an expected domain."""
    cols = [c for c in domains if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "table string, column string, expected_domain string, "
                                                   "invalid_count bigint, invalid_pct double, invalid_examples string")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                 (F.col(c).isNotNull() & ~F.col(c).isin(list(domains[c]))).alias("bad")) for c in cols])).alias("p")
    ).select("p.*")
    counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("__n"),
                                         F.sum(F.col("bad").cast("long")).alias("invalid_count"))
    # top-k per column: row_number <= k gets a partial group limit before the shuffle
    bad = pairs.filter("bad").select("column", "value").distinct()
    w = Window.partitionBy("column").orderBy("value")
    ex = (bad.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= examples)
             .groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("invalid_examples")))
    dom = df.sparkSession.createDataFrame(
        [(c, ", ".join(sorted(str(v) for v in domains[c]))) for c in cols], "column string, expected_domain string")
    rep = counts.join(F.broadcast(dom), "column").join(ex, "column", "left")
    return rep.select(F.lit(name).alias("table"), "column", "expected_domain", "invalid_count",
                      (F.col("invalid_count") * 100.0 / F.col("__n")).alias("invalid_pct"),
                      F.coalesce("invalid_examples", F.lit("")).alias("invalid_examples"))


# Texts counted as "missing or unknown" by the inconsistency check.
UNKNOWN_TEXTS = ["UNKNOWN", "MISSING", "NA", "N/A", ""]


def text_inconsistency(df: DataFrame, columns: Iterable[str], name: str = "table") -> DataFrame:
    """Q9: raw vs accent-insensitive distinct counts per column, a flag when
    normalising merges values, and the missing-or-unknown count; sorted
    by flag, missing count and raw count, descending.

    Values are unpivoted to (column, value) pairs and reduced to distinct
    pairs before the key UDF runs, so the UDF sees each value once.
    """
    cols = [c for c in columns if c in df.columns]
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p")
    ).select("p.*")
    unk = pairs.groupBy("column").agg(F.sum((F.col("value").isNull() | F.upper(F.trim("value")).isin(UNKNOWN_TEXTS))
                                            .cast("long")).alias("missing_or_unknown_count"))
    distinct = pairs.distinct()
    keyed = with_accent_key(distinct, "value", "norm")
    counts = keyed.groupBy("column").agg(F.count_distinct("value").alias("raw_unique"),
                                         F.count_distinct("norm").alias("normalized_unique"))
    rep = counts.join(unk, "column")
    return rep.select(F.lit(name).alias("table"), "column", "raw_unique", "normalized_unique",
                      (F.col("normalized_unique") < F.col("raw_unique")).cast("int").alias("possible_text_inconsistency"),
                      "missing_or_unknown_count").orderBy(
        F.desc("possible_text_inconsistency"), F.desc("missing_or_unknown_count"), F.desc("raw_unique"), "column")


def hours_without_valid(master: DataFrame, count_col: str = "wait_proxy_valid_count") -> DataFrame:
    """Q10: hours whose valid-wait count is 0, as count and %."""
    return master.agg(F.count(F.lit(1)).alias("hours"),
                      F.sum((F.col(count_col) == 0).cast("long")).alias("hours_without_valid"),
                      (F.avg((F.col(count_col) == 0).cast("double")) * 100.0).alias("pct"))


def unique_counts(df: DataFrame, columns: Iterable[str] | None = None, approx: bool = False) -> DataFrame:
    """Q11: distinct non-null values per column (exact, or HyperLogLog++)."""
    cols = [c for c in (columns or df.columns) if c in df.columns]
    f = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    one = df.agg(*[f(c).alias(f"{c}__unique") for c in cols])
    return _rows(one, cols, ["unique"])


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Counts per value (null included) with % of rows, by count desc
    then value; ``top`` keeps the first n (T4)."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("__t"))
    out = attach_scalars(counts, total).withColumn("pct", F.col("count") * 100.0 / F.col("__t")).drop("__t")
    order = [F.desc("count"), F.asc_nulls_last("value")]
    return out.orderBy(*order).limit(top) if top else out.orderBy(*order)


def crosstab_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two-column value counts."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("count"))


def numeric_profile(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Count, missing, min, q1, median, mean, q3, max, sample std,
    bias-corrected skew and IQR outliers per column. Text that is no number
    is neither counted nor missing: missing counts nulls of the raw column.

    The quartiles are found first (:func:`select_quantiles`: a few scans that
    shuffle histograms alone); one last scan then takes the moments and counts
    the outliers together. ``df`` should be a table, as it is read once a scan.
    """
    from careflow.functions.parse import safe_numeric
    cols = [c for c in columns if c in df.columns]
    number = {c: safe_numeric(c) if isinstance(df.schema[c].dataType, StringType) else F.col(c).cast("double") for c in cols}
    quartiles = select_quantiles(df, number, [0.25, 0.5, 0.75])

    def fields(c: str) -> Column:
        q = dict(zip(("q1", "median", "q3"), quartiles[c]))
        return F.struct(F.lit(c).alias("column"), number[c].alias("x"), F.col(c).isNull().cast("long").alias("none"),
                        *[F.lit(v).cast("double").alias(k) for k, v in q.items()])

    long = df.select(F.explode(F.array(*[fields(c) for c in cols])).alias("p")).select("p.*")
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    outside = (F.col("x") < F.col("q1") - fence) | (F.col("x") > F.col("q3") + fence)
    n = F.col("count").cast("double")
    prof = long.groupBy("column", "q1", "median", "q3").agg(
        F.count("x").alias("count"), F.sum("none").alias("missing"),
        F.min("x").alias("min"), F.avg("x").alias("mean"), F.max("x").alias("max"),
        F.stddev_samp("x").alias("std"), F.skewness("x").alias("__g1"), F.count_if(outside).alias("iqr_outliers"))
    return prof.withColumn("skew", F.when(n > 2, F.col("__g1") * F.sqrt(n * (n - 1)) / (n - 2))).select(
        "column", "count", "missing", "min", "q1", "median", "mean", "q3", "max", "std", "skew", "iqr_outliers")


def describe(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Pandas-style describe (count, mean, std, min, 25%, 50%, 75%,
    max) with exact interpolated quantiles."""
    p = numeric_profile(df, columns)
    return p.select("column", "count", "mean", "std", "min", F.col("q1").alias("p25"),
                    F.col("median").alias("p50"), F.col("q3").alias("p75"), "max")


def column_sums(df: DataFrame, prefix: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Sums of the columns starting with ``prefix``, largest first."""
    ex = set(exclude)
    cols = [c for c in df.columns if c.startswith(prefix) and c not in ex]
    one = df.agg(*[F.sum(c).alias(f"{c}__total") for c in cols])
    return _rows(one, cols, ["total"]).orderBy(F.desc("total"), "column")


def label_correlations(df: DataFrame, label: str, columns: Iterable[str]) -> DataFrame:
    """Pearson correlation of each numeric column with the label,
    ranked by absolute value."""
    cols = [c for c in columns if c in df.columns and c != label]
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(f"{c}__corr") for c in cols])
    rep = _rows(one, cols, ["corr"]).withColumn("abs_corr", F.abs("corr"))
    return rep.orderBy(F.desc_nulls_last("abs_corr"), "column")


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed);
    every bin is reported, empty ones with 0."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    b = F.least(F.floor((x - F.col("__lo")) / width), F.lit(bins - 1))
    b = F.when(width == 0, F.lit(0)).otherwise(b).cast("int")
    counts = (attach_scalars(df.select(col).filter(x.isNotNull()), rng)
              .groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    spine = rng.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "__lo", "__hi")
    spine = spine.select("bin", (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("lower"),
                         (F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins).alias("upper"))
    return spine.join(counts, "bin", "left").fillna({"count": 0}).orderBy("bin")


def union_reports(reports: Sequence[DataFrame]) -> DataFrame:
    """Concatenate per-table reports (columns aligned by name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def schema_diff(spark, raw_columns: Sequence[str], processed_columns: Sequence[str],
                name: str = "table") -> DataFrame:
    """Columns kept, removed and new between a raw and a processed table."""
    raw, proc = list(raw_columns), list(processed_columns)
    rows = ([(name, c, "kept") for c in raw if c in proc] + [(name, c, "removed") for c in raw if c not in proc]
            + [(name, c, "new") for c in proc if c not in raw])
    return spark.createDataFrame(rows, "table string, column string, status string")

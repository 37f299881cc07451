"""careflow: hospital-operations analytics as Spark DataFrame operators.

Sub-packages
------------
functions   Column -> Column helpers (text cleaning, parsing, calendar).
operators   DataFrame -> DataFrame operators (joins, dedup, aggregates,
            time-series windows, data-quality reports, KPIs, features,
            splits, metrics, models).
sources     Readers and writers (parquet, JSON, CSV, prediction log, models).
plans       Composite entry points (cleaning, integration, modelling) and the
            role mapping used to run them on the driver's tables.

Every operator takes column names as arguments (hospital names are only
defaults), never collects data to the driver, and leaves physical planning
to Catalyst/AQE.
"""

__version__ = "0.1.0"

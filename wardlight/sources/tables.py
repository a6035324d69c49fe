"""Loading and refreshing the three related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "asset": "asset_id long, hostname string, environment string, department string, "
    "criticality string, os string, internet_exposed string",
    "incident": "incident_id long, asset_id long, opened_on date, kind string, severity string, "
    "technique string, status string, hours_to_resolve double, false_positive string",
    "vulnerability": "vuln_id string, asset_id long, cve string, cvss double, detected_on date, "
    "status string, sla_days int",
}


def load_tables(
    spark: SparkSession,
    directory: str,
    fmt: str = "csv",
    schemas: dict[str, str] | None = None,
    views: bool = True,
) -> dict[str, DataFrame]:
    """Read ``<directory>/<table>`` for every table with its declared types; CSV
    has a header line. A schema of None is inferred."""
    tables = {}
    for name, schema in (SCHEMAS if schemas is None else schemas).items():
        reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
        if fmt == "csv":
            reader = reader.option("header", True)
        tables[name] = reader.format(fmt).load(f"{directory}/{name}")
        if views:
            tables[name].createOrReplaceTempView(name)
    return tables


def save_tables(tables: dict[str, DataFrame], directory: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{directory}/{name}")


def refresh_tables(
    spark: SparkSession, source: str, target: str, fmt: str = "csv",
    schemas: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Rebuild the Parquet tables from their source; running it again gives the
    same tables."""
    wanted = SCHEMAS if schemas is None else schemas
    save_tables(load_tables(spark, source, fmt, wanted, views=False), target)
    return load_tables(spark, target, "parquet", wanted)

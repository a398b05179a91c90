"""Annotations and votes in a relational database: tables of a JDBC catalog, read in parts, with filters and counts done by the database.

Spark plans these tables like any other: columns, filters, limits and aggregates that the database can do are sent to
it, so of a large table only what a query needs, or only its sums, comes over the connection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"


def attach(spark: SparkSession, name: str, url: str, driver: str, **options: str) -> str:
    """Makes the database known to the session as a catalog of this name, with aggregates, limits and offsets sent to it.

    options are those of Spark's JDBC source (user, password, fetchsize, ..). A catalog that the session has already used
    keeps the address it was used with.
    """
    conf = {"url": url, "driver": driver, "pushDownAggregate": "true", "pushDownLimit": "true", "pushDownOffset": "true", **options}
    for key, value in conf.items():
        spark.conf.set(f"spark.sql.catalog.{name}.{key}", value)
    spark.conf.set(f"spark.sql.catalog.{name}", CATALOG)
    return name


def _name(catalog: str, *path: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in (catalog, *path))


def table(spark: SparkSession, catalog: str, *path: str) -> DataFrame:
    """A table (schema, name) of an attached database."""
    return spark.table(_name(catalog, *path))


def bounds(spark: SparkSession, catalog: str, *path: str, column: str) -> tuple[int, int, int] | None:
    """(least, largest, rows) of a whole-number column, from one aggregate in the database; None for an empty table."""
    least, largest, n = table(spark, catalog, *path).agg(F.min(column), F.max(column), F.count("*")).first()
    return None if least is None else (int(least), int(largest), int(n))


def in_parts(spark: SparkSession, catalog: str, *path: str, column: str, rows: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """The table in as many parts as it has `rows` rows, each a range of the column and a query of its own to the database.

    Bounds are taken from the table itself, so no row is left out and rows without a value go with the first part. Filters
    on the result are sent along with each part's range.
    """
    found = bounds(spark, catalog, *path, column=column)
    if found is None:
        return table(spark, catalog, *path)
    least, largest, n = found
    parts = parts or max(1, -(-n // rows))
    conf = lambda key: spark.conf.get(f"spark.sql.catalog.{catalog}.{key}")
    reader = spark.read.format("jdbc").option("url", conf("url")).option("driver", conf("driver"))
    for key in ("user", "password", "fetchsize"):
        value = spark.conf.get(f"spark.sql.catalog.{catalog}.{key}", None)
        if value is not None:
            reader = reader.option(key, value)
    reader = reader.option("dbtable", ".".join('"' + p.replace('"', '""') + '"' for p in path))
    return reader.option("partitionColumn", column).option("lowerBound", str(least)).option("upperBound", str(largest + 1)).option("numPartitions", str(parts)).load()


def annotations_of(spark: SparkSession, catalog: str, schema: str, *, corpus: str | None = None, authority: str | None = None) -> DataFrame:
    """The annotation table, of one corpus or authority if given; the database does the filtering."""
    found = table(spark, catalog, schema, "ANNOTATIONS")
    if corpus is not None:
        found = found.where(F.col("CORPUS") == corpus)
    if authority is not None:
        found = found.where(F.col("AUTHORITY") == authority)
    return found.toDF(*[c.lower() for c in found.columns])


def vote_counts(spark: SparkSession, catalog: str, schema: str, *, least: int = 1) -> DataFrame:
    """(exercise, fingering, votes) of what at least so many annotators gave: grouped and counted in the database."""
    votes = table(spark, catalog, schema, "VOTES")
    counted = votes.groupBy("EXERCISE", "FINGERING").agg(F.count("*").alias("VOTES"))
    return counted.where(F.col("VOTES") >= least).toDF("exercise", "fingering", "votes")


def write_table(df: DataFrame, catalog: str, schema: str, name: str, *, width: int = 4000) -> None:
    """Writes a new table, or more rows of one that is there. Texts get columns of `width` characters, which databases can group and compare."""
    spark = df.sparkSession
    upper = df.toDF(*[c.upper() for c in df.columns])
    full = _name(catalog, schema, name)
    if not spark.catalog.tableExists(full):
        kinds = ", ".join(f"`{c}` {f'VARCHAR({width})' if t == 'string' else t}" for c, t in upper.dtypes)
        spark.sql(f"CREATE TABLE {full} ({kinds})")
    upper.writeTo(full).append()

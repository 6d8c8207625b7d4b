"""Landed API pages -> flat issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas

ISO_OFFSET = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed search pages, one JSON document per file."""
    return spark.read.schema(schemas.PAGE).option("multiLine", True).json(path)


def parse_pages(bodies: DataFrame, column: str = "body") -> DataFrame:
    """The same pages held as JSON text in a column."""
    return bodies.select(F.from_json(column, schemas.PAGE).alias("p")).select("p.*")


def api_time(stamp: Column) -> Column:
    """ISO time with a numeric offset."""
    return F.to_timestamp(stamp, ISO_OFFSET)


def flatten_pages(pages: DataFrame, project: str | None = None) -> DataFrame:
    """One row per issue, with its ``start_at`` and ``position`` as arrival order.

    Pages without issues add nothing.  Without ``project`` the key's prefix is used.  ``raw`` holds all fields as they
    came, undeclared and nested ones and explicit nulls too, as JSON with sorted keys and no blanks.
    """
    def field(name: str) -> Column:
        return F.try_variant_get("i.fields", f"$.{name}", "string")

    def name_of(name: str) -> Column:
        """The name of a named object; NULL where the field is anything else."""
        return field(f"{name}.name")

    owner = F.lit(project) if project else F.substring_index("i.key", "-", 1)
    # The outer form keeps Catalyst from adding a size test that would parse JSON pages twice.
    return (pages.select("startAt", F.posexplode_outer("issues").alias("position", "i"))
            .where(F.col("position").isNotNull())
            .select(
                F.col("i.key").alias("issue_key"), F.col("i.id").cast("bigint").alias("issue_id"),
                owner.alias("project"), field("summary").alias("summary"), field("description").alias("description"),
                name_of("issuetype").alias("issue_type"), name_of("priority").alias("priority"),
                name_of("status").alias("status"), name_of("resolution").alias("resolution"),
                api_time(field("created")).alias("created"), api_time(field("updated")).alias("updated"),
                api_time(field("resolutiondate")).alias("resolutiondate"),
                F.to_json("i.fields").alias("raw"),
                F.current_timestamp().alias("ingested_at"), F.lit(False).alias("date_suspect"),
                F.coalesce("startAt", F.lit(0)).alias("start_at"), "position"))


def of_project(issues: DataFrame, project: str, max_issues: int = 0) -> DataFrame:
    """Issues of one project; ``max_issues`` takes the oldest ones (0 = all)."""
    rows = issues.where(F.col("project") == project)
    return rows.orderBy("created", "issue_key").limit(max_issues) if max_issues else rows


def project_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("project").agg(F.count("*").alias("n"))

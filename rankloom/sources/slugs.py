"""Company slugs of applicant tracking systems: contributed lines, and careers URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The supported systems.
SYSTEMS = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "recruitee", "pinpoint", "breezy", "recruiterbox", "jobscore", "crelate", "personio", "paylocity", "dayforce", "workday", "eightfold")
#: Systems whose slugs keep their case.
CASED = ("smartrecruiters", "workday")
# Where a careers URL of a system has the slug.
URL_PATTERNS = (
    ("greenhouse", r"^https?://boards\.greenhouse\.io/([^/?#]+)"),
    ("lever", r"^https?://jobs\.lever\.co/([^/?#]+)"),
    ("ashby", r"^https?://jobs\.ashbyhq\.com/([^/?#]+)"),
    ("workable", r"^https?://apply\.workable\.com/([^/?#]+)"),
    ("smartrecruiters", r"^https?://careers\.smartrecruiters\.com/([^/?#]+)"),
    ("recruitee", r"^https?://([^./]+)\.recruitee\.com"),
    ("personio", r"^https?://([^./]+)\.jobs\.personio\.com"),
    ("paylocity", r"^https?://recruiting\.paylocity\.com/.*/([^/?#]+)"),
    ("workday", r"^https?://([^./]+)\.wd[0-9]+\.myworkdayjobs\.com"),
    ("breezy", r"^https?://([^./]+)\.breezy\.hr"),
)


def folded(system: Column, slug: Column) -> Column:
    """The slug in lower case, but for systems that keep its case."""
    return F.when(system.isin(*CASED), slug).otherwise(F.lower(slug))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(ats, slug) of ``<ats>,<slug>`` lines; comments, blank lines and unsupported systems are skipped."""
    text = F.trim(F.col(column))
    parts = F.split(text, ",", 2)
    rows = lines.where((text != "") & ~text.startswith("#") & text.contains(","))
    rows = rows.select(F.lower(F.trim(parts[0])).alias("ats"), F.trim(parts[1]).alias("slug")).where(F.col("ats").isin(*SYSTEMS) & (F.col("slug") != ""))
    return rows.select("ats", folded(F.col("ats"), F.col("slug")).alias("slug"))


def read_slugs(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path)).distinct()


def missing(contributed: DataFrame, registry: DataFrame) -> DataFrame:
    """Contributed slugs that the registry lacks."""
    return contributed.join(registry, ["ats", "slug"], "left_anti")


def from_url(url: Column, patterns: tuple[tuple[str, str], ...] = URL_PATTERNS) -> Column:
    """struct(ats, slug) of a careers URL by the first pattern that fits, null otherwise."""
    out = F.lit(None).cast("struct<ats:string,slug:string>")
    for system, pattern in reversed(patterns):
        slug = F.regexp_extract(url, pattern, 1)
        out = F.when(slug != "", F.struct(F.lit(system).alias("ats"), folded(F.lit(system), slug).alias("slug"))).otherwise(out)
    return out

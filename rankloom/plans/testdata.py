"""The synthetic tables seen as job postings and pairwise decisions; one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_JOBS = """
select p.p_partkey as id, concat('ats', p.p_partkey % 16) as ats, p.p_brand as company,
  case when p.p_partkey % 5 = 0 then '' when p.p_partkey % 7 = 0 then null else concat(p.p_brand, ' Inc') end as company_name,
  p.p_name as title, concat('https://jobs.example/', p.p_partkey) as url, d.text as jd_markdown,
  lower(p.p_type) as function, lower(p.p_name) as sub_function,
  case p.p_size % 4 when 0 then 'Junior' when 1 then 'Mid' when 2 then 'Senior' else 'Staff' end as level,
  case p.p_partkey % 4 when 0 then 'fully_remote' when 1 then 'remote_first' when 2 then 'hybrid' else 'onsite' end as work_mode,
  case p.p_partkey % 3 when 0 then 'us-only' when 1 then 'us-canada' else '' end as remote_scope,
  case p.p_partkey % 9 when 0 then 'CA' when 1 then 'US' when 2 then 'DE' else '' end as country_code,
  case when p.p_partkey % 13 = 0 then null else p.p_partkey % 11 = 0 end as is_staffing,
  case when p.p_partkey % 17 = 0 then null else p.p_partkey % 10 = 0 end as management,
  case p.p_partkey % 3 when 0 then 'yes' when 1 then 'no' else 'unknown' end as visa_sponsorship,
  cast(p.p_size * 3 as double) as salary_min_k,
  cast(case when p.p_partkey % 6 = 0 then -1 when p.p_partkey % 19 = 0 then null when p.p_partkey % 23 = 0 then 0 else p.p_size * 5 end as double) as salary_max_k,
  case p.p_partkey % 5 when 0 then 'EUR' when 1 then '' else 'USD' end as salary_currency,
  case when p.p_partkey % 8 = 0 then null else split(concat(p.p_name, '|Lead ', p.p_name), {sep}) end as alt_titles,
  split(concat(p.p_type, '|', lower(p.p_brand)), {sep}) as skills, e.embedding as jd_embedding
from {part} p left join {documents} d on d.doc_id = p.p_partkey left join {embeddings} e on e.vec_id = p.p_partkey
"""

_DECISIONS = """
select a_id, b_id, case when (ua > ub) {flip} then 'A' else 'B' end as winner from (
  select a.vec_id as a_id, b.vec_id as b_id, cast(a.embedding[{first}] as double) as ua, cast(b.embedding[{first}] as double) as ub
  from (select vec_id, embedding, {start} as start, {most} as most from {embeddings}, (select max(vec_id) + 1 as n from {embeddings}) t) a cross join (select 1 as k union all select 2 union all select 3) ks
  join {embeddings} b on b.vec_id = a.start + (a.vec_id * 7 + ks.k * 13) % a.most where a.vec_id <> b.vec_id)
"""


def _decisions(first: int, acyclic: bool, pool: int) -> str:
    start, most = (f"vec_id - vec_id % {pool}", str(pool)) if pool else ("0", "n")
    flip = "" if acyclic else "<> (a_id % 50 = 0)"
    text = _DECISIONS
    for name, value in (("{first}", str(first)), ("{start}", start), ("{most}", most), ("{flip}", flip)):
        text = text.replace(name, value)
    return text


def sql_jobs() -> str:
    """The jobs view for DuckDB."""
    return "(" + _JOBS.format(sep="'|'", part="part", documents="documents", embeddings="embeddings") + ")"


def sql_decisions(acyclic: bool = False, pool: int = 0) -> str:
    return "(" + _decisions(1, acyclic, pool).replace("{embeddings}", "embeddings") + ")"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: read(spark, sf_dir, n) for n in ("part", "documents", "embeddings")}
    return spark.sql(_JOBS.replace("{sep}", "'[|]'"), **tables)


def decisions(spark: SparkSession, sf_dir: str, acyclic: bool = False, pool: int = 0) -> DataFrame:
    """Three decisions for each vector, by a hidden utility; every 50th vector's are turned, so cycles exist, unless ``acyclic``.

    Partners are from the whole table or, with ``pool``, from so many neighbouring ids:
    contests of bounded size, whose closure grows with the table and not with its square.
    """
    return spark.sql(_decisions(0, acyclic, pool), embeddings=read(spark, sf_dir, "embeddings"))

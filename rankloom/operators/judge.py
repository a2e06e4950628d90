"""Judges: pluggable deciders of pairs and scorers of fits, called by partition and replayable from a log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import exprs as X
from rankloom.operators import graph
from rankloom.sources import files

PAIR_TEXT, FIT_TEXT = 4000, 6000


class PairJudge(Protocol):
    def __call__(self, resume: str, a: dict, b: dict) -> str:
        """A or B."""


class FitJudge(Protocol):
    def __call__(self, resume: str, job: dict) -> dict:
        """match_score, verdict, summary, strengths, gaps."""


@dataclass
class UtilityJudge:
    """A deterministic offline judge: the larger value of a field wins, then the smaller id."""

    by: str = "utility"

    def __call__(self, resume: str, a: dict, b: dict) -> str:
        x, y = a.get(self.by) or 0.0, b.get(self.by) or 0.0
        return "A" if (x, b["id"]) > (y, a["id"]) else "B"


@dataclass
class ReplayJudge:
    """Answers from decisions made before, in either orientation."""

    decided: dict[tuple, str] = field(default_factory=dict)

    def __call__(self, resume: str, a: dict, b: dict) -> str:
        if (a["id"], b["id"]) in self.decided:
            return self.decided[a["id"], b["id"]]
        return {"A": "B", "B": "A"}[self.decided[b["id"], a["id"]]]


@dataclass
class OverlapFit:
    """A deterministic offline fit judge: the share of a job's skills that the text names."""

    def __call__(self, resume: str, job: dict) -> dict:
        skills = [s for s in (job.get("skills") if job.get("skills") is not None else []) if s]
        have = [s for s in skills if s.lower() in resume.lower()]
        score = round(100 * len(have) / len(skills)) if skills else 0
        return {"match_score": score, "verdict": band(score), "summary": f"{len(have)} of {len(skills)} skills", "strengths": have, "gaps": [s for s in skills if s not in have]}


def band(score: int) -> str:
    return "strong" if score >= 90 else "solid" if score >= 70 else "stretch" if score >= 50 else "weak"


def patient(call: Callable, tries: int = 6, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call with retries, waiting 1, 2, 4, ... up to ``most`` seconds; the last error is raised.  Retries stay inside the task, so that a task's own retry asks nothing twice that was answered."""

    def run(*args):
        for k in range(tries):
            try:
                return call(*args)
            except Exception:
                if k == tries - 1:
                    raise
                sleep(min(2.0**k, most))

    return run


def _bounded(rows: DataFrame, workers: int) -> tuple[DataFrame, int]:
    """rows in so few partitions, and calls at a time in each, that all together make at most ``workers`` calls at a time."""
    tasks = max(1, min(workers, rows.sparkSession.sparkContext.defaultParallelism))
    return rows.coalesce(tasks), workers // tasks


def decide(pairs: DataFrame, judge: PairJudge, resume: str = "", workers: int = 8) -> DataFrame:
    """Pairs (a, b: structs of candidates with id, company, title) with winner, winner_id and labels.

    At most ``workers`` calls are made at a time, over all tasks.  Any error fails the run,
    as an answer that is missing would bias the order.  Write the result before anything
    else reads it: a second evaluation would ask again.
    """
    pairs, each = _bounded(pairs, workers)
    kind = pairs.schema["a"].dataType["id"].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]):
        ask = patient(lambda a, b: judge(resume, a, b))
        with ThreadPoolExecutor(each) as pool:
            for frame in batches:
                got = list(pool.map(ask, frame["a"], frame["b"]))
                if bad := set(got) - {"A", "B"}:
                    raise ValueError(f"a judge answered {bad}")
                name = [[f"{x.get('company')}: {x.get('title')}" for x in frame[c]] for c in "ab"]
                yield pd.DataFrame({"a_id": [x["id"] for x in frame["a"]], "b_id": [x["id"] for x in frame["b"]], "winner": got, "winner_id": [(a if w == "A" else b)["id"] for a, b, w in zip(frame["a"], frame["b"], got, strict=True)], "a": name[0], "b": name[1]})

    return pairs.mapInPandas(run, f"a_id {kind}, b_id {kind}, winner string, winner_id {kind}, a string, b string")


def with_memo(asked: DataFrame, log: DataFrame | None) -> tuple[DataFrame | None, DataFrame]:
    """Splits asked (a_id, b_id) into those a log answers, in either orientation, and those it doesn't."""
    if log is None:
        return None, asked
    memo = graph.pairs(log).groupBy("lo", "hi").agg(F.max("lo_won").alias("lo_won"))
    return graph.recall(asked, memo)


def score_fits(candidates: DataFrame, judge: FitJudge, resume: str, done: DataFrame | None = None, workers: int = 8) -> DataFrame:
    """Match records of candidates with a job text that are not done yet; a failed one has null fields and its error, and is asked again next time.

    A column ``score`` of the candidates, of any numeric type, comes back as embed_score;
    without one it is null.  At most ``workers`` calls are made at a time, over all tasks.
    """
    if len(resume.strip()) < 100:
        raise ValueError("the text is too short to score")
    rows = candidates.where(X.is_filled(F.col("jd_markdown"))).withColumn("jd_markdown", F.substring("jd_markdown", 1, FIT_TEXT))
    if done is not None:
        rows = rows.join(done.select("id").distinct(), "id", "left_anti")
    prior = F.col("score").cast("double") if "score" in rows.columns else F.lit(None).cast("double")
    rows, each = _bounded(rows.withColumn("embed_score", prior), workers)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]):
        ask = patient(lambda job: judge(resume, job), tries=2, sleep=lambda _: None)

        def one(job: dict) -> dict:
            try:
                return {"error": None, **ask(job)}
            except Exception as e:
                return {"error": str(e)[:200]}

        with ThreadPoolExecutor(each) as pool:
            for frame in batches:
                jobs = frame.to_dict("records")
                got = list(pool.map(one, jobs))
                yield pd.DataFrame([{"id": j["id"], "company": j.get("company"), "title": j.get("title"), "url": j.get("url"), "embed_score": None if pd.isna(j["embed_score"]) else j["embed_score"], **{k: g.get(k) for k in ("match_score", "verdict", "summary", "strengths", "gaps", "error")}} for j, g in zip(jobs, got, strict=True)]).astype({"match_score": "Int32", "embed_score": "Float64"})

    return rows.mapInPandas(run, f"id {kind}, company string, title string, url string, embed_score double, match_score int, verdict string, summary string, strengths array<string>, gaps array<string>, error string")


def matched(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """The log's records of current candidates, the last one for each id if the log has ``at``, best score first; ids of earlier runs are left out."""
    rows = log.where(F.col("match_score").isNotNull()).join(candidates.select("id").distinct(), "id", "left_semi")
    if "at" in log.columns:
        rows = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "id"]), "at").alias("r")).select("id", "r.*")
    return rows.orderBy(F.desc("match_score"), "id")


def append_round(spark, decisions: DataFrame, path: str) -> DataFrame:
    """Writes a round of decisions to the log and returns the log."""
    files.append_log(decisions, path)
    return spark.read.schema(decisions.schema).json(path)

"""Null, sentinel and tie rules on hand-written rows."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankloom.functions import exprs as X
from rankloom.operators import dedup
from rankloom.operators.filters import HullConfig, RecallConfig
from rankloom.plans import pipelines
from rankloom.sources import files, slugs

SCHEMA = (
    "id long, company string, company_name string, title string, url string, jd_markdown string, function string, sub_function string, level string, work_mode string, remote_scope string, country_code string, "
    "is_staffing boolean, management boolean, visa_sponsorship string, salary_min_k double, salary_max_k double, salary_currency string, alt_titles array<string>, skills array<string>, jd_embedding array<float>"
)


def rows(spark, *changes):
    base = dict(id=0, company="Acme", company_name=None, title="Backend Dev", url="u", jd_markdown="text", function="eng", sub_function="web", level="Senior", work_mode="fully_remote", remote_scope="", country_code="US",
                is_staffing=None, management=None, visa_sponsorship="yes", salary_min_k=50.0, salary_max_k=100.0, salary_currency="USD", alt_titles=None, skills=None, jd_embedding=None)
    data = [{**base, "id": k, "company": f"c{k}", **c} for k, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f.split()[0]] for f in SCHEMA.split(", ")) for r in data], SCHEMA)


def kept_ids(df, config):
    return sorted(r["id"] for r in pipelines.hull(df, config).collect())


@pytest.mark.parametrize("value", [-1.0, 0.0, None, float("nan")])
def test_unknown_comp_is_dropped_or_kept_by_a_flag(spark, value):
    df = rows(spark, dict(salary_max_k=value), dict(salary_max_k=60.0))
    assert kept_ids(df, HullConfig(min_comp=50)) == [1]
    assert kept_ids(df, HullConfig(min_comp=50, unknown_comp="keep")) == [0, 1]
    assert kept_ids(df, HullConfig()) == [0, 1]


def test_flags_that_are_null_keep_a_row(spark):
    df = rows(spark, {}, dict(is_staffing=True), dict(management=True), dict(is_staffing=False, management=False))
    assert kept_ids(df, HullConfig()) == [0, 3]
    assert kept_ids(df, HullConfig(include_staffing=True)) == [0, 1, 3]


def test_scope_stands_for_the_us_only(spark):
    df = rows(spark, dict(country_code="DE", remote_scope="us-only"), dict(country_code=None, remote_scope="us-canada"), dict(country_code="CA"))
    assert kept_ids(df, HullConfig(country="us ")) == [0, 1]
    assert kept_ids(df, HullConfig(country="CA")) == [2]


def test_titles_match_literally_and_in_alternatives(spark):
    df = rows(spark, dict(title=None, alt_titles=[None, "Backend Dev"]), dict(title="C++ (50%)"), dict(title="ccc", alt_titles=[]), dict(title=None))
    assert kept_ids(df, HullConfig(titles=("backend",))) == [0]
    assert kept_ids(df, HullConfig(titles=("c++",))) == [1]
    assert kept_ids(df, HullConfig(titles=("50%", " "))) == [1]
    assert kept_ids(df, HullConfig(titles=("c_c", "."))) == []


def test_first_of_a_company_and_title_stays(spark):
    df = rows(spark, dict(company="Acme", company_name=""), dict(company="x", company_name="ACME", title="backend DEV"), dict(company="n", title=None), dict(company="N", title="None"))
    assert kept_ids(df, HullConfig()) == [0, 2]


def test_seeds_match_skills_by_case_and_across_fields(spark):
    df = rows(spark, dict(skills=["Rust"], title="x"), dict(title="platform", alt_titles=["rust dev", None]))
    ask = lambda **k: [r["id"] for r in df.where(RecallConfig(**k).is_seed()).orderBy("id").collect()]
    assert ask(seeds=("rust",)) == [1]
    assert ask(seeds=("rust",), case_fold=True) == [0, 1]
    assert ask(seeds=("platform rust",)) == [1]


def test_currency_guard_is_for_the_us(spark):
    df = rows(spark, dict(salary_currency="EUR"), dict(salary_currency=""), dict(salary_currency=None))
    assert df.where(RecallConfig(country="US").column()).count() == 2
    assert df.where(RecallConfig().column()).count() == 3


def test_where_compares_as_python_writes(spark):
    df = rows(spark, dict(is_staffing=True, title=None), dict(alt_titles=["A", None], salary_max_k=1e7))
    ids = lambda text: [r["id"] for r in files.stream_rows(df, ["id"], where=files.parse_where(text)).collect()]
    assert ids("is_staffing=True") == [0]
    assert ids("title=None,noise") == [0]
    assert ids("salary_max_k=10000000.0") == [1]
    shown = df.where("id = 1").select(X.py_str(F.col("alt_titles"), df.schema["alt_titles"].dataType)).first()[0]
    assert shown == "['A', None]"


def test_blank_texts(spark):
    df = spark.createDataFrame([(" \n\t ",), ("a",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.is_filled(F.col("t"))).collect()] == [False, True, False, False]


def test_projection_drops_vectors_and_adds_filter_keys(spark):
    df = rows(spark, {})
    assert "jd_embedding" not in files.project(df, embeddings=False).columns
    assert files.project(df, ["id", "nope", "id"], extra=["title", "gone"]).columns == ["id", "title", "gone"]


def test_logs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a_id": "1", "b_id": "2", "winner": "A"}\n{"a_id": "3", "b_')
    assert files.read_jsonl(spark, str(p)).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        files.read_jsonl(spark, str(p), strict=True).collect()
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "empty.jsonl"), strict=True)
    (tmp_path / "list.json").write_text('[{"id": "1"}, {"id": "2"}]')
    assert files.read_json_array(spark, str(tmp_path / "list.json")).count() == 2
    (tmp_path / "r.txt").write_text(" hello ")
    assert files.read_text(spark, str(tmp_path / "r.txt")) == "hello"
    with pytest.raises(ValueError):
        files.read_text(spark, str(tmp_path / "r.txt"), least=100)


def test_append_log_and_iterate(spark, tmp_path):
    df = spark.createDataFrame([("1", "2", "A")], "a_id string, b_id string, winner string")
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert len(list(files.iterate(files.read_jsonl(spark, str(tmp_path / "log"))))) == 2


def test_scan_order_is_file_and_row(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "t"))
    got = files.with_ordinal(spark.read.parquet(str(tmp_path / "t"))).orderBy("ordinal").collect()
    assert [r["id"] for r in got] == list(range(50))


def test_slugs(spark):
    lines = spark.createDataFrame([("# greenhouse,x",), ("",), ("Greenhouse, Acme ",), ("workday,Acme",), ("nosuch,a",), ("lever",)], "value string")
    assert sorted(tuple(r) for r in slugs.parse_lines(lines).collect()) == [("greenhouse", "acme"), ("workday", "Acme")]
    urls = spark.createDataFrame([("https://boards.greenhouse.io/Stripe/jobs/1",), ("https://Acme.wd5.myworkdayjobs.com/en",), ("https://x.example.com/",), (None,)], "url string")
    got = [r[0] and tuple(r[0]) for r in urls.select(slugs.from_url(F.col("url"))).collect()]
    assert got == [("greenhouse", "stripe"), ("workday", "Acme"), None, None]


def test_last_and_best(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 5.0, 2), (2, "c", None, 3)], "k int, v string, s double, o int")
    assert sorted(r["v"] for r in dedup.last_by(df, ["k"], "o").collect()) == ["b", "c"]
    assert sorted(r["v"] for r in dedup.best_by(df, ["k"], "s", "o").collect()) == ["b", "c"]


def test_salary_and_sizes(spark):
    df = spark.createDataFrame([(50.0, 100.0, 1536.0), (50.0, -1.0, 10.0), (-1.0, 100.0, 1024.0**3)], "lo double, hi double, n double")
    assert [tuple(r) for r in df.select(X.salary(F.col("lo"), F.col("hi")), X.human_size(F.col("n"))).collect()] == [("$50-100k", "1.5KB"), ("$50-?k", "10.0B"), ("", "1.0GB")]


def test_sizes_are_exact_and_end_at_the_last_unit(spark):
    exact = [0.15, 0.25, 0.35, 0.05, 0.95, 9.96, 1023.96, 1280.0, 1024.0**4, 1.5 * 1024.0**5, 3.35 * 2.0**50 * 1024, 2.0**90, 2.0**122, 0.0, -0.0, -5.0, -1e30, float("inf"), float("nan")]
    rng = random.Random(3)
    # quotients whose shortest decimals seem to end in a 5
    exact += [float(f"{rng.randrange(10**6)}.{rng.randrange(10)}5") * 2.0**30 for _ in range(500)] + [rng.uniform(0, 20) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in exact], "n double").select("n", X.human_size(F.col("n"), ("B", "KB", "MB", "GB"))).collect()
    for n, size in got:
        k = 0
        while k < 3 and not n / 1024**k < 1024:
            k += 1
        assert size == f"{n / 1024**k:.1f}" + ("B", "KB", "MB", "GB")[k]
    odd = spark.createDataFrame([(None,), (1024.0**4,), (1024.0**5,)], "n double")
    assert [tuple(r) for r in odd.select(X.human_size(F.col("n"), ("B", "KB", "MB", "GB")), X.human_size(F.col("n"))).collect()] == [("GB", "TB"), ("1024.0GB", "1.0TB"), ("1048576.0GB", "1024.0TB")]


def test_human_size_equals_its_sql_on_large_and_missing_keys(spark, tmp_path):
    from rankloom.plans import registry

    keys = [(1, 1), (2**21, 2**20), (9_000_000, 900_000), (2**62, 2**62), (None, 3), (3, None), (-7, 5), (0, -1), (1640, 1), (94_906_267, 94_906_265)]
    pq.write_table(pa.table({"o_orderkey": pa.array([k[0] for k in keys], pa.int64()), "o_custkey": pa.array([k[1] for k in keys], pa.int64())}), f"{tmp_path}/orders.parquet")
    got = registry.queries()["human_size"](spark, str(tmp_path)).collect()
    with duckdb.connect() as c:
        c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
        want = c.execute(registry.oracle_sql()["human_size"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_list_prefix_and_look_up(spark, tmp_path):
    rows = spark.createDataFrame([(5, 1), (4, 2), (3, 3)], "id long, ordinal long")
    assert [r["id"] for r in files.head_of(rows, 2).orderBy("ordinal").collect()] == [5, 4] and files.head_of(rows).count() == 3
    spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, "c"), (None, "d"), (7, "e")], "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/corpus")
    corpus = files.with_ordinal(spark.read.parquet(f"{tmp_path}/corpus"))
    wanted = spark.createDataFrame([(1,), (1,), (2,), (None,), (8,)], "id long")
    assert sorted(map(tuple, files.look_up(corpus, wanted, ["text"]).collect())) == [(1, "a"), (2, None)]
    assert files.look_up(corpus, wanted.limit(0), ["text"]).count() == 0


def test_json_array_file(spark, tmp_path):
    import json

    path = f"file://{tmp_path}/list.json"
    rows = spark.createDataFrame([(2, "é \"q\"", None), (1, None, ["a", None])], "id long, title string, skills array<string>")
    for _ in range(2):
        files.write_json_array(rows, path, "id")
    want = [{"id": 1, "title": None, "skills": ["a", None]}, {"id": 2, "title": "é \"q\"", "skills": None}]
    assert json.load(open(f"{tmp_path}/list.json", encoding="utf-8")) == want
    assert files.read_json_array(spark, path, "id long, title string, skills array<string>").count() == 2
    files.write_json_array(rows.limit(0), path)
    assert json.load(open(f"{tmp_path}/list.json")) == []
    assert files.parse_where("a=b=c,d, e= f") == {"a": "b=c", " e": " f"}


def test_session_options_are_put_back(spark):
    from rankloom.plans import pipelines, registry
    from rankloom.plans.testdata import jobs
    from rankloom.sources.store import CLEANUP

    names = ("spark.sql.optimizer.windowGroupLimitThreshold", CLEANUP)
    before = [spark.conf.get(n, None) for n in names]
    pipelines.recall_rank(jobs(spark, "/root/testdata/sf0.001"), registry.RECALL)
    assert [spark.conf.get(n, None) for n in names] == before

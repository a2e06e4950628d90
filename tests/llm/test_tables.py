"""Classifier, mixing, sharding, pages and the pipeline."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import components, html_text, mixing, quality, shards
from rankloom.llm.store import fresh

from .conftest import SCHEMA

SF = "/root/testdata/sf0.001"


# rule ensemble


def junk_and_prose(n):
    import random

    rng = random.Random(2)
    out = []
    for k in range(n):
        words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
        good = rng.random() < 0.6
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + rng.choice(["!!", "###", "$$"]) for w in words)
        out.append((k, text, int(good)))
    return out


def test_rules_learn_and_hold_out(spark):
    data = junk_and_prose(400)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t, _ in data] + [(None, None, None, None, None), (1000, "", "en", "s", 0)], SCHEMA)
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    assert len(got) == 402
    for k, _, y in data:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= got[k]["score"] <= 1 and got[k]["predicted"] == (got[k]["score"] >= 0.5)
    held = [(got[k]["predicted"], y) for k, _, y in data if got[k]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[None]["score"] == got[1000]["score"]
    # held-out labels don't matter
    turned = spark.createDataFrame([(k, 1 - y if got[k]["held_out"] else y) for k, _, y in data], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in quality.score(docs, turned).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-12 for k in got)


def test_compiled_rules_equal_the_model(spark):
    data = junk_and_prose(200)
    x = quality.statistics([t.encode() for _, t, _ in data])
    model = quality.fit(x, np.array([y for *_, y in data], float))
    assert model.rules
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, stats array<double>")
    got = [r["s"] for r in df.select("k", model.column(F.col("stats")).alias("s")).orderBy("k").collect()]
    assert np.allclose(got, model.score(x))


def plain_statistics(text):
    """The statistics of a text, counted byte by byte and word by word."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.STATS)
    kinds = [quality._CLASS[b] for b in raw]
    n = len(raw)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    low = [w.lower() for w in words]
    many = max(1, len(words))
    share = lambda k: kinds.count(k) / n
    each = lambda f: sum(bool(f(w)) for w in words) / many
    letters = lambda w: [b for b in w if quality._CLASS[b] <= 1]
    lines = [x for x in raw.split(b"\n") if x]
    distinct_pairs = len(set(zip(low, low[1:], strict=False)))
    at_least = max(1, len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / many, each(lambda w: len(w) > 14), each(lambda w: len(w) < 3), *[share(k) for k in range(11)],
        len(set(low)) / many, max(map(low.count, low), default=0) / many, sum(a == b for a, b in zip(low, low[1:], strict=False)) / many, each(lambda w: quality._CLASS[w[-1]] == 7), each(lambda w: quality._CLASS[w[-1]] == 6),
        each(lambda w: len(letters(w)) > 1 and all(65 <= b <= 90 for b in letters(w))), each(lambda w: any(48 <= b <= 57 for b in w)), np.log1p(len(lines)), np.log1p(n / at_least),
        len({x.lower() for x in lines}) / at_least, sum(quality._CLASS[x[-1]] in (5, 6) for x in lines) / at_least, distinct_pairs / max(1, len(words) - 1),
    ]


def test_statistics_against_plain_counting():
    import random

    rng = random.Random(4)
    bits = ["one", "Two", "TWO", " ", "  ", "\n", "\n\n", ".", "!", "#", "<b>", "x9", "é", "日本", "\t", "averylongwordindeed", "y" * 80, "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    got = quality.statistics([t.encode() for t in texts])
    assert np.allclose(got, np.array([plain_statistics(t) for t in texts]))


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((600, 25)).astype(np.float32)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * a[:, 0] - a[:, 1] + 0.3)))).astype(float)
    for penalty in (0.002, 0.05, 1.0):
        w, b = quality.lasso(a, y, penalty)
        r = 1 / (1 + np.exp(-(a @ w + b))) - y
        slope = a.T @ r / len(y)
        assert abs(r.mean()) < 1e-4 and np.abs(slope[w == 0]).max(initial=0) <= penalty + 1e-4
        assert np.abs(slope[w != 0] + penalty * np.sign(w[w != 0])).max(initial=0) < 1e-4
    assert not w.any()


def test_statistics_of_odd_texts():
    texts = [b"", b" ", b"\n\n", b"Two two one.\nTwo two one.\n", "é".encode(), b"A1!" * 5000]
    x = quality.statistics(texts)
    name = {n: k for k, n in enumerate(quality.STATS)}
    assert np.isfinite(x).all() and not x[0].any()
    assert x[3, name["distinct_lines"]] == 0.5 and x[3, name["lines_ending_stop"]] == 1 and abs(x[3, name["twice_running"]] - 2 / 6) < 1e-9
    assert np.allclose(x[3], quality.statistics([texts[3]])[0])


def test_without_labels_or_rows(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(no_docs, none).count() == 0
    assert quality.accepted(docs, none).columns == docs.columns
    assert quality.accepted(docs, none).count() == docs.count()


# mixing


def water(sizes, weights, most=3.0):
    total, fixed, left = sum(sizes), {}, set(range(len(sizes)))
    while left:
        level = (total - sum(fixed.values())) / sum(weights[k] for k in left)
        full = {k for k in left if weights[k] * level > most * sizes[k]}
        if not full:
            return [fixed.get(k, weights[k] * level) for k in range(len(sizes))]
        for k in full:
            fixed[k] = most * sizes[k]
        left -= full
    return [fixed[k] for k in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 1000, 5, 0, 70], [0, 0], [7], [10, 900, 3]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    assert np.allclose(got, water(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))]))


def test_permutations(spark):
    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x"))
        got = [r["x"] for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def test_mix(spark, docs, rows):
    mix = mixing.Mix(docs, block=4, shard_blocks=16)
    got = mix.documents.collect()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((r[0], n) for r, n in zip(rows, sizes, strict=True)), key=repr)
    total = {}
    for r, n in zip(rows, sizes, strict=True):
        total[r[3]] = total.get(r[3], 0) + n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water([total[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    for r in got:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
    for s in names:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= 4 + 0.02 * want[s]
    again = mixing.Mix(docs.repartition(2), block=4, shard_blocks=16).documents.select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, again), key=repr) == sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=repr)
    # each slot has a place of its own, and a lap takes no block twice
    plan = mix.plan.collect()
    assert sorted(r["place"] for r in plan) == list(range(len(plan)))
    assert len({(r["k"], r["block"], r["lap"]) for r in plan}) == len(plan)
    assert sum(r["slots"] for r in mix.shards.collect()) == len(plan)


def test_mixed_texts_have_the_words_that_were_taken(docs):
    mix = mixing.Mix(docs, block=4)
    out = mix.applied(docs)
    assert out.columns == docs.columns
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(count(r["text"]) for r in out.collect()) == sum(r["taken"] for r in mix.documents.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    # a row is a stretch of one document, and a lap's rows are as many as its runs of blocks
    words = {r["doc_id"]: f" {' '.join((r['text'] or '').split(' '))} " for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] != 3}
    split = lambda t: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(f" {split(r['text'])} " in f" {split(words[r['doc_id']])} " for r in out.collect() if r["doc_id"] in words)
    runs = 0
    first = {(r["k"], r["first_word"]): r["size"] for r in mix.placed.where("size > 0").collect()}
    times = {}
    for r in mix.plan.collect():
        times[r["k"], r["block"]] = times.get((r["k"], r["block"]), 0) + 1
    for (k, at), size in first.items():
        own = [times.get((k, b), 0) for b in range(at // 4, (at + size - 1) // 4 + 1)]
        for lap in range(1, max(own) + 1):
            runs += sum(n >= lap and (j == 0 or own[j - 1] < lap) for j, n in enumerate(own))
    assert out.count() == runs


def test_mix_of_nothing(spark, no_docs):
    assert mixing.Mix(no_docs).documents.count() == 0
    blank = spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 1)], SCHEMA)
    assert [r["taken"] for r in mixing.Mix(blank).documents.collect()] == [0, 0]
    assert mixing.Mix(blank).applied(blank).count() == 0


# sharding


def test_store_versions_compaction_and_conflicts(spark, docs, rows):
    store = shards.ShardStore(spark, fresh(spark, "store"), target=1 << 20, smallest=1 << 10, fan_in=2)
    assert store.versions() == [] and store.shards() == []
    assert store.append(docs) == 1
    assert store.append(docs.limit(0)) == 2
    assert store.append(docs.coalesce(1)) == 3
    before = len(store.shards())
    old = store.shards()
    store.compact(flush=True)
    assert len(store.shards()) < before
    both = store.read(shard="shard")
    assert both.count() == 2 * len(rows) and both.columns == [*docs.columns, "shard"]
    assert store.read().exceptAll(docs.unionAll(docs)).count() == 0
    assert store.read(1).count() == len(rows)  # older versions stay readable until they are vacuumed
    with pytest.raises(shards.Conflict):
        store.commit([], old[:1], docs.schema)
    assert store.vacuum(keep=1) > 0 and len(store.versions()) == 1
    assert store.read().count() == 2 * len(rows)


def test_store_keeps_columns_that_later_arrivals_lack(spark):
    store = shards.ShardStore(spark, fresh(spark, "store"), smallest=1 << 10, fan_in=2)
    make = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(1)
    store.append(make([(1, "a", 5)], "id long, text string, extra int"))
    store.append(make([(2, "b")], "id long, TEXT string"))
    store.compact(flush=True)
    store.vacuum()
    store.append(make([("x", 7, None)], "extra2 string, extra int, id long"))
    store.compact(flush=True)
    store.vacuum(keep=1)
    assert sorted(map(tuple, store.read().select("id", "text", "extra", "extra2").collect()), key=repr) == [(1, "a", 5, None), (2, "b", None, None), (None, None, 7, "x")]
    with pytest.raises(ValueError, match="extra is int in the table"):
        store.append(make([("x",)], "extra string"))


def test_store_serves_readers_of_the_version_before(spark, docs, rows):
    store = shards.ShardStore(spark, fresh(spark, "store"), smallest=1 << 10, fan_in=2)
    store.append(docs)
    store.append(docs)
    reader = store.read()
    store.compact(flush=True)
    store.vacuum()
    assert reader.count() == 2 * len(rows)
    orphan = store._path(f"{store.root}/data/left-by-a-failed-writer")
    store._fs.mkdirs(orphan)
    store.vacuum()
    assert store._fs.exists(orphan)
    store.vacuum(orphans_after=-60.0)
    assert not store._fs.exists(orphan) and store.read().count() == 2 * len(rows)


def test_store_with_columns_of_its_own_names(spark):
    clash = "_path _number _path_of path at shard _metadata file_path".split()
    df = spark.createDataFrame([tuple(range(len(clash)))], ", ".join(f"{c} int" for c in clash))
    store = shards.ShardStore(spark, fresh(spark, "store"))
    store.append(df)
    got = store.read(shard="shard")
    assert got.columns == [*clash, "shard_"] and tuple(got.first()) == (*range(len(clash)), 0)


def test_tiered_shards_query(spark):
    """Every row of the query from a plain read of the documents and of the shards' files."""
    import hashlib

    import duckdb

    from rankloom.llm import queries

    got = queries.op2_tiered_shards(spark, SF).collect()
    docs = duckdb.sql(f"select doc_id, source, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    want = sorted((i, s, len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, s, t in docs)
    assert sorted((r["doc_id"], r["source"], r["n_bytes"], r["text_sha256"]) for r in got) == want
    assert {r["shard"] for r in got} == set(range(len({r["shard"] for r in got}))) and len({r["version"] for r in got}) == 1


def test_a_version_is_committed_once(spark, docs):
    store = shards.ShardStore(spark, fresh(spark, "store"))
    store.append(docs)
    other = store._path(f"{store.root}/_manifests/x")
    store._fs.create(other).close()
    assert not store._rename(other, store._path(f"{store.root}/_manifests/v{1:012d}.json"))


def test_plans_merge_similar_sizes():
    s = lambda *sizes: [shards.Shard(f"p{k}", n, 1) for k, n in enumerate(sizes)]
    sizes = lambda groups: [[x.bytes for x in g] for g in groups]
    assert sizes(shards.plan(s(1, 1, 1), 100, 2, 4)) == []
    assert sizes(shards.plan(s(1, 1, 1, 1), 100, 2, 4)) == [[1, 1, 1, 1]]
    assert sizes(shards.plan(s(1, 1, 1, 40, 40, 90), 100, 2, 3)) == [[1, 1, 1]]
    assert sizes(shards.plan(s(30, 30, 30, 30), 100, 40, 4)) == [[30, 30, 30]]
    assert sizes(shards.plan(s(1, 30, 90), 100, 2, 4, flush=True)) == [[1, 30]]


def test_shards_of_documents(spark, docs, no_docs, rows):
    store = shards.shard_documents(docs, fresh(spark, "s"), batches=3)
    assert len(store.shards()) == 1 and store.read().exceptAll(docs).count() == 0 and store.read().count() == len(rows)
    assert shards.shard_documents(no_docs, fresh(spark, "s")).read(shard="shard").count() == 0


# pages


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="</p>";</script></head><body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<nav>a<ul><li>b</ul></nav><div class="wrap{n}"><div class="{cls}"><h2>T &amp; U &lt;b&gt;</h2><p>First <b>bold</b>ed&nbsp;text with some more words<p>Second<br>line <a href="x>y">link here</a> more words of it</p>
<ul><li>one<li>two</ul><div class="ad-box">Buy</div><!-- <p>gone</p> --><form><p>mail</p></form><section class="comments"><p>nice article this one is</p></section></div>
<div class="sidebar"><p>side bar text that is long</p></div></div><aside>q</aside><footer>f &copy; x</footer></body></html>"""
TEXT = "T & U <b>\nFirst bolded text with some more words\nSecond line link here more words of it\none\ntwo"


def page(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string, host string")


def test_main_text_of_a_host_with_many_templates(spark):
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    say = lambda w, n: " ".join([w] * n)
    html = lambda name, main, extra: f"<body><div class='{name}'><div class='story'><p>{main}</p></div><div class='more'><p>{extra}</p></div></div></body>"
    many = [(k * 10 + j, "https://host.example/x", html(name, say(name, 300), "one two three"), None) for k, name in enumerate(names) for j in range(3)]
    few = [(500 + j, "https://host.example/y", html("rare", say("right", 70), "one two three"), None) for j in range(2)]
    odd = (600, "https://host.example/z", html("rare", say("right", 50), say("wrong", 90)), None)
    got = {r["page_id"]: r["text"] for r in html_text.main_text(page(spark, *many, *few, odd)).collect()}
    assert got[600] == say("right", 50) and got[500] == say("right", 70) and got[0] == say("alpha", 300)


def test_main_text(spark):
    odd = '<body><div class="post">short</div><div class="hot"><p>' + "a teaser that is longer than the post itself " * 4 + "</p></div></body>"
    rows = [(k, f"https://a.example.com/{k}", PAGE.replace("{cls}", "post").replace("{n}", str(k)), "x") for k in range(4)]
    rows += [(9, None, None, None), (10, "https://a.example.com/odd", odd, None), (11, "ftp://b.example.com", "<article><p>x y z<p>w", None), (12, "c", "no tags, 1 < 2 & 3", None)]
    got = {r["page_id"]: r for r in html_text.main_text(page(spark, *rows)).collect()}
    assert [got[k]["text"] for k in range(4)] == [TEXT] * 4
    assert got[9]["text"] == "" and got[9]["n_chars"] == 0 and got[11]["text"] == "x y z\nw" and got[12]["text"] == "no tags, 1 < 2 & 3"
    assert html_text.main_text(page(spark).limit(0)).count() == 0


def test_hosts_agree_on_a_path(spark):
    """A page whose longest container is not the host's gives the host's."""
    body = '<body><div class="post"><p>{post}</p></div><div class="hot"><p>{hot}</p></div></body>'
    many = [(k, "http://h.example.com/", body.replace("{post}", "words of the post " * 9).replace("{hot}", "a teaser"), "x") for k in range(5)]
    one = (9, "http://h.example.com/9", body.replace("{post}", "a post").replace("{hot}", "a long teaser of words " * 6), "x")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(page(spark, *many, one)).collect()}
    assert got[9] == "a post"


def test_markup_that_is_broken():
    texts = lambda h: [t for _, t, _ in html_text.blocks(h)[0]]
    assert texts("<p><b>a<br><p>b</b></div> c") == ["a", "b c"]
    assert texts("<script>x") == [] and texts("a<!-- b") == ["a"] and texts("<nav>x<article>y") == ["y"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts('<p title="a>b">c</p><p title="d>e</p>') [:1] == ["c"]
    assert texts("&#x41;&eacute;&bogus; &lt;p&gt;") == ["Aé&bogus; <p>"]
    assert texts("<div>" * 3000 + "x") == ["x"]
    assert texts("<iframe><p>a<iframe><p>b") == ["a", "b"] and texts("<p>a</p <p>b") == ["a", "b"] and texts("a <b") == ["a <b"]
    assert texts('x <i a=">" <i a=">"') == ['x <i a=">" <i a=">"'] and texts("1 <! 2") == ["1 <! 2"] and texts("a<!x>b<?y>c") == ["abc"]


@pytest.mark.parametrize("unit", ["<div>", "<div class='x{k}'>", "<a ", "<ul>", "</ul>", "<p><ul>", "<i a='>' ", "</script ", "<iframe>", "<!-", "<!", "<", "&amp", "<form><p>", "<article><nav>", "<td>a"])
def test_a_megabyte_of_broken_markup(unit):
    """Time and memory in proportion to the page."""
    import time
    import tracemalloc

    page = "<div>" * 20_000 + "".join(unit.replace("{k}", str(k)) for k in range(900_000 // len(unit))) + "the end of it"
    began = time.process_time()
    text = html_text.text_of(*html_text.blocks(page), [])
    assert time.process_time() - began < 6 and ("the end of it" in text or unit in ("<form><p>", "<article><nav>", "<i a='>' ", "<!-", "<!", "<a ", "&amp", "<"))
    if unit in ("<div>", "<td>a"):
        tracemalloc.start()
        html_text.text_of(*html_text.blocks(page[:300_000]), [])
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
        tracemalloc.stop()


def test_hosts_with_more_paths_than_are_listed(spark):
    """Path by path or by a list: the same texts."""
    say = lambda w, n: " ".join([w] * n)
    html = lambda name, main, extra: f"<body><div class='{name}'><div class='story'><p>{main}</p></div><div class='more'><p>{extra}</p></div></div></body>"
    names = ["a" * (k + 1) for k in range(12)]
    rows = [(k * 10 + j, f"https://h{k % 2}.example/x", html(name, say(name, 30 + 40 * (j > 0)), say("more", 50)), None) for k, name in enumerate(names) for j in range(3)]
    rows += [rows[0], (999, "https://h0.example/", None, None), (998, "https://h0.example/", "<p>bare", None), (None, None, "<div>no host", None)]
    df = page(spark, *rows)
    run = lambda n: sorted((tuple(r) for r in html_text.main_text(df, listed=n).collect()), key=repr)
    assert run(0) == run(1) == run(1000) and len(run(0)) == len(rows)


# graph


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7), (500, 500)]
    of = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == of


# the pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    """Each stage's rows from its predecessor's, by brute force."""
    import corpus_pipeline as pipeline

    from .test_text_operators import SPACED, hits, linked

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if name == "quality classifier":
            assert ids(rows) == sorted(k for k, s in scores.items() if s >= 0.5) and 0 < len(rows) < len(before)
        elif name == "near-duplicates":
            assert ids(rows) == sorted(i for i, _, _, stays in linked([(r["doc_id"], r["text"]) for r in before]) if stays)
        elif name == "benchmark decontamination":
            assert ids(rows) == sorted(r[0] for r in hits([(r["doc_id"], r["text"]) for r in before], bench) if not r[5])
        elif name == "mixing to target weights":
            size, taken = {}, {}
            for into, part in ((size, before), (taken, rows)):
                for r in part:
                    into[r["source"]] = into.get(r["source"], 0) + len(SPACED.findall(r["text"] or ""))
            names = sorted(size, key=lambda s: (s is None, s or ""))
            want = water([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])
            assert all(abs(taken.get(s, 0) - n) <= 64 + 0.02 * n for s, n in zip(names, want, strict=True))
            text = {r["doc_id"]: " ".join(SPACED.findall(r["text"] or "")) for r in before}
            assert all(" ".join(SPACED.findall(r["text"])) in text[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in rows)
        else:
            assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(map(tuple, before)) and docs.columns == [*columns, "shard"]
            assert {r["shard"] for r in rows} == set(range(len({r["shard"] for r in rows})))
        if name in ("quality classifier", "near-duplicates", "benchmark decontamination"):
            whole = {tuple(r) for r in before}
            assert all(tuple(r) in whole for r in rows)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        before = rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pages_give_their_documents(spark):
    """Every page was made around a document: the extracted text below its heading is that document's."""
    from rankloom.llm import queries

    sf = SF.replace("0.001", "0.01")
    plain = lambda t: " ".join((t or "").split())
    docs = {plain(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_consensus_paths(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(plain(r["text"].partition("\n")[2]) in docs or plain(r["text"]) in docs for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))

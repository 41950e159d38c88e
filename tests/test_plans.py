"""Runs, reports, recipes, streaming, CLI, and every registered query against its SQL."""

import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.operators.verdict import Step, apply_steps
from corpusmill.plans import manifest, queries, recipes, report
from corpusmill.streaming import stream

from .test_filters import GOOD
from .test_sources import record, response

ROOT = Path(__file__).resolve().parent.parent


def test_manifest_resumes_and_records(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    run = manifest.Run(spark, str(tmp_path / "r"))
    assert run.stage("one", build).count() == 5 == manifest.Run(spark, str(tmp_path / "r")).stage("one", build).count() and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        run.stage("two", lambda: 1 / 0)
    run.stage("two", build)
    rows = manifest.status(spark, str(tmp_path / "r")).collect()
    assert {(r.stage, r.status, r.documents) for r in rows} == {("one", "done", 5), ("two", "done", 5)}
    assert "one" in manifest.render_status(rows)


def test_eta_and_durations():
    assert manifest.estimate_eta([10, 20], [(5, 0.5)], 3, 2) == 5 + 2 * (40 / 3) and manifest.estimate_eta([], [(3, 0.0)], 1, 1) is None
    assert [manifest.duration(s) for s in (5, 65, 7260)] == ["5s", "1m05s", "2h01m"]


def page(body):
    return f"<html><body><nav>menu</nav><article>{''.join(f'<p>{s}.</p>' for s in body.split('. '))}</article></body></html>"


def test_english_web(spark, tmp_path):
    other = GOOD.replace("river", "sea").replace("bridge", "harbour").replace("town", "port").replace("walls", "ships").replace("fields", "islands").replace("children", "sailors").replace("wheat", "oats").replace("winter", "autumn")
    texts = [GOOD.rstrip(".") + ". Write to a.b@mail.org today", GOOD.rstrip(".") + ". Write to a.b@mail.org today", other.rstrip("."), "too short", GOOD.rstrip(".")]
    parts = b"".join(response(f"http://site{k}.{'bad.com' if k == 4 else 'org'}/p", page(t), ident=str(k)) + record("metadata", b'languages-cld2: {"x": 1, "languages":[{"n": 0, "code":"en"}]}', WARC_Concurrent_To=f"<urn:{k}>") for k, t in enumerate(texts))
    (tmp_path / "a.warc.gz").write_bytes(parts)
    out = str(tmp_path / "out")
    docs = recipes.english_web(spark, [str(tmp_path / "a.warc.gz")], out, blocked_domains=("bad.com",), scores=lambda t: F.create_map(F.lit("en"), F.lit(0.99)))
    got = {r.url: r for r in docs.collect()}
    assert sorted(got) == ["http://site0.org/p", "http://site2.org/p"] and "a.b@mail.org" not in got["http://site0.org/p"].text and got["http://site2.org/p"].language == "en"
    verdicts = spark.read.parquet(f"{out}/filtered")
    assert {(r.url[7:12], r.drop_step, r.drop_reason) for r in verdicts.where("drop_step is not null").collect()} == {("site3", "gopher repetition", "top_2_gram"), ("site4", "url", "domain")} or verdicts.where("drop_step = 'url'").count() == 1
    rows = report.build_report(verdicts, recipes.ENGLISH_STEPS).collect()
    assert rows[0].asDict() == {"section": "funnel", "group": "url", "key": "total", "value": 5, "share": 1.0}
    text = report.render_report(rows)
    assert "dropped_domain" in text and "domain of kept" in text
    report.save_report(report.build_report(verdicts, recipes.ENGLISH_STEPS), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).count() == len(rows)
    from corpusmill import cli

    args = lambda **k: type("Args", (), k)()
    assert "filtered" in cli.status(spark, args(folder=out))
    shown = cli.inspect(spark, args(folder=f"{out}/output", reason=None, domain="site0.org", grep=None, sample=0, seed=0, limit=5, width=40))
    assert "site0.org" in shown and "site2.org" not in shown
    assert "funnel" not in cli.report(spark, args(folder=f"{out}/filtered", steps=None, top=5, out=None)) and "kept" in cli.publish(spark, args(folder=f"{out}/filtered", out=str(tmp_path / "pub"), title="P"))


def test_language_and_pool_recipes(spark, tmp_path):
    index = spark.createDataFrame([("c", "tel", "f", 0, 5), ("c", "eng", "f", 5, 5)], "crawl string, content_languages string, warc_filename string, warc_record_offset long, warc_record_length long")
    chosen, summary = recipes.language_selection(index, "tel", spark.createDataFrame([("c", 2)], "crawl string, count long"))
    assert chosen.count() == 1 and summary.first().difference == -0.5
    (tmp_path / "f").write_bytes(b"\x1f\x8b123")
    assert recipes.fetch_selection(spark, chosen, str(tmp_path), str(tmp_path / "o"), per_second=100, tasks=1).first().ok


def test_streaming_processes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string").coalesce(1).write.parquet(str(source))
    steps = [Step("rule", lambda _: F.when(F.col("text") == "bad", "is_bad"))]

    def drain():
        s = stream.documents(spark, str(source), "id long, text string")
        stream.drain(s, steps, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out" / "kept")).collect())

    assert drain() == [1] == drain()
    spark.createDataFrame([(3, "more")], "id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    assert drain() == [1, 3] and spark.read.parquet(str(tmp_path / "out" / "removed")).first().drop_reason == "is_bad"
    spark.createDataFrame([(4, "more")], "id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    s = stream.exact_dedup(stream.documents(spark, str(source), "id long, text string"))
    stream.start(s, str(tmp_path / "dedup"), str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "dedup")).count() == 3


def canonical(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(int(value)) if isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, sf, name):
    frame = queries.QUERIES[name](spark, sf)
    rows = frame.toPandas()
    if name not in queries.SQL:
        assert list(rows.columns)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(queries.SQL[name]).df()
    columns = sorted(rows.columns)
    assert columns == sorted(want.columns)
    shape = lambda d: sorted(tuple(map(canonical, r)) for r in d[columns].astype(object).itertuples(index=False))
    assert shape(rows) == shape(want)


def test_top_ngrams_stay_in_place_but_for_repeated_ids(spark, tmp_path):
    """No n-gram of a document with an id of its own is shuffled; rows of one id, null included, are one document."""
    texts = [(1, "a b a b c d"), (2, "x y"), (2, "q x y x y"), (None, "k l m k l"), (None, "k l"), (3, "one"), (4, None), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    frame = queries.QUERIES["gopher_repetition_top_ngram"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select doc_id, n, chars from ({queries.SQL['gopher_repetition_top_ngram']})").fetchall()
    assert sorted(tuple(map(canonical, r)) for r in frame.select("doc_id", "n", "chars").collect()) == sorted(tuple(map(canonical, r)) for r in want)
    alone = tmp_path / "alone"
    spark.createDataFrame([t for t in texts if t[0] in (1, 3, 4, 5)], "doc_id long, text string").write.parquet(str(alone / "documents.parquet"))
    frame = queries.QUERIES["gopher_repetition_top_ngram"](spark, str(alone))
    assert sorted((r.n, r.chars) for r in frame.collect()) == [(2, 6), (3, 5), (4, 7)]
    final = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" not in final and "ShuffleQueryStage" not in final


def test_repetition_query_equals_plain_python(spark, sf):
    import regex

    from corpusmill.operators import filters

    word = regex.compile(r"[\p{M}\w]+(?:['’][\p{M}\w]+)*|[^\p{M}\w\s]")

    def reason(t):
        w = word.findall(t)
        for n, most in filters.TOP_NGRAMS.items():
            if filters.top_ngram(w, n) / len(t) > most:
                return f"top_{n}_gram"
        for n, most in filters.DUPLICATED_NGRAMS.items():
            if filters.repeated_ngrams(w, n) / len(t) > most:
                return f"duplicated_{n}_n_grams"

    lines = {r.doc_id: r.reason for r in queries.QUERIES["gopher_repetition_lines"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["gopher_repetition_full"](spark, sf).collect():
        assert r.reason == (lines[r.doc_id] or reason(texts[r.doc_id]))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def test_entry_without_optional_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_plans_push_filters_and_prune_columns(spark, sf):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    p = plan(queries.QUERIES["lambda_filter"](spark, sf))
    assert "PushedFilters" in p and "GreaterThan(n_chars,500)" in p and "text" not in p.split("ReadSchema")[1]
    p = plan(queries.QUERIES["gopher_quality"](spark, sf))
    assert "Exchange" not in p and "Python" not in p
    verdicts = apply_steps(spark.read.parquet(f"{sf}/documents.parquet"), [Step("a", lambda _: F.when(F.length("text") < 9, "x"))])
    assert "Exchange" not in plan(verdicts)

"""The derived inputs hit every branch: no query's result is an identity or a zero."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def run(spark):
    from __spark_entry__ import queries
    return lambda key: queries()[key](spark, SF_SMALL)


def test_maintenance_finds_changes(run):
    diff, pay = run("reclean_diff_old").first(), run("resalary_diff_old").first()
    assert 0 < diff.experience_changed < diff.n_rows and 0 < diff.education_changed < diff.n_rows
    assert 0 < pay.cleared < pay.changed < pay.n_rows
    assert run("reclean_hist_old").where("n_before <> n_after").count() > 0


def test_audits_find_faults(run):
    assert all(r.dup_groups > 0 for r in run("hc_duplicates_dirty").collect())
    assert all(r.n > 0 for r in run("hc_nulls_dirty").collect())
    pay = run("hc_salary_dirty").first()
    assert pay.lt1 > 0 and pay.min_gt_max > 0


def test_cleaners_leave_the_identity(run):
    tags = run("normalize_tag_aliases")
    assert tags.where("tag <> normalized").count() > 20 and tags.where("tag = normalized").count() > 0
    ids = run("url_job_id_branches")
    assert ids.where(F.col("job_id").rlike("^[0-9]+$")).count() > 0
    assert ids.where("job_id = ''").count() > 0 and ids.where("job_id like 'https%'").count() > 0
    keys = run("make_job_key_branches")
    assert keys.where("derived_key like 'https%'").count() > 0
    assert keys.where(F.col("derived_key").rlike("^h[0-9a-f]{32}$")).count() > 0
    assert run("extract_skills_titles").where("skills <> ''").count() > 4000
    assert run("parse_salary_wide").where("salary_avg > 100000000").count() > 0


def test_cards_and_labels(run):
    cards = run("cards")
    assert cards.where("job_key = url").count() > 0 and cards.where("area is null").count() > 0
    assert cards.where("company is null or industry is null or city is null").count() == 0
    labels = run("classify_labels").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("edu", "salary")]).first()
    assert labels.edu > 0 and labels.salary > 0


def test_worklist_keeps_what_was_never_collected(run, spark):
    from hirelens.operators.extract import worklist
    rest = run("worklist_configured")
    assert rest.where("city = 'NATION_NEW'").count() == 4 and rest.where("keyword = 'NEVER'").count() == 26
    seen = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 1), (None, "x", 2)], "city string, keyword string, ok int")
    cities = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "city string")
    got = {tuple(r) for r in worklist(cities, ["x", "y", "x"], seen, F.col("ok") == 2).collect()}
    assert got == {("a", "y"), ("b", "x"), ("b", "y"), ("c", "x"), ("c", "y")}


def test_references_are_decoded_once(spark):
    from hirelens.operators.extract import html_unescape
    texts = {"a &amp; b": "a & b", "&amp;#34;&#38;quot;": "&#34;&quot;", "&#233;&#xE9;&#x1F600;": "éé😀", "x & y &": "x & y &",
             "&#xD800;&#0;": "��", "&bogus;&lt": "&bogus;&lt", "": "", None: None, "&apos;&nbsp;": "' "}
    df = spark.createDataFrame([(k,) for k in texts], "t string").select("t", html_unescape(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == texts


def test_cards_with_odd_markup(spark):
    from hirelens.operators.extract import cards_from_html
    html = ("""<div sensorsdata='{"jobTitle":"A","jobArea":""}'><a class='x comp' href='/c/1'>c</a>"""
            """<b class="cname" title="T &amp; S"> </b></div><div sensorsdata="{&#34;jobId&#34;:&#x22;2&#x22;}"></div>"""
            """<div sensorsdata="{&quot;jobId&quot;:"></div><div sensorsdata=""></div><div sensorsdata="[1]"></div>""")
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    rows = cards_from_html(pages, search_city=F.lit("C")).collect()
    assert [(r.job_key, r.title, r.city, r.company, r.industry, r.url) for r in rows] == [
        (None, "A", "C", "T & S", None, "/c/1"), ("2", None, "C", None, None, None)]


def test_permutation_does_not_depend_on_buckets(spark):
    from hirelens.operators.ml import permuted
    t = spark.range(3000).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("job_key"), F.col("id").alias("v"))
    one, many = ({r.job_key: r.v for r in permuted(t, "v", 7, b).collect()} for b in (2, 1 << 12))
    assert one == many and sorted(one.values()) == list(range(3000))
    assert sum(int(k) == v for k, v in one.items()) == 0


def test_split_is_exact_per_stratum(spark):
    from hirelens.operators.ml import stratified_split
    t = spark.range(1007).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("job_key"),
                                 F.when(F.col("id") < 900, "a").when(F.col("id") < 1006, "b").otherwise("c").alias("experience"))
    out = stratified_split(t, buckets=16)
    got = {(r.experience, r.is_test): r["count"] for r in out.groupBy("experience", "is_test").count().collect()}
    assert got == {("a", True): 180, ("a", False): 720, ("b", True): 21, ("b", False): 85, ("c", False): 1}
    assert out.columns == ["source", "job_key", "experience", "is_test"]

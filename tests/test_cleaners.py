"""C2-C13 cleaners and flags on inline rows (cases from FIXTURES / the reference)."""

import pytest
from pyspark.sql import functions as F

from hirelens.functions import flags, levels, tags
from hirelens.operators import extract


def one(spark, values, fn, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_experience(spark):
    cases = {"1-3年": "1-3年", "3年及以上": "3-5年", "5年以下": "3-5年", "1年以下": "1年以下",
             "10年以上": "10年以上", "在校": "应届/不限", "": None, None: None,
             "1年以内": "1-3年", "一年以内": "应届/不限", "经验不限": "应届/不限",
             "   ": "应届/不限", "3年以下": "1-3年", "20年以下": "10年以上", "0年": "1年以下"}
    got = one(spark, list(cases), levels.clean_experience)
    assert got == list(cases.values())


def test_education(spark):
    cases = {"统招本科": "本科", "EMBA": "硕士", "专科": "大专", "中专": "高中及以下",
             "学历不限": "不限", None: None, "": None, "博士后": "博士", " 研究生 ": "硕士"}
    assert one(spark, list(cases), levels.clean_education) == list(cases.values())


def test_levels_staged_equals_column(spark):
    vals = ["1-3年", "5年以下", "", None, "应届", "2年", "本科", "MBA", "x"]
    df = spark.createDataFrame([(v, v) for v in vals], "experience string, education string")
    a = df.select(levels.clean_experience(F.col("experience")).alias("e"),
                  levels.clean_education(F.col("education")).alias("d")).collect()
    b = levels.with_levels(df, exp_out="e", edu_out="d").select("e", "d").collect()
    assert a == b


def test_split_tags(spark):
    assert one(spark, ["a,b、c；d/e f", None, " x | y ;; ", "单个"], tags.split_tags) == \
        ["a,b,c,d,e,f", "", "x,y", "单个"]


def test_extract_skills(spark):
    vals = ["Python后端开发工程师", "高级Java(Spring) 工程师", "HTML", "middle", "golang dev",
            "C++/Linux", "js and ts"]
    got = one(spark, vals, tags.extract_skills)
    assert got[0] == "Python,后端"
    assert got[1] == "Java,Spring"
    assert "机器学习" not in got[2] and got[2] == "HTML/CSS"
    assert got[3] == ""
    assert got[4] == "Go"
    assert got[5] == "C++,Linux"
    assert got[6] == "JavaScript,TypeScript"


def test_normalize_and_count(spark):
    assert one(spark, [" Python ", "vue.js", "Unknown", "K8S"], tags.normalize_tag) == \
        ["Python", "Vue", "Unknown", "Kubernetes"]
    assert one(spark, [None, "", "a,,b", " a , b ,c"], tags.skill_count) == [0, 0, 2, 3]


def test_skill_set(spark):
    got = one(spark, ["python,Python开发,Java", "", "es,ES"], tags.skill_set)
    assert got == [["Python", "Java"], [], ["Elasticsearch"]]


def test_intern_flags(spark):
    df = spark.createDataFrame([("不招实习", None), ("前端实习生", None), ("工程师", "http://x/lptjob/1"),
                                ("", None), (None, None)], "t string, u string")
    c8 = [r[0] for r in df.select(flags.intern_flag(F.col("t"), F.col("u"))).collect()]
    assert c8 == [True, True, True, False, False]
    c9 = [r[0] for r in df.select(flags.intern_title_flag(F.col("t"))).collect()]
    assert c9 == [False, True, False, False, False]


def test_nontech(spark):
    assert one(spark, ["测试开发工程师", "财务分析", None, "数据分析师"], flags.nontech_flag) == \
        [False, True, False, False]


def test_whitelist(spark):
    df = spark.createDataFrame([(" 上海 ",), ("昆山",), (None,), ("",)], "c string")
    got = [r[0] for r in df.select(flags.in_whitelist(F.col("c"), ["上海"])).collect()]
    assert got == [True, False, False, False]


def test_url_job_id(spark):
    assert one(spark, ["https://x/job/123.shtml", "https://x/lptjob/45", "x?y=1", None, ""],
               flags.url_job_id) == ["123", "45", "x", "", ""]


def test_make_job_key(spark):
    import hashlib
    df = spark.createDataFrame(
        [("7", None, "t", "c", "s"), (None, "u", "t", "c", "s"), (None, None, "t", None, "s"),
         ("k" * 130, None, "t", "c", "s")],
        "job_key string, url string, title string, company string, city string")
    got = [r[0] for r in df.select(flags.make_job_key(*[F.col(c) for c in df.columns])).collect()]
    assert got[0] == "7" and got[1] == "u"
    assert got[2] == "h" + hashlib.md5("t|None|s".encode()).hexdigest()
    assert got[3] == "h" + hashlib.md5(("k" * 130).encode()).hexdigest()


def test_classify_labels(spark):
    df = spark.createDataFrame([(["统招本科", "·", "20-40k·15薪", "3-5年", "硕士"],),
                                (["本科", "硕士", "经验不限"],)], "s array<string>")
    got = [r[0].asDict() for r in df.select(extract.classify_labels(F.col("s"))).collect()]
    assert got[0] == {"edu": "统招本科", "salary": "20-40k·15薪", "exp": "3-5年"}
    # a second education-like span falls through to the other slots
    assert got[1] == {"edu": "本科", "salary": None, "exp": "经验不限"}


def test_cards_from_html(spark):
    good = ('{&quot;jobId&quot;:&quot;9&quot;,&quot;jobTitle&quot;:&quot;Python开发&quot;,'
            '&quot;jobSalary&quot;:&quot;15-25K&quot;,&quot;jobArea&quot;:&quot;成都·青羊区&quot;}')
    html = f'<div sensorsdata="{good}"></div><div sensorsdata="not json"></div>'
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    rows = extract.cards_from_html(pages).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.job_key, r.city, r.salary_text, r.tags_text) == ("9", "成都", "15-25K", "Python")

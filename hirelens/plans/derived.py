"""Registered queries over inputs derived by rule from the stored tables.

The fixture's postings are regular: they hold no alias spelling, no job URL, no doubled
key and no stale silver row. Each query here first derives, from every row, the texts or
the state that its operator exists for; the SQL derives the same independently.
The rule is the line number, the part of ``job_key`` after the dash (1 to 7).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.functions.flags import make_job_key, url_job_id
from hirelens.functions.salary import with_salary
from hirelens.functions.tags import normalize_tag, with_skills
from hirelens.operators import dictionary, extract, ingest, quality, stats
from hirelens.plans import catalog as C
from hirelens.plans import oracle as O
from hirelens.plans.catalog import bronze, register, silver
from hirelens.sources import tables

ORDER_SQL, LINE_SQL = "split_part(job_key, '-', 1)", "split_part(job_key, '-', 2)"


def _order() -> Column:
    return F.split_part("job_key", F.lit("-"), F.lit(1))


def _line(*numbers: int) -> Column:
    return F.split_part("job_key", F.lit("-"), F.lit(2)).isin([str(n) for n in numbers])


def _cents(x: float) -> Column:
    return F.lit(x).cast("decimal(20,2)")


# Rows, not only counts --------------------------------------------------
@register("dedupe_first", """
SELECT source, job_key, title, salary_text, city, area, experience, education, company, industry,
       tags, keyword, crawled_at FROM bronze""")
def q_dedupe_first(spark, sf_dir):
    raw = ingest.dedupe_first(tables.postings_raw(spark, sf_dir))
    return ingest.bronze_from_raw(raw).drop("company_size", "detail_url")


@register("silver", """
SELECT source, job_key, title, keyword, salary_text, city, company, industry, salary_min, salary_max,
       salary_avg, experience, education, tags, crawled_at FROM silver""")
def q_silver(spark, sf_dir):
    return silver(spark, sf_dir).drop("company_size").withColumns(
        {c: F.col(c).cast("double") for c in ("salary_min", "salary_max", "salary_avg")})


@register("insert_rows", f"""
SELECT 'raw_job' AS tbl, source, job_key, title, city, education, experience, tags,
       CAST(NULL AS DOUBLE) AS salary_avg FROM bronze x
WHERE NOT EXISTS (SELECT 1 FROM bronze b WHERE b.crawled_at < {C._CUT}
                  AND b.source = x.source AND b.job_key = x.job_key)
UNION ALL
SELECT 'job', source, job_key, title, city, education, experience, tags, salary_avg FROM silver x
WHERE {LINE_SQL} = '3' OR NOT EXISTS (SELECT 1 FROM silver b WHERE b.crawled_at < {C._CUT}
                  AND b.source = x.source AND b.job_key = x.job_key)""")
def q_insert_rows(spark, sf_dir):
    """The earlier silver also lacks line 3: such rows are in bronze and new to silver."""
    b, s = ingest.ingest_batch(tables.postings_raw(spark, sf_dir), tables.bronze_snapshot(spark, sf_dir),
                               tables.silver_snapshot(spark, sf_dir).where(~_line(3)),
                               stored=lambda batch: tables.stored_batch(spark, sf_dir, batch))
    cols = ["source", "job_key", "title", "city", "education", "experience", "tags"]
    return (b.select(F.lit("raw_job").alias("tbl"), *cols, F.lit(None).cast("double").alias("salary_avg"))
            .unionByName(s.select(F.lit("job").alias("tbl"), *cols, F.col("salary_avg").cast("double"))))


# S5, S6, S10 -------------------------------------------------------------------------
def _escaped(text: Column, marks: dict[str, str]) -> Column:
    for char, ref in marks.items():          # & comes first
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def card_pages(spark, sf_dir: str) -> DataFrame:
    """One result page per order, one card per bronze row (at most seven a page).

    Line 2 quotes its attributes singly, 3 and 4 use numeric references, 5 holds broken
    JSON, 6 has no id and 7 no area.
    """
    json = F.to_json(F.struct(
        F.when(~_line(6), F.col("job_key")).alias("jobId"),
        F.concat("title", F.lit(' & "'), "keyword", F.lit("\" <é '1'>")).alias("jobTitle"),
        F.col("salary_text").alias("jobSalary"),
        F.when(~_line(7), F.concat("city", F.lit("·"), "area")).alias("jobArea"),
        F.col("experience").alias("jobYear"), F.col("education").alias("jobDegree")))
    json = F.when(_line(5), F.substr(json, F.lit(1), F.length(json) - 9)).otherwise(json)
    named = _escaped(json, {"&": "&amp;", '"': "&quot;", "<": "&lt;", ">": "&gt;", "'": "&apos;"})
    single = _escaped(json, {"&": "&amp;", "'": "&#39;"})
    decimal = _escaped(json, {"&": "&#38;", '"': "&#34;", "é": "&#233;"})
    hexa = _escaped(json, {"&": "&#X26;", '"': "&#x22;", "é": "&#xe9;"})
    attr = (F.when(_line(2), F.concat(F.lit("'"), single, F.lit("'")))
            .otherwise(F.concat(F.lit('"'), F.when(_line(3), decimal).when(_line(4), hexa).otherwise(named),
                                F.lit('"'))))
    company = F.concat("company", F.lit(" &amp; Co"))
    body = F.when(_line(2), F.concat(
        F.lit("<span class='cname' title='"), company, F.lit("'></span><div class='bc'><i>1</i><span class='dc'> "),
        "industry", F.lit(" </span></div>"))).otherwise(F.concat(
            F.lit('<span class="text cname">'), company, F.lit('</span><div class="bc"><span class="dc" title="'),
            "industry", F.lit('">cut</span><span class="dc">size</span></div>')))
    card = F.concat(F.lit("<div class=\"item\" sensorsdata="), attr, F.lit("><a class=\"comp\" href=\"//x/co/"),
                    "job_key", F.lit('?a=1&amp;b=2">co</a>'), body, F.lit("</div>\n"))
    # the postings of a page are brought together before they become cards, which are several times as long,
    # in twice as many parts as the stored tables have: a part's cards are put in order without spilling
    needed = ["job_key", "title", "keyword", "salary_text", "city", "area", "experience", "education", "company", "industry"]
    rows = bronze(spark, sf_dir).select(*needed).repartition(2 * tables.bucket_count(spark, sf_dir), _order())
    return rows.groupBy(_order().alias("page_id")).agg(
        F.max("city").alias("city"), F.array_join(F.sort_array(F.collect_list(card)), "").alias("html"))


@register("cards", f"""
, c AS (SELECT *, concat('//x/co/', job_key, '?a=1&b=2') AS link FROM bronze)
SELECT 'site_a' AS source, CASE WHEN {LINE_SQL} = '6' THEN link ELSE job_key END AS job_key,
       concat(title, ' & "', keyword, '" <é ''1''>') AS title, salary_text, city,
       CASE WHEN {LINE_SQL} <> '7' THEN concat(city, '·', area) END AS area,
       education AS education_text, experience AS experience_text, concat(company, ' & Co') AS company,
       industry, link AS url
FROM c WHERE {LINE_SQL} <> '5'""")
def q_cards(spark, sf_dir):
    cards = extract.cards_from_html(card_pages(spark, sf_dir), search_city=F.col("city"))
    return ingest.keyed(cards).select(
        "source", "job_key", "title", "salary_text", "city", "area", "education_text", "experience_text",
        "company", "industry", "url")


def _like_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_SPAN = O.ustrip("s[i]")
_LIVE = f"{_SPAN} <> '' AND {_SPAN} NOT IN {O.in_list(list(dims.LABEL_SKIP))}"


def _first_sql(test: str) -> str:
    return f"list_filter(range(1, len(s) + 1), lambda i: {_LIVE} AND {test})[1]"


@register("classify_labels", f"""
, a AS (SELECT source, job_key, CASE {LINE_SQL}
          WHEN '1' THEN [education, salary_text, experience] WHEN '2' THEN [salary_text, ' ', education, '硕士', experience]
          WHEN '3' THEN ['·', experience, education, salary_text] WHEN '4' THEN [experience, '1-3年', salary_text, '20-30k']
          WHEN '5' THEN [concat(' ', education, ' '), NULL, experience] ELSE [title, salary_text, experience, education] END AS s
        FROM bronze),
  e AS (SELECT *, coalesce({_first_sql(_like_sql(_SPAN, dims.LABEL_EDU_KWS))}, 0) AS e FROM a),
  m AS (SELECT *, coalesce({_first_sql(f"i <> e AND regexp_matches({_SPAN}, '{dims.LABEL_SALARY_PATTERN}')")}, 0) AS m FROM e),
  x AS (SELECT *, coalesce({_first_sql(f"i <> e AND i <> m AND {_like_sql(_SPAN, dims.LABEL_EXP_KWS)}")}, 0) AS x FROM m)
SELECT source, job_key, {O.ustrip("s[nullif(e, 0)]")} AS edu, {O.ustrip("s[nullif(m, 0)]")} AS salary,
       {O.ustrip("s[nullif(x, 0)]")} AS exp FROM x""")
def q_classify_labels(spark, sf_dir):
    edu, sal, exp = F.col("education"), F.col("salary_text"), F.col("experience")
    spans = (F.when(_line(1), F.array(edu, sal, exp))
             .when(_line(2), F.array(sal, F.lit(" "), edu, F.lit("硕士"), exp))
             .when(_line(3), F.array(F.lit("·"), exp, edu, sal))
             .when(_line(4), F.array(exp, F.lit("1-3年"), sal, F.lit("20-30k")))
             .when(_line(5), F.array(F.concat(F.lit(" "), edu, F.lit(" ")), F.lit(None).cast("string"), exp))
             .otherwise(F.array(F.col("title"), sal, exp, edu)))
    b = bronze(spark, sf_dir).select("source", "job_key", spans.alias("s"))
    return b.select("source", "job_key", extract.classify_labels(F.col("s")).alias("c")).select(
        "source", "job_key", "c.*")


#: Configured search words; the last one was never collected, neither was the last city.
WORDS = [*C.FX_KEYWORDS, "NEVER"]
NEW_CITY = "NATION_NEW"
_DONE = "industry = 'BUILDING' AND crawled_at < TIMESTAMP '1995-03-01 00:00:00'"


@register("worklist_configured", f"""
, c AS (SELECT n_name AS city FROM nation UNION SELECT '{NEW_CITY}'),
  k AS (SELECT unnest([{', '.join(f"'{w}'" for w in WORDS)}]) AS keyword)
SELECT city, keyword FROM c CROSS JOIN k WHERE NOT EXISTS (
  SELECT 1 FROM bronze b WHERE {_DONE} AND b.city = c.city AND b.keyword = k.keyword)""")
def q_worklist_configured(spark, sf_dir):
    names = tables.table(spark, sf_dir, "nation").select(F.col("n_name").alias("city"))
    cities = names.unionByName(spark.createDataFrame([(NEW_CITY,)], "city string"))
    done = (F.col("industry") == "BUILDING") & (F.col("crawled_at") < F.lit("1995-03-01").cast("timestamp_ntz"))
    return extract.worklist(cities, WORDS, bronze(spark, sf_dir), done)


# Every branch ---------------------------------------------------
@register("url_job_id_branches", f"""
, u AS (SELECT source, job_key, CASE {LINE_SQL} WHEN '1' THEN concat('https://x/job/', {ORDER_SQL}, '?k=1')
          WHEN '2' THEN concat('/lptjob/', {ORDER_SQL}, '.shtml') WHEN '3' THEN concat('https://x/a/', {ORDER_SQL}, '?q=2')
          WHEN '4' THEN '' WHEN '5' THEN NULL WHEN '6' THEN 'https://x/job/abc?z' ELSE '/job/12/job/34' END AS url
        FROM bronze)
SELECT source, job_key, url, {O.url_job_id_sql('url')} AS job_id FROM u""")
def q_url_job_id_branches(spark, sf_dir):
    url = (F.when(_line(1), F.concat(F.lit("https://x/job/"), _order(), F.lit("?k=1")))
           .when(_line(2), F.concat(F.lit("/lptjob/"), _order(), F.lit(".shtml")))
           .when(_line(3), F.concat(F.lit("https://x/a/"), _order(), F.lit("?q=2")))
           .when(_line(4), F.lit("")).when(_line(6), F.lit("https://x/job/abc?z"))
           .when(_line(7), F.lit("/job/12/job/34")))
    u = bronze(spark, sf_dir).select("source", "job_key", url.alias("url"))
    return u.withColumn("job_id", url_job_id(F.col("url")))


@register("make_job_key_branches", f"""
, k AS (SELECT source, job_key, CASE WHEN {LINE_SQL} IN ('1', '2') THEN job_key WHEN {LINE_SQL} = '3' THEN ''
                 WHEN {LINE_SQL} = '5' THEN repeat(job_key, 45) END AS official,
               CASE {LINE_SQL} WHEN '3' THEN concat('https://x/job/', job_key)
                 WHEN '4' THEN concat(repeat('u', 130), job_key) WHEN '7' THEN '' END AS url,
               title, CASE WHEN {LINE_SQL} <> '6' THEN company END AS company, city FROM bronze),
  d AS (SELECT *, coalesce(nullif(official, ''), nullif(url, ''), concat('h', md5(concat_ws('|',
          coalesce(title, 'None'), coalesce(company, 'None'), coalesce(city, 'None'))))) AS key0 FROM k)
SELECT source, job_key, CASE WHEN length(key0) > 128 THEN concat('h', md5(key0)) ELSE key0 END AS derived_key FROM d""")
def q_make_job_key_branches(spark, sf_dir):
    key = F.col("job_key")
    official = F.when(_line(1, 2), key).when(_line(3), F.lit("")).when(_line(5), F.repeat(key, 45))
    url = (F.when(_line(3), F.concat(F.lit("https://x/job/"), key))
           .when(_line(4), F.concat(F.repeat(F.lit("u"), 130), key)).when(_line(7), F.lit("")))
    company = F.when(~_line(6), F.col("company"))
    return bronze(spark, sf_dir).select("source", "job_key", make_job_key(
        official, url, F.col("title"), company, F.col("city")).alias("derived_key"))


@register("parse_salary_wide", f"""
, texts AS (SELECT DISTINCT CASE {LINE_SQL} WHEN '1' THEN concat({ORDER_SQL}, '00000K')
              WHEN '2' THEN concat({ORDER_SQL}, '000000元/天') WHEN '3' THEN concat({ORDER_SQL}, '.23495K')
              WHEN '4' THEN concat({ORDER_SQL}, '00000000元/年') ELSE salary_text END AS salary_text FROM bronze)
, """ + O.salary_ctes("texts", "pt").strip() + """
SELECT salary_text, salary_min_c / 100.0 AS salary_min, salary_max_c / 100.0 AS salary_max,
       salary_avg_c / 100.0 AS salary_avg FROM pt""")
def q_parse_salary_wide(spark, sf_dir):
    text = (F.when(_line(1), F.concat(_order(), F.lit("00000K")))
            .when(_line(2), F.concat(_order(), F.lit("000000元/天")))
            .when(_line(3), F.concat(_order(), F.lit(".23495K")))
            .when(_line(4), F.concat(_order(), F.lit("00000000元/年"))).otherwise(F.col("salary_text")))
    t = bronze(spark, sf_dir).select(text.alias("salary_text")).distinct()
    return with_salary(t).select("salary_text", *[F.col(c).cast("double").alias(c)
                                                  for c in ("salary_min", "salary_max", "salary_avg")])


def _literals(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_ALIASES = list(dims.TAG_ALIASES)
_NTH = f"CAST(p_partkey % {len(_ALIASES) + 3} AS INTEGER)"


@register("normalize_tag_aliases", f"""
, t AS (SELECT DISTINCT CASE WHEN {_NTH} >= {len(_ALIASES)} THEN p_name
          WHEN p_partkey % 2 = 0 THEN upper({_literals(_ALIASES)}[{_NTH} + 1])
          ELSE concat(' ', {_literals(_ALIASES)}[{_NTH} + 1], '　') END AS tag FROM part),
  s AS (SELECT tag, {O.ustrip('tag')} AS bare FROM t)
SELECT tag, {C._TAG_NORM_SQL.replace('lower(tag)', 'lower(bare)').replace('ELSE tag', 'ELSE bare')} AS normalized FROM s""")
def q_normalize_tag_aliases(spark, sf_dir):
    nth = (F.col("p_partkey") % (len(_ALIASES) + 3)).cast("int")
    alias = F.get(F.array(*[F.lit(a) for a in _ALIASES]), nth)
    tag = (F.when(alias.isNull(), F.col("p_name")).when(F.col("p_partkey") % 2 == 0, F.upper(alias))
           .otherwise(F.concat(F.lit(" "), alias, F.lit("　"))))
    t = tables.table(spark, sf_dir, "part").select(tag.alias("tag")).distinct()
    return t.select("tag", normalize_tag(F.col("tag")).alias("normalized"))


_WORDS = [a for _, aliases in dims.SKILL_DICT for a in aliases]
_TITLE_SQL = f"concat(title, ' ', upper({_literals(_WORDS)}[CAST({ORDER_SQL} AS BIGINT) % {len(_WORDS)} + 1]))"


@register("extract_skills_titles", f"""
, t AS (SELECT source, job_key, {_TITLE_SQL} AS t FROM bronze)
SELECT source, job_key, {O.skills_sql("lower(t)", dims.SKILL_DICT)} AS skills FROM t""")
def q_extract_skills_titles(spark, sf_dir):
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), (_order().cast("long") % len(_WORDS)).cast("int"))
    t = bronze(spark, sf_dir).select("source", "job_key", F.concat("title", F.lit(" "), F.upper(word)).alias("title"))
    return with_skills(t, ["title"], "skills").select("source", "job_key", "skills")


# Silver as an older cleaner left it --------------------------------------------
_OLD = f"""
, old AS (SELECT * REPLACE (CASE WHEN {LINE_SQL} = '3' THEN '经验不限' ELSE experience END AS experience,
                            CASE WHEN {LINE_SQL} = '4' THEN NULL ELSE education END AS education) FROM silver)"""
_OLD_RECLEAN = _OLD + C._RECLEAN.replace("FROM silver s", "FROM old s")


def _old_silver(spark, sf_dir):
    return silver(spark, sf_dir).withColumns({
        "experience": F.when(_line(3), F.lit("经验不限")).otherwise(F.col("experience")),
        "education": F.when(~_line(4), F.col("education"))})


@register("reclean_diff_old", _OLD_RECLEAN + """
SELECT count(*) AS n_rows,
       count_if(experience IS DISTINCT FROM new_experience) AS experience_changed,
       count_if(education IS DISTINCT FROM new_education) AS education_changed,
       count_if(coalesce(tags, '') <> new_tags) AS tags_changed
FROM r""")
def q_reclean_diff_old(spark, sf_dir):
    return ingest.reclean_diff(_old_silver(spark, sf_dir), bronze(spark, sf_dir))


@register("reclean_hist_old", _OLD_RECLEAN + """,
  bf AS (SELECT experience AS tier, count(*) AS n_before FROM r GROUP BY 1),
  af AS (SELECT new_experience AS tier, count(*) AS n_after FROM r GROUP BY 1)
SELECT coalesce(bf.tier, af.tier) AS tier, coalesce(bf.n_before, 0) AS n_before,
       coalesce(af.n_after, 0) AS n_after
FROM bf FULL JOIN af ON bf.tier IS NOT DISTINCT FROM af.tier""")
def q_reclean_hist_old(spark, sf_dir):
    return ingest.reclean_hist(_old_silver(spark, sf_dir), bronze(spark, sf_dir))


@register("resalary_diff_old", f"""
, sv AS (SELECT CASE WHEN {LINE_SQL} = '2' THEN '面议' ELSE salary_text END AS salary_text,
                salary_min_c AS old_min, salary_max_c AS old_max,
                salary_avg_c + CASE WHEN {LINE_SQL} = '1' THEN 100 ELSE 0 END AS old_avg FROM silver)
, """ + O.salary_ctes("sv", "rs").strip() + """
SELECT count(*) AS n_rows,
       count_if(old_min IS DISTINCT FROM salary_min_c OR old_max IS DISTINCT FROM salary_max_c
                OR old_avg IS DISTINCT FROM salary_avg_c) AS changed,
       count_if(salary_avg_c IS NULL AND old_avg IS NOT NULL) AS cleared
FROM rs""")
def q_resalary_diff_old(spark, sf_dir):
    avg = F.col("salary_avg")
    return ingest.resalary_diff(silver(spark, sf_dir).withColumns({
        "salary_text": F.when(_line(2), F.lit("面议")).otherwise(F.col("salary_text")),
        "salary_avg": F.when(_line(1), (avg + _cents(1)).cast("decimal(20,2)")).otherwise(avg)}))


# Q2, Q5, Q6: tables with the faults they look for ------------------------------------
@register("hc_duplicates_dirty", f"""
, labelled AS (SELECT 'job' AS tbl, source, job_key FROM silver
               UNION ALL SELECT 'job', source, job_key FROM silver WHERE {LINE_SQL} = '2'
               UNION ALL SELECT 'raw_job', source, job_key FROM bronze
               UNION ALL SELECT 'raw_job', source, job_key FROM bronze WHERE {LINE_SQL} IN ('1', '3'))
, per_key AS (SELECT tbl, source, job_key, count(*) AS c FROM labelled GROUP BY tbl, source, job_key)
SELECT tbl, count_if(c > 1) AS dup_groups FROM per_key GROUP BY tbl""")
def q_hc_duplicates_dirty(spark, sf_dir):
    s, b = silver(spark, sf_dir), bronze(spark, sf_dir)
    return quality.hc_duplicates(s.unionByName(s.where(_line(2))), b.unionByName(b.where(_line(1, 3))))


_DIRTY = f"""
, dirty AS (SELECT * REPLACE (
    CASE WHEN {LINE_SQL} <> '1' THEN city END AS city, CASE WHEN {LINE_SQL} = '2' THEN '' ELSE title END AS title,
    CASE WHEN {LINE_SQL} <> '3' THEN keyword END AS keyword,
    CASE WHEN {LINE_SQL} = '4' THEN '' ELSE experience END AS experience,
    CASE WHEN {LINE_SQL} <> '5' THEN education END AS education,
    CASE WHEN {LINE_SQL} = '3' THEN salary_max + 1 ELSE salary_min END AS salary_min,
    CASE {LINE_SQL} WHEN '6' THEN 0 WHEN '2' THEN 0.5 ELSE salary_avg END AS salary_avg,
    CASE {LINE_SQL} WHEN '6' THEN 0 WHEN '2' THEN 50 ELSE salary_avg_c END AS salary_avg_c) FROM silver)"""


def _dirty_silver(spark, sf_dir):
    c = F.col
    return silver(spark, sf_dir).withColumns({
        "city": F.when(~_line(1), c("city")), "title": F.when(_line(2), F.lit("")).otherwise(c("title")),
        "keyword": F.when(~_line(3), c("keyword")),
        "experience": F.when(_line(4), F.lit("")).otherwise(c("experience")),
        "education": F.when(~_line(5), c("education")),
        "salary_min": F.when(_line(3), (c("salary_max") + _cents(1)).cast("decimal(20,2)")).otherwise(c("salary_min")),
        "salary_avg": F.when(_line(6), _cents(0)).when(_line(2), _cents(0.5)).otherwise(c("salary_avg"))})


@register("hc_nulls_dirty", _DIRTY + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS check_name, count_if({c}) AS n FROM dirty" for n, c in C._NULL_CHECKS))
def q_hc_nulls_dirty(spark, sf_dir):
    return quality.hc_nulls(_dirty_silver(spark, sf_dir))


@register("hc_salary_dirty", _DIRTY + f"""
SELECT count_if(salary_avg > {C.FX_OUTLIER}) AS gt_threshold,
       count_if(salary_avg < 1 AND salary_avg > 0) AS lt1,
       count_if(salary_min > salary_max) AS min_gt_max,
       min(salary_avg) AS min_avg, max(salary_avg) AS max_avg,
       {O.mean6('salary_avg_c')} AS mean_avg
FROM dirty WHERE salary_avg IS NOT NULL""")
def q_hc_salary_dirty(spark, sf_dir):
    return quality.hc_salary(_dirty_silver(spark, sf_dir), C.FX_OUTLIER)


# Labels beyond the cleaner's six, one of them in one source only -----------------
_MORE_LABELS = f"""
, labelled AS (SELECT source, CASE WHEN {LINE_SQL} = '2' AND source = 'site_a' THEN 'MBA'
                                   WHEN {LINE_SQL} = '3' THEN 'EMBA'
                                   WHEN education IN ('博士', '不限') THEN NULL ELSE education END AS education FROM silver),
  counts AS (SELECT source, education, count(*) AS n FROM labelled
             WHERE source IS NOT NULL AND education IS NOT NULL GROUP BY source, education),
  labels AS (SELECT education, row_number() OVER (PARTITION BY known IS NULL ORDER BY education) - 1 AS r, known
             FROM (SELECT DISTINCT education, list_position({dims.EDU_ORDER}, education) - 1 AS known FROM counts))
SELECT s.source, l.education, coalesce(l.known, {len(dims.EDU_ORDER)} + l.r) AS ord, coalesce(c.n, 0) AS n,
       round(coalesce(c.n, 0) * 100.0 / s.total, 6) AS pct
FROM (SELECT source, sum(n) AS total FROM counts GROUP BY source) s CROSS JOIN labels l
LEFT JOIN counts c ON c.source = s.source AND c.education = l.education"""


@register("education_grid", _MORE_LABELS)
def q_education_grid(spark, sf_dir):
    edu = F.col("education")
    label = (F.when(_line(2) & (F.col("source") == "site_a"), "MBA").when(_line(3), "EMBA")
             .when(~edu.isin("博士", "不限"), edu))
    return stats.education_grid(silver(spark, sf_dir).withColumn("education", label))


# I6, I7 applied: the rows of the rewritten tables ---------------------------------------
@register("reclean_rows", _OLD_RECLEAN.replace("SELECT s.experience", "SELECT s.source, s.job_key, s.experience") + """
SELECT source, job_key, new_experience AS experience, new_education AS education, new_tags AS tags, new_tags AS raw_tags
FROM r""")
def q_reclean_rows(spark, sf_dir):
    s, b = ingest.reclean_apply(_old_silver(spark, sf_dir), bronze(spark, sf_dir))
    raw = b.select("source", "job_key", F.col("tags").alias("raw_tags"))
    return s.select("source", "job_key", "experience", "education", "tags").join(raw, ["source", "job_key"])


@register("reclean_changes", _OLD_RECLEAN.replace("SELECT s.experience", "SELECT s.source, s.job_key, s.experience") + " UNION ALL ".join(f"""
SELECT source, job_key, '{f}' AS field, {f} AS old, new_{f} AS new FROM r WHERE {f} IS DISTINCT FROM new_{f}"""
    for f in ("experience", "education", "tags")))
def q_reclean_changes(spark, sf_dir):
    return ingest.reclean_changes(_old_silver(spark, sf_dir), bronze(spark, sf_dir))


# C5, C6 with a dictionary from the data: every benchmark item's first word and first two words
_TERMS = """
, heads AS (SELECT regexp_extract(lower(text), '^[^ ]+') AS w1, regexp_extract(lower(text), '^[^ ]+ [^ ]+') AS w2 FROM benchmark),
  terms AS (SELECT DISTINCT t FROM (SELECT w1 AS t FROM heads UNION ALL SELECT w2 FROM heads) WHERE t <> ''),
  low AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text <> ''),
  runs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[a-z]+')) AS w FROM low)
SELECT doc_id, t AS term FROM runs JOIN terms ON w = t WHERE regexp_full_match(t, '[a-z]+')
UNION ALL
SELECT DISTINCT doc_id, terms.t FROM low JOIN terms ON contains(low.t, terms.t)
WHERE NOT regexp_full_match(terms.t, '[a-z]+')"""


@register("dictionary_terms", _TERMS)
def q_dictionary_terms(spark, sf_dir):
    low = F.lower("text")
    heads = tables.table(spark, sf_dir, "benchmark").select(F.explode(F.array(
        F.regexp_extract(low, "^[^ ]+", 0), F.regexp_extract(low, "^[^ ]+ [^ ]+", 0))).alias("alias"))
    found = dictionary.hits(tables.table(spark, sf_dir, "documents"), heads.withColumn("canonical", F.col("alias")),
                            "doc_id", "text")
    return found.withColumnRenamed("canonical", "term")

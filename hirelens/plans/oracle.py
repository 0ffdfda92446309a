"""Independent DuckDB SQL for the correctness gate.

Every statement recomputes bronze and silver from the driver tables with its
own SQL (integer-cent arithmetic for salaries). It shares the fixed vocabularies, the blank
characters and the regex escaping with the Spark plans, and no other code. Conventions: averages/shares exact half-up to 6 dp,
medians over doubles rounded to 6 dp, top-k ordered by value desc then name.
"""

from __future__ import annotations

# Unicode blank class equivalent to Java's (?U)\s
WS = r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NUM_RE = r"([0-9]+\.?[0-9]*)[\t\n\x{0b}\f\r ]*([Kk千万wW]?)"
MONTHS_RE = r"[·xX*,，/、]([0-9]{1,2})薪"
MONTHS_STRIP = r"[·xX*,，/、][0-9]{1,2}薪"


def ustrip(x: str) -> str:
    from hirelens.functions.text import WS_CHARS
    return f"trim({x}, '{WS_CHARS}')"


def mean6(cents: str) -> str:
    """Exact half-up mean of an integer-cents column, 6 dp, as double."""
    return (f"((2 * CAST(sum({cents}) AS HUGEINT) * 10000 + count({cents})) "
            f"// nullif(2 * count({cents}), 0)) / 1000000.0")


def pct6(n: str, total: str) -> str:
    """Exact half-up n*100/total, 6 dp, as double."""
    return f"((2 * CAST({n} AS HUGEINT) * 100000000 + ({total})) // (2 * ({total}))) / 1000000.0"


def med6(x: str = "salary_avg") -> str:
    return f"round(median({x}), 6)"


RAW = """
postings_raw AS (
  SELECT
    CASE WHEN l.l_suppkey % 5 = 0 THEN 'site_a' ELSE 'site_b' END AS source,
    concat(CAST(l.l_orderkey AS VARCHAR), '-', CAST(l.l_linenumber AS VARCHAR)) AS job_key,
    p.p_name AS title, p.p_type AS keyword, n.n_name AS city,
    concat(n.n_name, '-', r.r_name) AS area,
    CASE l.l_linenumber
      WHEN 1 THEN concat(CAST(p.p_size AS VARCHAR), '-', CAST(p.p_size + 10 AS VARCHAR), 'K')
      WHEN 2 THEN concat(CAST(p.p_size AS VARCHAR), '-', CAST(p.p_size + 10 AS VARCHAR), 'K·13薪')
      WHEN 3 THEN concat(CAST(p.p_size % 9 + 1 AS VARCHAR), '千-1.2万')
      WHEN 4 THEN concat(CAST(p.p_size AS VARCHAR), '-', CAST(p.p_size + 20 AS VARCHAR), '万/年')
      WHEN 5 THEN concat(CAST(p.p_size * 20 AS VARCHAR), '元/天')
      WHEN 6 THEN concat(CAST(p.p_size AS VARCHAR), 'K以上')
      ELSE '面议' END AS salary_text,
    CASE l.l_orderkey % 8
      WHEN 0 THEN '应届' WHEN 1 THEN '1年以下' WHEN 2 THEN '1-3年' WHEN 3 THEN '3年及以上'
      WHEN 4 THEN '5年以下' WHEN 5 THEN '5-10年' WHEN 6 THEN '10年以上' ELSE '经验不限' END AS experience_text,
    CASE l.l_partkey % 7
      WHEN 0 THEN '统招本科' WHEN 1 THEN '大专' WHEN 2 THEN '硕士' WHEN 3 THEN '博士'
      WHEN 4 THEN 'MBA' WHEN 5 THEN '中专' ELSE '学历不限' END AS education_text,
    concat(replace(p.p_name, ' ', '/'), ',', p.p_brand) AS tags_text,
    c.c_name AS company, c.c_mktsegment AS industry, o.o_orderdate AS crawled_at,
    l.l_partkey AS ord1, l.l_suppkey AS ord2
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
bronze AS (
  SELECT source, job_key, title, salary_text, city, area,
         experience_text AS experience, education_text AS education, company,
         CAST(NULL AS VARCHAR) AS company_size, industry, tags_text AS tags, keyword,
         CAST(NULL AS VARCHAR) AS detail_url, crawled_at
  FROM postings_raw
  QUALIFY row_number() OVER (PARTITION BY source, job_key ORDER BY ord1, ord2) = 1
)"""


def salary_ctes(src: str, prefix: str = "sal") -> str:
    """CTE chain adding salary_{min,max,avg}_c (cents) and doubles to relation ``src``."""
    T = prefix
    fill = ("CASE WHEN contains(_t, '万') OR contains(_t, 'w') OR contains(_t, 'W') THEN '万' "
            "WHEN contains(_t, 'K') OR contains(_t, 'k') OR contains(_t, '千') THEN 'K' ELSE '' END")

    def cents(i: str) -> str:
        x, y = f"_x{i}", f"_y{i}"
        return (f"CASE _period WHEN 'day' THEN (2 * {x} * 2175 + 100000000000) // 200000000000 "
                f"WHEN 'year' THEN (2 * {y} + 12000000) // 24000000 "
                f"ELSE (2 * {y} * _months + 12000000) // 24000000 END")

    return f"""
{T}_a AS (SELECT *, replace({ustrip('salary_text')}, ' ', '') AS _t FROM {src}),
{T}_b AS (
  SELECT *, regexp_replace(_t, '{MONTHS_STRIP}', '', 'g') AS _d,
    coalesce(TRY_CAST(regexp_extract(_t, '{MONTHS_RE}', 1) AS INTEGER), 12) AS _months,
    CASE WHEN contains(_t, '/天') OR contains(_t, '/日') THEN 'day'
         WHEN contains(_t, '/年') THEN 'year' ELSE 'month' END AS _period,
    {fill} AS _fill
  FROM {T}_a),
{T}_c AS (
  SELECT *, regexp_extract_all(_d, '{NUM_RE}', 1) AS _nums,
            regexp_extract_all(_d, '{NUM_RE}', 2) AS _units
  FROM {T}_b),
{T}_d AS (
  SELECT *, len(_nums) AS _n,
    CAST(TRY_CAST(_nums[1] AS DECIMAL(28,8)) * 100000000 AS HUGEINT) AS _x0,
    CAST(TRY_CAST(_nums[2] AS DECIMAL(28,8)) * 100000000 AS HUGEINT) AS _x1,
    coalesce(nullif(_units[1], ''), _fill) AS _u0,
    coalesce(nullif(_units[2], ''), _fill) AS _u1
  FROM {T}_c),
{T}_e AS (
  SELECT *,
    CASE WHEN _u0 IN ('万', 'w', 'W') THEN _x0 * 10 ELSE _x0 END AS _y0,
    CASE WHEN _u1 IN ('万', 'w', 'W') THEN _x1 * 10 ELSE _x1 END AS _y1
  FROM {T}_d),
{T}_f AS (
  SELECT *, {cents('0')} AS _c0,
    CASE WHEN _n = 1 THEN {cents('0')} ELSE {cents('1')} END AS _c1,
    (_n = 1 AND (contains(_t, '以上') OR contains(_t, '+'))) AS _open
  FROM {T}_e),
{T}_g AS (
  SELECT *, (_n > 0 AND _c0 IS NOT NULL AND _c1 IS NOT NULL
             AND _c0 < 4000000000000000000 AND _c1 < 4000000000000000000) AS _ok,
    (_c0 + _c1) // 2 AS _q
  FROM {T}_f),
{T} AS (
  SELECT * EXCLUDE (_t, _d, _months, _period, _fill, _nums, _units, _n, _x0, _x1, _u0, _u1,
                    _y0, _y1, _c0, _c1, _open, _ok, _q),
    CAST(CASE WHEN _ok THEN _c0 END AS BIGINT) AS salary_min_c,
    CAST(CASE WHEN _ok AND NOT _open THEN _c1 END AS BIGINT) AS salary_max_c,
    CAST(CASE WHEN _ok AND _open THEN _c0
              WHEN _ok THEN _q + CASE WHEN (_c0 + _c1) % 2 = 1 AND _q % 2 = 1 THEN 1 ELSE 0 END
         END AS BIGINT) AS salary_avg_c
  FROM {T}_g)"""


def experience_sql(x: str) -> str:
    t = ustrip(x)
    nums = f"list_transform(regexp_extract_all({t}, '[0-9]+'), lambda v: TRY_CAST(v AS BIGINT))"
    from hirelens.dims import EXPERIENCE_ANY_KWS
    any_kw = " OR ".join(f"contains({t}, '{k}')" for k in EXPERIENCE_ANY_KWS)
    first = f"({nums})[1]"
    years = f"CASE WHEN len({nums}) > 1 THEN list_min({nums}) ELSE {first} END"
    return f"""(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL
  WHEN {any_kw} THEN '应届/不限'
  WHEN len({nums}) = 0 THEN '应届/不限'
  WHEN contains({t}, '以下') THEN
    CASE WHEN {first} <= 1 THEN '1年以下' WHEN {first} <= 3 THEN '1-3年'
         WHEN {first} <= 5 THEN '3-5年' WHEN {first} <= 10 THEN '5-10年' ELSE '10年以上' END
  ELSE CASE WHEN {years} < 1 THEN '1年以下' WHEN {years} < 3 THEN '1-3年'
            WHEN {years} < 5 THEN '3-5年' WHEN {years} < 10 THEN '5-10年' ELSE '10年以上' END
  END)"""


def education_sql(x: str) -> str:
    from hirelens.dims import EDUCATION_RULES as rules
    t = ustrip(x)
    whens = " ".join(f"WHEN contains({t}, '{k}') THEN '{v}'" for k, v in rules)
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL {whens} ELSE '不限' END)"


def tags_sql(x: str) -> str:
    from hirelens.functions.text import WS_CLASS
    sep = "[,，、;；/|" + WS_CLASS + "]+"
    parts = f"string_split_regex({ustrip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '{sep}')"
    clean = f"list_filter({parts}, lambda v: v <> '')"
    return f"array_to_string({clean}, ',')"


BASE = "WITH " + RAW.strip() + "," + salary_ctes("bronze", "salb") + """,
silver AS (
  SELECT source, job_key, title, keyword, salary_text, city, company, company_size, industry,
         salary_min_c, salary_max_c, salary_avg_c,
         salary_min_c / 100.0 AS salary_min, salary_max_c / 100.0 AS salary_max,
         salary_avg_c / 100.0 AS salary_avg,
         """ + experience_sql("experience") + """ AS experience,
         """ + education_sql("education") + """ AS education,
         """ + tags_sql("tags") + """ AS tags,
         crawled_at
  FROM salb
)"""


def q(body: str) -> str:
    """Full statement: shared CTEs + the query body (may add CTEs with a leading comma)."""
    body = body.strip()
    if body.startswith(","):
        return BASE + body
    return BASE + "\n" + body


def stored_tags_sql(x: str = "tags") -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda v: {ustrip('v')}), lambda v: v <> '')"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def skills_sql(blob: str, dictionary) -> str:
    """Dictionary tagging without look-around: (^|[^a-z])alias([^a-z]|$) for ASCII words."""
    from hirelens.functions.text import rx_escape
    items = []
    for canon, aliases in dictionary:
        pats = []
        for a in aliases:
            if a.isascii() and a.isalpha():
                pats.append(f"(^|[^a-z]){rx_escape(a)}([^a-z]|$)")
            else:
                pats.append(rx_escape(a))
        pat = "|".join(pats).replace("'", "''")
        items.append(f"CASE WHEN regexp_matches({blob}, '{pat}') THEN '{canon}' END")
    return f"array_to_string(list_filter([{', '.join(items)}], lambda v: v IS NOT NULL), ',')"


def unescape_sql(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def url_job_id_sql(url: str) -> str:
    m = f"regexp_extract({url}, '/(?:lpt)?job/([0-9]+)', 1)"
    return (f"CASE WHEN {url} IS NULL OR {url} = '' THEN '' WHEN {m} <> '' THEN {m} "
            f"ELSE split_part({url}, '?', 1) END")

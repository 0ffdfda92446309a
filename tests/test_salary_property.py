"""Generated salary texts: staged Spark parse == Column Spark parse == DuckDB SQL."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hirelens.functions.salary import with_salary
from hirelens.plans import oracle as O

number = st.one_of(
    st.integers(0, 999).map(str),
    st.tuples(st.integers(0, 99), st.integers(0, 99)).map(lambda t: f"{t[0]}.{t[1]}"),
)
unit = st.sampled_from(["", "K", "k", "千", "万", "w", "W"])
suffix = st.sampled_from(["", "·13薪", "·14薪", "x15薪", "/年", "/天", "/日", "以上", "+",
                          "元/天", "万/年", "/月", "面议"])
blank = st.sampled_from(["", " ", "　", "\t"])


@st.composite
def salary_text(draw):
    lo = draw(number) + draw(unit)
    text = lo
    if draw(st.booleans()):
        text += draw(st.sampled_from(["-", "~", " - "])) + draw(number) + draw(unit)
    return draw(blank) + text + draw(suffix) + draw(blank)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(salary_text(), min_size=300, max_size=300))
def test_agreement_with_sql(spark, texts):
    texts = list(dict.fromkeys([*texts, "123456789K", "100000000元/天", "1.23495K", "7.0000500-99999999999.123456元/年"]))
    df = spark.createDataFrame([(t,) for t in texts], "salary_text string")
    staged = {r[0]: tuple(None if v is None else float(v) for v in r[1:])
              for r in with_salary(df).select("salary_text", "salary_min", "salary_max",
                                               "salary_avg").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE src(salary_text VARCHAR)")
    con.executemany("INSERT INTO src VALUES (?)", [(t,) for t in texts])
    sql = ("WITH " + O.salary_ctes("src", "ps").strip() + " SELECT salary_text, "
           "salary_min_c / 100.0, salary_max_c / 100.0, salary_avg_c / 100.0 FROM ps")
    duck = {r[0]: tuple(None if v is None else float(v) for v in r[1:])
            for r in con.execute(sql).fetchall()}
    for t in texts:
        assert staged[t] == duck[t], t

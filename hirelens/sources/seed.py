"""A handful of in-memory raw postings (demo / golden fixture) and S3 JDBC I/O.

The rows are invented for this project; they exercise every cleaner path
(ranges, mixed units, months bonus, yearly and daily pay, open-ended, missing
salary, duplicate key within the batch, missing official id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_CARD = ("source string, job_key string, title string, company string, city string, "
            "industry string, salary_text string, education_text string, "
            "experience_text string, tags_text string, keyword string, url string, area string")

SEED_ROWS = [
    ("site_a", "A100", "Python数据工程师", "甲公司", "上海", "互联网", "15-25K·13薪", "本科",
     "3-5年", "Python,Spark,SQL", "Python", None, "上海·浦东新区"),
    ("site_a", "A101", "Java后端开发", "乙公司", "北京", "金融", "8千-1.2万", "大专", "1-3年",
     "Java、Spring Boot", "Java", None, "北京·朝阳区"),
    ("site_a", "A102", "前端开发工程师(Vue)", "丙公司", "深圳", "电商", "1.5-3万", "统招本科",
     "5年以下", "Vue/JavaScript", "前端", None, "深圳·南山区"),
    ("site_a", "A102", "前端开发工程师(Vue)", "丙公司", "深圳", "电商", "1.6-3万", "统招本科",
     "5年以下", "Vue/JavaScript", "前端", None, "深圳·南山区"),
    ("site_a", "A103", "数据分析师", "丁公司", "杭州", "零售", "30-60万/年", "硕士", "经验不限",
     "SQL；Excel", "数据分析", None, "杭州·西湖区"),
    ("site_b", None, "算法实习生", "戊公司", "成都", "人工智能", "200元/天", "硕士", "在校",
     "Python PyTorch", "Python", "https://example.org/lptjob/7788", "成都-高新区"),
    ("site_b", None, "资深Java架构师", "己公司", "武汉", "软件", "40K以上", "本科", "10年以上",
     "Java,微服务,分布式", "Java", "https://example.org/job/5566.shtml?ref=list", "武汉-洪山区"),
    ("site_b", None, "数据分析专员", "庚公司", "南京", "制造", "面议", "学历不限", None,
     None, "数据分析", None, "南京-江宁区"),
    (None, "C1", "全栈工程师", "辛公司", "西安", "软件", "20-30k", "EMBA", "一年以内",
     "Node.js | React", "前端", None, None),
]


def seed_cards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_ROWS, RAW_CARD)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, partitions: int = 64) -> DataFrame:
    """S3 source: a relational table read in parallel ranges of ``partition_column``."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", partitions))
    return r.load()


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None,
               mode: str = "append") -> None:
    """S3 sink: append (or overwrite) a DataFrame into a relational table."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).mode(mode)
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()

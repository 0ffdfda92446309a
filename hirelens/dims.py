"""Dimension data and vocabularies.

Everything between the FIXED VALUES markers must equal the behaviour being
rebuilt (keyword lists, label sets, dictionaries, orders, constants). They are
plain data; the logic that uses them lives in ``hirelens.functions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour; keep in this order)
# ---------------------------------------------------------------------------

# Legal paid days per month used to turn a day rate into a monthly salary.
WORK_DAYS_PER_MONTH = "21.75"

# Default search keywords and the 20-city whitelist (in configured order).
KEYWORDS = ["Python", "Java", "前端", "数据分析"]
CITIES = ["上海", "北京", "深圳", "重庆", "广州", "苏州", "成都", "杭州", "武汉", "南京",
          "宁波", "天津", "青岛", "无锡", "长沙", "郑州", "福州", "济南", "合肥", "西安"]

# City coordinates (lon, lat) for the geo view.
CITY_COORDS = {
    "北京": (116.41, 39.90), "上海": (121.47, 31.23), "广州": (113.26, 23.13),
    "深圳": (114.06, 22.55), "重庆": (106.55, 29.56), "天津": (117.20, 39.13),
    "杭州": (120.15, 30.28), "宁波": (121.55, 29.88), "成都": (104.07, 30.57),
    "南京": (118.80, 32.06), "苏州": (120.62, 31.32), "无锡": (120.30, 31.57),
    "武汉": (114.31, 30.52), "长沙": (112.94, 28.23), "郑州": (113.63, 34.75),
    "西安": (108.95, 34.27), "青岛": (120.38, 36.07), "济南": (117.00, 36.65),
    "福州": (119.30, 26.08), "合肥": (117.28, 31.86),
}

# Education: ordered first-match substring rules (keyword, normalised label).
EDUCATION_RULES = [
    ("博士", "博士"), ("EMBA", "硕士"), ("MBA", "硕士"), ("硕士", "硕士"),
    ("研究生", "硕士"), ("本科", "本科"), ("大专", "大专"), ("专科", "大专"),
    ("高中", "高中及以下"), ("中专", "高中及以下"), ("初中", "高中及以下"),
]
EDUCATION_DEFAULT = "不限"

# Experience: phrases meaning "fresh graduate / no requirement", and the tiers.
EXPERIENCE_ANY_KWS = ["应届", "在校", "经验不限", "无需经验", "不限"]
EXPERIENCE_ANY = "应届/不限"
EXP_ORDER = ["应届/不限", "1年以下", "1-3年", "3-5年", "5-10年", "10年以上"]
EDU_ORDER = ["博士", "硕士", "本科", "大专", "高中及以下", "不限"]
# Low-to-high education order used by inference.
EDU_ORDER_ASC = ["高中及以下", "大专", "本科", "硕士", "博士"]

# Ordinal codes used by the correlation matrix and the models.
EDU_RANK = {"高中及以下": 1, "不限": 1, "大专": 2, "本科": 3, "硕士": 4, "博士": 5}
EXP_RANK = {"应届/不限": 0, "1年以下": 1, "1-3年": 2, "3-5年": 3, "5-10年": 4, "10年以上": 5}

# Tag separators (split_tags).
TAG_SEPARATORS = ",，、;；/|"

# Title skill dictionary: canonical -> aliases (lower case), dictionary order.
SKILL_DICT = [
    ("Python", ["python"]),
    ("Java", ["java"]),
    ("C++", ["c++"]),
    ("C#", ["c#", ".net", "asp.net"]),
    ("Go", ["golang", "go语言"]),
    ("PHP", ["php"]),
    ("JavaScript", ["javascript", "js", "es6"]),
    ("TypeScript", ["typescript", "ts"]),
    ("Vue", ["vue"]),
    ("React", ["react"]),
    ("Angular", ["angular"]),
    ("HTML/CSS", ["html", "css", "h5"]),
    ("Node.js", ["node.js", "nodejs", "node"]),
    ("Spring", ["spring", "springboot", "spring boot", "springcloud"]),
    ("MySQL", ["mysql"]),
    ("Redis", ["redis"]),
    ("MongoDB", ["mongodb", "mongo"]),
    ("Oracle", ["oracle"]),
    ("SQL", ["sql"]),
    ("Linux", ["linux"]),
    ("Docker", ["docker"]),
    ("Kubernetes", ["kubernetes", "k8s"]),
    ("分布式", ["分布式"]),
    ("微服务", ["微服务"]),
    ("大数据", ["大数据", "hadoop", "spark", "hive", "flink"]),
    ("机器学习", ["机器学习", "machine learning", "ml"]),
    ("深度学习", ["深度学习", "deep learning", "dl", "pytorch", "tensorflow"]),
    ("算法", ["算法"]),
    ("爬虫", ["爬虫", "spider", "scrapy"]),
    ("数据分析", ["数据分析", "数据挖掘"]),
    ("测试", ["测试", "自动化测试", "qa"]),
    ("运维", ["运维", "devops"]),
    ("前端", ["前端"]),
    ("后端", ["后端", "服务端"]),
    ("全栈", ["全栈"]),
    ("Android", ["android", "安卓"]),
    ("iOS", ["ios"]),
]

# Tag alias map used by the skill graph: lower-cased tag -> canonical name.
TAG_ALIASES = {
    "python": "Python", "python开发": "Python",
    "java": "Java", "java开发": "Java", "javaee": "Java",
    "golang": "Go", "go": "Go",
    "c++": "C++", "c/c++": "C++",
    "javascript": "JavaScript", "js": "JavaScript",
    "typescript": "TypeScript", "ts": "TypeScript",
    "spring": "Spring",
    "spring boot": "Spring Boot", "springboot": "Spring Boot",
    "spring bot": "Spring Boot",
    "spring cloud": "Spring Cloud", "springcloud": "Spring Cloud",
    "vue": "Vue", "vue.js": "Vue", "vuejs": "Vue",
    "react": "React", "react.js": "React",
    "angular": "Angular",
    "node.js": "Node.js", "nodejs": "Node.js",
    "mysql": "MySQL", "redis": "Redis", "mongodb": "MongoDB",
    "elasticsearch": "Elasticsearch", "es": "Elasticsearch",
    "kafka": "Kafka",
    "hadoop": "Hadoop", "hive": "Hive", "spark": "Spark",
    "linux": "Linux", "docker": "Docker",
    "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "git": "Git", "shell": "Shell",
    "html5": "HTML5", "html": "HTML5", "css3": "CSS3", "css": "CSS3",
    "web前端": "前端开发", "前端": "前端开发", "前端开发": "前端开发",
    "数据分析": "数据分析", "数据挖掘": "数据挖掘", "数据仓库": "数据仓库",
    "数据开发": "数据开发", "数据治理": "数据治理", "数据可视化": "数据可视化",
    "机器学习": "机器学习", "深度学习": "深度学习", "大数据": "大数据",
    "微服务": "微服务", "微服务架构": "微服务", "分布式": "分布式",
    "分布式架构": "分布式", "数据库": "数据库", "sql": "SQL",
    "软件开发": "软件开发",
}

# Intern / part-time title keywords, the direct-hire URL marker, and the
# negation phrases that win over them in the clean-up job.
INTERN_KWS = ["实习", "见习", "兼职", "日结", "临时工"]
INTERN_URL_MARK = "/lptjob/"
INTERN_NEGATIONS = ["不招实习", "非实习", "不含实习", "拒绝实习"]

# Non-IT clean-up: tech white-list protects, then the black-list deletes.
TECH_KWS = [
    "开发", "工程师", "程序员", "算法", "架构", "后端", "前端", "全栈",
    "运维", "测试开发", "数据研发", "数据开发", "大数据", "机器学习",
    "深度学习", "人工智能", "爬虫", "软件", "研发工程", "SRE", "DevOps",
    "Java", "Python", "Golang", "C++", "前端开发", "web开发", "嵌入式",
]
NONTECH_KWS = [
    "财务", "会计", "出纳", "审计", "税务", "成本核算", "核价", "成本会计",
    "药物", "药品", "临床", "生信", "单细胞", "医药", "制药", "药学",
    "化验", "检测员", "化学检测", "无机化学", "药物分析", "化验员",
    "人力", "人事", "招聘", "薪酬", "绩效", "行政", "HRBP", "HR",
    "培训生", "储备干部",
    "市场分析", "商业分析", "销售", "客服", "运营专员", "商品主管",
    "商品经理", "品类", "选品", "外贸", "跟单",
    "投资", "证券", "基金", "风控专员", "信贷",
    "服装", "纺织", "女装", "男装", "面料", "IE分析", "车间", "生产计划",
    "计划员", "物料", "仓储", "质检",
    "统计员", "调研", "录入", "数据录入", "文员", "助理",
]

# Card label classification (list pages without semantic classes).
LABEL_EDU_KWS = ["本科", "大专", "硕士", "博士", "学历", "高中", "中专", "初中", "MBA", "EMBA"]
LABEL_SALARY_PATTERN = r"\d+\s*[-~]\s*\d+\s*[kK万]|面议|\d+\s*元|\d+\s*万"
LABEL_EXP_KWS = ["年", "应届", "经验", "在校", "不限", "往届"]
LABEL_SKIP = ["·", "|", "-"]

# Posting id inside a detail URL.
URL_JOB_ID_PATTERN = r"/(?:lpt)?job/(\d+)"
JOB_KEY_MAX = 128

# CSV export: column order and headers.
EXPORT_COLUMNS = [
    ("source", "来源"), ("keyword", "职位关键词"), ("title", "岗位名称"),
    ("company", "公司"), ("city", "城市"), ("education", "学历"),
    ("experience", "经验"), ("salary_text", "薪资原文"),
    ("salary_min", "最低月薪(K)"), ("salary_max", "最高月薪(K)"),
    ("salary_avg", "平均月薪(K)"), ("tags", "技能标签"),
]

# Model features and their display labels.
CAT_FEATURES = ["city", "education", "experience", "keyword", "source"]
NUM_FEATURES = ["skill_count"]
FEATURE_LABELS = {"city": "城市", "education": "学历", "experience": "经验",
                  "keyword": "职位方向", "source": "数据来源", "skill_count": "技能数量"}

# Statistics thresholds.
MIN_GROUP_N = 30
EDU_PAIRS = [("大专", "本科"), ("本科", "硕士"), ("硕士", "博士")]
EXP_PAIRS = [("1年以下", "1-3年"), ("1-3年", "3-5年"), ("3-5年", "5-10年")]
GROUP_EXCLUDE = ["None", "不限"]
BLANK_LABEL = "(空)"
# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------


def fixture_cities(n: int = 20) -> list[str]:
    """Whitelist for the driver fixture: the first ``n`` nation names (rule-built)."""
    return [f"NATION_{i}" for i in range(n)]


def dim_city_fixture(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """City dimension derived from ``nation``: name, ord, lon, lat.

    Coordinates follow a fixed rule so the geo query has something to join.
    """
    from pyspark.sql import functions as F
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return (nation.where(F.col("n_nationkey") < n)
            .select(F.col("n_name").alias("name"),
                    F.col("n_nationkey").cast("int").alias("ord"),
                    (F.lit(100.0) + F.col("n_nationkey") * F.lit(1.5)).alias("lon"),
                    (F.lit(20.0) + F.col("n_regionkey") * F.lit(4.0)).alias("lat")))


def dim_city(spark: SparkSession, cities: list[str] | None = None) -> DataFrame:
    """City dimension for real data (20 rows, exact size -> broadcast)."""
    cities = cities or CITIES
    rows = [(c, i, *CITY_COORDS.get(c, (None, None))) for i, c in enumerate(cities)]
    schema = T.StructType([
        T.StructField("name", T.StringType(), False),
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("lon", T.DoubleType(), True),
        T.StructField("lat", T.DoubleType(), True),
    ])
    return spark.createDataFrame(rows, schema)

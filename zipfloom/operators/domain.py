"""Domain detection by weighted keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: keyword weights of the shipped profiles, in profile and keyword order
PROFILES = {
    ("zh", "finance"): "财政 1.0|税收 0.9|货币 0.9|宏观 0.8|微观 0.8|均衡 0.7|GDP 0.8|通胀 0.8|利率 0.8|汇率 0.7|央行 0.8|市场 0.5|供给 0.7|需求 0.7|弹性 0.6|边际 0.6|效用 0.6|成本 0.5|收益 0.5|投资 0.6|消费 0.5|贸易 0.6|预算 0.7|赤字 0.7|公债 0.8|转移支付 0.8|政府购买 0.8|乘数 0.7|IS-LM 0.9|AD-AS 0.9",
    ("zh", "legal"): "法律 1.0|法规 0.9|宪法 0.9|民法 0.9|刑法 0.9|合同 0.7|诉讼 0.8|判决 0.8|司法 0.8|行政 0.6|权利 0.5|义务 0.5|侵权 0.8|仲裁 0.8",
    ("zh", "medical"): "临床 1.0|诊断 0.9|治疗 0.8|病理 0.9|药理 0.9|症状 0.7|患者 0.6|手术 0.7|药物 0.6|感染 0.7|免疫 0.7|肿瘤 0.8",
    ("zh", "tech"): "算法 1.0|数据结构 0.9|编程 0.8|接口 0.6|架构 0.7|数据库 0.8|网络 0.5|操作系统 0.8|编译 0.8|并发 0.7|分布式 0.7|机器学习 0.8|深度学习 0.8|神经网络 0.8",
    ("en", "finance"): "fiscal 1.0|monetary 0.9|inflation 0.8|GDP 0.8|equilibrium 0.7|aggregate 0.6|supply 0.5|demand 0.5|interest rate 0.8|exchange rate 0.7|central bank 0.8|taxation 0.9|budget deficit 0.8|multiplier 0.7",
    ("en", "legal"): "statute 1.0|jurisdiction 0.9|plaintiff 0.9|defendant 0.9|court 0.7|contract 0.6|liability 0.8|tort 0.9|arbitration 0.8|amendment 0.7",
    ("en", "tech"): "algorithm 1.0|data structure 0.9|compiler 0.8|distributed 0.7|concurrency 0.8|API 0.6|database 0.7|architecture 0.7|machine learning 0.8|neural network 0.8",
}
LEAST_CONFIDENCE = 0.05


def profile_rows() -> list[tuple[str, int, str, int, str, float]]:
    out, order = [], {}
    for (lang, name), words in PROFILES.items():
        o = order[lang] = order.get(lang, -1) + 1
        for k, w in enumerate(words.split("|")):
            keyword, weight = w.rsplit(" ", 1)
            out.append((lang, o, name, k, keyword, float(weight)))
    return out


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(profile_rows(), "lang string, profile_ord int, id string, kw_ord int, keyword string, weight double")


def detect_domains(docs: DataFrame, profile: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, domain, confidence, matched): the profile of most matched weight, if over 0.05; ties go to the
    earlier profile. Keywords match with case, anywhere in the text. A text matching no profile has no row.

    Profiles are small by their meaning; they are read into the plan as one expression, so each text is
    scanned in place and nothing is joined or shuffled.
    """
    rows = [tuple(r) for r in profile.select("lang", "profile_ord", "id", "kw_ord", "keyword", "weight").collect()]
    groups: dict[tuple, list] = {}
    for r in sorted(rows):
        groups.setdefault((r[0], r[1], r[2]), []).append((r[4], r[5]))
    t = F.coalesce(F.col(text), F.lit(""))
    each = []
    for (lg, order, name), words in groups.items():
        total = float(sum(w for _, w in words))
        hit = F.lit(0.0)
        for k, w in words:
            hit = hit + F.when(F.contains(t, F.lit(k)), F.lit(w)).otherwise(F.lit(0.0))
        found = F.filter(F.array(*[F.when(F.contains(t, F.lit(k)), F.lit(k)) for k, _ in words]), lambda x: x.isNotNull())
        mine = F.when(F.col(lang) == "zh", F.lit("zh")).otherwise(F.lit("en")) == lg
        each.append(F.when(mine & (hit / total > LEAST_CONFIDENCE), F.struct((hit / total).alias("confidence"), F.lit(-order).alias("o"), F.lit(name).alias("domain"), found.alias("matched"))))
    best = F.array_max(F.filter(F.array(*each), lambda x: x.isNotNull()))
    return docs.select(key, best.alias("b")).filter("b is not null").select(key, "b.domain", "b.confidence", "b.matched")

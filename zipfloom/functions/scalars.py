"""Scores, weights, bands and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DEFAULT_ZIPF = {"en": 4.0, "zh": 3.5}
BIGRAM_MISS = 4.0
BIGRAM_HIT = 5.0
BIGRAM_WEIGHT = 1.3
WEIGHTS = {"frequency": 0.40, "collocation": 0.20, "complexity": 0.15, "slot_preservation": 0.15, "domain_relevance": 0.10}
THRESHOLDS = {"action": 0.85, "object": 0.90, "scope": 0.95, "modifier": 0.75, "qtype": 0.95, "register": 0.80, "entity": 0.95, "condition": 0.90, "placeholder": 1.0, "negation": 1.0}
KIND_NAMES = {"action": "动作 (Action)", "object": "对象 (Object)", "scope": "范围 (Scope)", "modifier": "修饰 (Modifier)", "qtype": "问法 (Q-Type)", "register": "语体 (Register)", "placeholder": "占位符 (Placeholder)", "entity": "实体 (Entity)", "negation": "否定 (Negation)", "condition": "条件 (Condition)"}
EXACT_KINDS = ("placeholder", "negation")
VERDICT_LABELS = {"Allowed": "等价替换", "Narrowing": "语义收窄（父→子）", "Widening": "语义扩展（子→父）", "Unrelated": "无本体关系", "CrossBranch": "跨分支替换"}
SAFE_VERDICTS = ("Allowed", "Widening", "Unrelated")
ALPHA, BETA = 0.6, 0.4


def token_weight(token: Column, lang: Column) -> Column:
    n = F.length(token)
    zh = F.when(n <= 1, 0.5).when(n == 2, 1.0).when(n == 3, 1.2).when(n == 4, 1.3).otherwise(1.4)
    en = F.when(n <= 2, 0.4).when(n <= 4, 0.7).when(n <= 7, 1.0).otherwise(1.2)
    return F.when(lang == "zh", zh).otherwise(en)


def score_floor(zipf: Column, lang: Column) -> Column:
    return F.greatest(zipf, F.when(lang == "zh", DEFAULT_ZIPF["zh"] * 0.5).otherwise(DEFAULT_ZIPF["en"] * 0.5))


def bigram_weight(pos: Column, bigram: Column) -> Column:
    return F.when((pos > 0) & (bigram > BIGRAM_HIT), BIGRAM_WEIGHT).otherwise(1.0)


def complexity(n: Column, avg_length: Column) -> Column:
    return 1.0 / (1.0 + F.sqrt(n / 20.0) + F.sqrt(avg_length / 5.0))


def layered(layers: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + layers[k] * F.lit(float(w))
    return out


def weights_valid(*weights: Column) -> Column:
    return F.abs(sum(weights[1:], weights[0]) - 1.0) < 0.01


def normalized(weights: dict[str, float]) -> dict[str, float]:
    s = sum(weights.values())
    return {k: v / s for k, v in weights.items()} if s > 0 else dict(weights)


def hybrid(general: Column, domain: Column, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """The blend where the domain knows the word, else the general score unscaled."""
    return F.coalesce(alpha * general + beta * domain, general)


def corpus_zipf(count: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.log10(count / total * 1e9)))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot / (na * nb)).otherwise(0.0)


def string_hash(text: Column) -> Column:
    """h = h * 31 + UTF-16 unit in 32-bit arithmetic, then the absolute value, as a long.

    Characters beyond the basic plane count as their two surrogate units.
    """
    two32, two31 = F.lit(2**32), F.lit(2**31)
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    wrap = lambda x: F.pmod(x + two31, two32) - two31
    return F.abs(F.aggregate(units, F.lit(0).cast("long"), lambda h, u: wrap(h * 31 + F.conv(u, 16, 10).cast("long"))))


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def threshold(kind: Column) -> Column:
    return _map(THRESHOLDS)[kind]


def kind_name(kind: Column) -> Column:
    return _map(KIND_NAMES)[kind]


def needs_exact(kind: Column) -> Column:
    return kind.isin(*EXACT_KINDS)


def is_safe(verdict: Column) -> Column:
    return verdict.isin(*SAFE_VERDICTS)


def verdict_label(verdict: Column) -> Column:
    return _map(VERDICT_LABELS)[verdict]


def is_content(pos: Column) -> Column:
    return pos.isin("verb", "noun", "adjective", "adverb")


def sentence_band(score: Column) -> Column:
    return F.when(score >= 5.0, "score-high").when(score >= 4.0, "score-mid").otherwise("score-low")


def word_band(score: Column) -> Column:
    return F.when(score >= 6.0, "wf-high").when(score >= 4.5, "wf-mid").otherwise("wf-low")


def delta_class(d: Column) -> Column:
    return F.when(d > 0.05, "delta-pos").when(d < -0.05, "delta-neg").otherwise("delta-neu")


def delta_text(d: Column) -> Column:
    two = F.format_string("%.2f", d)
    return F.when(d > 0.01, F.concat(F.lit("+"), two)).when(d < -0.01, two).otherwise("±0.00")


def ring_share(score: Column, top: float = 8.0) -> Column:
    return F.greatest(F.lit(0.03), F.least(score / top, F.lit(1.0)))


def similarity_band(s: Column) -> Column:
    return F.when(s < 0.4, "low").when(s < 0.7, "mid").otherwise("high")

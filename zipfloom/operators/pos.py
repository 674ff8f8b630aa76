"""Coarse parts of speech, as one CASE expression a language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists in the order they are tried
EN_FUNCTION = "a an the of in on at to for by with from as is are was were be been being am ai and or but if then so than that this these those it its he she they them his her their i you we us me my your our do does did done have has had having will would should could can may might must shall not no yes".split()
EN_PREPOSITION = "about above across after against along among around before behind below beneath beside between beyond during except inside into near onto opposite outside over through toward under underneath until upon within without although because since unless when whenever where whereas wherever whether while".split()
EN_PRONOUN = "i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours ourselves they them their theirs themselves this that these those who what which whom".split()
EN_VERB = "explain examine describe analyze analyse modify discuss elaborate list enumerate compare contrast investigate study research review summarize outline clarify define identify evaluate assess interpret predict recommend suggest propose argue claim state report tell say speak talk write read understand know think consider feel want need use make do go come take give get see look find show help include contain involve require depend vary differ express indicate reflect represent highlight emphasize underline demonstrate illustrate is are was were been".split()
EN_ADJECTIVE = "global national local regional federal central macroeconomic microeconomic monetary fiscal financial economic structural industrial commercial overall entire whole complete partial full empty main major minor key primary secondary tertiary important critical essential necessary crucial vital obvious clear unclear ambiguous current present past future recent ancient modern".split()
ZH_ONE = {
    "function": "的了着过们吗呢吧啊呀哦嘛和与或及而但因所",
    "adverb": "不没非无未勿请求",
    "preposition": "在从向往到给为对以把被",
    "pronoun": "我你他她它这那此",
    "verb": "是有做说看想去来走写读听会能将",
    "entity": "一二三四五六七八九十百千万亿几多少",
}
ZH_VERB = "阐述 说明 解释 介绍 描述 讲述 讲 分析 论述 讨论 研究 调查 请 求 帮忙 帮 试试 进行 实施 执行 开展 做出 实行 影响 导致 造成 引起 带来 产生 推动 发生 出现 存在 具有 包含 涉及".split()
ZH_VERB_END = "做了 去过 看过 读过 听过 写过 想过 说过 起来 下去 上来 下来".split()
ZH_ADJECTIVE = "整体 部分 全部 主要 次要 核心 基本 重要 关键 详细 具体 完整 全面 系统 深入 明显 显著 有效 无效 成功 失败 好 坏 新 旧 对 错".split()


def tag_en(word: Column) -> Column:
    return tag_lower_en(F.lower(word))


def tag_lower_en(w: Column) -> Column:
    """tag_en of a word in lower case already."""
    byte_len = F.octet_length(w)
    ends = lambda *s: w.rlike("(?:" + "|".join(s) + ")$")
    return (
        F.when(w == "", "other")
        .when(w.isin(EN_FUNCTION), "function")
        .when(w.isin(EN_PREPOSITION), "preposition")
        .when(w.isin(EN_PRONOUN), "pronoun")
        .when(w.isin(EN_VERB), "verb")
        .when(w.isin(EN_ADJECTIVE), "adjective")
        .when(ends("ly") & (byte_len > 4), "adverb")
        .when(ends("ize", "ise", "ify", "ate", "ect"), "verb")
        .when(ends("tion", "sion", "ment", "ity", "ness", "ence", "ance", "ist", "ism", "ology", "graphy", "ics"), "noun")
        .when(ends("er", "or"), "noun")
        .when(ends("ed") & (byte_len > 4), "adjective")
        .when(ends("al", "ous", "ive", "ful", "less", "able", "ible", "ic", "ical"), "adjective")
        .otherwise("noun")
    )


_EN_LISTS = {w: tag for tag, words in reversed((("function", EN_FUNCTION), ("preposition", EN_PREPOSITION), ("pronoun", EN_PRONOUN), ("verb", EN_VERB), ("adjective", EN_ADJECTIVE))) for w in words}
# endings in the order they are tried; the mark stands for a length of more than four bytes
_EN_ENDINGS = ((("ly",), "adverb", True), (("ize", "ise", "ify", "ate", "ect"), "verb", False), (("tion", "sion", "ment", "ity", "ness", "ence", "ance", "ist", "ism", "ology", "graphy", "ics", "er", "or"), "noun", False), (("ed",), "adjective", True), (("al", "ous", "ive", "ful", "less", "able", "ible", "ic", "ical"), "adjective", False))


def tag_word_en(w: str) -> str:
    """tag_lower_en of one word, for scanners that run in Python."""
    if not w:
        return "other"
    if w in _EN_LISTS:
        return _EN_LISTS[w]
    return next((tag for ends, tag, long in _EN_ENDINGS if w.endswith(ends) and (not long or len(w.encode()) > 4)), "noun")


def tag_zh(word: Column) -> Column:
    one = F.lit("noun")
    for tag, chars in reversed(list(ZH_ONE.items())):
        one = F.when(word.isin(list(chars)), tag).otherwise(one)
    ends = lambda s: word.rlike("(?:" + "|".join(s) + ")$")
    many = F.when(word.rlike("^[不没未]"), "adverb").when(word.isin(ZH_VERB) | ends(ZH_VERB_END), "verb").when(word.isin(ZH_ADJECTIVE), "adjective").when(word.rlike("地$"), "adverb").otherwise("noun")
    return F.when(word == "", "other").when(F.length(word) == 1, one).otherwise(many)

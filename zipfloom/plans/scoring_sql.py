"""The queries of scoring.py as SQL."""

from __future__ import annotations

from ..functions import scalars as S
from ..functions.text import CJK_ZH, QUOTES, WS_RE2
from ..operators import pos, slots
from ..operators.domain import profile_rows

SEP = rf"[{WS_RE2}[:punct:]]"
HAN, COMPAT, PUNCT, WIDE = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", r"\x{F900}-\x{FAFF}", r"\x{3000}-\x{303F}", r"\x{FF00}-\x{FFEF}"


def _count(text: str, ranges: str) -> str:
    return f"length(regexp_replace({text}, '[^{ranges}]', '', 'g'))"


def _share(text: str, ranges: str, blank: str, blanks_count: bool = True) -> str:
    rest = f"regexp_replace({text}, '[{blank}]', '', 'g')"
    return f"CASE WHEN length({rest}) > 0 THEN {_count(text if blanks_count else rest, ranges)} / length({rest}) ELSE 0 END"


def _zh(test: str) -> str:
    return f"CASE WHEN {test} THEN 'zh' ELSE 'en' END"


L1 = _zh(_share("t", HAN + COMPAT + PUNCT + WIDE, WS_RE2) + " > 0.3")
ZH_SPLIT = rf"[\s{WS_RE2}。！？，、；：{QUOTES}（）\[\]【】《》]+"
EN_SPLIT = rf"[\s{WS_RE2}.,;:!?''\"()\[\]{{}}<>]+"
CHANGE_SPLIT = rf"[\s{WS_RE2},，。！？、；：{QUOTES}\"''（）\[\]【】]+"
K1 = f"list_filter(string_split_regex(t, '{SEP}'), lambda x: regexp_matches(x, '\\p{{L}}'))"
K4 = f"list_filter(string_split_regex(t, '{ZH_SPLIT}'), lambda x: regexp_matches(x, '[{CJK_ZH}A-Za-z0-9]'))"
K5 = f"list_transform(list_filter(string_split_regex(t, '{EN_SPLIT}'), lambda x: regexp_matches(x, '[A-Za-z0-9]')), lambda x: lower(x))"
K7 = f"list_filter(string_split_regex(t, '{CHANGE_SPLIT}'), lambda x: x <> '')"
K3 = f"regexp_extract_all(t, '[^{WS_RE2}[:punct:]]+')"
ZIPF = "greatest(0, least(10, log10({n} / {total} * 1e9)))"

DOCS = "d AS (SELECT doc_id, text AS t, source, bitext_id FROM documents)"


def _tokens(docs: str) -> str:
    return f"""{docs},
k AS (SELECT doc_id, {K1} AS k FROM d),
i AS (SELECT doc_id, k, unnest(range(len(k))) AS pos FROM k),
tokens AS (SELECT doc_id, CAST(pos AS INT) AS pos, k[pos + 1] AS token, CASE WHEN pos > 0 THEN k[pos] END AS prev FROM i)"""


TOKENS = _tokens(DOCS)


def _table(name: str, expr: str, where: str = "true") -> str:
    return f"""{name}_n AS (SELECT {expr} AS word, count(*) AS n FROM tokens WHERE {where} GROUP BY 1),
{name} AS (SELECT word, n, {ZIPF.format(n="n", total="(SELECT sum(n) FROM " + name + "_n)")} AS zipf FROM {name}_n)"""


# Chinese words by dynamic programming over units (a CJK character, a blank or mark, a run of others): each unit's best
# sum is that of a word of up to eight units before it; the sums of the last eight units are carried on.
UNIT_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"
ZH_WORDS = rf"""zh_counts AS (SELECT regexp_replace(word, '^[{WS_RE2}]+|[{WS_RE2}]+$', '', 'g') AS word, sum(word_count) AS n FROM domain_freq WHERE lang = 'zh' AND word_count > 0 AND word IS NOT NULL GROUP BY 1),
zh_lex AS (SELECT word, greatest(0, least(10, log10(n / (SELECT sum(n) FROM zh_counts) * 1e9))) AS zipf FROM zh_counts)"""


def _cut(texts: str) -> str:
    """cut (doc_id, pos, token, prev) of the texts (doc_id, t)."""
    return rf"""{ZH_WORDS},
units AS MATERIALIZED (SELECT doc_id, regexp_extract_all(t, '[{UNIT_CJK}]|[{WS_RE2}[:punct:]]|[^{UNIT_CJK}{WS_RE2}[:punct:]]+') AS us FROM ({texts})),
ends AS MATERIALIZED (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS j FROM units),
spans AS MATERIALIZED (SELECT doc_id, j, k, array_to_string(us[j - k + 1:j], '') AS w FROM (SELECT *, unnest(range(1, least(j, 8) + 1)) AS k FROM ends)),
usable AS (SELECT *, regexp_full_match(w, '[{UNIT_CJK}]+') AS cjk FROM spans WHERE k = 1 OR regexp_full_match(w, '[{UNIT_CJK}]+')),
gains AS MATERIALIZED (
  SELECT doc_id, j, list({{'k': k, 'cjk': cjk, 'own': NOT regexp_matches(w, '^[{WS_RE2}[:punct:]]$'),
    'gain': CASE WHEN cjk THEN ln(greatest(coalesce(zipf, 3.5), 0.1)) * CASE k WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 1.0 WHEN 3 THEN 1.1 ELSE 1.05 END ELSE 0.1 END}}) AS options
  FROM usable LEFT JOIN zh_lex ON word = w GROUP BY ALL),
sums AS (
  SELECT doc_id, 0::BIGINT AS j, [0.0::DOUBLE] AS best, [false] AS paired, 0::BIGINT AS k FROM units
  UNION ALL
  SELECT doc_id, j, list_append(best, pick.s)[-8:], list_append(paired, pick.p)[-8:], pick.k FROM (
    SELECT g.doc_id, g.j, best, paired, list_max(list_transform(options, lambda x: {{'s': best[len(best) - x.k + 1] + x.gain + CASE WHEN x.cjk AND paired[len(paired) - x.k + 1] THEN 0.4 * ln(3.5) ELSE 0 END, 'k': x.k, 'p': paired[len(paired) - x.k + 1] OR (x.own AND g.j > x.k)}})) AS pick
    FROM sums s JOIN gains g ON g.doc_id = s.doc_id AND g.j = s.j + 1)),
steps AS MATERIALIZED (SELECT doc_id, j, k FROM sums WHERE j > 0),
marks AS (SELECT doc_id, len(us)::BIGINT AS j FROM units UNION ALL SELECT m.doc_id, m.j - s.k FROM marks m JOIN steps s ON s.doc_id = m.doc_id AND s.j = m.j),
cut_words AS (SELECT s.doc_id, s.j, p.w AS token FROM marks m JOIN steps s ON s.doc_id = m.doc_id AND s.j = m.j JOIN spans p ON p.doc_id = s.doc_id AND p.j = s.j AND p.k = s.k WHERE NOT regexp_matches(p.w, '^[{WS_RE2}[:punct:]]$')),
cut AS (SELECT doc_id, CAST(row_number() OVER v - 1 AS INT) AS pos, token, lag(token) OVER v AS prev FROM cut_words WINDOW v AS (PARTITION BY doc_id ORDER BY j))"""


OWN = "SELECT doc_id, " + L1.replace("(t,", "(coalesce(t, ''),") + " AS lang FROM d"
# the language of the first sentence of the batch that is not empty
BATCH = f"""SELECT doc_id, CASE WHEN bitext_id IS NULL THEN lang ELSE coalesce(min({{'at': doc_id, 'lang': lang}}) FILTER (WHERE t <> '') OVER (PARTITION BY bitext_id), {{'at': 0, 'lang': 'en'}}).lang END AS lang FROM d JOIN ({OWN}) USING (doc_id)"""


def _scored(lang: str, docs: str = DOCS) -> str:
    """measures of each document in the language that lang (doc_id, lang) gives it."""
    return f"""WITH RECURSIVE {_tokens(docs)}, {_table("lex", "lower(token)")}, {_table("big", "concat_ws(' ', prev, token)", "prev IS NOT NULL")},
doc_lang AS ({lang}),
{_cut("SELECT doc_id, t FROM d JOIN doc_lang USING (doc_id) WHERE lang = 'zh' AND t IS NOT NULL")},
zh_big_n AS (SELECT concat_ws(' ', prev, token) AS word, count(*) AS n FROM cut WHERE prev IS NOT NULL GROUP BY 1),
zh_big AS (SELECT word, {ZIPF.format(n="n", total="(SELECT sum(n) FROM zh_big_n)")} AS zipf FROM zh_big_n),
zh_chars AS (SELECT w, unnest(string_split(w, '')) AS c FROM (SELECT DISTINCT trim(token) AS w FROM cut)),
zh_mean AS (SELECT w, exp(avg(ln(greatest(coalesce(zipf, 3.5), 0.01)))) AS z FROM zh_chars LEFT JOIN zh_lex ON word = c GROUP BY 1),
scored AS (
  SELECT doc_id, pos, token, prev, 'en' AS lang, coalesce(lex.zipf, 4.0) AS raw, greatest(coalesce(lex.zipf, 4.0), 2.0) AS z, CASE WHEN prev IS NOT NULL THEN coalesce(big.zipf, 4.0) END AS bigram
  FROM tokens JOIN doc_lang USING (doc_id) LEFT JOIN lex ON lex.word = lower(token) LEFT JOIN big ON big.word = concat_ws(' ', prev, token) AND prev IS NOT NULL WHERE lang = 'en'
  UNION ALL
  SELECT doc_id, pos, token, prev, 'zh', raw, greatest(raw, 1.75), bigram FROM (
    SELECT doc_id, pos, token, prev, coalesce(l.zipf, CASE WHEN length(trim(token)) <= 1 THEN 3.5 END, m.z) AS raw, CASE WHEN prev IS NOT NULL THEN coalesce(b.zipf, 4.0) END AS bigram
    FROM cut LEFT JOIN zh_lex l ON l.word = trim(token) LEFT JOIN zh_mean m ON m.w = trim(token) LEFT JOIN zh_big b ON b.word = concat_ws(' ', prev, token) AND prev IS NOT NULL)),
weighed AS (
  SELECT *, CASE WHEN lang = 'zh' THEN CASE length(token) WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 1.2 WHEN 4 THEN 1.3 ELSE 1.4 END
    WHEN length(token) <= 2 THEN 0.4 WHEN length(token) <= 4 THEN 0.7 WHEN length(token) <= 7 THEN 1.0 ELSE 1.2 END * CASE WHEN pos > 0 AND bigram > 5.0 THEN 1.3 ELSE 1.0 END AS w FROM scored),
m AS (
  SELECT doc_id, sum(z * w) / sum(w) AS score, avg(z) AS live_avg, avg(CASE WHEN prev IS NOT NULL THEN CASE WHEN bigram > 5.0 THEN 1.0 ELSE 0.0 END END) AS collocation, avg(length(token)) AS avg_word_length, count(*) AS n_tokens
  FROM weighed GROUP BY doc_id),
measures AS (
  SELECT doc_id, CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(live_avg, 0) AS DOUBLE) AS live_avg, CAST(coalesce(collocation, 1) AS DOUBLE) AS collocation, CAST(coalesce(avg_word_length, 0) AS DOUBLE) AS avg_word_length,
    coalesce(n_tokens, 0) AS n_tokens, 1 / (1 + sqrt(coalesce(n_tokens, 0) / 20.0) + sqrt(coalesce(avg_word_length, 0) / 5.0)) AS complexity
  FROM d LEFT JOIN m USING (doc_id))"""


SCORED = _scored(OWN)

DOMAIN = f"""c AS (SELECT coalesce(source, '') AS name, unnest(CASE WHEN lg = 'zh' THEN {K4} ELSE {K5} END) AS word FROM (SELECT *, {L1.replace("(t,", "(coalesce(t, ''),")} AS lg FROM d)),
cn AS (SELECT name, word, count(*) AS n FROM c GROUP BY ALL),
domain_table AS (SELECT name, word, n, {ZIPF.format(n="n", total="sum(n) OVER (PARTITION BY name)")} AS zipf FROM cn)"""


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _ends(*s: str) -> str:
    return "regexp_matches(w, '(?:" + "|".join(s) + ")$')"


TAG = f"""CASE WHEN w = '' THEN 'other' WHEN w IN {_in(pos.EN_FUNCTION)} THEN 'function' WHEN w IN {_in(pos.EN_PREPOSITION)} THEN 'preposition' WHEN w IN {_in(pos.EN_PRONOUN)} THEN 'pronoun'
  WHEN w IN {_in(pos.EN_VERB)} THEN 'verb' WHEN w IN {_in(pos.EN_ADJECTIVE)} THEN 'adjective' WHEN {_ends("ly")} AND strlen(w) > 4 THEN 'adverb'
  WHEN {_ends("ize", "ise", "ify", "ate", "ect")} THEN 'verb' WHEN {_ends("tion", "sion", "ment", "ity", "ness", "ence", "ance", "ist", "ism", "ology", "graphy", "ics", "er", "or")} THEN 'noun'
  WHEN {_ends("ed")} AND strlen(w) > 4 THEN 'adjective' WHEN {_ends("al", "ous", "ive", "ful", "less", "able", "ible", "ic", "ical")} THEN 'adjective' ELSE 'noun' END"""



def _slots_of(texts: str, name: str = "") -> str:
    """slots (id, t, slot_ord, kind, text, char_start, char_end, sub_tag) of the texts (id, t), before merging."""
    return f"""h{name} AS ({texts}),
r{name} AS (SELECT id, t, unnest(regexp_extract_all(t, '{SEP}+|[^{WS_RE2}[:punct:]]+')) AS run, generate_subscripts(regexp_extract_all(t, '{SEP}+|[^{WS_RE2}[:punct:]]+'), 1) AS i FROM h{name}),
o{name} AS (SELECT id, t, i, run, CAST(sum(length(run)) OVER (PARTITION BY id, t ORDER BY i) AS INT) AS char_end FROM r{name}),
k{name} AS (SELECT id, t, run AS token, lower(run) AS w, char_end - length(run) AS char_start, char_end, row_number() OVER (PARTITION BY id, t ORDER BY i) - 1 AS idx, count(*) OVER (PARTITION BY id, t) AS n FROM o{name} WHERE NOT regexp_matches(run, '^{SEP}')),
p{name} AS (SELECT *, {TAG} AS pos FROM k{name}),
s{name} AS (SELECT id, t, token AS text, char_start, char_end, idx, CASE WHEN w IN {_in(slots.EN_REGISTER)} THEN 'register' WHEN w IN {_in(slots.EN_NEGATION)} THEN 'negation' WHEN w IN {_in(slots.EN_CONDITION)} THEN 'condition' WHEN w IN {_in(slots.EN_QTYPE)} THEN 'qtype'
  WHEN idx > 0 AND regexp_matches(token, '^\\p{{Lu}}\\p{{L}}*$') THEN 'entity' WHEN pos = 'verb' AND idx <= n // 2 THEN 'action' WHEN pos = 'adjective' THEN 'modifier' WHEN pos = 'noun' AND idx > 0 AND w NOT IN {_in(slots.EN_GENERIC)} THEN 'object' END AS kind FROM p{name}),
slots{name} AS (SELECT id, t, CAST(row_number() OVER (PARTITION BY id, t ORDER BY idx) - 1 AS INT) AS slot_ord, kind, text, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end,
  CASE kind WHEN 'register' THEN 'politeness' WHEN 'entity' THEN 'proper-noun' WHEN 'action' THEN 'verb' WHEN 'modifier' THEN 'adj' WHEN 'object' THEN 'noun' END AS sub_tag
FROM s{name} WHERE kind IS NOT NULL)"""


SLOTS = f"WITH {_slots_of('SELECT DISTINCT id, original AS t FROM history')} SELECT id, slot_ord, kind, text, char_start, char_end, sub_tag FROM slots"
# a modifier or object takes the object one character behind it
def _merged(texts: str) -> str:
    return f"""{_slots_of(texts, "_e")},
edges AS (SELECT *, coalesce(kind = 'object' AND lag(kind) OVER v IN ('modifier', 'object') AND char_start = lag(char_end) OVER v + 1, false) AS joins FROM slots_e WINDOW v AS (PARTITION BY id, t ORDER BY slot_ord)),
groups AS (SELECT *, count(*) FILTER (WHERE NOT joins) OVER (PARTITION BY id, t ORDER BY slot_ord) - 1 AS g FROM edges),
en_slots AS (SELECT id, t, CAST(g AS INT) AS slot_ord, CASE WHEN count(*) > 1 THEN 'object' ELSE any_value(kind) END AS kind, string_agg(text, ' ' ORDER BY slot_ord) AS text, min(char_start) AS char_start, max(char_end) AS char_end,
  CASE WHEN count(*) > 1 THEN 'phrase' ELSE any_value(sub_tag) END AS sub_tag FROM groups GROUP BY id, t, g)"""


MERGED = f"WITH {_merged('SELECT DISTINCT id, original AS t FROM history')} SELECT id, slot_ord, kind, text, char_start, char_end, sub_tag FROM en_slots"

_PROFILES = ", ".join(f"('{lg}', {o}, '{i}', {k}, '{w}', {v})" for lg, o, i, k, w, v in profile_rows())
DETECT = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, t, {L1} AS lg FROM d),
p(lang, profile_ord, id, kw_ord, keyword, weight) AS (VALUES {_PROFILES}),
s AS (SELECT doc_id, profile_ord, id, CAST(sum(CASE WHEN contains(t, keyword) THEN weight ELSE 0 END) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) AS confidence, string_agg(CASE WHEN contains(t, keyword) THEN keyword END, '|' ORDER BY kw_ord) AS matched
  FROM l JOIN p ON p.lang = l.lg GROUP BY doc_id, profile_ord, id)
SELECT doc_id, id AS domain, confidence, matched FROM s WHERE confidence > 0.05 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(confidence, 12) DESC, profile_ord) = 1"""

CLOSURE = """
WITH RECURSIVE rec AS (SELECT DISTINCT * FROM concepts WHERE id IS NOT NULL),
alias_of AS (SELECT domain_key, lang, name, min(id) AS id FROM (SELECT domain_key, lang, id, unnest(aliases) AS name FROM rec) WHERE name <> '' GROUP BY ALL),
named AS (
  SELECT domain_key, lang, text AS name, id FROM rec WHERE text <> ''
  UNION ALL SELECT a.domain_key, a.lang, a.name, a.id FROM alias_of a WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.domain_key = a.domain_key AND r.lang = a.lang AND r.text = a.name)),
base AS (SELECT DISTINCT domain_key, lang, id, name FROM (SELECT domain_key, lang, id, unnest(hypernyms) AS name FROM rec) WHERE name <> ''),
walk AS (
  SELECT domain_key, lang, id, name FROM base
  UNION SELECT w.domain_key, w.lang, w.id, b.name FROM walk w JOIN named n ON n.domain_key = w.domain_key AND n.lang = w.lang AND n.name = w.name JOIN base b ON b.id = n.id)
"""
VERDICTS = (
    CLOSURE
    + """, listed AS (SELECT DISTINCT domain_key, lang, text AS a, unnest(list_concat(list_concat(coalesce(hypernyms, []), coalesce(hyponyms, [])), list_concat(coalesce(siblings, []), coalesce(aliases, [])))) AS b FROM rec WHERE text IS NOT NULL),
pairs AS (SELECT domain_key, lang, a AS original, b AS candidate FROM listed WHERE b <> '' UNION SELECT domain_key, lang, b, a FROM listed WHERE b <> ''),
j AS (
  SELECT p.*, x.id AS a_id, y.id AS b_id, rx.siblings AS sa, ry.siblings AS sb, rx.hypernyms AS ha, ry.hypernyms AS hb,
    EXISTS (SELECT 1 FROM walk w WHERE w.id = y.id AND w.name = p.original) AS a_over, EXISTS (SELECT 1 FROM walk w WHERE w.id = x.id AND w.name = p.candidate) AS b_over
  FROM pairs p LEFT JOIN named x ON x.domain_key = p.domain_key AND x.lang = p.lang AND x.name = p.original LEFT JOIN named y ON y.domain_key = p.domain_key AND y.lang = p.lang AND y.name = p.candidate
  LEFT JOIN rec rx ON rx.id = x.id LEFT JOIN rec ry ON ry.id = y.id),
v AS (SELECT domain_key, lang, original, candidate, CASE WHEN original = candidate THEN 'Allowed' WHEN a_id IS NULL OR b_id IS NULL THEN 'Unrelated' WHEN a_id = b_id THEN 'Allowed' WHEN a_over THEN 'Narrowing' WHEN b_over THEN 'Widening'
  WHEN coalesce(list_contains(sa, candidate), false) OR coalesce(list_contains(sb, original), false) OR coalesce(list_has_any(list_filter(ha, lambda x: x IS NOT NULL), hb), false) THEN 'CrossBranch' ELSE 'Unrelated' END AS verdict FROM j)
SELECT *, verdict IN ('Allowed', 'Widening', 'Unrelated') AS safe FROM v"""
)

LATEST = "h AS (SELECT * FROM history WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY saved_at DESC) = 1)"

ZH_SCOPE = "'整体', '部分', '全部', '总体', '宏观', '微观', '全球', '国内', '国际', '长期', '短期', '中期', '当前', '目前', '现在', '过去', '未来'"
ZH_MARK = rf"{WS_RE2}[:punct:]\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}"


def _zh_slots(texts: str) -> str:
    return rf"""src AS (SELECT id, coalesce(id, '') || '/' || md5(t) AS doc_id, t FROM ({texts}) WHERE {_share('t', HAN + COMPAT + PUNCT, WS_RE2)} > 0.3),
{_cut("SELECT doc_id, t FROM src")},
placed AS (SELECT doc_id, token, length(array_to_string(us[1:j], '')) AS b FROM cut_words JOIN units USING (doc_id) WHERE NOT regexp_full_match(token, '[{ZH_MARK}]+')),
lost AS (SELECT DISTINCT doc_id FROM placed WHERE regexp_matches(token, '^[{ZH_MARK}]')),
tags AS (SELECT doc_id, token, b - length(token) AS a, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n,
  CASE WHEN length(token) = 1 THEN CASE WHEN contains('的了着过们吗呢吧啊呀哦嘛和与或及而但因所', token) THEN 'function' WHEN contains('不没非无未勿请求', token) THEN 'adverb' WHEN contains('在从向往到给为对以把被', token) THEN 'preposition'
      WHEN contains('我你他她它这那此', token) THEN 'pronoun' WHEN contains('是有做说看想去来走写读听会能将', token) THEN 'verb' WHEN contains('一二三四五六七八九十百千万亿几多少', token) THEN 'entity' ELSE 'noun' END
    WHEN regexp_matches(token, '^[不没未]') THEN 'adverb'
    WHEN token IN ('阐述', '说明', '解释', '介绍', '描述', '讲述', '分析', '论述', '讨论', '研究', '调查', '帮忙', '试试', '进行', '实施', '执行', '开展', '做出', '实行', '影响', '导致', '造成', '引起', '带来', '产生', '推动', '发生', '出现', '存在', '具有', '包含', '涉及') OR regexp_matches(token, '(做了|去过|看过|读过|听过|写过|想过|说过|起来|下去|上来|下来)$') THEN 'verb'
    WHEN token IN ('整体', '部分', '全部', '主要', '次要', '核心', '基本', '重要', '关键', '详细', '具体', '完整', '全面', '系统', '深入', '明显', '显著', '有效', '无效', '成功', '失败') THEN 'adjective' WHEN regexp_matches(token, '地$') THEN 'adverb' ELSE 'noun' END AS pos
  FROM placed WHERE doc_id NOT IN (SELECT doc_id FROM lost)),
kinds AS (SELECT *, lag(token) OVER v AS before, lag(a) OVER v AS start, token IN ({ZH_SCOPE}) AS scope, CASE WHEN token IN ('请', '麻烦', '求', '麻烦你', '请帮忙', '拜托') THEN 'register'
    WHEN token IN ('不', '没', '没有', '未', '非', '无', '勿', '不要', '无法', '不能') OR (regexp_matches(token, '^[不没]') AND length(token) <= 3) THEN 'negation' WHEN token IN ('如果', '要是', '假如', '假设', '若', '倘若', '假如说') THEN 'condition'
    WHEN token IN ('如何', '怎么', '怎样', '怎么样', '为什么', '为何', '是什么', '什么是', '哪些', '什么', '影响', '机制', '过程', '原理', '原因', '方法', '步骤', '流程', '区别', '差异', '对比', '比较') OR regexp_matches(token, '(机制|过程|原理)$') THEN 'qtype'
    WHEN pos = 'verb' AND (i <= n // 3 OR lead(pos) OVER v = 'noun') THEN 'action' WHEN pos = 'noun' AND lag(token) OVER v IN ({ZH_SCOPE}) THEN 'pair' WHEN pos = 'noun' THEN 'object'
    WHEN token IN ({ZH_SCOPE}) AND coalesce(lead(pos) OVER v, '') <> 'noun' THEN 'scope' WHEN pos = 'adjective' THEN 'modifier' END AS kind FROM tags WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
zslots AS (SELECT doc_id, i, CASE WHEN kind = 'pair' THEN 'scope' ELSE kind END AS kind, CASE WHEN kind = 'pair' THEN before || token ELSE token END AS text, CASE WHEN kind = 'pair' THEN start ELSE a END AS a, b,
    CASE kind WHEN 'register' THEN 'politeness' WHEN 'action' THEN 'verb' WHEN 'pair' THEN 'scope-noun' WHEN 'object' THEN 'noun' WHEN 'modifier' THEN 'adj' END AS sub_tag
  FROM (SELECT *, lead(kind) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM kinds) WHERE kind IS NOT NULL AND NOT (coalesce(following, '') = 'pair' AND kind <> 'pair')),
joined AS (SELECT *, coalesce(kind = 'object' AND lag(kind) OVER v = 'object' AND lag(b) OVER v = a, false) AS joins FROM zslots WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
zgroups AS (SELECT *, count(*) FILTER (WHERE NOT joins) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS g FROM joined),
zh_slots AS (SELECT id, t, slot_ord, kind, text, char_start, char_end, sub_tag FROM (
  SELECT doc_id, CAST(g AS INT) AS slot_ord, any_value(kind) AS kind, string_agg(text, '' ORDER BY i) AS text, CAST(min(a) AS INT) AS char_start, CAST(max(b) AS INT) AS char_end, CASE WHEN count(*) > 1 THEN 'phrase' ELSE any_value(sub_tag) END AS sub_tag FROM zgroups GROUP BY doc_id, g)
JOIN src USING (doc_id))"""



VERIFIED = f"""WITH {LATEST}, {_slots_of("SELECT id, original AS t FROM h", "_o").replace("h_o AS", "ho AS").replace("FROM h_o)", "FROM ho)")}, {_slots_of("SELECT id, optimized AS t FROM h", "_c").replace("h_c AS", "hc AS").replace("FROM h_c)", "FROM hc)")},
v AS (
  SELECT o.id, o.slot_ord, o.kind, o.text, c.text AS matched, CASE WHEN o.kind = 'negation' THEN CASE WHEN c.text = o.text THEN 1.0 ELSE 0.0 END WHEN c.text = o.text THEN 1.0 WHEN c.text IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS similarity,
    CASE o.kind WHEN 'action' THEN 0.85 WHEN 'object' THEN 0.90 WHEN 'modifier' THEN 0.75 WHEN 'qtype' THEN 0.95 WHEN 'register' THEN 0.80 WHEN 'entity' THEN 0.95 WHEN 'condition' THEN 0.90 WHEN 'negation' THEN 1.0 END::DOUBLE AS threshold
  FROM slots_o o LEFT JOIN slots_c c ON c.id = o.id AND c.slot_ord = o.slot_ord AND c.kind = o.kind),
verified AS (SELECT *, CASE WHEN kind = 'negation' THEN similarity >= 0.999 ELSE similarity >= threshold END AS passes FROM v)
"""
BOTH = f"""{LATEST}, e AS (SELECT id, original, optimized FROM h WHERE original IS NOT NULL),
d AS (SELECT id || '/0' AS doc_id, optimized AS t, id, 0 AS pos FROM e WHERE optimized IS NOT NULL UNION ALL SELECT id || '/1', original, id, 1 FROM e)"""
LINES = f"""list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[{WS_RE2}]+|[{WS_RE2}]+$', '', 'g')), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '^[0-9]+[.)、][{WS_RE2}]*', ''), '^[{WS_RE2}]+|[{WS_RE2}]+$', '', 'g')), lambda x: length(x) + length(regexp_replace(x, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) > 5)[1:6]"""

_NUMBER = r"[0-9](?:[0-9]|,[0-9]|e[0-9])*(?:\.[0-9](?:[0-9]|,[0-9]|e[0-9])*)?(?:e-|[%$€¥£元块千万亿kKmM])?"
_RUN = r"\p{L}\p{N}@_+\-"  # of an address, without the point
_SPAN = "|".join((
    r"[{\[<]", r"\$[A-Za-z_][A-Za-z0-9_]*", r"\"[^\"\n]*\"", r"''[^''\n]*''", r"‘[^‘\n]*‘", r"’[^’\n]*’", rf"http[^{WS_RE2})\]><\"]*",
    rf"[A-Za-z][{_RUN}.]*@[{_RUN}]*\.[{_RUN}.]*", rf"[A-Za-z][{_RUN}]*\.[{_RUN}.]*@[{_RUN}.]*", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]+年[0-9]*月(?:[0-9]+日?)?", _NUMBER,
))
# one span a step, from where the last one ended; brackets close where as many have closed as opened on their line


def _placeholders(texts: str) -> str:
    """pl_slots (id, t, slot_ord, kind, text, char_start, char_end, sub_tag) of the texts (id, t)."""
    return rf"""pl_texts AS MATERIALIZED (SELECT row_number() OVER () AS key, id, t FROM ({texts})),
pl_scan AS (
  SELECT key, t, 0::BIGINT AS p, NULL::VARCHAR AS m, NULL::BIGINT AS a FROM pl_texts
  UNION ALL
  SELECT key, t, CASE WHEN m IS NULL THEN a + 1 ELSE a + length(m) END, m, a FROM (
    SELECT key, t, a, CASE WHEN NOT regexp_matches(found, '^[{{\[<]$') THEN regexp_replace(found, '^([0-9][0-9.,e]*e)-$', '\1')
        WHEN k IS NULL THEN NULL WHEN found <> '<' OR (NOT regexp_matches(line[1:k], '[= ]') AND strlen(line[1:k]) >= 3 AND (regexp_matches(line[1:k], '[A-Za-z]') OR NOT regexp_matches(line[1:k], '[0-9]'))) THEN line[1:k] END AS m
    FROM (
      SELECT *, list_filter(range(1, length(line) + 1), lambda k: k > 1 AND k - length(replace(line[1:k], found, '')) = k - length(replace(line[1:k], CASE found WHEN '{{' THEN '}}' WHEN '[' THEN ']' ELSE '>' END, '')))[1] AS k
      FROM (
        SELECT key, t, p + length(regexp_extract(t[p + 1:], '(?s)^(.*?)(?:{_SPAN})', 1)) AS a, regexp_extract(t[p + 1:], '(?s)^.*?({_SPAN})', 1) AS found,
          regexp_extract(t[p + length(regexp_extract(t[p + 1:], '(?s)^(.*?)(?:{_SPAN})', 1)) + 1:], '^[^\n]*') AS line
        FROM pl_scan WHERE regexp_matches(t[p + 1:], '{_SPAN}'))))),
pl_spans AS (SELECT id, t, a, m, CASE WHEN regexp_matches(m, '^\{{') THEN 'braces' WHEN regexp_matches(m, '^\[') THEN 'square' WHEN regexp_matches(m, '^<') THEN 'angle' WHEN regexp_matches(m, '^\$') THEN 'shell' WHEN regexp_matches(m, '^["''‘’]') THEN 'quoted'
    WHEN regexp_matches(m, '^http') THEN 'url' WHEN regexp_full_match(m, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'iso-date' WHEN regexp_matches(m, '^[0-9]+年') THEN 'cn-date' WHEN regexp_matches(m, '^[0-9]') THEN 'number' ELSE 'email' END AS sub_tag
  , key FROM (SELECT key, m, a FROM pl_scan) JOIN pl_texts USING (key) WHERE m IS NOT NULL),
pl_slots AS (SELECT id, t, CAST(row_number() OVER (PARTITION BY key ORDER BY a) - 1 AS INT) AS slot_ord, CASE WHEN sub_tag IN ('braces', 'square', 'angle', 'shell', 'quoted') THEN 'placeholder' ELSE 'entity' END AS kind, m AS text, CAST(a AS INT) AS char_start, CAST(a + length(m) AS INT) AS char_end, sub_tag FROM pl_spans)"""


_PROMPTS = "SELECT DISTINCT id, original AS t FROM history WHERE original IS NOT NULL"
PLACEHOLDERS = f"WITH RECURSIVE {_placeholders(_PROMPTS)} SELECT id, slot_ord, kind, text, char_start, char_end, sub_tag FROM pl_slots"


def _all_slots(texts: str) -> str:
    """all_slots of the texts (id, t): placeholders, and the slots of the text's language, by place."""
    return f"""{_placeholders(texts)}, {_merged(texts)}, {_zh_slots(texts)},
of_both AS (SELECT *, 0 AS rank FROM pl_slots UNION ALL SELECT *, 1 FROM zh_slots UNION ALL SELECT *, 1 FROM en_slots WHERE NOT {_share('t', HAN + COMPAT + PUNCT, WS_RE2)} > 0.3),
all_slots AS (SELECT id, t, CAST(row_number() OVER (PARTITION BY id, t ORDER BY char_start, rank, slot_ord) - 1 AS INT) AS slot_ord, kind, text, char_start, char_end, sub_tag FROM of_both)"""


LOW_WORDS = f"""{SCORED}, u AS (SELECT doc_id, token, min(pos) AS pos, min(z) AS zipf FROM scored GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY zipf, pos) AS rank FROM u QUALIFY rank <= 6),
low AS (SELECT doc_id, string_agg('  - "' || token || '" (频率分: ' || printf('%.1f', round(zipf, 6)) || ')', chr(10) ORDER BY rank) AS words FROM x GROUP BY doc_id)
"""

_ANSWERS = f"""{LATEST}, e AS (SELECT id, original, optimized AS t FROM h WHERE original IS NOT NULL),
l AS (SELECT id, original, {LINES} AS lines FROM e), answers AS (SELECT id, original, CAST(n - 1 AS INT) AS pos, lines[n] AS text FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS n FROM l))"""
_ANSWER_DOCS = f"""{_ANSWERS}, d AS (SELECT doc_id, t, {L1.replace("(t,", "(original,")} AS own FROM (SELECT id AS doc_id, original AS t, original FROM e UNION ALL SELECT id || '/' || pos, text, original FROM answers))"""
# candidates guarded by the prompt's exact slots; where none passes, the first is kept
OPTIMIZED = f"""WITH RECURSIVE {_ANSWERS},
scores AS (SELECT doc_id, round(score, 9) AS score FROM ({_scored("SELECT doc_id, own AS lang FROM d", _ANSWER_DOCS)} SELECT doc_id, score FROM measures)),
{_all_slots("SELECT id, original AS t FROM e")},
exact AS (SELECT id, list(text) AS kept FROM all_slots WHERE kind IN ('placeholder', 'negation') GROUP BY id),
first AS (SELECT id, text, min(pos) AS pos FROM answers GROUP BY ALL),
judged AS (SELECT f.*, s.score, len(list_filter(coalesce(x.kept, []), lambda k: NOT contains(f.text, k))) = 0 AS passes FROM first f LEFT JOIN exact x USING (id) JOIN scores s ON s.doc_id = f.id || '/' || f.pos),
guarded AS (SELECT * FROM judged QUALIFY passes OR (NOT bool_or(passes) OVER (PARTITION BY id) AND pos = min(pos) OVER (PARTITION BY id))),
best AS (SELECT id, text, score FROM guarded QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) = 1)
SELECT e.id, original, CASE WHEN b.score >= o.score THEN b.text ELSE original END AS optimized, o.score AS original_score, CASE WHEN b.score >= o.score THEN b.score ELSE o.score END AS optimized_score, false AS second_applied
FROM e JOIN scores o ON o.doc_id = e.id LEFT JOIN best b ON b.id = e.id"""

SQL = {
    "optimize_prompts": OPTIMIZED,
    "json_sentences": "SELECT doc_id, 0 AS pos, text FROM documents WHERE text IS NOT NULL",
    "json_structure": f"""WITH {LATEST}, w AS (SELECT id, optimized, unnest(regexp_extract_all(original, '[^{WS_RE2}[:punct:]]+')) AS token, generate_subscripts(regexp_extract_all(original, '[^{WS_RE2}[:punct:]]+'), 1) AS i FROM h),
m AS (SELECT id, '[' || string_agg('{{"kind":"negation","text":"' || token || '","issue":"missing"}}', ',' ORDER BY i) || ']' AS reply FROM w WHERE lower(token) IN ('not', 'no', 'never', 'neither', 'nor', 'cannot') AND NOT contains(optimized, token) GROUP BY id)
SELECT id, coalesce(reply, '[]') AS reply FROM h LEFT JOIN m USING (id)""",
    "json_verify": VERIFIED + "SELECT id, round(CASE WHEN bool_or(kind = 'negation' AND NOT passes) THEN 0.0 ELSE avg(similarity) END, 9) AS preservation, bool_and(passes) AS passes FROM verified GROUP BY id",
    "json_substitutions": f"""SELECT domain_key, lang, original, candidate, '{{"verdict":"' || verdict || '","is_safe":' || CASE WHEN safe THEN 'true' ELSE 'false' END || ',"label":"' ||
CASE verdict WHEN 'Allowed' THEN '等价替换' WHEN 'Narrowing' THEN '语义收窄（父→子）' WHEN 'Widening' THEN '语义扩展（子→父）' WHEN 'Unrelated' THEN '无本体关系' ELSE '跨分支替换' END || '"}}' AS reply FROM ({VERDICTS})""",
    "slots_en_merged": MERGED,
    "slots_chinese": f"WITH RECURSIVE {_zh_slots(_PROMPTS)} SELECT id, slot_ord, kind, text, char_start, char_end, sub_tag FROM zh_slots",
    "slots_merged": f"WITH RECURSIVE {_all_slots(_PROMPTS)} SELECT id, slot_ord, kind, text, char_start, char_end, sub_tag FROM all_slots",
    "slots_zh": f"WITH RECURSIVE {_all_slots(_PROMPTS)} SELECT id, slot_ord, kind, text, char_start, char_end, sub_tag FROM all_slots",
    "structural_check": f"""WITH RECURSIVE {LATEST}, {_all_slots("SELECT id, original AS t FROM h WHERE original IS NOT NULL")}
SELECT id, slot_ord, kind, text, CASE WHEN NOT contains(coalesce(optimized, ''), text) THEN 'missing' END AS issue FROM all_slots JOIN h USING (id) WHERE kind IN ('placeholder', 'negation')""",
    "placeholder_slots": PLACEHOLDERS,
    "verify_slots": VERIFIED + "SELECT * FROM verified",
    "slot_preservation": VERIFIED + """SELECT id, round(CASE WHEN bool_or(kind = 'negation' AND NOT passes) THEN 0.0 ELSE avg(similarity) END, 9) AS preservation, bool_and(passes) AS passes, count(*) AS total, count(*) FILTER (WHERE passes) AS kept,
count(*) FILTER (WHERE NOT passes) AS dropped, count(*) FILTER (WHERE NOT passes) / count(*) > 0.5 AS bad FROM verified GROUP BY id""",
    "substitutions_unsafe": f"SELECT * FROM ({VERDICTS}) WHERE NOT safe",
    "changed_words": f"""WITH {LATEST}, w AS (SELECT id, {K7.replace("(t,", "(original,")} AS o, {K7.replace("(t,", "(optimized,")} AS c FROM h),
g AS (SELECT id, list_filter(o, lambda x: NOT list_contains(c, x))[1] AS original, list_filter(c, lambda x: NOT list_contains(o, x)) AS new FROM w) SELECT id, original, unnest(new) AS candidate FROM g WHERE original IS NOT NULL""",
    "lowest_live": f"{SCORED} SELECT doc_id, pos, token, z AS zipf, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY z, pos) AS INT) AS rank FROM scored QUALIFY rank <= 3",
    "escaped": "SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;') AS html, replace(replace(replace(replace(source, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS attribute FROM documents",
    "content_words": f"WITH {TOKENS}, u AS (SELECT DISTINCT token, lower(token) AS w FROM tokens) SELECT token, {TAG} IN ('verb', 'noun', 'adjective', 'adverb') AS content FROM u",
    "answer_candidates": f"WITH {LATEST}, l AS (SELECT id, {LINES} AS lines FROM (SELECT id, optimized AS t FROM h)), n AS (SELECT id, lines, unnest(range(1, len(lines) + 1)) AS k FROM l) SELECT id, CAST(k - 1 AS INT) AS pos, lines[k] AS text FROM n",
    "low_word_requests": LOW_WORDS + "SELECT * FROM low",
    "replace_requests": LOW_WORDS + f""", a AS (SELECT doc_id, text, words, {L1.replace("(t,", "(text,")} AS lang FROM documents JOIN low USING (doc_id) WHERE contains(words, chr(10)) AND text IS NOT NULL)
SELECT doc_id, CASE WHEN lang = 'zh' THEN '原始句子：' || chr(10) || text || chr(10) || chr(10) || '需要替换的低频词（分数越低越需要换）：' || chr(10) || words || chr(10) || chr(10) || '请只替换这些词，生成 4 个版本：'
ELSE 'Original sentence:' || chr(10) || text || chr(10) || chr(10) || 'Low-frequency words to replace (lower = rarer):' || chr(10) || words || chr(10) || chr(10) || 'Replace only these words, generate 4 versions:' END AS prompt FROM a""",
    "history_import_count": "WITH h AS (SELECT *, coalesce(epoch_us(saved_at) / 1e6 - ts_millis / 1000 > 86400, false) AS late FROM history) SELECT count(*) AS imported FROM h WHERE late AND coalesce(id, '') <> '' AND coalesce(original, '') <> '' AND id NOT IN (SELECT id FROM h WHERE NOT late AND id IS NOT NULL)",
    "slot_kinds": f"""WITH {_slots_of('SELECT DISTINCT id, original AS t FROM history')} SELECT DISTINCT kind, CASE kind WHEN 'action' THEN '动作 (Action)' WHEN 'object' THEN '对象 (Object)' WHEN 'modifier' THEN '修饰 (Modifier)' WHEN 'qtype' THEN '问法 (Q-Type)' WHEN 'register' THEN '语体 (Register)' WHEN 'entity' THEN '实体 (Entity)' WHEN 'negation' THEN '否定 (Negation)' WHEN 'condition' THEN '条件 (Condition)' END AS name,
CASE kind WHEN 'action' THEN 0.85 WHEN 'object' THEN 0.90 WHEN 'modifier' THEN 0.75 WHEN 'qtype' THEN 0.95 WHEN 'register' THEN 0.80 WHEN 'entity' THEN 0.95 WHEN 'condition' THEN 0.90 WHEN 'negation' THEN 1.0 END::DOUBLE AS threshold, kind = 'negation' AS exact FROM slots""",
    "weights_valid": "SELECT id, abs(original_score / 10 + optimized_score / 10 + 0.2 - 1.0) < 0.01 AS valid FROM (SELECT DISTINCT id, original_score, optimized_score FROM history)",
    "score_candidates": _scored(OWN, BOTH) + f""", lost AS (SELECT DISTINCT id FROM (SELECT id, optimized, unnest(regexp_extract_all(original, '[^{WS_RE2}[:punct:]]+')) AS token FROM e) WHERE lower(token) IN ('not', 'no', 'never', 'neither', 'nor', 'n''t', 'cannot') AND NOT coalesce(contains(optimized, token), false)),
f AS (SELECT id, pos, round(0.4 * score + 0.2 * collocation + 0.15 * complexity + 0.15 * CASE WHEN pos = 0 AND id IN (SELECT id FROM lost) THEN 0.0 ELSE 1.0 END, 9) AS final_score FROM d JOIN measures USING (doc_id))
SELECT id, pos, final_score, CAST(row_number() OVER (PARTITION BY id ORDER BY final_score DESC, pos) AS INT) AS rank FROM f""",
    "text_hashes": """WITH h AS (SELECT DISTINCT id, original FROM history), u AS (SELECT id, original, list_transform(range(1, length(coalesce(original, '')) + 1), lambda i: unicode(substring(original, i, 1))::BIGINT) AS cp FROM h),
w AS (SELECT id, list_prepend(0::BIGINT, flatten(list_transform(cp, lambda c: CASE WHEN c > 65535 THEN [55296 + ((c - 65536) >> 10), 56320 + ((c - 65536) & 1023)] ELSE [c] END))) AS units FROM u),
r AS (SELECT id, list_reduce(units, lambda a, x: (a * 31 + x) & 4294967295) AS h FROM w) SELECT id, CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END AS h FROM r""",
    "lang_detect": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, {L1} AS l1, {_share('t', HAN + COMPAT + PUNCT, WS_RE2)} > 0.3 AS l2, {_zh(_share('t', HAN + PUNCT, WS_RE2 + chr(92) + 'x{FEFF}', False) + ' > 0.3')} AS l3, {_zh(f"regexp_matches(t, '[{CJK_ZH}]')")} AS l4, {_zh(f"regexp_matches(substring(t, 1, 100), '[{CJK_ZH}]')")} AS l5 FROM d",
    "token_counts": f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, CAST(len({K1}) AS INT) AS k1, CAST(len({K3}) AS INT) AS k3, CAST(len({K4}) AS INT) AS k4, CAST(len({K5}) AS INT) AS k5, CAST(len({K7}) AS INT) AS k7 FROM d",
    "zipf_table": f"WITH {TOKENS}, {_table('x', 'token')} SELECT word, n AS count, zipf FROM x",
    "zipf_top_n": f"WITH {TOKENS}, {_table('x', 'token')} SELECT word, n AS count, zipf FROM x ORDER BY n DESC, word LIMIT 20",
    "domain_tables": f"WITH {DOCS}, {DOMAIN} SELECT name, word, n AS count, zipf FROM domain_table",
    "token_scores": f"{SCORED} SELECT doc_id, pos, token, z AS zipf FROM scored",
    "sentence_measures": f"{SCORED} SELECT *, 0.4 * score + 0.2 * collocation + 0.15 * complexity + 0.15 AS final_score FROM measures",
    "lowest_tokens": f"{SCORED}, u AS (SELECT doc_id, token, min(pos) AS pos, min(z) AS zipf FROM scored GROUP BY ALL) SELECT doc_id, token, zipf, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY zipf, pos) AS INT) AS rank FROM u QUALIFY rank <= 5",
    "rank_sentences": f"{_scored(BATCH)} SELECT doc_id, bitext_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY bitext_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM d JOIN measures USING (doc_id)",
    "hybrid_score": f"""{SCORED}, {DOMAIN}, s AS (SELECT doc_id, raw, x.zipf AS dz FROM scored JOIN d USING (doc_id) LEFT JOIN domain_table x ON x.name = coalesce(d.source, '') AND x.word = token),
g AS (SELECT doc_id, exp(avg(ln(coalesce(0.6 * raw + 0.4 * dz, raw) + 1e-12))) AS h, count(*) AS n, count(dz) AS hit FROM s GROUP BY 1)
SELECT doc_id, coalesce(h, 0) AS hybrid_score, coalesce(n, 0) AS token_count, coalesce(hit / greatest(n, 1), 0) AS domain_coverage FROM d LEFT JOIN g USING (doc_id)""",
    "domain_detect": DETECT,
    "onto_closure": CLOSURE + "SELECT domain_key, lang, id, name FROM walk",
    "substitution_verdicts": VERDICTS,
    "pos_tags": f"WITH {TOKENS}, u AS (SELECT DISTINCT token, lower(token) AS w FROM tokens) SELECT token, {TAG} AS en FROM u",
    "slots_en": SLOTS,
    "segment_chinese": f"WITH RECURSIVE {_cut('SELECT doc_id, text AS t FROM documents WHERE ' + f"regexp_matches(text, '[{CJK_ZH}]')")} SELECT doc_id, pos, token FROM cut",
    "cosine_neighbours": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 9) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query, neighbour, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "history_newest": f"WITH {LATEST} SELECT id, ts_millis FROM h ORDER BY ts_millis DESC, id LIMIT 50",
    "history_import": "WITH h AS (SELECT *, coalesce(epoch_us(saved_at) / 1e6 - ts_millis / 1000 > 86400, false) AS late FROM history) SELECT id, ts_millis, original FROM h WHERE late AND coalesce(id, '') <> '' AND coalesce(original, '') <> '' AND id NOT IN (SELECT id FROM h WHERE NOT late AND id IS NOT NULL)",
    "best_candidates": f"""WITH {LATEST}, c AS (SELECT id, 0 AS pos, optimized AS text, coalesce(optimized_score, 0.0) AS score, false AS is_original FROM h WHERE original IS NOT NULL AND optimized IS NOT NULL
UNION ALL SELECT id, 1, original, coalesce(original_score, 0.0), true FROM h WHERE original IS NOT NULL AND optimized IS NOT NULL)
SELECT id, text, score, is_original, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS INT) AS rank FROM c""",
    "score_bands": """WITH h AS (SELECT DISTINCT id, original_score AS o, optimized_score AS s FROM history)
SELECT id, CASE WHEN s >= 5 THEN 'score-high' WHEN s >= 4 THEN 'score-mid' ELSE 'score-low' END AS band, CASE WHEN s >= 6 THEN 'wf-high' WHEN s >= 4.5 THEN 'wf-mid' ELSE 'wf-low' END AS word_band,
CASE WHEN s - o > 0.05 THEN 'delta-pos' WHEN s - o < -0.05 THEN 'delta-neg' ELSE 'delta-neu' END AS delta, greatest(0.03, CASE WHEN s IS NULL THEN 1.0 ELSE least(s / 8.0, 1.0) END) AS ring FROM h""",
}

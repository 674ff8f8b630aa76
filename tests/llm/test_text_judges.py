"""Language identification, broken pairs and abuse."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zipfloom.llm import abuse, langid, pairs
from zipfloom.llm import segment as S

NOUNS = {"en": "report garden bridge letter school engine".split(), "de": "Bericht Garten Brücke Brief Schule Motor".split(), "fr": "rapport jardin pont lettre école moteur".split(), "es": "informe jardín puente carta escuela motor".split(), "zh": "报告 花园 旧桥 信件 学校 引擎".split(), "ja": "報告書 庭 橋 手紙 学校 機械".split()}
FRAMES = {
    "en": ["The mayor still checks the {} with the {} every morning.", "Please write a short note about the {} and why the {} matters.", "Nobody knows when the {} will be finished."],
    "de": ["Der Bürgermeister prüft jeden Morgen den Zustand von {} und {}.", "Bitte schreiben Sie eine kurze Notiz über {} und warum {} wichtig ist.", "Niemand weiß, wann {} fertig wird."],
    "fr": ["Le maire vérifie chaque matin l'état de {} et de {}.", "Veuillez écrire une courte note sur {} et dire pourquoi {} compte.", "Personne ne sait quand {} sera fini."],
    "es": ["El alcalde revisa cada mañana el estado de {} y de {}.", "Por favor, escriba una nota corta sobre {} y por qué {} importa.", "Nadie sabe cuándo estará terminado {}."],
    "zh": ["市长每天早上检查{}和{}的情况。", "请写一段关于{}的短文，并说明{}为什么重要。", "没有人知道{}什么时候完成。"],
    "ja": ["市長は毎朝{}と{}の様子を調べています。", "{}について短い文章を書き、{}がなぜ大切か説明してください。", "{}がいつ終わるのか誰も知りません。"],
}


def sentence(rng, lang):
    f = rng.choice(FRAMES[lang])
    return f.format(*[rng.choice(NOUNS[lang]) for _ in range(f.count("{}"))])


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = []
    for lang in langid.LANGS:
        for _ in range(120):
            text = " ".join(sentence(rng, lang) for _ in range(2))
            rows.append((lang if rng.random() > 0.1 else rng.choice(langid.LANGS), text))
    return langid.train(rows)


def test_held_out_accuracy(model):
    rng = random.Random(9)
    truth = [(lang, sentence(rng, lang)) for lang in langid.LANGS for _ in range(60)]
    got = langid.judged(model, [t for _, t in truth])
    right = sum(langid.main_language(g) == lang for (lang, _), g in zip(truth, got))
    assert right >= 0.98 * len(truth)
    assert all(0 <= s[3] <= 1 for g in got for s in g)


def test_probabilities_sum_to_one(model):
    """After a seen context the known characters and the rest share one."""
    for ctx in ("the mayo", "der ", "市长"):
        chars = sorted({c for t in [*FRAMES["en"], *FRAMES["de"], *FRAMES["zh"]] for c in t.lower()} | {"\x03"})
        one, _ = model.scores([ctx])
        total = np.zeros(len(model.langs))
        base = _raw(model, ctx)
        for c in chars:
            total += np.exp(_raw(model, ctx + c) - base)
        assert (total <= 1.02).all() and total.max() > 0.5


def _raw(model, text):
    """Sum of log probabilities without the end mark."""
    mean, n = model.scores([text])
    codes, live, _ = langid._codes([text])
    end, _ = model.scores([text])
    # the end mark's own share is taken off by scoring it apart
    h = None
    for k in range(langid.ORDER, 0, -1):
        key = langid._hashes(codes, k)[-1]
        keys, logp = model.tables[k]
        at = min(int(np.searchsorted(keys, key)), len(keys) - 1)
        if keys[at] == key:
            tail = logp[at] + (0 if h is None else h)
            break
        if k > 1:
            ckey = langid._hashes(codes, k - 1)[-2]
            ckeys, bow = model.contexts[k]
            cat = min(int(np.searchsorted(ckeys, ckey)), len(ckeys) - 1)
            if ckeys[cat] == ckey:
                h = (0 if h is None else h) + bow[cat]
    else:
        tail = model.floor + (0 if h is None else h)
    return end[0] * n[0] - tail


def test_sentences_cover_the_text():
    for t in ("One. Two!  Three? ", "一。二！三", "a / b\nc", "v1.2 is out.md now.", "", "  "):
        spans = S.sentences(t)
        assert "".join(t[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == t.replace(" ", "").replace("\n", "")


HISTORY = "id string, ts_millis long, original string, optimized string, optimized_score double, original_score double, lang string, saved_at timestamp, code string"
NAMES = [("en", "en"), ("English", "en"), ("de", "de"), ("Deutsch", "de"), ("zh", "zh"), ("fr", "fr"), ("ja", "ja"), ("es", "es")]


def history(spark, rows):
    return spark.createDataFrame([(i, 1, o, p, None, None, lang, dt.datetime(2024, 1, 1 + k), "clash") for i, o, p, lang, k in rows], HISTORY)


def test_labels(spark, model):
    en, de = "The mayor checks the bridge every single morning.", "Der Bürgermeister prüft jeden Morgen die alte Brücke."
    rows = [
        ("ok", en, "", " English ", 0), ("wrong", en, "", "de", 0), ("none", de, "", None, 0), ("odd", de, "", "???", 0), ("mixed", f"{en} {de}", "", "en", 0), ("quoted", 'The mayor says "Der Bürgermeister prüft die Brücke" and leaves it.', "", "en", 0),
        ("null", None, "", "en", 0), ("blank", " 　", "", None, 0), ("marks", "?! 42 {x}", "", None, 0), ("again", de, "", "en", 0), ("again", de, "", "de", 1), (None, en, "", "de", 0), ("long", f"{en} " * 3000, "", "fr", 0),
    ]
    names = spark.createDataFrame(NAMES, "spelling string, lang string")
    h = langid.with_code(langid.latest(history(spark, rows)), names)
    got = sorted((r["id"], r["kind"], r["lang"]) for r in langid.findings(langid.identify(h, model, "entries")).collect())
    assert got == [("long", "wrong", "en"), ("mixed", "mixed", "de"), ("mixed", "mixed", "en"), ("none", "missing", "de"), ("odd", "missing", "de"), ("wrong", "wrong", "en")]
    segs = [r for r in langid.identify(h, model, "segments").collect() if r["id"] == "mixed"]
    assert [r["lang"] for r in sorted(segs, key=lambda r: r["seg_no"])] == ["en", "de"]
    assert langid.identify(h.limit(0), model, "segments").count() == 0


def test_model_of_empty_history(spark):
    m = langid.model_of(history(spark, []), spark.createDataFrame([], "spelling string, lang string"))
    assert langid.main_language(langid.judged(m, ["Please write to me if you need anything else."])[0]) == "en"


def test_gibberish_is_rejected(model):
    assert langid.judged(model, ["qzxv wqjk zzxq vvkq jqxz qqwz xkcd"])[0][0][2] == "und"


O_EN = "Please explain the effect of the new bridge on the old garden. The mayor still has 12 days for it."
PAIRS = [
    ("e1", O_EN, None, "empty"), ("e2", O_EN, "N/A", "empty"), ("e3", O_EN, "Here is the improved version:\n", "empty"), ("e4", O_EN, "​", "empty"), ("e5", O_EN, "（无）", "empty"), ("e6", O_EN, "...", "empty"),
    ("r1", O_EN, "I'm sorry, but I can't help with that request.", "refusal"), ("r2", O_EN, "对不起，我无法完成这个请求。", "refusal"), ("r3", O_EN, "Leider kann ich dabei nicht helfen.", "refusal"), ("r4", O_EN, "申し訳ありませんが、そのご依頼にはお応えできません。", "refusal"), ("r5", O_EN, "No puedo ayudar con esa solicitud.", "refusal"), ("r6", O_EN, "Je ne peux pas répondre à cette demande.", "refusal"),
    ("c1", O_EN, O_EN, "copy"), ("c2", O_EN, O_EN.upper().replace(".", " !"), "copy"), ("c3", O_EN, f"Optimized:\n**{O_EN}**", "copy"), ("c4", O_EN, f"{O_EN}\n{O_EN}", "copy"), ("c5", O_EN, f"{O_EN} Begin with a one-line summary.", None),
    ("t1", O_EN, "Say in plain words how the new bridge changes the old garden. The mayor still has", "truncated"), ("t2", O_EN, "Say in plain words how the new bridge changes the", "truncated"), ("t3", O_EN, "Say how it changes (the old", "truncated"), ("t4", O_EN, "Say in plain words how the new bridge changes the old garden. The mayor still has 12 days for it", None), ("t5", O_EN, "Say in plain words how it changes,", "truncated"),
    ("o1", O_EN, "Erkläre mit einfachen Worten, wie die neue Brücke den alten Garten verändert. Der Bürgermeister hat noch 12 Tage.", "other_language"),
    ("g1", O_EN, "Say in plain words how the new bridge changes the old garden.", None), ("g2", 'Find kinder words than "I cannot help with that request."', 'Look for nicer words than "I cannot help with that request."', None), ("n1", None, None, None), ("n2", "", "x", None),
]


def test_pairs(spark, model, write):
    h = history(spark, [(i, o, p, "en", 0) for i, o, p, _ in PAIRS] + [("e1", O_EN, None, "en", 1)])
    h = write(langid.latest(h), "h")
    first = write(pairs.first_pass(h, model), "first")
    got = {r["id"]: r["defect"] for r in pairs.settle(first, pairs.sentence_ends(h)).collect()}
    assert got == {i: d for i, _, _, d in PAIRS if d}
    none = h.limit(0)
    assert pairs.settle(pairs.first_pass(none, model), pairs.sentence_ends(none)).count() == 0


def test_pushdown():
    assert pairs.open_at_end("a (b [c") == ["(", "["]
    assert pairs.open_at_end("```\n(\n``` done (x)") == []
    assert pairs.open_at_end('say "x" and **bold') == ["**"]
    assert pairs.open_at_end(":) fine") == []


def test_tiles():
    a, b = list("abcxyz"), list("xyzabc")
    assert sorted(pairs.tiles(a, b)) == [(0, 3, 3), (3, 0, 3)]
    assert pairs.tiles(list("aaaa"), list("aaa")) == [(0, 0, 3)]


ABUSE = [
    ("Shut up, you moron.", True), ("Listen, i d i o t, nobody here can stand you.", True), ("You useless b*****d!", True), ("What a pathetic h4lfw17, I hope you rot.", True), ("You stupid m​o​r​o​n", True), ("Halt die Klappe, du Trottel.", True), ("闭嘴，你这个废·物。", True), ("黙れ、この間抜け。", True),
    ("I will find out where you live and break your hands.", True), ("They are vermin and should be driven out of town.", True), ("She masturbated on camera.", True),
    ("The handbook says that calling a colleague an idiot leads to a warning.", False), ("Hate speech is rising, the report warns.", False), ("The script kills the stuck process.", False), ("The nurse explains breast cancer screening.", False), ("The vermin in the grain store must be driven out before winter.", False),
    ("手册规定，骂同事废物会受到警告。", False), ("The loser of the match pays for dinner.", False), (None, False), ("", False), ("   ", False),
]


def test_abuse(spark):
    df = spark.createDataFrame([(i, t, None if i % 2 else "s", 0.5) for i, (t, _) in enumerate(ABUSE)], "doc_id long, text string, source string, score double")
    s = abuse.scores(df).cache()
    got = {r["doc_id"]: r["score"] >= abuse.FLAG for r in s.collect()}
    assert got == {i: w for i, (_, w) in enumerate(ABUSE)}
    rates = {r["source"]: r for r in abuse.rates(s).collect()}
    assert rates[None]["documents"] + rates["s"]["documents"] == len(ABUSE)
    assert sum(r["flagged"] for r in rates.values()) == sum(w for _, w in ABUSE)
    assert abuse.scores(df.limit(0)).count() == 0


def test_abuse_reads_to_the_end():
    assert abuse.scorer().text("The museum opens today. " * 5000 + "Shut up, you moron.")[0] >= abuse.FLAG


def test_ordinary_words(spark):
    rows = [(i, "El horno de la cocina", "s") for i in range(5)] + [(9, "a porn clip", "s"), (10, "a moronn", "s")]
    words = abuse.ordinary_words(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert "horno" in words and "moronn" not in words


def near_by_distance(word, term):
    d = [[i + j if not i * j else 0 for j in range(len(term) + 1)] for i in range(len(word) + 1)]
    for i in range(1, len(word) + 1):
        for j in range(1, len(term) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (word[i - 1] != term[j - 1] and word[i - 1] != "*"))
            if i > 1 and j > 1 and word[i - 1] == term[j - 2] and word[i - 2] == term[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_distance():
    lex = abuse.scorer().lex
    rng = random.Random(4)
    terms = [w for w in lex.words if not w.endswith("-") and len(w) >= 5]
    for _ in range(120):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], ["x"], [w[k], "x"], ["*"]])
        w = "".join(w)
        if len(w) < 3:
            continue
        got = {k for k, v in lex.near(w, 1).items()}
        want = {lex.words[t] for t in terms if near_by_distance(w, t) <= 1}
        assert want <= got
        assert all(near_by_distance(w, t) <= 1 for t, k in lex.words.items() if k in got and not t.endswith("-"))


def test_copies_by_tiling():
    o = "Write a poem about cats."
    for r in ("1. " + o, "① " + o, "Neuer Entwurf folgt: " + o + " " + o, "1. " + o + "\n2. " + o, "Neuer Entwurf folgt:\n1. " + o + "\n2. " + o):
        assert pairs.is_copy(o, r), r
    assert pairs.is_copy("写一首诗", "1. 写一首诗")
    assert pairs.is_copy("First point\nSecond point", "1. First point\n2. Second point")
    for r in ("Please write a poem about cats.", "About cats: write a poem.", "1. Write a poem about dogs.", o + " Make it 1 page.", "2.5 " + o):
        assert not pairs.is_copy(o, r), r


def test_gapped_phrases_at_any_place():
    sc = abuse.Scorer(frozenset())
    plain = sc._chained([{(0, 1): 1.0}, {(3, 5): 1.0}])
    assert plain == (0, 1.0)
    # the first part also earlier, the second also before the first
    assert sc._chained([{(0, 1): 1.0, (30, 31): 1.0}, {(33, 35): 1.0}]) == (30, 1.0)
    assert sc._chained([{(10, 11): 1.0}, {(0, 2): 1.0, (13, 15): 0.85}]) == (10, 0.85)
    assert sc._chained([{(10, 11): 1.0}, {(0, 2): 1.0}]) is None and sc._chained([{(0, 1): 1.0}, {(16, 18): 1.0}]) is None

    def told(text):
        return {h[:2] for h in sc._cjk_hits(text) if h[0] in abuse.TOLD}

    assert told("你真的太蠢")
    long = "你昨天在会议上说过的那些话我都认真地记下来了，你真的太蠢"
    for text in (long, "太蠢的是这件事，可是你也太蠢"):
        assert told(text) == told("你真的太蠢"), text


def test_one_misspelled_term_is_enough():
    sc = abuse.Scorer(frozenset())
    for t in ("You moronn.", "You moronn!", "They are vermyn and should go."):
        assert sc.text(t)[0] >= abuse.FLAG, t
    assert abuse.Scorer(frozenset({"canal"})).text("Ils ont ouvert une boulangerie au bord du canal!")[0] < abuse.FLAG
    for t in ("The moronn left.", "For project Tetar, the clerk repairs the meter.", "The handbook says that calling a colleague a moronn leads to a warning."):
        assert sc.text(t)[0] < abuse.FLAG, t


def test_ordinary_words_by_share(spark):
    near = ["You moronn."] * 4
    few = spark.createDataFrame([(t,) for t in near], "text string")
    many = spark.createDataFrame([(t,) for t in near + ["Good day."] * 19_996], "text string")
    assert "moronn" in abuse.ordinary_words(few) and "moronn" not in abuse.ordinary_words(many)


def test_abuse_on_unseen_wordings():
    from .abuse_wordings import ABUSIVE, HARMLESS

    sc = abuse.Scorer()
    flags = lambda lines: [sc.text(x)[0] >= abuse.FLAG for x in lines.splitlines()]
    hit = [f for lines in ABUSIVE.values() for f in flags(lines)]
    assert sum(hit) >= 0.9 * len(hit)
    assert sum(flags(HARMLESS)) <= 0.05 * len(HARMLESS.splitlines())


def test_quotation_told_of_in_the_next_sentence():
    sc = abuse.Scorer()
    assert sc.text('"You are a filthy bastard." The court fined him for it.')[0] < abuse.FLAG
    assert sc.text("You are a filthy bastard. The court fined him for it.")[0] >= abuse.FLAG


def test_scripts_without_a_model_have_segments(model):
    segs = langid.judged(model, ["Сегодня хорошая погода. 오늘 날씨가 좋습니다. The mayor still checks the bridge."])[0]
    assert [s[2] for s in segs] == ["und", "und", "en"] and segs[0][3] == 0.0
    assert all(0 <= s[0] < s[1] for s in segs)


def test_a_seventh_language_comes_from_its_labels():
    ru = ["Мэр каждое утро проверяет состояние моста и сада.", "Никто не знает, когда будет готов отчёт.", "Напишите, пожалуйста, короткую записку о школе."] * 8
    rng = random.Random(4)
    rows = [("ru", t) for t in ru] + [(lang, sentence(rng, lang)) for lang in ("en", "de") for _ in range(40)]
    m = langid.train(rows)
    assert "ru" in m.langs and langid.main_language(langid.judged(m, ["Мэр не знает, когда будет готов мост."])[0]) == "ru"


def test_kana_is_a_feature_of_the_model(model):
    got = [langid.main_language(x) for x in langid.judged(model, ["市长每天早上检查花园的情况。", "市長は毎朝庭の様子を調べています。"])]
    assert got == ["zh", "ja"] and (np.exp(model.kana).sum(axis=0) < 1.01).all()


def test_refusals_of_unseen_wordings():
    from .refusal_wordings import ANSWERS, REFUSALS

    hit = [pairs.refuses(x, "Write a poem about bridges.") for x in REFUSALS.splitlines()]
    assert sum(hit) >= 0.9 * len(hit)
    assert not any(pairs.refuses(x, "Please say something about the town.") for x in ANSWERS.splitlines())
    # a rewrite that keeps the prompt is none, whatever it says
    prompt = "I cannot help my neighbour with the old bridge and the garden fence today."
    assert not pairs.refuses("Well: I cannot help my neighbour with the old bridge or the garden fence today.", prompt)


def test_pushdown_parser():
    is_open = lambda t: bool(pairs.open_at_end(t)) or pairs.cut_mark(t)
    for t in ("<ul><li>one</li><li>two", "A word in *emph", "1. one\n2. two\n3.", "# Title\n##", "text <div", "say (this", "**bold", "a `code", "```\nx", "„so", "x\n- one\n-"):
        assert is_open(t), t
    for t in ("<ul><li>one<li>two</ul>", "*emph* and _more_", "1. one\n2. two", "a * b * c", "snake_case_name", "<name> writes <br> here", "*open\n\nnext paragraph", ":-) done", "2*3", "{x} [y] (z)"):
        assert not is_open(t), t


def test_copies_behind_long_lead_ins():
    original = "Please write a short note about the bridge and why it matters to the town."
    lead = "After thinking about what you asked for and reading it several times I would like to offer you the following improved version"
    assert pairs.is_copy(original, f"{lead}: {original}") and pairs.is_copy(original, f"My version of it - {original}") and pairs.is_copy(original, f"{lead}:\n1. {original}\n2. {original}")
    assert not pairs.is_copy(original, f"{original} Add where it was built.") and not pairs.is_copy(original, f"The bridge is old. It is long. {original}")

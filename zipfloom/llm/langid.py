"""Language of documents and of the segments of mixed ones.

Interpolated Kneser-Ney character models, one per language, kept as sorted hash arrays: for every n-gram that
any language has seen, the row of all languages' log probabilities with the backing-off already done, so a
position costs one binary search where its longest n-gram is known. To the log probabilities of the characters
comes that of one feature of the clause, its use of kana, counted per language in the fitted text. The lowest
length-normalised cross-entropy wins; segments worse than a limit calibrated on text of other sources, in the
language and in languages without a model, are rejected ("und"). Segments of scripts no model is of are "und" too.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segment as S

LANGS = ("de", "en", "es", "fr", "ja", "zh")
ORDER = 5
SLICE_CHARS = 500_000
SAMPLE = 2500  # labelled rows a language the models are fitted on, at most
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCRIPT = {"ja": "cjk", "zh": "cjk"}  # of languages without text to count; the others by most of their labelled text
KANA_WEIGHT = 3.0  # characters the use of kana counts for

# Seeds so that a language without labelled rows has a model too, and everyday words are known; our own sentences.
SEEDS = {
    "de": "Das ist ein kurzer Text, der zeigt, wie die Sprache klingt. Wir haben gestern lange darüber gesprochen und sind uns nicht einig geworden. Bitte schreiben Sie mir, wenn Sie noch etwas brauchen. Die Kinder spielen im Garten, während ihre Eltern arbeiten. Was möchtest du heute machen? Ich weiß nicht, ob er morgen wieder nach Hause kommt. Am Abend gehen wir oft noch eine Stunde durch den Wald. Sie hat ihre Schlüssel im Zug vergessen und musste auf ihren Bruder warten. Das Essen war gut, aber ein bisschen zu scharf für mich. Kannst du mir sagen, wann der nächste Bus fährt? Früher lebten hier viel mehr Menschen als jetzt. Man sollte nicht alles glauben, was in der Zeitung steht.",
    "en": "This is a short text that shows what the language sounds like. We talked about it for a long time yesterday and could not agree. Please write to me if you need anything else. The children play in the garden while their parents are working. What would you like to do today? I do not know whether he will come home again tomorrow. In the evening we often walk through the woods for an hour. She left her keys on the train and had to wait for her brother. The food was good but a little too hot for me. Could you tell me when the next bus leaves? Many more people used to live here than now. You should not believe everything that is in the paper.",
    "es": "Este es un texto corto que muestra cómo suena el idioma. Ayer hablamos mucho de ello y no nos pusimos de acuerdo. Por favor, escríbame si necesita algo más. Los niños juegan en el jardín mientras sus padres trabajan. ¿Qué te gustaría hacer hoy? No sé si mañana volverá a casa. Por la tarde solemos caminar una hora por el bosque. Ella olvidó las llaves en el tren y tuvo que esperar a su hermano. La comida estaba buena, pero un poco picante para mí. ¿Me puedes decir cuándo sale el próximo autobús? Antes vivía aquí mucha más gente que ahora. No hay que creer todo lo que dice el periódico.",
    "fr": "Ceci est un court texte qui montre comment sonne la langue. Nous en avons parlé longtemps hier et nous ne sommes pas tombés d'accord. Écrivez-moi si vous avez besoin d'autre chose. Les enfants jouent dans le jardin pendant que leurs parents travaillent. Que veux-tu faire aujourd'hui ? Je ne sais pas s'il rentrera chez lui demain. Le soir, nous marchons souvent une heure dans la forêt. Elle a oublié ses clés dans le train et a dû attendre son frère. Le repas était bon, mais un peu trop épicé pour moi. Peux-tu me dire quand part le prochain bus ? Autrefois, beaucoup plus de gens vivaient ici. Il ne faut pas croire tout ce qui est écrit dans le journal.",
    "ja": "これは言葉の響きを示す短い文章です。昨日は長い時間それについて話しましたが、意見は合いませんでした。ほかに必要なものがあれば書いてください。両親が働いている間、子供たちは庭で遊んでいます。今日は何をしたいですか。明日彼が家に帰ってくるかどうか分かりません。夜にはよく森の中を一時間ほど歩きます。彼女は電車に鍵を忘れて、兄を待たなければなりませんでした。料理はおいしかったけれど、私には少し辛すぎました。次のバスはいつ出るか教えてくれますか。昔はここにもっと多くの人が住んでいました。新聞に書いてあることを全部信じてはいけない。",
    "zh": "这是一段短文，用来展示这种语言的样子。昨天我们谈了很久，但没有达成一致。如果您还需要什么，请写信给我。父母工作的时候，孩子们在花园里玩。你今天想做什么？我不知道他明天会不会回家。晚上我们常常在树林里走一个小时。她把钥匙忘在火车上，只好等她的哥哥。饭菜很好吃，不过对我来说有点辣。你能告诉我下一班公共汽车什么时候开吗？以前这里住的人比现在多得多。报纸上写的东西不能全信。",
}
# Sentences to calibrate the limit and the confidence on, in none of the fitted texts: of the languages with seeds, and
# of languages nothing is fitted on.
CALIBRATION = {
    "de": "Das Wetter soll am Wochenende besser werden.|Mein Nachbar hat drei Katzen und einen alten Hund.|Wir treffen uns um acht vor dem Kino.|Gestern ist die Heizung ausgefallen, deshalb war es kalt.|Kinder unter sechs Jahren zahlen keinen Eintritt.|Der Arzt sagte, ich solle mehr Wasser trinken.|Leider haben wir die letzte Bahn verpasst.|Sie lernt seit zwei Jahren Geige.",
    "en": "The weather should get better at the weekend.|My neighbour has three cats and an old dog.|We will meet at eight outside the cinema.|The heating broke down yesterday, so it was cold.|Children under six do not pay for entry.|The doctor told me to drink more water.|Unfortunately we missed the last train.|She has been learning the violin for two years.",
    "es": "El tiempo mejorará el fin de semana.|Mi vecino tiene tres gatos y un perro viejo.|Nos vemos a las ocho delante del cine.|Ayer se estropeó la calefacción y hacía frío.|Los niños menores de seis años no pagan entrada.|El médico me dijo que bebiera más agua.|Por desgracia perdimos el último tren.|Ella aprende violín desde hace dos años.",
    "fr": "Le temps devrait s'améliorer ce week-end.|Mon voisin a trois chats et un vieux chien.|On se retrouve à huit heures devant le cinéma.|Hier, le chauffage est tombé en panne, il faisait froid.|Les enfants de moins de six ans ne paient pas l'entrée.|Le médecin m'a dit de boire plus d'eau.|Malheureusement, nous avons raté le dernier train.|Elle apprend le violon depuis deux ans.",
    "ja": "週末は天気が良くなるでしょう。|隣の人は猫を三匹と年取った犬を飼っています。|八時に映画館の前で会いましょう。|昨日は暖房が壊れたので寒かった。|六歳未満の子供は入場無料です。|医者にもっと水を飲むように言われた。|残念ながら終電に乗り遅れました。|国際会議開催予定。",
    "zh": "周末天气应该会好一些。|我的邻居有三只猫和一条老狗。|我们八点在电影院门口见。|昨天暖气坏了，所以很冷。|六岁以下的儿童不用买票。|医生叫我多喝水。|可惜我们没赶上末班车。|她学小提琴已经两年了。",
    "": "Il tempo dovrebbe migliorare nel fine settimana.|Il mio vicino ha tre gatti e un vecchio cane.|Het weer wordt dit weekend beter dan vorige week.|Mijn buurman heeft drie katten en een oude hond.|O tempo deve melhorar no fim de semana.|O meu vizinho tem três gatos e um cão velho.|Vädret ska bli bättre till helgen.|Min granne har tre katter och en gammal hund.|Pogoda powinna się poprawić w weekend.|Mój sąsiad ma trzy koty i starego psa.|Hava hafta sonu düzelecek gibi görünüyor.|Komşumun üç kedisi ve yaşlı bir köpeği var.|Sään pitäisi parantua viikonloppuna.|Naapurillani on kolme kissaa ja vanha koira.|Vremea ar trebui să se îmbunătățească la sfârșitul săptămânii.|Počasí by se mělo o víkendu zlepšit.",
}


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n codes ending at each position; positions before the n-th hold hashes over wrapped zeros."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        c = np.zeros(len(codes), dtype=np.uint64)
        c[k:] = codes[: len(codes) - k]
        h = (h + c + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each led by ORDER-1 marks; which positions are scored; owner of each position."""
    lead = "\x02" * (ORDER - 1)
    joined = "".join(f"{lead}{t}\x03" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(t) + ORDER for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    return codes, codes != 2, owner


class Model:
    """Fitted by fit(); arrays only, so it is small to ship and quick to load."""

    def __init__(self, langs, tables, contexts, floor):
        self.langs, self.tables, self.contexts, self.floor = langs, tables, contexts, floor
        self.scripts = {lang: SCRIPT.get(lang, "latin") for lang in langs}
        self.kana = np.zeros((3, len(langs)))  # log share of each use of kana among the clauses of each language
        self.limit = np.full(len(langs), np.inf)
        self.sharp = 1.0

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(mean log probability a character of each text in each language, number of characters). Long lists
        are scored in slices, so memory does not grow with them."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > SLICE_CHARS:
                out.append(self._scores(part))
                part, size = [], 0
        out.append(self._scores(part))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.langs)
        if not texts:
            return np.zeros((0, k)), np.zeros(0)
        codes, live, owner = _codes(texts)
        pos = np.nonzero(live)[0]
        total = np.zeros((len(pos), k), dtype=np.float64)
        todo = np.arange(len(pos))
        for n in range(ORDER, 0, -1):
            if not len(todo):
                break
            h = _hashes(codes, n)[pos[todo]]
            keys, logp = self.tables[n]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            total[todo[hit]] += logp[at[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):
                ch = _hashes(codes, n - 1)[pos[todo] - 1]
                ckeys, bow = self.contexts[n]
                cat = np.minimum(np.searchsorted(ckeys, ch), len(ckeys) - 1)
                seen = ckeys[cat] == ch
                total[todo[seen]] += bow[cat[seen]]
        total[todo] += self.floor
        own = owner[pos]
        out = np.zeros((len(texts), k))
        for j in range(k):
            out[:, j] = np.bincount(own, total[:, j], len(texts))
        count = np.bincount(own, minlength=len(texts)).astype(float)
        return out / np.maximum(count, 1)[:, None], count

    def weighed(self, scripts: list[str], parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """scores() with the use of kana as one character more."""
        mean, n = self.scores(parts)
        if len(parts):
            use = np.array([kana_use(p) if s == "cjk" else -1 for s, p in zip(scripts, parts)])
            mean = np.where(use[:, None] >= 0, (mean * n[:, None] + KANA_WEIGHT * self.kana[np.maximum(use, 0)]) / (n[:, None] + 1), mean)
        return mean, n

    def judge(self, scripts: list[str], parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', confidence, lead over the runner-up a character) of each segment."""
        mean, n = self.weighed(scripts, parts)
        own = np.array([self.scripts[x] for x in self.langs])
        mean = np.where(np.array(scripts, dtype=object)[:, None] == own[None, :], mean, -np.inf) if len(parts) else mean
        if not len(parts):
            return [], np.zeros(0), np.zeros(0)
        best = mean.argmax(axis=1)
        top = mean[np.arange(len(parts)), best]
        with np.errstate(invalid="ignore"):
            z = np.exp((mean - top[:, None]) * (self.sharp * np.minimum(n, 60))[:, None])
        z[~np.isfinite(z)] = 0
        conf = 1 / np.maximum(z.sum(axis=1), 1e-9)
        rest = mean.copy()
        rest[np.arange(len(parts)), best] = -np.inf
        with np.errstate(invalid="ignore"):
            lead = np.where(np.isfinite(rest.max(axis=1)), top - rest.max(axis=1), 9.0)
        ok = np.isfinite(top) & (misfit(top, lead) <= self.limit[best])
        return [self.langs[b] if o else "und" for b, o in zip(best, ok)], np.where(ok, conf, 0.0), lead


def fit(samples: dict[str, list[str]]) -> Model:
    """samples: wordings in the right script by language."""
    langs = tuple(sorted(samples))
    grams: dict[int, dict[str, tuple]] = defaultdict(dict)
    for lang in langs:
        codes, live, _ = _codes(samples[lang])
        pos = np.nonzero(live)[0]
        upper = None
        for n in range(ORDER, 0, -1):
            h = _hashes(codes, n)
            if upper is None:
                key, idx, count = np.unique(h[pos], return_index=True, return_counts=True)
                at = pos[idx]
            else:  # continuation counts: how many different characters precede the n-gram
                key, idx, count = np.unique(h[upper], return_index=True, return_counts=True)
                at = upper[idx]
            ctx = _hashes(codes, n - 1)[at - 1] if n > 1 else np.zeros(len(at), dtype=np.uint64)
            suffix = _hashes(codes, n - 1)[at] if n > 1 else np.zeros(len(at), dtype=np.uint64)
            grams[n][lang] = (key, count.astype(float), ctx, suffix)
            upper = at
    tables, contexts = {}, {}
    k = len(langs)
    lower_keys, lower_p = np.zeros(1, dtype=np.uint64), None
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([grams[n][lang][0] for lang in langs]))
        ctx_of, suf_of = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
        for lang in langs:
            key, _, ctx, suffix = grams[n][lang]
            at = np.searchsorted(keys, key)
            ctx_of[at], suf_of[at] = ctx, suffix
        ctxs = np.unique(ctx_of)
        ctx_at = np.searchsorted(ctxs, ctx_of)
        below = np.full((len(keys), k), 1.0 / 8000) if lower_p is None else lower_p[np.searchsorted(lower_keys, suf_of)]
        p, bow = np.zeros((len(keys), k)), np.ones((len(ctxs), k))
        for j, lang in enumerate(langs):
            key, count, ctx, _ = grams[n][lang]
            c1, c2 = float((count == 1).sum()), float((count == 2).sum())
            d = min(0.95, max(0.1, c1 / (c1 + 2 * c2))) if c1 else 0.5
            ci = np.searchsorted(ctxs, ctx)
            tot = np.bincount(ci, count, len(ctxs))
            kinds = np.bincount(ci, minlength=len(ctxs))
            bow[:, j] = np.where(tot > 0, d * kinds / np.maximum(tot, 1), 1.0)
            own = np.zeros(len(keys))
            own[np.searchsorted(keys, key)] = (count - d) / tot[ci]
            p[:, j] = own + bow[ctx_at, j] * below[:, j]
        tables[n] = (keys, np.log(p).astype(np.float32))
        contexts[n] = (ctxs, np.log(bow).astype(np.float32))
        lower_keys, lower_p = keys, p
    floor = np.log(contexts_floor(contexts[1]) / 8000)
    return Model(langs, tables, contexts, floor)


def contexts_floor(unigram_context: tuple) -> np.ndarray:
    return np.exp(unigram_context[1][0].astype(float))


def misfit(top: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """What a limit is held against: the best cross-entropy, less its lead over the next language, if there is one."""
    return -top - np.where(lead < 9.0, lead, 0.0)


def kana_use(part: str) -> int:
    """0 without kana, 2 where it begins or ends a clause as grammar does, else 1 (a name within another language)."""
    if not S.KANA.search(part):
        return 0
    return 2 if S.HIRAGANA_END.search(part) or S.KANA.match(part) else 1


def _segments(text: str) -> list[tuple[int, int, str, str]]:
    out = []
    for a, b in S.sentences(text):
        script, part = S.clause(text[a:b])
        if script:
            out.append((a, b, script, part))
    return out


def train(labelled: list[tuple[str, str]], langs: tuple | None = None, rounds: int = 2) -> Model:
    """labelled: (language, text). Labels may be wrong and texts mixed: after each round only the segments
    that a model of the others gives the label's language are fitted on. A tenth is held out, which with the sentences of
    CALIBRATION sets limits and confidence. Languages are those of the labels and of the seeds."""
    langs = tuple(sorted(langs or set(SEEDS) | {lang for lang, _ in labelled}))
    every = [(lang, s, p) for lang, text in labelled if lang in langs for _, _, s, p in _segments(text)]
    seen: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for lang, s, p in every:
        seen[lang][s] += len(p)
    script = {lang: SCRIPT.get(lang, "latin") if lang in SEEDS or not seen[lang] else max(sorted(seen[lang]), key=seen[lang].get) for lang in langs}
    seeds = {lang: [p for _, _, s, p in _segments(SEEDS.get(lang, "")) if s == script[lang]] for lang in langs}
    segs = [x for x in every if x[1] == script[x[0]]]
    held = segs[::10]
    used = [x for i, x in enumerate(segs) if i % 10]

    def fitted(rows: list) -> Model:
        by = {lang: list(v) for lang, v in seeds.items()}
        for lang, _, p in rows:
            by[lang].append(p)
        m = fit(by)
        m.scripts = script
        for j, lang in enumerate(m.langs):
            uses = np.bincount([kana_use(p) for p in by[lang]], minlength=3) + 1.0
            m.kana[:, j] = np.log(uses / uses.sum())
        return m

    # each half is cleaned by a model of the other, which cannot have learnt its wrong labels by heart
    for _ in range(rounds - 1):
        kept = []
        for k in (0, 1):
            half = used[k::2]
            got = fitted(used[1 - k :: 2]).judge([s for _, s, _ in half], [p for _, _, p in half])[0]
            kept += [x for x, g in zip(half, got) if x[0] == g]
        used = kept
    model = fitted(used)
    _calibrate(model, held)
    return model


def _fits(model: Model, rows: list[tuple[str, str, str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language before any rejection, lead, misfit) of (language, script, part) rows."""
    limit, model.limit = model.limit, np.full(len(model.langs), np.inf)
    got, _, lead = model.judge([s for _, s, _ in rows], [p for _, _, p in rows])
    mean, _ = model.weighed([s for _, s, _ in rows], [p for _, _, p in rows])
    model.limit = limit
    top = np.array([m[model.langs.index(g)] if g in model.langs else -np.inf for g, m in zip(got, mean)])
    return got, lead, misfit(top, lead)


def _calibrate(model: Model, held: list[tuple[str, str, str]]) -> None:
    """Limits and sharpness. The limit of a script's languages is that which errs least on the calibration sentences
    (too high: others taken for one of them; too low: they are rejected), but not below nearly all of the held-out
    ones; where no other language of the script is at hand, half as much again as the farthest."""
    own = [(lang, *x[2:]) for lang, text in CALIBRATION.items() if lang in model.langs for t in text.split("|") for x in _segments(t)]
    none = [("", *x[2:]) for t in CALIBRATION[""].split("|") for x in _segments(t)]
    known = held + own
    mean, n = model.weighed([s for _, s, _ in known], [p for _, _, p in known])
    got, lead, far = _fits(model, known)
    got2, _, far2 = _fits(model, own + none)
    for script in set(model.scripts.values()):
        right = np.array([f for (x, s, _), g, f in zip(known, got, far) if s == script and x == g])
        if len(right) < 5:
            continue
        pairs = [(f, x == g) for (x, s, _), g, f in zip(own + none, got2, far2) if s == script]
        if any(s == script for _, s, _ in none):
            errors = lambda limit: sum((f <= limit) != ok for f, ok in pairs)  # noqa: E731, B023
            limit = max(np.quantile(right, 0.995), min(sorted(f for f, _ in pairs), key=errors))
        else:
            limit = 1.5 * right.max()
        for j, lang in enumerate(model.langs):
            if model.scripts[lang] == script:
                model.limit[j] = limit
    # sharpness: the grid value of least negative log likelihood
    # (a label the model contradicts by a wide margin is taken for a wrong label)
    truth = [(i, model.langs.index(lang)) for i, ((lang, _, _), g, m) in enumerate(zip(known, got, lead)) if g == lang or m < 0.15]
    if truth:
        i, j = np.array(truth).T
        value = None
        for b in (0.05, 0.1, 0.2, 0.4, 0.7, 1.0):
            x = mean[i] * (b * np.minimum(n[i], 60))[:, None]
            nll = float((np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) + x.max(1) - x[np.arange(len(i)), j]).mean())
            if value is None or nll < value[0]:
                value = (nll, b)
        model.sharp = value[1]


def labelled_sample(rows: DataFrame, per_lang: int) -> list[tuple[str, str]]:
    """At most about per_lang (lang, text) rows a language, chosen by a hash of the text so that any order
    and partitioning gives the same. rows: code, text."""
    n = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}
    if not n:
        return []
    share = F.create_map(*[x for k, c in n.items() for x in (F.lit(k), F.lit(int(min(1.0, per_lang / c) * 1_000_000)))])
    got = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("code")]).collect()
    return sorted((r["code"], r["text"]) for r in got)


def latest(history: DataFrame) -> DataFrame:
    """One row an id, the latest saved_at (ties: the greatest content). Null ids are left out."""
    cols = ["saved_at", "original", "optimized", "lang"]
    return history.filter(history["id"].isNotNull()).groupBy(history["id"].alias("id")).agg(F.max(F.struct(*[history[c].alias(c) for c in cols])).alias("r")).select("id", *[f"r.{c}" for c in cols])


def spelled(lang_names: DataFrame) -> DataFrame:
    """(spelling, code) with blanks taken off; one code a spelling."""
    s = F.regexp_replace(F.col("spelling"), r"^[\s\u3000\u00a0]+|[\s\u3000\u00a0]+$", "")
    return lang_names.filter("spelling is not null and lang is not null").groupBy(s.alias("spelling")).agg(F.min("lang").alias("code"))


def with_code(rows: DataFrame, lang_names: DataFrame) -> DataFrame:
    """Adds code: what the label stands for, null where it names no language."""
    key = F.regexp_replace(F.coalesce(F.col("lang"), F.lit("")), r"^[\s\u3000\u00a0]+|[\s\u3000\u00a0]+$", "")
    n = spelled(lang_names)
    return rows.withColumn("_label", key).join(n.withColumnRenamed("spelling", "_label"), "_label", "left").drop("_label")


def model_of(history: DataFrame, lang_names: DataFrame, per_lang: int = SAMPLE) -> Model:
    rows = with_code(history.select("original", "optimized", "lang"), lang_names)
    rows = rows.filter("code is not null and trim(original) <> ''").select("code", F.concat_ws("\n", "original", "optimized").alias("text"))
    return train(labelled_sample(rows, per_lang))


def judged(model: Model, texts: list[str]) -> list[list[tuple[int, int, str, float, bool, int, float]]]:
    """For each text its segments (start, end, lang, confidence, whole sentence, letters, lead)."""
    flat, owner = [], []
    for i, t in enumerate(texts):
        for seg in _segments(t or ""):
            flat.append(seg)
            owner.append(i)
    # a clause that several texts have is judged once
    once = list(dict.fromkeys((x[2], x[3]) for x in flat))
    number = {x: i for i, x in enumerate(once)}
    at = [number[x[2], x[3]] for x in flat]
    langs, conf, lead = model.judge([s for s, _ in once], [p for _, p in once])
    langs, conf, lead = [langs[i] for i in at], conf[at], lead[at]
    out: list[list] = [[] for _ in texts]
    doubt = []
    for i, (a, b, script, part), lang, c, m in zip(owner, flat, langs, conf, lead):
        whole = S.is_sentence(script, part)
        if not whole and c < 0.7 and script == "latin":  # a scrap that could be any language's
            lang, c = "und", 0.0
        out[i].append((a, b, lang, float(c), whole, len(part), float(m)))
        doubt.append((i, len(out[i]) - 1, script, part))
    _by_head(model, out, doubt)
    return out


def _by_head(model: Model, out: list[list], segs: list[tuple[int, int, str, str]]) -> None:
    """A clause may name a foreign term longer than itself. In entries whose segments differ in language, the
    first words of each are judged alone; a segment whose beginning is of the language another segment begins
    in, or is in, is of that language."""
    langs = [{x[2] for x in entry} for entry in out]
    differs = [(i, k, s, p) for i, k, s, p in segs if len(langs[i] - {"und"}) > 1 or len(out[i]) > 1 and "und" in langs[i]]
    cjk = []
    for i, k, s, p in differs:
        if s == "cjk" and not S.KANA.search(p[:4]) and kana_use(p) == 1:
            cjk.append((i, k, p))
    # a name in kana inside a Chinese clause: the clause without it
    bare = [(i, k, S.KANA.sub("", p)) for i, k, p in cjk]
    for (i, k, _), g, c in zip(bare, *model.judge(["cjk"] * len(bare), [p for _, _, p in bare])[:2]):
        if g in langs[i]:
            out[i][k] = (*out[i][k][:2], g, float(c), *out[i][k][4:])
    latin = [(i, k, " ".join(p.split()[:4])) for i, k, s, p in differs if s == "latin"]
    got, conf, by = model.judge(["latin"] * len(latin), [h for _, _, h in latin])
    begins: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for (i, k, _), g, m in zip(latin, got, by):
        if m >= 0.1:
            begins[i].append((k, g))
    new = []
    for (i, k, _), g, c, m in zip(latin, got, conf, by):
        if m >= 0.1 and g not in ("und", out[i][k][2]) and (any(g == g2 for k2, g2 in begins[i] if k2 != k) or any(x[2] == g for k2, x in enumerate(out[i]) if k2 != k)):
            new.append((i, k, g, float(c)))
    for i, k, g, c in new:
        out[i][k] = (*out[i][k][:2], g, c, *out[i][k][4:])


def whole_languages(segs: list[tuple]) -> dict[str, int]:
    """Letters by language over the whole sentences of an entry. A sentence of a language that holds less
    than the leading one must be clearly its own to count."""
    n: dict[str, int] = defaultdict(int)
    for _, _, lang, _, whole, letters, _ in segs:
        if whole and lang != "und":
            n[lang] += letters
    if len(n) < 2:
        return dict(n)
    top = max(n, key=lambda x: (n[x], x))
    sure: dict[str, int] = defaultdict(int)
    for _, _, lang, _, whole, letters, lead in segs:
        if whole and lang != "und" and (lang == top or lead >= 0.25):
            sure[lang] += letters
    return dict(sure)


def main_language(segs: list[tuple]) -> str | None:
    n: dict[str, float] = defaultdict(float)
    for _, _, lang, _, whole, letters, _ in segs:
        if lang != "und":
            n[lang] += letters * (2 if lang in SCRIPT else 1) * (1 if whole else 0.5)
    return max(sorted(n), key=lambda x: n[x]) if n else None


def identify(rows: DataFrame, model: Model, out: str) -> DataFrame:
    """out: 'segments' (id, seg_no, seg_start, seg_end, lang, confidence) or 'entries' (id, code, main_lang,
    confidence, langs). rows: id, original, code; main_lang is und where no segment fits, null without letters. Null or blank originals give no row; a segment that fits
    no model has lang 'und' and confidence 0; offsets count code points."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # arrays bounded by the fitting sample

    def run(batches):
        m = shipped.value
        for b in batches:
            texts = b["original"].tolist()
            every = judged(m, texts)
            if out == "segments":
                recs = [(i, k, s[0], s[1], s[2], s[3]) for i, segs in zip(b["id"], every) for k, s in enumerate(segs)]
                yield pd.DataFrame(recs, columns=["id", "seg_no", "seg_start", "seg_end", "lang", "confidence"])
            else:
                recs = []
                for i, code, segs in zip(b["id"], b["code"], every):
                    main = main_language(segs)
                    own = [(s[3], s[5]) for s in segs if s[2] == main]
                    conf = sum(c * n for c, n in own) / max(1, sum(s[5] for s in segs)) if own else 0.0
                    main = main or ("und" if segs else None)
                    recs.append((i, code, main, conf, sorted(whole_languages(segs))))
                yield pd.DataFrame(recs, columns=["id", "code", "main_lang", "confidence", "langs"])

    schema = "id string, seg_no int, seg_start int, seg_end int, lang string, confidence double" if out == "segments" else "id string, code string, main_lang string, confidence double, langs array<string>"
    kept = rows.filter(F.col("original").isNotNull() & (F.regexp_replace("original", r"[\s\u3000\u00a0\u200b]+", "") != ""))
    return kept.select("id", "original", "code").mapInPandas(run, schema)


def findings(entries: DataFrame) -> DataFrame:
    """(id, kind, lang): mixed entries, one row a language; else missing or wrong labels."""
    one = lambda kind, lang: F.struct(kind.alias("kind"), lang.alias("lang"))
    # a text of no language a model knows lacks a label, but its label may be right
    single = F.when(F.col("code").isNull(), "missing").when((F.col("code") != F.col("main_lang")) & (F.col("main_lang") != "und"), "wrong")
    all_ = F.when(F.size("langs") >= 2, F.transform("langs", lambda x: one(F.lit("mixed"), x))).when(F.col("main_lang").isNotNull(), F.array(one(single, F.col("main_lang"))))
    return entries.select("id", F.explode(all_).alias("f")).select("id", "f.kind", "f.lang").filter("kind is not null")

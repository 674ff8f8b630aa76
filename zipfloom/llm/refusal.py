"""Refusals by a grammar of word classes: who speaks, what they cannot or will not do, and the task.

A rule is a sequence of classes; between two of them stand GAP characters of the same sentence at most. Classes
are fixed values, by language. A text is read only where a word of the second kind is in it at all.
"""

from __future__ import annotations

import regex

GAP = 45

CLASSES = {
    "en": {
        "SELF": "I|we|I'm|I am|I'll|I'd|I've|this assistant|the assistant",
        "CANNOT": "can't|cannot|can not|can only decline|could not|couldn't|won't|will not|wouldn't|would not|unable to|not able to|not going to|not willing to|unwilling to|not comfortable|not allowed to|not permitted to|not in a position to|not prepared to|not authorized to|not authorised to|don't feel comfortable|do not feel comfortable|am not the right one",
        "TASK": "help|helping|assist|assisting|rewrite|rewriting|rephrase|rephrasing|reword|do|doing|provide|providing|answer|answering|comply|write|writing|fulfil|fulfill|process|complete|carry|respond|give|offer|touch|work|engage|support|produce|create|continue|discuss|edit|improve|optimize|optimise|change|paraphrase|handle|accept|take|meet|satisfy|generate|go|talk|comment|proceed|deal|follow|act|undertake|share|this|that|it",
        "THING": "this|that|it|your request|the request|this request|such a request|this one|the rewrite|rewriting|rephrasing|this prompt|the prompt|this text|the text|this topic|the topic|this task|the task|this content|the content|helping|a rewrite|what you ask",
        "NO": "off the table|out of the question|not possible|impossible|not something I|not something we|beyond my|beyond me|beyond what|outside my|outside the scope|outside what|outside of what|falls outside|goes against|against my|against our|against the|violates|violate|conflicts with|conflict with|can't be done|cannot be done|cannot be processed|cannot be answered|cannot be rewritten|could not be|will not happen|won't happen|isn't going to happen|not appropriate|inappropriate|would not be appropriate|not within my|not allowed|not permitted",
        "DECLINE": "refuse|decline|must decline|have to decline|must refuse|have to refuse|must pass|have to pass|will pass|'ll pass|pass on|would rather not|'d rather not|would prefer not|prefer not to|have to say no|must say no|say no to|sit this one out|leave this one|must abstain|opt out|respectfully decline|respectfully pass",
        "RULE": "do not permit me|don't permit me|do not allow me|don't allow me|does not permit me|does not allow me|prevent me from|prevents me from|forbid me|forbids me",
        "FULL": "count me out|no can do|not happening",
        "NONE": "no",
        "GIVEN": "can be given|can be provided|can be offered|could be provided|will be provided|will be given|can do",
    },
    "de": {
        "SELF": "ich|wir|mir|uns",
        "CANNOT": "kann|könnte|darf|möchte|will|werde|können|dürfen|möchten|wollen|werden|mag|bin|sind|sehe|ist|mache|machen|helfe|helfen|tue|schreibe|bearbeite|beantworte|übernehme|erledige|liefere|gebe|unterstütze",
        "NOT": "nicht|kein|keine|keinen|keinerlei|keinesfalls|niemals|außerstande|nie",
        "TASK": "helfen|beantworten|umformulieren|umschreiben|bearbeiten|schreiben|erfüllen|nachkommen|unterstützen|geben|antworten|machen|tun|übernehmen|erledigen|liefern|umsetzen|befugt|möglich|weiterhelfen|dienen|anbieten|ausführen|eingehen|behandeln|verfassen|leisten|annehmen|ändern|optimieren|verbessern|in der Lage|imstande|beantwortung|hilfe|antwort|auskunft|umformulierung|fassung",
        "THING": "das|dies|dieses|dabei|hierbei|damit|hiermit|so etwas|sowas|dafür|daran|darauf|diese anfrage|diese bitte|dieser bitte|diesen text|diese aufgabe|dieses thema|die anfrage|der text|die aufgabe|diese frage|ihre anfrage|deine anfrage|diesem wunsch|dem",
        "NO": "kommt nicht in frage|kommt nicht infrage|geht nicht|ist nicht drin|ist nicht möglich|nicht möglich|unmöglich|ausgeschlossen|nicht zulässig|außerhalb|übersteigt|verstößt gegen|widerspricht|entspricht nicht|liegt mir fern",
        "FULL": "muss ich passen|muss ich ablehnen|ohne mich|da bin ich raus",
        "DECLINE": "ablehnen|lehne|lehnen|verweigere|verweigern|weigere|verzichte|muss passen|muss ich passen|nehme abstand|sehe davon ab|davon absehen|absehen|erteile ich",
    },
    "fr": {
        "SELF": "je|j'|nous|on",
        "CANNOT": "ne sommes|ne pouvons|ne souhaitons|ne peux|ne puis|ne suis|ne saurais|ne souhaite|ne veux|ne pourrai|ne pourrais|ne vais|ne ferai|ne le ferai|ne compte|ne dois|n'ai|ne pouvons|ne peut|ne donnerai|ne répondrai|ne traiterai|n'y|ne me sens|ne serai|peux|puis|suis|souhaite",
        "NOT": "pas|point|malheureusement pas|aucunement|jamais|aucune|aucun",
        "TASK": "répondre|aider|reformuler|traiter|réécrire|écrire|en mesure|autorisé|autorisée|donner|satisfaire|accéder|faire|fournir|rédiger|poursuivre|continuer|accepter|apporter|accomplir|proposer|participer|donc|cela|ça|le droit|réponse|suite|aide|m'en|occuper|à l'aise",
        "THING": "cela|ceci|ça|c'est|cette demande|votre demande|ta demande|ce texte|ce contenu|ce sujet|cette tâche|cette requête|la demande",
        "NO": "hors de question|pas question|impossible|n'est pas possible|pas possible|dépasse|sort du cadre|hors de ma portée|n'est pas conforme|enfreint|est contraire|ne peut être|ne sera pas|va à l'encontre|n'est pas de mon ressort",
        "DECLINE": "refuse|refuser|décline|décliner|m'abstenir|m'abstiens|m'y refuse|préfère ne pas|passe mon tour|renonce|contraint de refuser|contrainte de refuser|dois dire non",
    },
    "es": {
        "SELF": "yo|me|nosotros",
        "CANNOT": "no puedo|no podré|no podría|no podemos|no voy a|no quiero|no me es posible|no estoy en condiciones|no estoy autorizado|no estoy autorizada|no tengo permitido|no me está permitido|no lo haré|no lo voy|me es imposible|me resulta imposible|no me siento|no pienso|no debo|no tengo permiso|no haré|no daré|no responderé",
        "TASK": "ayudar|ayudarte|ayudarle|responder|reescribir|reformular|escribir|procesar|atender|cumplir|hacer|hacerlo|dar|ofrecer|proporcionar|redactar|contestar|tratar|continuar|satisfacer|completar|realizar|optimizar|mejorar|editar|aceptar|eso|esto|esta|lo|cómodo|cómoda|reescribirlo|colaborar|participar|generar|acceder|solicitud|petición|texto",
        "THING": "esto|eso|esta solicitud|esta petición|este texto|este contenido|este tema|tu solicitud|su solicitud|la solicitud|la petición|esta tarea|hacerlo",
        "NO": "ni hablar|imposible|excede|está fuera|queda fuera|fuera de mi alcance|va en contra|infringe|incumple|no cumple|no es posible|no está en mis manos|no entra en|no procede|descartado",
        "DECLINE": "me niego|rehúso|declino|rechazo|debo rechazar|tengo que rechazar|debo declinar|tengo que declinar|prefiero no|preferiría no|quisiera no|debo negarme|me abstengo|paso de",
    },
    "zh": {
        "SELF": "我|本人|我们|本助手|恕|抱歉|对不起|很遗憾",
        "CANNOT": "无法|不能|没法|没办法|不可以|不会|拒绝|不便|不方便|不愿|不想|恕难|难以|不打算|做不了|帮不了|帮不上|不行",
        "TASK": "完成|改写|回答|处理|提供|帮|协助|满足|撰写|重写|优化|继续|讨论|请求|这|做|写|从命|照办|效劳|执行|参与|答应|接受|忙|给出|润色|修改|内容|要求",
        "THING": "这|该|此|这个|这件事|此事|这种|这类|该请求|此请求|这个请求|这段|内容|问题|话题|请求|此类|该内容|你的要求",
        "NO": "做不到|办不到|无能为力|爱莫能助|恕不|恕难从命|不予|无法予以|超出|免谈|不合适|不符合|违反|不在我|无可奉告|帮不了|帮不上忙|我不便|我无法|我不能|我拒绝|不行",
        "FULL": "恕难从命|恕不从命|爱莫能助|无可奉告",
        "DECLINE": "必须拒绝|只能拒绝|不得不拒绝|婉拒|谢绝|恕我拒绝|我拒绝|恕不从命",
    },
    "ja": {
        "THING": "ご依頼|依頼|リクエスト|ご要望|要望|この件|文章|内容|質問|要求|お手伝い|書き換え|対応|回答|お答え|お応え|ご対応|話題|テーマ|それ|これ|こちら|私|わたし|協力|お力|作業|ご希望|申し訳|残念",
        "NO": "できません|できない|できかねます|いたしかねます|致しかねます|しかねます|お断り|控えさせ|応じられません|承れません|差し控え|お応えできない|無理です|ご遠慮|ご容赦|やりません|いたしません|致しません|なれません|出来ません|お受けできません|引き受けられません|辞退|見送らせ|遠慮させ",
        "DECLINE": "お断りいたします|お断りします|お断りさせて|遠慮させていただきます|回答を控え|お力になれません|お手伝いできません|ご期待に沿えません|ご要望には応えられません",
    },
}
# alternatives of sequences of classes; a class may also stand before or after the one it belongs to
RULES = {
    "en": ("SELF CANNOT TASK", "SELF DECLINE", "THING NO", "NONE TASK GIVEN", "NONE GIVEN", "DECLINE THING", "CANNOT TASK THING", "RULE", "FULL"),
    "de": ("SELF CANNOT NOT TASK", "CANNOT SELF NOT TASK", "THING CANNOT SELF NOT", "CANNOT SELF THING NOT", "SELF NOT TASK", "SELF DECLINE", "DECLINE SELF", "THING NO", "NO SELF", "FULL"),
    "fr": ("SELF CANNOT NOT TASK", "SELF DECLINE", "THING NO", "NO THING", "NO TASK"),
    "es": ("CANNOT TASK", "DECLINE", "THING NO", "NO THING", "SELF NO"),
    "zh": ("SELF CANNOT TASK", "THING NO", "DECLINE", "THING SELF NO", "SELF NO", "FULL"),
    "ja": ("THING NO", "DECLINE"),
}
_SPACELESS = ("zh", "ja")


def _compiled() -> tuple[tuple[str, ...], list[regex.Pattern]]:
    rules, literals = [], set()
    for lang, classes in CLASSES.items():
        edge = "" if lang in _SPACELESS else r"\b"
        gap = rf"[^.!?。！？\n]{{0,{GAP if edge else 14}}}?"
        one = lambda c: edge + "(?:" + "|".join(map(regex.escape, sorted(classes[c].split("|"), key=len, reverse=True))) + ")" + (edge if edge else "")  # noqa: E731, B023
        for rule in RULES[lang]:
            rules.append(regex.compile(gap.join(one(c) for c in rule.split()), regex.I))
        for c in ("CANNOT", "NOT", "NO", "DECLINE", "GIVEN", "RULE", "FULL"):
            # German and French verbs are no sign by themselves
            if c in classes and not (c == "CANNOT" and "NOT" in classes):
                literals.update(classes[c].split("|"))
    signs = sorted({x.lower() for x in literals})
    return tuple(x for x in signs if not any(y in x for y in signs if y != x)), rules


_SIGNS, _RULES = _compiled()


def has_sign(text: str) -> bool:
    """Some word without which no rule holds is in the text."""
    low = text.lower()
    return any(x in low for x in _SIGNS)


def declines(sentence: str) -> bool:
    """One of the rules is in the sentence (outside quotations, which the caller takes out)."""
    return any(r.search(sentence) for r in _RULES)

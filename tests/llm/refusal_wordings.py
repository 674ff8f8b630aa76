"""Declining and harmless answers, written after the refusal grammar but for three known before. The README has the first
measurement; faults it showed were mended since."""

REFUSALS = """Apologies, but rewriting this is off the table for me.
I'm going to have to pass on that one.
Unfortunately I am not able to work on requests of this kind.
Helping with that is out of the question.
I'd rather not touch this topic.
This is not something I can do for you.
Sorry, no can do.
We are unable to provide a version of this text.
I have to say no to this.
My guidelines do not permit me to answer.
That would go beyond my abilities, sorry.
I will not be writing this.
Count me out on this request.
As an assistant I must refuse.
Das mache ich nicht.
Dabei kann ich dir leider nicht helfen.
Diese Anfrage muss ich ablehnen.
Tut mir leid, das geht nicht.
Hierzu gebe ich keine Antwort.
So etwas schreibe ich nicht.
Ich bin nicht befugt, diesen Text zu bearbeiten.
Da muss ich passen.
Je préfère ne pas traiter cette demande.
Désolé, c'est hors de question.
Je ne vais pas réécrire ce texte.
Il m'est impossible de vous aider.
Je refuse de répondre à cela.
Nous ne sommes pas en mesure de donner suite.
No voy a reescribir este texto.
Lo siento, pero me niego a hacerlo.
Eso está fuera de mi alcance.
Prefiero no hablar de ese tema.
No me es posible atender la petición.
这个我做不到。
抱歉，这件事我帮不上忙。
恕难从命。
对不起，我不想回答这种问题。
很遗憾，我没办法改写这段话。
申し訳ありませんが、お手伝いできません。
それは私には無理です。
この件についてはお答えしかねます。
ご要望には応じられません。"""

ANSWERS = """Explain why the bridge cannot be repaired before winter.
List five reasons why the mayor will not attend the meeting.
Describe how the engine works and what to do when it does not start.
Write a short text about a town that has no library.
The report should not be longer than two pages.
Summarize the plan so that nobody can misunderstand it.
How can I help my neighbour carry the boxes?
Compare both offers and say which one is not worth the money.
Erkläre, warum die Brücke vor dem Winter nicht repariert werden kann.
Nenne fünf Gründe, warum das Museum keine Karten verkauft.
Beschreibe, was zu tun ist, wenn der Motor nicht anspringt.
Der Text soll nicht länger als zwei Seiten sein.
Expliquez pourquoi le pont ne peut pas être réparé avant l'hiver.
Donnez cinq raisons pour lesquelles le maire n'assistera pas à la réunion.
Décrivez le fonctionnement du moteur.
Explica por qué el puente no se puede reparar antes del invierno.
Enumera cinco razones por las que el alcalde no asistirá.
Describe cómo funciona el motor y cuándo no arranca.
请解释为什么这座桥冬天之前不能修好。
列出市长不参加会议的五个理由。
请说明发动机无法启动时该怎么办。
橋が冬までに修理できない理由を説明してください。
市長が会議に出席しない理由を五つ挙げてください。
エンジンが動かないときの対処を書いてください。"""

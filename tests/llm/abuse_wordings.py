"""Sentences to measure recall and false alarms on, written after the lexicon but for four abusive and three harmless ones
known before. The README has the first measurement; faults it showed were mended since."""

ABUSIVE = {
    "threat": """I am going to gouge your eyes out tonight.
Watch your back, I will shoot you.
Ich hoffe, du bekommst Krebs und stirbst qualvoll.
I swear I'll strangle you in your sleep.
You deserve to be hanged from the nearest lamp post.
We are coming for you and we will burn your house down.
I hope your whole family dies in a car crash.
Somebody ought to smash your teeth in.
Your days are numbered, we know where your kids go to school.
You will regret being born when I get my hands on you.
Just go hang yourself already.
Jump off a bridge and do us all a favor.
I want to see you bleed out on the pavement.
One day I will find you and cut your throat.
If I ever meet you I'm going to break every bone in your body.
Ich werde dich eines Tages umbringen.
Pass auf deinen Rücken auf, wir kriegen dich.
Dir sollte man die Zähne einschlagen.
Ich wünsche dir einen langsamen Tod.
Spring doch von der nächsten Brücke.
Je vais te casser les dents un jour.
J'espère que tu crèveras seul comme un chien.
Tes jours sont comptés, on sait où tu dors.
On va t'égorger devant ta famille.
Te voy a partir la cara cuando te vea.
Ojalá te mueras de cáncer.
Tus días están contados, sabemos dónde duermes.
Te mereces una muerte lenta.
我要杀了你全家。
希望你早点得癌症死掉。
你给我等着瞧，小心你的狗命。
お前を必ず殺してやるからな。
夜道に気をつけろよ、お前。
さっさと死んでしまえ。""",
    "insult": """You are such a brainless moron.
Shut your mouth, you fat pig.
What a spineless coward you are.
You're a disgrace and a total failure, idiot.
Nobody likes you, freak.
Du bist echt ein mieser Versager.
Halt den Mund, du dreckiges Schwein.
So ein Vollidiot wie du gehört nicht in dieses Team.
Tu n'es qu'un pauvre abruti.
Ferme-la, espèce de connard.
Quelle bande d'imbéciles vous êtes.
Eres un imbécil de primera.
Cierra la boca, gilipollas.
Menuda panda de inútiles sois.
你真是个没脑子的蠢货。
你这个废物，滚远点。
お前は本当に馬鹿だな。
黙れ、このろくでなし。""",
    "hate": """All those immigrants should be shot at the border.
Refugees are nothing but parasites.
Jews are vermin, and everyone knows it.
Muslims should be expelled from this country.
Kill all the gays.
Women are stupid and should not vote.
Gypsies are thieves, never let them in.
The city would be safer without immigrants.
Alle Ausländer gehören an die Wand gestellt.
Flüchtlinge sind Ungeziefer.
Ausländer raus aus unserem Land.
Ich hasse diese Juden.
Les immigrés sont des parasites.
Dehors les étrangers, ils volent tout.
Il faut expulser tous les musulmans.
Los inmigrantes son una plaga.
Muerte a los judíos.
Fuera los moros de aquí.
移民都是寄生虫。
那些难民都该去死。
外国人は出て行け。
移民はゴミだ。""",
    "sexual": """She sucked his cock until he moaned.
He thrust deep into her wet pussy.
Horny singles near you are waiting, click for nude pics.
Send me naked pictures of yourself, you know you want to get fucked.
They fucked all night on the kitchen table.
Er leckte ihre Muschi, bis sie stöhnte.
Geile Hausfrauen warten auf dich.
Elle suça sa bite avec plaisir.
Il la pénétra et elle eut un orgasme, gémissant très fort.
Le chupó la polla hasta que se corrió.
Chicas desnudas y cachondas te esperan.
她脱光衣服和他做爱。
想约炮的点这里看裸照。
彼は彼女の中に入り、激しくセックスした。
無修正エロ動画はこちら。""",
}

HARMLESS = """The cock crowed at dawn.
The man who shouted "you are an idiot" at the referee was fined.
In the play an idiot tells you the truth about the king.
She wrote "I will kill you" in the novel's first chapter.
Calling a colleague a moron leads to a warning.
The nurse explained safe sex and handed out leaflets about contraception.
Rats are vermin in the grain store and spoil the harvest.
The surgeon made a cut near the left breast to take a biopsy.
I'll beat you at chess tonight.
You will love this cake, I could die for it.
If you cut your hair, send me a photo.
Take care of yourself on the way home.
Our dog bit the postman again.
The court convicted him for threatening to shoot his neighbour.
Do not call people idiots, the rules say.
The report warns of rising hatred against refugees.
Refugees are waiting at the border for food.
The immigrants should be registered by Friday.
Women are the majority in this department.
The hunters shot two boars at the edge of the forest.
I hope you get well soon.
I hope you have a wonderful birthday.
The exhibition shows nude paintings from Paris.
The patient reported pain during orgasm, the clinic noted.
The kitten licked her fingers.
Heat the oven and burn the sugar lightly.
He pushed the door open and went in.
The pig farm lies behind the hill.
You can see a snake in this picture.
Bitte pass auf dich auf.
Der Hahn krähte, als die Sonne aufging.
Der Angeklagte rief „du Idiot“ und wurde verurteilt.
Ausländer zahlen hier dieselben Gebühren.
Sie liegt seit Montag im Krankenhaus.
Das Schwein lief über den Hof.
Ich hoffe, du kommst bald wieder.
J'espère que tu auras une bonne journée.
Le tribunal l'a condamné pour avoir traité un agent de connard.
Les étrangers peuvent demander une carte de séjour.
Le chat chasse les rats dans la grange.
Espero que tengas un buen viaje.
Los inmigrantes llegaron al puerto por la mañana.
El juez lo multó por llamar imbécil a un policía.
La cocina tiene un horno nuevo.
请把插头插进插座。
移民局周一不开门。
报告指出针对难民的仇恨言论在增加。
医生说明了乳腺癌的检查方法。
外国人登録の窓口は二階です。
この小説では主人公が「馬鹿」と叫ぶ。
医師は避妊について説明した。
倉庫の害虫を駆除する。"""

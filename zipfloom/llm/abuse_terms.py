"""Lexicon of the abuse scorer: fixed values, as phrases by category.

Words of a phrase follow each other with at most GAP words between them; a word ending in "-" stands for
every word it begins, "a|b" for either, "@name" for any word of the class in CLASSES. Phrases in scripts without
word spaces are runs of characters, with "…" for a gap and "@name" for any of a class. Case and accents do not matter.
"""

CLASSES = {
    "sex": "cock pussy dick tits clit nipples balls shaft penis ass breasts dildo",
    "sexe": "bite chatte seins sexe queue tétons cul pénis clitoris",
    "sexo": "polla coño tetas pezones pene sexo culo verga clítoris",
    # verbs of violence: bare, and as done to somebody
    "hurt": "kill murder shoot stab strangle choke beat punch smash break cut burn hang drown slit gut bash cripple maim rape gouge poison butcher slaughter bury crush skin torture behead hunt destroy hurt",
    "hurt_ed": "killed murdered shot stabbed strangled beaten hanged hung drowned gassed burned burnt executed slaughtered exterminated eradicated lynched sterilized castrated deported expelled raped wiped butchered crushed whipped",
    "body": "eyes eye hands legs arms neck bones face jaw fingers skull head teeth throat knees ribs nose guts",
    "ill": "cancer aids tumor plague disease accident stroke hell",
    "suffer": "die rot suffer burn choke drown bleed starve perish crash",
    "group": "immigrants immigrant migrants refugees foreigners gypsies jews muslims arabs blacks whites mexicans asians africans turks poles gays lesbians homosexuals women feminists disabled",
    "low": "vermin parasites parasite subhuman subhumans cockroaches leeches savages maggots rats pests animals filth scum apes monkeys trash garbage swine",
    "totet": "umbringen töten totschlagen abstechen ertränken erschießen erwürgen verprügeln vergiften abknallen aufschlitzen kaltmachen erschlagen schlachten verbrennen zusammenschlagen fertigmachen",
    "leid": "krebs verrecken verreckst sterben stirbst krepieren krepierst verrotten verrottest draufgehst leidest ersticken erstickst ertrinkst",
    "leib": "hände beine arme hals knochen gesicht kiefer finger schädel zähne kehle genick nase augen rippen",
    "gruppe": "ausländer flüchtlinge migranten juden muslime türken araber schwarze schwarzen zigeuner schwule schwulen frauen behinderte polen asylanten",
    "gering": "ungeziefer parasiten untermenschen abschaum ratten schädlinge tiere dreck krebsgeschwür affen kakerlaken müll",
    "tuer": "tuer buter égorger étrangler frapper noyer brûler pendre poignarder fusiller massacrer crever démolir défoncer abattre tuerai buterai égorgerai étranglerai frapperai massacrerai démolirai défoncerai abattrai",
    "souffre": "crève crèves meures meurs pourrisses souffres crèveras mourras pourriras souffriras brûleras cancer brûles mourir crever pourrir",
    "corps": "mains jambes gueule os cou dents crâne tête yeux nez doigts genoux",
    "groupe": "immigrés étrangers migrants réfugiés juifs musulmans arabes noirs gitans roms femmes homosexuels handicapés pédés",
    "vil": "vermine parasites rats cafards déchets ordures animaux singes cancer sous-hommes bêtes racaille",
    "matar": "matar mataré mato degollar apuñalar estrangular golpear ahogar quemar colgar fusilar disparar reventar destrozar partiré romperé degollaré reventaré destrozaré estrangularé",
    "sufras": "mueras murieras pudras sufras ahogues quemes revientes cáncer",
    "cuerpo": "manos piernas huesos dedos cara dientes cabeza cráneo cuello ojos nariz costillas",
    "grupo": "inmigrantes extranjeros migrantes refugiados judíos musulmanes moros negros gitanos mujeres homosexuales maricones indios",
    "vileza": "alimañas plaga sabandijas parásitos ratas escoria bichos animales cucarachas cáncer basura monos",
    "杀": "杀 弄死 打死 砍死 捅死 掐死 烧死 宰 打断 砍断 打烂 打爆 毒死 勒死 撕烂",
    "族": "外国人 移民 难民 黑人 犹太人 穆斯林 女人 同性恋 外地人 残疾人 少数民族",
    "贱": "害虫 寄生虫 畜生 垃圾 蟑螂 老鼠 毒瘤 败类 猪狗 劣等",
    "殺": "殺し ぶっ殺し 刺し 殴り 絞め 焼き 撃ち 埋め 潰し",
    "民": "移民 外国人 難民 ユダヤ人 黒人 イスラム教徒 同性愛者 女 障害者 在日",
    "卑": "害虫 寄生虫 ゴミ ゴキブリ 劣等 クズ 家畜 ダニ 病原菌",
}

INSULT = """
猪头
垃圾
懦夫
小丑
笨猪
蠢驴
饭桶
贱货
ブス
豚野郎
臆病者
阿呆
カス
のろま
ろくでなし
出来損ない
idiot|idiots|moron|morons|loser|losers|bastard|bastards|scumbag|scumbags|halfwit|halfwits|imbecile|asshole|arsehole|dickhead|dumbass|retard|cretin|fuckwit|wanker|twat|douchebag|bitch|whore|slut|cunt|motherfucker|shithead|dimwit|nitwit|scum|lowlife|dipshit|jackass
piece of shit|trash|garbage|filth
waste of space|air|oxygen
trottel|versager|drecksack|mistkerl|schwachkopf|arschloch|vollidiot|depp|hurensohn|wichser|schlampe|fotze|missgeburt|spast|dummkopf|blodmann|scheisskerl|abschaum|hohlkopf|volltrottel|dreckskerl|nichtsnutz|vollpfosten|idioten
cretin|minable|batard|salaud|abruti|imbecile|connard|connasse|encule|salope|ordure|raclure|enfoire|crapule|debile|sous-merde
fils de pute
pauvre|sale con
idiota|imbecil|cabron|fracasado|fracasada|tarado|tarada|cretino|gilipollas|bastardo|escoria|subnormal|pendejo|maricon|malnacido|inutil|estupido|estupida|desgraciado|mamon|canalla|canallas|sinverguenza|payaso
hijo de puta
人渣
蠢货
蠢猪
废物
白痴
混蛋
傻逼
王八蛋
贱人
婊子
脑残
智障
狗东西
畜生
杂种
败类
笨蛋
蠢材
窝囊废
傻瓜
間抜け
馬鹿
バカ
能無し
くそ野郎
クソ野郎
クズ
負け犬
アホ
ゴミ野郎
低能
カス野郎
腰抜け
まぬけ
"""

# names that insult only when somebody is called so
WEAK = """
freak|pig|rat|snake|clown|coward|creep|psycho|maggot|pervert|failure|disgrace|fool|dunce|simpleton|airhead|bozo|prick|tosser|skank|hag|swine|donkey
sau|schwein|ratte|idiot|lusche|penner|clown|feigling|arsch|drecksau|trampel|null|loser|vollpfosten|hohlbirne|kotzbrocken|lappen
porc|rat|clown|nul|nulle|lache|bouffon|tocard|raté|ratée|con|conne|pourriture|cochon|ane|idiot|idiote|cloporte
cerdo|cerda|rata|basura|burro|burra|cobarde|asqueroso|asquerosa|bobo|zopenco|inepto|capullo|perdedor|perdedora|mierda|lerdo|bruto
"""

# what turns an insult against somebody: address, contempt, orders
ADDRESS = """
fucking|damn|bloody|dumb|ugly|fat|brainless|spineless|lousy|rotten|clueless|sorry excuse
such a|an
sie|ihnen|ihr sind
so|was|du ein|eine
vous|votre|vos
espece de
tellement|si
usted|ustedes|vosotros
eres|sois|sos
您
真是
简直是
あんた
君は
この野郎
you|your|you're|yourself|youre|ur|u
listen
shut up
what a
go to hell
get lost
useless|pathetic|worthless|miserable|filthy|disgusting|stupid|dumb
nobody can stand
halt die klappe|fresse|schnauze
hor zu
du|dich|dir|dein|deine|deiner|euch
erbarmlich-|nutzlos-|wertlos-|jammerlich-|widerlich-|dumm-|blod-
tais-toi
ferme-la
ferme la
ecoute|ecoutez
tu|te|toi|ton|ta|tes
quel|quelle miserable|pauvre|sale
pauvre|miserable|pathetique|pitoyable
callate
oye|escucha
tan patetico|patetica|miserable
pedazo de
tu|te|ti|tus|eres
闭嘴
听着
你
真是个
可悲
没用
滚
黙れ
おい
お前
てめえ
貴様
なんて哀れ
哀れな
役立たず
"""

# complete in themselves: belittling, wishes of harm, threats
HARM = """
i|i'm|i'll|i'd|we|we'll|im|ill will|going|gonna|want|shall|must|swear|ll|love @hurt you|your|ya
i'll|we'll|gonna|going @hurt you|your|ya
@hurt your @body
somebody|someone|they should|ought|must|will @hurt you
you|you'll should|deserve|will|gonna to|be|get @hurt_ed
you|you'll should|deserve|gonna to die|bleed|hang
you should|deserve @suffer
hope|wish|pray|hoping you|you'll|your|u @suffer
hope|wish|pray you get|catch @ill
hope|wish your family|kids|children|mother @suffer|@ill
watch your back
you|you'll|your end|leave|wind|finish coffin|grave|morgue|bodybag|ditch
coming for you
regret being|that born
you|your days are numbered
you|you'll won't|wont see tomorrow|morning
world|everyone would be better without you
do the|us world|all a favor|favour and kill|jump|die|disappear
jump off a|the bridge|roof|cliff
go kill|hang|drown|shoot yourself
nobody would miss|notice if you
ich|wir werde|werden|will|schwöre|könnte dich|euch @totet
dich|euch @totet
hoffe|hoffentlich|wünsche|wünschte du|dir|ihr|dich @leid
du|ihr sollst|sollt|wirst|werdet|gehörst @leid|@totet|erschossen|gehängt|aufgehängt|vergast
dir|euch die|den|das|alle @leib brechen|breche|einschlagen|ausschlagen|ausstechen|zertrümmern|aufschlitzen|steche|schlage
breche|breche|schlage|steche|schlitze|haue|trete dir|euch
deine tage sind gezählt
pass auf deinen rücken
wirst das|es bereuen|nicht überleben
du|ihr verlässt|verlasst|endest|landest|gehst sarg|leichensack|grab|kiste
bring dich|euch um
niemand würde dich vermissen
spring von|vom brücke|dach
je|on|nous vais|vas|va|allons|veux te|vous|t|le @tuer
je te|vous|t @tuer
t|te|vous @tuer
espere|souhaite|j'espere que tu|vous @souffre
tu merites|mérites|devrais @souffre|pendu|fusillé
tu vas @souffre
te|vous casser|casserai|briser|briserai|arracher|arracherai|péter|crever|crèverai|exploser|écraser les|la|le @corps
tes jours sont comptés
surveille|surveillez tes|ton|vos arrières|dos
tu|vous finir|finiras|quitter|quittes|quittez|sortir|sors|sortiras|sortez cercueil|morgue|cimetière
tu vas le regretter
saute d|du pont|toit
te|os voy|vamos|quiero|juro a|que @matar
te|os @matar
ojalá te|os|tú|tengas @sufras
espero|deseo que te|os|tú|tengas @sufras|cáncer
te mereces|merecerías muerte|morir
deberías|debes|vas morir|morirte
te|os romper|romperé|partir|partiré|arrancar|arrancaré|reventar|sacar|sacaré los|las|la|el @cuerpo
tus días están contados
cuida|cuídate tu|la espalda
sales|saldrás|sale|acabas|acabarás|salir ataúd|morgue|cementerio|tumba|féretro
te vas a arrepentir
tírate por|de|del puente|azotea
@杀…你
你…棺材
把你…@杀
要你的命
弄瞎你
剁了你
让你死
让你…后悔
你等着瞧
小心你的狗命
希望你…死
祝你…癌
愿你…死
你…该死
你怎么不去死
你就该…死
你的死期
没人会想你
お前を…@殺
@殺…てやる
てめえを…@殺
お前…棺桶
棺桶…お前
棺桶で出
お前…死ね
癌になって
苦しんで死
夜道に気をつけ
消えてしまえ
首を絞め
目を抉
覚えてろ
後悔させてやる
生まれてこなければ
死んでしまえ
you|you're are|re|'re too|so stupid|dumb|dense|thick to
too stupid|dumb to tie
hope you rot|die|burn|suffer|choke
rot|burn in hell
break your|his|her|their hands|legs|arms|neck|bones|face|jaw|fingers
have drowned you
i|we will|gonna|going kill|hurt|cut|bury|stab|strangle you
i'll|we'll kill|hurt|bury|stab|strangle you
find out where you live
know where you live
if you were gone|dead
kill|hang yourself
wish you were dead
drop dead
slit your throat
smash your face|skull|head|teeth
beat you up|to|senseless
better off dead
burn your house
du bist zu|so blod|dumm|bescheuert
sollst verrotten|sterben|krepieren|verrecken
breche dir|euch
brech dir|euch
wo du wohnst
mutter hatte dich ertranken|abtreiben
dich umbringen|toten|totschlagen|abstechen|ertranken
ich bring|bringe dich um
wenn du weg|verschwunden|tot warst
verrecke|verreck
fahr zur holle
hang dich auf
tu es trop|si bete|stupide|con|debile pour
creve|crevez donc|charogne|ordure
va crever|mourir
puisses-tu crever|pourrir
pourris|pourrir en enfer
ou tu habites
te|vous briser|brise|briserai|casser|casserai|casse les|la mains|jambes|gueule|os
te briserai|casserai
aurait du te noyer
du te noyer
si tu disparaissais|mourais
te tuer|tuerai|buter|egorger
va te pendre
eres demasiado|tan tonto|tonta|estupido|estupida|torpe|idiota|burro para
ojala te pudras|mueras|murieras|ahogues
romper-|rompo|romperte|partire|partirte las|los manos|piernas|huesos|dedos
te romper-|partir-|matar-|mato
donde vives
debio|deberia|debia haberte|ahogarte ahogado|al
haberte ahogado
ahogarte al nacer
si desaparecieras|murieras|desaparecieses
muerete
vete al infierno
cuelgate|matate
你蠢得
你…太蠢
烂掉
打断你
你住哪
你住在哪
淹死你
把你淹死
你…淹死
你…永远消失
去死
弄死你
杀了你
打死你
死全家
不得好死
下地狱
お前…頭が悪い
腐ってしまえ
へし折ってやる
家を突き止め
溺れさせるべき
お前…永遠に消え
お前…消えても誰も
死ね
殺してやる
ぶっ殺
くたばれ
地獄に落ち
"""

# degrading a group of people
HATE = """
@group|they should|must|ought|deserve be|to @hurt_ed|die|gassed
@group are|is @low|inferior|thieves|rapists|terrorists|stupid|dirty|lazy|worthless
they|these|those|people are all|nothing|just @low
@group don't|do|not deserve|belong rights|here|vote|live|breathe|exist
deport|kill|shoot|gas|burn|exterminate|hang|castrate|sterilize all|every|those|these|the @group
no place|room for @group
country|town|city|street|world cleaner|better|safer|infested|overrun|polluted without|by|with @group
get rid of|all the|these|those|all @group
i hate|despise|loathe all|those|these|the @group
@group are ruining|destroying|invading|polluting
one of the|those|these|them lock|hide|watch|guard|mind|count the|your till|wallet|purse|bag|valuables|silver|cash|money|pockets
lazy|thieving|shifty|greedy eyes|hands|faces|look one|that of
@gruppe gehören|sollte|sollten|müssen|soll erschossen|vergast|gehängt|abgeschoben|ausgerottet|vertrieben|verbrannt|getötet|verrecken|lager|wand
@gruppe sind|ist @gering|kriminelle|verbrecher|diebe|minderwertig|dumm|faul|dreckig|vergewaltiger
@gruppe raus
ich hasse alle|diese|die @gruppe
@gruppe haben|gehören hier|nichts|nicht verloren|zu|hierher
weg mit den|diesen|allen @gruppe
einer|einen|eine von|der schließt|schließ|versteckt|versteck|sperrt|sperr|bewacht|hütet kasse|geldbeutel|brieftasche|schmuck|tasche
@groupe devraient|doivent|méritent|faut fusillés|fusiller|pendus|expulsés|expulser|exterminés|exterminer|brûlés|gazés|mourir|tuer|stérilisés
@groupe sont @vil|voleurs|criminels|violeurs|inférieurs|sales
dehors les|tous @groupe
expulser|exterminer|tuer|fusiller|gazer tous|les @groupe
je hais|déteste tous|ces|les @groupe
mort aux @groupe
@groupe n'ont|ont rien|pas à|leur|place faire|ici
l'un|un|une des|d'eux|de fermez|verrouillez|cachez|surveillez|gardez|ferme|cache|surveille caisse|portefeuille|sac|poches|bijoux|argent
@grupo deberían|merecen|hay|tienen fusilados|fusilar|expulsados|expulsarlos|exterminados|quemados|deportados|colgados|morir
@grupo son @vileza|ladrones|criminales|violadores|inferiores|sucios
fuera|muerte|abajo los|las|a|todos @grupo
odio a|todos los|las|esos @grupo
@grupo no merecen|tienen|pintan derechos|nada|vivir|aquí|votar
uno|una|otro de cierra|cierren|cerrad|esconde|esconded|vigila|vigilad|guarda|guardad|echa caja|cartera|bolso|bolsillos|joyas|dinero
@族…是@贱
@族…都该…死
@族…都该…杀
@族…滚出
@族…不配
@族…赶出
@族…消灭
把…@族…杀
杀光…@族
讨厌…@族
人…锁…钱
人…看好…钱包
天生…懒
@民…は@卑
@民…皆殺し
@民…出て行け
@民…追い出
@民…死ね
@民…消えろ
@民…価値がない
@民…殺す
人…レジ…鍵
人…財布…隠
are|is vermin|parasites|subhuman|cockroaches|leeches|savages|maggots
are all|nothing vermin|parasites|animals|criminals|thieves|rats
driven out of town|country|here
thieves|criminals|liars by blood|birth|nature
never hire|trust|employ|serve thieves|criminals|liars|savages
carries|carry|bring|spread filth|disease and disease|filth
send them|all back
street full stinks|reeks
stinks|reeks like a sewer
burn their|the houses|homes|shops
do|does not|never share a bus|table|room with
decent people do|don't|never not|share
better off if did not exist
better off without the
wipe|gas|exterminate them out|all
go back where you came
don't belong here
inferior race|people|breed
breed like rats|rabbits
sind|ist ungeziefer|parasiten|untermenschen|abschaum|ratten
aus der stadt|dem|land gejagt|vertrieben|jagen|werfen|raus
von geburt an|diebe diebe
stellt|stell nie|niemals ein
schleppt|schleppen|bringt|bringen dreck|krankheit|schmutz
schickt|schick sie zuruck
stinkt|stinken wie
ginge es uns besser
verbrennt|zundet|brennt|brenn ihre hauser
hauser verbrennt|anzunden|niederbrennen|brennen
anstandige leute|menschen teilen|fahren|sitzen
anstandige leute|menschen bus
sont|est de|des la vermine|parasites|rats|cafards
faut les|tous chasser
chasser de la ville
chasses de la ville
voleurs|criminels de naissance|nature|sang
n'embauchez|n'embauche jamais
embauchez jamais
apportent|apporte|transportent la crasse|maladie|salete
renvoyez|renvoyons les|les-les
renvoyez-les
pue|puent comme
serait|serions|irait mieux sans|si
se porterait|porterions|porterait mieux sans|si
vivrait|vivrions|vivraient tous|toutes|mieux mieux|sans|si
vivrait|vivrions mieux|plus si|sans
brulez|brulons leurs|les maisons
gens bien|honnetes|decents|convenables ne|partagent
son alimanas|plaga|sabandijas|parasitos|ratas|escoria|bichos
hay que echarlos|expulsarlos|sacarlos
echarlos|expulsarlos|echados|expulsados de la ciudad
ladrones|criminales de|por nacimiento|sangre
contraten|contrateis|contrates|contratar a nunca|jamas
nunca|jamas contraten|contrateis|contrates
traen|trae|llevan|lleva|contagian mugre|suciedad|enfermedad-|porqueria
mandenlos|devuelvanlos|devolvedlos|mandadlos|echenlos
apesta|apestan|hiede|huele como|a
estariamos|viviriamos mejor si|sin
quemen|quemad|quema|quememos sus|las casas
gente decente|bien no|comparte|sube|viaja
都是害虫
都是寄生虫
赶出城
把他们赶
带着脏病
天生就是贼
天生就是小偷
别雇
满街…臭
臭得像
要是没有…更好
没有…人…更好
烧了他们
烧掉他们
正派人不
劣等
灭绝他们
滚回
害虫だ
害虫であり
人は害虫
寄生虫だ
町から追い出
街から追い出
送り返せ
汚れと病気
生まれつきの泥棒
雇うな
だらけの通り
下水のように臭
存在しない方が
いない方が皆
家を焼いて
まともな人
まともな人間
劣等
根絶やし
"""

SEXUAL = """
suck|sucked|sucking|lick|licked|licking|ride|rode|riding|stroked|stroking|rubbed|fingered his|her|my|your|me @sex
thrust-|pushed|entered|pounded|penetrated|slid inside|into|deep her|him
nude|nudes|naked pics|pictures|photos|video|videos|girls|women|teens|webcam
hot|horny|slutty|naughty singles|milf|milfs|moms|babes|chicks
horny|slutty|naughty girls|teens|women|wives|couples
spread her|your legs
sex tape|video|videos|chat|cam|show
made love all|wildly|passionately
stieß|drang|rammte tief in sie|ihn|ihr|mich
leckte|lutschte|saugte|ritt|wichste schwanz|muschi|titten|brüste|kitzler
heiße|geile|versaute|nackte frauen|girls|singles|milfs|luder|weiber|fotos|videos|bilder|hausfrauen
spreizte ihre|die beine
sex video|videos|chat|cam|treffen
suçait|suça|lécha|léchait|chevaucha|caressait|branlait son|sa|ses|le|la @sexe
pénétra|pénètre en elle|lui
photos|vidéos|filles|femmes nues|nus|chaudes|coquines
écarta ses|les jambes|cuisses
chupó|chupaba|lamió|lamía|montó|acariciaba|masturbaba|mamó su|sus|la|el|le @sexo
penetró dentro|en|hasta ella|él
fotos|vídeos|videos|chicas|mujeres|maduras desnudas|calientes|cachondas
abrió sus|las piernas
裸照
裸聊
舔…下体
插入她
骚货
淫荡
自拍…裸
张开双腿
约炮
高潮…叫
叫…高潮
想和你上床
裸的乳房
赤裸…乳房
赤裸…呻吟
舐め…股
濡れた…アソコ
裸の写真
エロ動画
股を開
セフレ
無修正
絶頂に達
fuck|fucking|fucked
porn|porno|pornos|pornographic|xxx
oral|anal sex
blowjob|handjob|cumshot|gangbang|threesome|deepthroat
masturbat-
naked breasts|tits|body|girls|women
deep inside her|him
came with a scream
loud sex
had|having sex on|in|with
until she|he moaned|came
strip and get off
get off live|on
live on cam
her|his wet|hard pussy|cock
fick-|gefickt|ficken
geile|geilen|geiler|geil
drang tief in sie|ihn|ihr
kam mit einem schrei
lauten|hemmungslosen|wilden|heftigen sex
hatten sex
nackten|nackte bruste|brust|titten
bis sie|er stohnte|kam
vor der kamera ausziehen
ausziehen und es sich machen
oralsex|oralverkehr|analsex
masturbier-
penetra|penetre|penetrait profondement|sauvagement
jouit|jouir en criant|direct
elle jouit
bruyamment l'amour
firent|faisaient l'amour|bruyamment
seins nus
jusqu'a ce qu'elle gemisse|gemit|jouisse
deshabiller et jouir
fellation|sodomie
baiser|baise ce soir
te|vous baiser
celibataires chaud-|excit-|coquin-
chaud-|excit-|coquin- celibataires
masturb-
nichons|foutre
penetro hasta|profundamente|con
corrio|corria gritando
follar|follarte|follando|folla
cachond-|caliente- solter-
solter- cachond-|caliente-
sexo oral|anal|ruidoso|salvaje
pechos desnudos
senos desnudos
hasta que gimio|gimiera
mamada|felacion
desnudarse y correrse|masturbarse|tocarse
en directo|vivo masturb-|correrse|desnud-
desnud- masturb-|correrse
ruidosamente|ruidoso sexo|amor
hicieron el amor
做爱
口交
肛交
色情
自慰
呻吟…女
女…呻吟
她…呻吟
深深地进入
饥渴的单身
脱光
操你
性交
鸡巴
激しくセックス
セックスした
自慰
オナニー
生配信
裸の胸
愛撫
喘い
ヤりたが
欲求不満
フェラ
口淫
口腔性交
オーラルセックス
ポルノ
奥深くに入
中出し
"""

# sexual only beside another sign of it: each counts half
HALF = """
cock|pussy|tits|dildo|dick|boobs|nipples|orgasm-|horny|naked|nude|moan-|erection|clit|panties
schwanz|muschi|titten|nackt-|stöhn-|orgasmus|erregt|brüste|höschen|geil
bite|chatte|seins|nue|nues|nu|gémi-|orgasme|excité-|mouillée|culotte|cuisses
polla|coño|tetas|desnud-|gimi-|orgasmo|excitad-|húmeda|bragas|pezones
赤裸
高潮
上床
乳房
呻吟
下体
裸体
湿了
勃起
裸体
絶頂
おっぱい
喘ぎ
乳首
濡れ
勃起
全裸
"""

# somebody reports, forbids or teaches; the everyday and the medical sense
REPORT = """
hate speech
report warns|says|finds
handbook|manual|guide|policy|rule|code says|forbids|states|prohibits
calling a|an|someone|somebody
leads to a warning
is|are forbidden|banned|prohibited|punished|rising
was|were fined|suspended|warned|convicted for
laut handbuch
abmahnung|verwarnung
zu nennen
hetze gegen|zunimmt
hassrede
bericht warnt
verboten
selon le manuel|reglement
avertissement|sanction
traiter un|une|quelqu'un
discours de haine
rapport avertit
interdit
segun el manual|reglamento
llamar a un|colega
conlleva una
advertencia|sancion
discurso de odio
informe advierte
prohibido
手册
规定
警告
骂同事
仇恨言论
报告
禁止
手引き
規則
と呼ぶと
警告
憎悪表現
ヘイト
報告書
禁止
"""

# said by somebody else: counts where the words stand in quotation marks
SPEECH = """
said|shouted|wrote|called|yelled|quoted|alleged|reported|testified|claimed|accused|read|reads|says|sign|message|comment
court|judge|police|trial|newspaper|article|study|researchers|teacher|moderator|victim
sagte|schrieb|rief|nannte|angeklagt|beschimpfte|stand|hieß|kommentar|nachricht
gericht|richter|polizei|prozess|zeitung|artikel|studie|lehrer|lehrerin
dit|cria|écrivit|écrit|traita|accusé|insulté|déclara|lit|lisait|message
tribunal|juge|police|procès|journal|article|étude|professeur
dijo|gritó|escribió|llamó|acusado|insultó|declaró|decía|mensaje
tribunal|juez|policía|juicio|periódico|artículo|estudio|profesor|profesora
法院
警方
报道
他说
她说
写道
喊
裁判
警察
新聞
と書
と叫
と言
"""

# punished, or told in a work of fiction
TOLD_OF = """
fined|sentenced|arrested|convicted|prosecuted|apologized|apologised|dismissed for|after|over|because|when
novel|play|character|scene|poem|opera|actor|actress
do|please|never not|call|use call|say|write|use
what does word|term|insult mean|means
verurteilt|gesperrt|entlassen|geldstrafe|angeklagt wegen|weil|nachdem|für
roman|theaterstück|szene|figur|gedicht|oper|schauspieler
condamné|suspendu|renvoyé|amende pour|avoir|après
roman|pièce|scène|personnage|poème|opéra|acteur
condenado|suspendido|despedido|multado|multa por|tras|después
novela|obra|escena|personaje|poema|ópera|actor
小说
剧中
角色
判处
被罚
因为骂
小説
劇中
役者
逮捕
罰金
"""

# everyday sense of threatening words
HARMLESS = """
hair|chess|game|games|record|deal|budget|toast|cake|wood|calories|costs|habit|bread|onions|competition|opponent|score|code|tree|price|bill|workload
haare|schach|spiel|rekord|kuchen|brot|zwiebeln|holz|preis|kosten
cheveux|échecs|jeu|record|gâteau|pain|oignons|bois|prix
pelo|ajedrez|juego|récord|pastel|pan|cebollas|leña|precio
头发
象棋
游戏
记录
髪
将棋
記録
"""

EVERYDAY = """
grain|crop|crops|pantry|kitchen|barn|field|harvest|warehouse|garden|roof|cellar|attic|traps|pest|granary|store|farm|farmer|lice|insects
rooster|crowed|hen|hens|cat|cats|dog|dogs|bird|birds|horse|beef|chicken|recipe|oven
artery|surgery|tissue|biopsy|patient|patients|symptoms|examination|pregnan-|midwife|anatomy|museum|sculpture|statue|painting
getreide-|kornspeicher|speicher|scheune|keller|dachboden|ernte|küche|falle|schädlingsbekämpf-|hahn|katze|hund|patient-|operation|gemälde
grenier|grange|récolte|cuisine|cave|pièges|blé|chat|chien|coq|patient-|chirurgie|tableau|statue
granero|cosecha|cocina|almacén|sótano|trampas|trigo|gato|perro|gallo|paciente-|cirugía|cuadro|estatua
粮仓
仓库
农田
厨房
小狗
灭虫
患者
手术
雕像
穀物
倉庫
畑
台所
駆除
子犬
犬は
患者
手術
彫刻
safe|safer sex
sex education
contracepti-
leaflets|brochures
cancer
screening
nurse|doctor|clinic explains|hands
sicher-|safer sex
verhutung
krebs-|brustkrebs-
vorsorge
merkblatter
depistage
cancer
contraception|contraceptif-
sexo seguro
anticoncep-
cancer|mama
folletos
script|skript|proceso|processus|prozess|process
乳腺癌
避孕
安全性行为
筛查
传单
乳がん
避妊
安全な
検診
冊子
"""

# words one edit from a term above that mean something else
ORDINARY = "closer loses lower lover loved loosen baton idiom idioms mormon bitch witch ditch batch pitch horn horns porch listed listens costard custard mustard bustard dustbin where whose shore short slug shut slit slot count coach cooks clock coke block geige ferner baser raser salud salada soldado taller torado tirado dorado cocido minibar minables corner retired regard record ritard twas what wants"

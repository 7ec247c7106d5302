"""Fixed values of P8: words and turns of phrase that mark abuse, by what they contribute.

Classes: noun (a name to call someone), adj (a slighting attribute), dehum (a word that denies people's
humanity), group (people spoken of as a group), sex (explicit words), violent (verbs of violence), you and
me (the persons of a threat), mention (talk about words or a sober subject).
"""

# Single words; a trailing * stands for any ending.
WORDS = {
    "noun": {
        "en": "idiot moron imbecile cretin asshole arsehole bastard bitch scumbag scum dipshit shithead dickhead douchebag halfwit jackass dumbass wanker twat skank slut whore motherfucker fucker prick cunt loser retard freak wimp coward liar pig clown swine maggot bum trash garbage nitwit dimwit creep tosser bellend weakling",
        "de": "idiot vollidiot schwachkopf trottel depp schwein drecksau dreckskerl arschloch wichser hurensohn hure schlampe fotze missgeburt versager penner abschaum bastard mistkerl miststück feigling spast blödmann dummkopf drecksack arsch schweinehund vollpfosten vollhonk lügner clown",
        "es": "idiota imbécil imbecil estúpido estúpida gilipollas cabrón cabron cabrona hijoputa puta zorra payaso cerdo subnormal capullo mierda pendejo tarado inútil cretino bastardo escoria basura maricón cobarde",
        "fr": "idiot imbécile crétin connard connasse salaud salope enfoiré enculé abruti pute putain bâtard porc ordure raclure débile merde clown lâche fdp crevure trouduc",
        "it": "idiota imbecille cretino stronzo stronza coglione bastardo puttana troia merda porco maiale deficiente pezzente vigliacco pagliaccio cazzone testadicazzo verme",
        "pt": "idiota imbecil cretino estúpido estúpida otário cabrão puta vadia merda porco palhaço burro parvo bastardo nojento filhodaputa desgraçado covarde verme",
        "ru": "идиот* дурак* дура кретин* придурок* придурк* урод* сволоч* мразь* мрази ублюд* скотин* тварь* твари подонок* подонк* дебил* мудак* сука суки суку шлюх* тупиц* козёл козел* гнида свинья* ничтожество дрянь* негодяй*",
    },
    "adj": {
        "en": "stupid worthless miserable pathetic filthy disgusting useless spineless lying damned damn fucking ugly stinking cowardly brainless retarded hopeless dirty bloody goddamn shitty absolute dumb rotten greasy",
        "de": "dumm* dreckig* widerlich* erbärmlich* feige* verdammt* wertlos* hässlich* elend* dämlich* blöd* mies* ekelhaft* nutzlos* jämmerlich*",
        "es": "miserable* asqueros* inútil* inutil* puto puta maldito maldita estúpido estúpida sucio sucia repugnante* despreciable* patétic*",
        "fr": "minable* dégueulasse* répugnant* misérable* sale* pauvre* stupide* pathétique* foutu* putain inutile* lamentable*",
        "it": "schifos* inutile* miserabile* stupid* sporco sporca maledett* patetic* lurid* ridicol* disgustos*",
        "pt": "nojent* inútil* miseráve* estúpid* maldit* imund* patétic* porc* desprezíve* ridícul*",
        "ru": "мерзк* жалк* туп* никчёмн* никчемн* поган* гнусн* грязн* вонюч* подл*",
    },
    "dehum": {
        "en": "vermin parasite* plague rats cockroach* insects animals subhuman* disease filth rabble savages leeches locusts pest scum lice",
        "de": "ungeziefer parasiten ratten abschaum gesindel schmarotzer pest viecher tiere untermenschen dreck",
        "es": "basura escoria parásitos ratas alimañas plaga chusma cucarachas animales peste gentuza bichos",
        "fr": "vermine parasites rats racaille cafards ordures peste déchets animaux nuisibles",
        "it": "parassiti feccia topi vermi ratti spazzatura animali piaga scarafaggi bestie",
        "pt": "lixo parasitas ratos escória praga vermes animais baratas ralé bichos",
        "ru": "паразит* крыс* отброс* твари нелюди животные тараканы сброд чума вредители",
    },
    "sex": {
        "en": "fuck fucked fucks cock dick pussy tits erection panties orgasm climax climaxed moan moaned moans blowjob cum cumming thrust naked nude undressed stripper horny nipples cunt banged screwed lick boobs",
        "de": "ficken fickt fickte gefickt nackt* schwanz muschi titten stöhnte stöhnt orgasmus geil* bumst",
        "es": "follar follara follaba follando folló fóllame desnud* polla coño tetas gimió gemía orgasmo verga chupó chupar",
        "fr": "baise baiser baisa baisait baisée nue chatte seins gémit orgasme sucer suça niquer enculer",
        "it": "scopare scoparla scoparlo scopava nuda nudo cazzo figa tette gemeva orgasmo pompino",
        "pt": "foder fodesse fodeu fodia foda nua caralho buceta cona mamas gemia gemeu orgasmo trepar chupou",
        "ru": "трах* ебат* выеб* догола голая голой сиськ* стонал* оргазм* разделась разделся минет*",
    },
}

# Everyday words a few letters away from a term, from a public vocabulary, the documents and by hand.
EVERYDAY = """
    animal boise raise kaiser banned hanged besie batch birch ditch hitch mitch pitch witch botch butch blood bombs books boots burst barro burra curro carbon chatt chatter blown crown flown
    howard toward creed creek creeps creepy cummings humming deficient diseases wreck druck treck elena election fifth feder folder moder poder podia podeu collar dollar hollar fallar folly
    break wreak sucked tucked tucker zucker sucking bucks ducks sucks geneva grease homeless horns inund insect inserts inspects closer laser leser loses lover lower loner poser lucid lured
    dying flying laying tying vying hamas mapas merge perde perda pierda loans means moins monas coron boron moran mormon moroc morton baked faked named nipple ordre bordure parties parto parco
    penned paste pests reste teste geste veste poste piste plaza plagued plaque prague playa plata polls polly pollo bolla porto pouco brick price trick crick putin rubble batas datas katas
    latas natas patas rastas ritas rotas ramos rates ratios atten hatten latten matten regard reward regarded rewarded gotten rotte salad slope savage schwarz schein reins skins spins veins
    shank spank swank stank spart swast marsch barsch sticking stripped sucker sucre super lucia socio shine spine swing swipe twine texas tutte trust there tiers tiefe tieren bitten mitten
    kitten ritten sitten tossed crash brash thrash prepar trois tropa varia vazia verda verde verge verna verra versa verta verja ferme fermi perme verse versi verte hermes verses termin banker
    tanker walker wander chore shore where whole whose dorra jorra korra torra borra corra zorro jenner renner kenner tenner nacht packt picken nicken baisse baisser rocaille dichos nichos metas
    letas setas cerco cardo zeige feile голос голод голом долой полой котел брод сбор дебит мазь
"""

# Weight of each class; a word of two classes counts by the stronger one in its setting.
WEIGHTS = {"noun": 1.0, "adj": 0.6, "dehum": 1.0, "sex": 0.8}

# Turns of phrase on the restored, lower-case sentence, with class and weight.
PHRASES = (
    # someone is addressed or pointed at
    ("aim", 1.0, r"\b(?:you|your|yours|yourself|u|ur|du|dich|dir|dein\w*|tu|te|ti|toi|ton|ta|eres|sei|és|você|vocês|vous|ты|тебя|тебе|твой|твоя|твою|свой|you're)\b|[-–](?:te|toi)\b|你"),
    ("aim", 0.6, r"\blook at this\b|\bwhat an? \w+|\bis an? (?:\w+ ){0,2}|\bist ein\w* |\bes una? |\best une? |\bè un[ao]? |\bé uma? |\bкакой же\b|\bseht euch\b|\bmira a\b|\bregarde\w* ce"),
    # threats
    ("threat", 2.0, r"\bi(?:'ll| will| am going to|'m going to| shall)? (?:\w+ ){0,3}(?:kill|strangle|stab|gut|shoot|beat|smash|hurt|punch|slap|slit|choke|cut|burn|bury|break|crush|hit|murder|knife|hang|destroy|bash|batter|skin|drown|find) (?:you|your|every bone|ur)\b"),
    ("threat", 2.0, r"\bbreak (?:every bone|your (?:bones|neck|legs|jaw|face))|\bi know where you (?:live|sleep|work)\b|\bwatch your back\b"),
    ("threat", 2.0, r"\bich (?:mach|mache|schlag|schlage|bring|bringe|stech|steche|brech|breche) dich\b|\bich (?:schlag|brech)\w* dir\b|\bbevor ich zuschlage\b|\bbring\w* dich um\b|\bmach\w* dich fertig\b|\bsonst (?:setzt es|knallt)"),
    ("threat", 2.0, r"\b(?:te|le) (?:parto|rompo|voy a (?:matar|romper|partir)|mato|reviento)\b|\b(?:je (?:te|vais te) (?:démolis|tue|casse|crève|défonce|pète|égorge|massacre))\w*|\bti (?:spacco|rompo|ammazzo|uccido|massacro|distruggo|gonfio|spezzo)\b|\b(?:parto|rebento|mato|parto)-te\b|\bte (?:mato|arrebento|quebro)\b"),
    ("threat", 2.0, r"\bслома\w* тебе\b|\bя тебя (?:найду|убью|урою|порву|зарежу)\b|\bубью тебя\b|\bнабью тебе\b|打死你|打断你|杀了你|弄死你|砍死你|揍死你"),
    # wishes of harm
    ("wish", 2.0, r"\b(?:kill|hang|shoot|drown) yourself\b|\bjump off an? (?:bridge|cliff|roof|building)\b|\b(?:nobody|no one) (?:would|will) miss you\b|\bnever have been born\b|\bhope you (?:choke|die|rot|suffer|burn|get)|\brot in (?:hell|that|your|prison)|\bgo to hell\b|\bcrawl back into\b|\bdrop dead\b|\bdo us all a favou?r\b|\bdeserves? (?:every bit of pain|to (?:die|suffer|rot|be beaten))|\bnobody (?:loves|wants) you\b|\bput down like an? dog\b|\bno right to breathe\b|\bbeaten in the street\b|\bwant to vomit\b|\bshould lose (?:her|his|their) job and\b|\bburn in hell\b|\bget lost before\b|\bfavou?r and disappear\b|\bmake everyone sick\b"),
    ("wish", 2.0, r"\bgeh doch sterben\b|\bspring doch\b|\bverreck\w*\b|\bdich (?:vermisst|will) (?:\w+ ){0,2}keiner\b|\bfahr zur hölle\b|\bdeine verdammte fresse\b|\bhalt (?:deine|die) (?:verdammte |dumme )?(?:fresse|schnauze|klappe|maul)\b"),
    ("wish", 1.5, r"\bvete al infierno\b|\bojalá te mueras\b|\bnadie te (?:quiere|echaría)\b|\bmuérete\b|\bno vales para nada\b|\bva (?:crever|mourir|te faire)\b|\bpersonne ne (?:veut|voudra) de toi\b|\bva en enfer\b|\bcrève\b|\bvai all'inferno\b|\bnessuno ti (?:vuole|ama)\b|\bcrepa\b|\bvai para o inferno\b|\bninguém te (?:quer|ama)\b|\bmorre\b|\bvai morrer\b|\bsanno tutti\b|\bvai a morire\b"),
    ("wish", 1.5, r"\bсдохни\b|\bиди к ч[её]рту\b|\bникому не нуж|\bпош[её]л (?:ты|вон)\b|\bзакрой свой\b|快去死|去死吧|滚出去|没人(?:要|喜欢|爱)你|闭上你的臭嘴"),
    ("wish", 0.6, r"\bshut (?:your|up)\b|\bferme\b|\bcierra\b|\bcállate\b|\btais-toi\b|\bstai zitto\b|\bchiudi quella bocca\b|\bcala-te\b|\bfecha essa boca\b|\bcala a boca\b|\bзаткнись\b|闭嘴"),
    # against groups
    ("group", 0.7, r"\b(?:those|these|all|every|any|such|that|the) (?:\w+ ){0,2}(?:people|folk|immigrants?|refugees|foreigners|beggars|families|kind|lot|tribe|faith|race|believers|women|gypsies|migrants|\w+(?:ians|ites|ish|ese|ers|ian|ite))\b|\b(?:women|immigrants|foreigners|refugees|cripples|men who|people (?:like|from|with)|their kind|your kind|those with that|with that skin|believers in)\b|\bthe (?:old|disabled|crippled|poor|sick|weak|blind|deaf|fat) and the\b|\bevery \w+ian i met\b"),
    ("group", 0.7, r"\b(?:diese?s?|alle|solche) [\wäöüß-]+|\bleute wie\b|-pack\b|\b(?:est[oa]s|es[oa]s|todos los|los de su) [\wñ]+|\b(?:ces|tous les) [\wéè]+|\b(?:quest[ie]|quei|quegli|tutti i|tutti gli) \w+|\b(?:ess[ea]s|todos os) \w+|\bэти\b|\bтакие\b|\bвсе эти\b|他们|这些人|那种人|这帮"),
    ("call", 1.6, r"\bdriven out\b|\bhunted out\b|\bthrown out of (?:this|the|our) (?:country|town|land)|\b(?:wipe|wiped) (?:them )?out\b|\bget rid of (?:them|all)\b|\bburn (?:their|down their) (?:houses|homes|shops)|\bbelong in (?:cages|camps|chains|the gutter|jail)\b|\bmust be put down\b|\bdeserves? (?:a beating|whatever is done|what(?:ever)? (?:they|comes|is))|\bdo(?:es)? not belong (?:among|here|in)|\bbreed like\b|\bminds? of insects\b|\bin their blood\b|\bspread filth\b|\btoo stupid to\b|\bback in the kitchen\b|\bnever be like us\b|\bshould (?:all )?be (?:shot|gassed|deported|exterminated|sterili[sz]ed|locked up|beaten|hanged|removed)\b|\bexterminate\b|\bsend them (?:all )?back\b|\bno place (?:here|among)\b|\bkeep them out\b|\bdo not serve \w+ (?:here|in)\b"),
    ("call", 1.6, r"\baus dem (?:land|dorf) gejagt\b|\bweg mit ihnen\b|\bkeine menschen\b|\bgehör\w+ (?:alle )?(?:weg|raus|vergast|eingesperrt|erschossen|ausgerottet)|\bausrotten\b|\braus mit\b|\bhay que (?:echarlos|expulsarlos|eliminarlos|acabar)|\bno merecen vivir\b|\bfuera (?:todos|con)|\bil faut (?:tous )?les (?:chasser|éliminer|expulser)|\bne méritent pas de vivre\b|\bbisogna cacciar\w+|\bnon meritano di vivere\b|\bandrebbero (?:cacciati|eliminati)|\bdeviam (?:ser )?todos (?:expulsos|morrer|mortos)|\bnão merecem viver\b|\bгнать их\b|\bне люди\b|\bвыгнать их\b|应该全部赶出去|全部赶走|都该死|不配活"),
    # explicit acts
    ("act", 1.5, r"\b(?:took|take|takes|taking|sucked?) his (?:\w+ )?(?:cock|dick|erection|\S+) into her mouth|\bspread (?:her|his) legs (?:for|wide)|\brode (?:him|her) (?:hard|\w+ on)|\bbanged (?:him|her)\b|\bscrewed (?:him|her)\b|\bfuck(?:ed|s)? (?:him|her|me)\b|\b(?:between|inside) her thighs\b|\bfingers (?:went|slid|pushed) (?:deeper|inside)|\bclosed around his\b|\b(?:want|have|having) sex (?:tonight|now|with)|\bstrip(?:ping)? live\b|\blick every part\b|\bthrust (?:into|inside)\b|\benter her\b|\bwet and naked\b|\bwanted it rougher\b|\bas they climaxed\b|\bmoan on top\b|\brubbed her (?:pussy|tits|bare)|\bbegg(?:ed|ing) (?:him|her|for) (?:to |more)"),
    ("act", 0.7, r"\b(?:begged|begging|pleaded|supplia|suplicó|pregò|pediu|умоляла|wollte, dass er)\b|\bon top of (?:me|him|her)\b|\b(?:all night|toda la noche|outra vez|ancora|encore|ещё раз)\b|\bon the (?:bed|sofa|kitchen floor)\b|\bto the bed\b|\bem cima dele\b|\bcontre lui\b|\bsul letto\b"),
    ("act", 1.6, r"做爱|性交|口交|操(?:她|他|我)|插入她|高潮"),
    ("act", 0.8, r"脱光|裸体|赤裸|呻吟"),
    # Chinese names and attributes, which have no word breaks
    ("noun", 1.0, r"白痴|混蛋|王八蛋|贱人|废物|人渣|蠢货|畜生|傻逼|傻瓜|笨蛋|婊子|垃圾|杂种|狗东西|臭婊子|懦夫|蠢猪"),
    ("adj", 0.6, r"没用的|恶心的|可怜的|臭嘴|该死的|下贱|愚蠢的|肮脏的"),
    ("dehum", 1.0, r"害虫|寄生虫|老鼠|蟑螂|垃圾|渣滓|瘟疫|牲口"),
    ("noun", 1.0, r"\bpiece of shit\b|\bson of a bitch\b|\bhijo de puta\b|\bfils de pute\b|\bfiglio di puttana\b|\bfilho da puta\b|\bpezzo di merda\b|\bstück (?:scheiße|dreck)\b|\bсукин сын\b|\bbouffon\b|\bbon à rien\b"),
    # words spoken of, or a sober subject
    ("mention", 1.0, r"\bthe (?:word|term|phrase|insult|slur)s? [\"“'‘«]|\b(?:words?|terms?|insults?|slurs?|expressions?) (?:such as|like|including)\b|\b(?:annotation|style|moderation) guide\b|\braters?\b|\bdictionary\b|\bdas wort [\"„“]|\bla palabra [\"“«]|\ble mot [\"“«]|\bla parola [\"“«]|\ba palavra [\"“«]|\bслово [\"«“]|词语|单词|这个词|的说法|\bein wörterbuch\b|\bel diccionario\b|\ble dictionnaire\b|\bil dizionario\b|\bo dicionário\b|\bсловар"),
)

# Sober subjects, which soften words that are said to nobody's face.
CLAIMS = r"\bmoderators?\b|\bflagged\b|\bpropaganda\b|\bthe essay\b|\bthe survey\b|\bthe study\b|\bthe article (?:asks|describes|explains)|\beducation\b"

# What says that quoted words are reported, judged or discussed.
REPORTED = (
    r"\b(?:quot(?:e|es|ed|ing|ation)|report(?:s|ed)? (?:quotes|cites|that|the)|condemn(?:s|ed)?|den(?:ounced|ounces)|the (?:insult|slur|phrase|message|comment|remark|sentence|words|posts?)|fined|convicted|sentenced for|court|judge|apologi[sz]ed for|for example the|read aloud)\b"
    r"|\b(?:zitier\w*|verurteil\w*|gericht|die (?:beleidigung|äußerung|nachricht))\b|\b(?:cita|citó|condenó|condenado|el (?:insulto|mensaje|comentario)|tribunal|juez)\b|\b(?:citer?|cité|condamn\w+|l'insulte|le (?:message|commentaire)|tribunal|juge)\b"
    r"|\b(?:citato|condannat\w|l'insulto|il (?:messaggio|commento)|giudice)\b|\b(?:citou|condenad\w|o (?:insulto|comentário)|a mensagem|juiz)\b|\b(?:цитир\w+|осуд\w+|оскорблени\w+|сообщени\w+|суд)\b|引用|谴责|法院|判决|这句话"
)

# Literal pieces, one of which stands in whatever the decisive turns of phrase above match.
TRIGGERS = (
    "kill strangle stab gut shoot beat smash hurt punch slap slit choke cut burn bury break crush hit murder knife hang destroy bash batter skin drown find "
    "know·where·you watch·your·back zuschlage mach·dich mache·dich schlag bring·dich bringe·dich stech brech mach·dich·fertig setzt·es knallt dich·um "
    "te·parto le·parto rompo voy·a mato reviento démolis tue casse crève défonce pète égorge massacr spacco ammazzo uccido distruggo gonfio spezzo parto-te rebento arrebento quebro "
    "слома я·тебя·найду убью урою порву зарежу набью 死你 断你 杀了你 "
    "yourself jump·off miss·you been·born hope·you rot·in go·to·hell crawl·back drop·dead favour favor every·bit deserve nobody·loves nobody·wants down·like no·right·to in·the·street to·vomit lose·her lose·his lose·their in·hell get·lost everyone·sick "
    "geh·doch spring·doch verreck keiner zur·hölle fresse schnauze klappe maul al·infierno ojalá nadie·te muérete no·vales va·crever va·mourir va·te·faire personne·ne en·enfer all'inferno nessuno·ti crepa o·inferno ninguém·te morre vai·morrer sanno·tutti a·morire "
    "сдохни черту чёрту никому·не·нуж пошел пошёл закрой·свой 去死 滚出去 没人 臭嘴 "
    "driven·out hunted·out thrown·out wipe get·rid belong be·put·down breed·like of·insects their·blood spread·filth too·stupid the·kitchen like·us should·be should·all exterminat send·them no·place keep·them not·serve "
    "gejagt weg·mit keine·menschen gehör ausrotten raus·mit hay·que merecen·vivir fuera·todos fuera·con il·faut ne·méritent bisogna non·meritano andrebbero deviam merecem гнать·их не·люди выгнать·их 赶出去 赶走 都该死 不配活 "
    "into·her·mouth her·legs his·legs rode·him rode·her banged screwed fuck her·thighs fingers closed·around sex·tonight sex·now sex·with strip every·part thrust enter·her wet·and·naked rougher climaxed moan rubbed·her begg "
    "做爱 性交 口交 操她 操他 操我 插入她 高潮 白痴 混蛋 王八蛋 贱人 废物 人渣 蠢 畜生 傻 笨蛋 婊子 垃圾 杂种 狗东西 懦夫 害虫 寄生虫 老鼠 蟑螂 渣滓 瘟疫 牲口 "
    "of·shit of·a·bitch de·puta de·pute di·puttana da·puta di·merda stück·scheiße stück·dreck сукин bouffon à·rien"
)

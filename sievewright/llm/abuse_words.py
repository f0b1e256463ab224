"""Words of the abuse grammar by class, in English, German, French, Spanish and Ukrainian.

Fixed values, to be extended like any word list.  A word may be in several
classes.  Lookup ignores case, accents and the script of look-alike letters.  An
entry that ends with a hyphen is a stem: it stands for itself and for itself with
each ending of ``ENDINGS``.
"""

#: Endings of stems: plurals, cases and persons of the five languages.
ENDINGS = """
s es e en er em in innen n d ed ing y x a o as os ais ait és ée ées er ant
и і у ю ом ем ів ам ами ах а я ою ею ка ки о е й ий ої ого ому их ими ім ають ає
"""

#: Words that insult whomever they are said of.
INSULT = """
idiot- moron- cretin- imbecile- loser- scumbag- bastard- jackass- jackasss asshole- arsehole- dickhead- dumbass- shithead- motherfucker- fuckwit- wanker-
twat- dimwit- nitwit- halfwit- lowlife- whore- slut- douchebag- dipshit- numbskull- numskull- dumbfuck- bellend- cunt- shitbag- weirdo-
vollidiot- vollpfosten trottel arschloch arschlöcher mistkerl- drecksack dreckskerl- miststück- schwachkopf schwachköpfe dummkopf blödmann wichser- hurensohn hurensöhne schlampe-
penner missgeburt- drecksau arschgeige- vollhonk spasti- hurenkind
connard- connasse- abruti- crétin- imbécile- salaud- salope- ordure- enfoiré- enculé- débile- bouffon raclure- bâtard- putain pute- minable-
imbécil- idiota- cabrón cabrones cabron gilipollas cretino- desgraciado- pendejo- capullo- mamón hijoputa subnormal- tarado- hijueputa puta
ідіот- дурень дурні дурню дурепа кретин- мерзотник- виродок виродки виродку покидьок покидьки покидьку придурок придурки придурку негідник- тварюка довбень довбню дебіл- сволота падлюка мудак- нікчема- дебілка
"""
#: Such words that have plain meanings too: alone they say nothing.
SOFT = """
pig- swine rat- snake- clown- fool- donkey- trash garbage bitch- scum prick- retard- cow dog- worm- weasel- cockroach- parasite- fraud- creep- liar- dummy coward- filth leech- dunce- bozo-
schwein- esel sau clown- ratte- versager- stück- dreck abschaum hund kuh null lügner müll
cochon- porc- âne- chien- rat- vermine minable- perdant- menteur- nul-
cerdo- burro- rata- basura perro- mierda inútil- mentiroso-
свиня осел цап баран клоун- корова собака сміття щур- лайно нікчемо
"""
#: Words that degrade a person.
DEGRADING = """
stupid stupidest dumb dumber dumbest useless worthless pathetic brainless braindead fucking disgusting filthy ugly lazy miserable rotten spineless retarded moronic idiotic
dumm- blöd- erbärmlich- wertlos- dreckig- hässlich- verdammt- unnütz-
stupide- sale- pauvre- inutile- minable- moche- gros fini con conne
estúpid- inútil- maldit- asqueros- puto patétic- feo tonto tonta
дурний дурна дурні тупий тупа тупі тупе нікчемний нікчемна жалюгідний жалюгідна клятий огидний огидна
"""
#: Words that make it stronger.
STRONGER = """
so such too really complete total absolute utter real damn bloody fat dirty little old big two three what
so zu wirklich echt ganz komplett total richtig kleiner kleines große fette verdammtes
si trop vraiment tellement vrai vraie total totale petit petite grosse
tan muy realmente completo total verdadero gran
такий така повний повна справжній справжня дуже занадто надто
"""
YOU = """
you your yours youre u yourself yourselves thou du dich dir dein deine deinen deinem deiner euch euer ihr tu toi te ton ta tes vous votre
tú usted ustedes vosotros ti ты ти тебе тобі твій твоя твоє твої твою твого ви вас вам ваш ваша твоїм своїм своєю
"""
BE = """
are is am were was be being look bist seid ist sind bin es est êtes sont suis eres son sois є виглядаєш sommes
"""
YOU_ARE = "you're you’re youre eres n'es t'es"
ARTICLE = "a an the ein eine einen einem eines der die das un une des le la les los las el la nothing but just only kind of de d' this that n'es qu'une qu'un"
I = "i we i'm we're im ich wir je j' nous yo я ми"  # noqa: E741
WILL = "will would gonna going shall werde werden würde vais allons voy vamos could should about"
I_WILL = "i'll we'll ill i'd"
PERSON = "he she they who guy man woman manager boss neighbour neighbor supervisor colleague everyone er sie wer kerl typ chef il elle type patron él ella jefe він вона вони начальник сусід this that"

#: Orders that send someone away or silence them.
DISMISS = """
fuck piss screw fahr verpiss verschwinde ferme dégage va vete cállate calla lárgate замовкни заткнись заткни іди йди пішов пішла забирайся get go shut halt geh nique drop kiss
"""
AWAY = "hell lost hölle diable infierno carajo біса дідька klappe maul gueule off foutre mierda пельку fresse mouth schnauze dead sterben ass cul mère забудь"
CURSE = "fuck screw nique verpiss encule"
PIECE = "piece pieces bunch pack waste stück haufen espèce tas pedazo montón bande panda купка шматок"
REFUSE = "shit garbage trash dirt filth scheiße dreck merde mierda лайна гівна oxygen space air skin breath idiot idiota idiots"

#: Groups of people.
GROUP = """
immigrant- migrant- refugee- foreigner- women men gay- lesbian- homosexual- jew- muslim- christian- believer- disabled old black- white- gypsy gypsies roma arab- asian- african- elderly poor religion people
ausländer- flüchtling- migrant- frau- frauen jude- juden muslim- schwule- behinderte- zigeuner
étranger- immigré- migrant- réfugié- femmes juif- musulman- homosexuel- handicapé- gitans arabes
inmigrante- extranjero- refugiado- mujeres judío- musulmán musulmanes homosexual- gitano- moro-
мігрант- іноземц- іноземці біженц- біженці жінк- жінки жінок євре- євреї мусульман- геї геїв інвалід- роми циган- цигани
"""
ALL = "all every those these alle diese tous toutes ces todos todas esos estos усі всі ці усім"
#: What people are called to deny that they are people.
VERMIN = """
vermin parasite- filth plague animals animal subhuman trash scum rats cockroaches disease cancer garbage savages dirt pests lice burden sick inferior
ungeziefer parasiten abschaum dreck untermenschen pest tiere ratten
parasites vermine racaille peste ordures rats nuisibles animaux
parásitos plaga escoria basura animales ratas alimañas
паразит- нечисть худоба бидло чума щури непотріб зараза тварини
"""
CRIME = "thieves thief criminals liars rapists terrorists diebe verbrecher voleurs criminels ladrones delincuentes злодії злочинці терористи stupid dumb lazy filthy dumm faul дурні тупі ліниві tontas tontos"
HATE = "hate hates despise loathe detest hasse hassen déteste haïs odio odiamos ненавиджу ненавидимо"
EXPEL = """
throw thrown out deport deported expel expelled exterminate exterminated kill killed gas gassed burn burned hang hanged cage cages caged belong driven shipped kicked banned shot back
gehören raus rauswerfen vertreiben vergasen vergast abschieben weg chasser virer expulser dehors
echar echarlos expulsar expulsarlos fuera вигнати викинути виселити знищити звідси геть
"""
MUST = "should must ought need have sollten müssen muss faut devraient hay deben debería треба повинні мають"
RIGHTS = "deserve rights allowed children near away born vote голосувати denken thinking"
COUNTRY = "country land where heimat pays país tierra країни країну додому"
DEATH_TO = "death tod mort muerte смерть"

#: Threats.
HARM = """
break kill hurt slap punch beat smash stab shoot strangle murder burn bury choke crush cut destroy skin drown end
brechen töten schlagen umbringen verprügeln erwürgen abstechen tuer frapper casser briser crever étrangler égorger
matar romper golpear pegar partir reventar зламати вбити вдарити
"""
HARM_I = "зламаю вб'ю вбью вбю вдарю поб'ю приб'ю заріжу задушу mataré romperé tuerai schlag schlage brech breche töte mato"
KILL_OFF = "um"
BRING = "bring bringe"
BODY = """
fingers finger face neck bones legs teeth head knees arm arms throat nose skull jaw hands
finger gesicht hals knochen beine zähne doigts visage cou os jambes dents gueule dedos cara cuello huesos piernas dientes
пальці обличчя шию кістки ноги зуби горло голову
"""
FIND = "live regret night sleep family house kids children school wohnst vis habites vives живеш"
WISH_GONE = """
miss gone disappear ashamed born favour favor fire choke die dead sterben verreckst mourir crever morir mueras здохни здохнеш зникни помри weint bus tomorrow cry
"""
FATE = "die dead pay suffer sterben verrecken mourir crever sufrir morir здохнеш помреш пошкодуєш mueras verreckst"
NEVER = "never nie jamais nunca ніколи"
WALK = "walk talk speak breathe see gehen laufen marcher parler caminar hablar ходити again"
PUT = "put bring send bringe bringen mettre envoyer mandar meter"
GRAVE = "hospital grave coffin wheelchair ground morgue krankenhaus grab sarg hôpital tombe hospital tumba lugar лікарню могилу"
BACK = "back rücken dos espalda спину"
WATCH = "watch pass surveille cuida"
LIKE = "people like leute wie gens comme gente como люди такі"

#: Sexual content: words that are explicit by themselves, and words that need another one.
EXPLICIT = """
hardcore horny nudes panties erection moaning masturbate masturbating orgasm blowjob cumshot handjob dildo gangbang milf xxx pornographic
cum cumming tits titties boobs clit fuck fucked fucking naughty sexy
geil fickt ficken wichsen titten muschi nackte höschen stöhnte erektion
bander baise baiser nue culotte érection gémissait
follar polla tetas bragas erección desnuda cachonda gemía
порно трусики ерекція стогнала трахати голі сиськи збуджена
"""
SEXUAL = """
sex porn porno nude naked breasts breast lick licked licking strip penis vagina nipples lust kiss bed girls singles cams pics cock cocks pussy spread legs mouth harder slut inch
nackt brüste lecken küssen schwanz feuchte sexe nu seins lécher lécha chatte bite sexo desnudo pechos lamer boca coño секс голий гола груди лизати лизав оголена
"""
BODILY = "she he her his him they them your sie er ihr ihre elle il sa ella su вона він її"

NOT = "not never nobody no none neither nor without don't isn't aren't kein keine keinen nicht niemand nie pas aucun jamais personne no nadie nunca ningún не ніхто ні жоден"
#: Words about words: moderation, lists, examples.
MENTION = """
word words term terms list lists rule rules moderation moderator filter filters detection detect detector classifier label labels policy phrase phrases comment comments message messages chapter title threats insults
wort wörter liste filter regel begriff mot mots liste règle terme filtre palabra palabras lista regla filtro frase censor слово слова список правило фільтр скарга модерація модерації фразу
reported report removed flagged blocked review export containing contains
"""
#: Things of trades in which such words are plain.
TECHNICAL = """
process processes job core dump debug symbols terminal bus master slave device devices eye cable cables test tests column columns form age
region height diameter resin forestry photo bug assassin cockpit pine penetration port server thread loop pointer api protocol regex process seal timing file files
"""
#: Single words of certain patterns.
SWEAR = "swear schwöre jure juro клянусь клянуся"
WHO = "who wer qui quién хто"
THIS = "this that diesen diese ce cet cette este esta ese цього цю mein my mon mi наш our dieser"
WHAT = "what was quel quelle qué яка який який-же"
TAUNT = "whining crying ass arse jammern gemecker plaindre quejarte скиглити"
TYPICAL = "typical typisch typische typique típico típica типовий типова"
ONLY = "only nur seul seule solo sólo тільки лише"
WOULD = "would could macht casse rompe міг могла"
MOTHER = "mother mum mutter mère madre мати мама family whole kind familie famille familia"
WISH = "hope wish hoffe hoffentlich espère j'espère espero ojalá сподіваюся бажаю"
KNOW = "know weiß wissen sais savons sé sabemos знаю знаємо"
WHERE = "where wo où dónde donde де"
AND = "and und et y і та"
SURE = "sure swear promise dafür"
LOVE = "loves likes wants needs asked"
SERVE = "sirves taugst vaux"
NOTHING = "nada nichts rien nothing"
DISGUST = "disgust asco widerst dégoûtes kotzt"
BRAIN = "think read spell lesen denken code"

CLASSES: dict[str, str] = {
    "INSULT": INSULT, "SOFT": SOFT, "ADJ": DEGRADING, "VERY": STRONGER, "YOU": YOU, "BE": BE, "YOU_ARE": YOU_ARE, "DET": ARTICLE, "I": I, "WILL": WILL, "I_WILL": I_WILL, "PERSON": PERSON,
    "DISMISS": DISMISS, "AWAY": AWAY, "CURSE": CURSE, "PIECE": PIECE, "REFUSE": REFUSE, "GROUP": GROUP, "ALL": ALL, "VERMIN": VERMIN, "CRIME": CRIME, "HATE": HATE, "EXPEL": EXPEL, "MUST": MUST,
    "RIGHTS": RIGHTS, "COUNTRY": COUNTRY, "DEATH": DEATH_TO, "HARM": HARM, "HARM_I": HARM_I, "UM": KILL_OFF, "BRING": BRING, "BODY": BODY, "FIND": FIND, "GONE": WISH_GONE, "FATE": FATE, "NEVER": NEVER,
    "WALK": WALK, "PUT": PUT, "GRAVE": GRAVE, "BACK": BACK, "WATCH": WATCH, "LIKE": LIKE, "EXPLICIT": EXPLICIT, "SEXUAL": SEXUAL, "BODILY": BODILY, "NOT": NOT, "MENTION": MENTION, "TECHNICAL": TECHNICAL,
    "SWEAR": SWEAR, "WHO": WHO, "THIS": THIS, "WHAT": WHAT, "TAUNT": TAUNT, "TYPICAL": TYPICAL, "ONLY": ONLY, "WOULD": WOULD, "MOTHER": MOTHER, "WISH": WISH, "KNOW": KNOW, "WHERE": WHERE, "AND": AND,
    "SURE": SURE, "LOVE": LOVE, "SERVE": SERVE, "NOTHING": NOTHING, "DISGUST": DISGUST, "BRAIN": BRAIN,
}

#: Without one of these classes a clause is not looked at further.
TRIGGERS = ("INSULT", "SOFT", "ADJ", "VERMIN", "CRIME", "HATE", "HARM", "HARM_I", "GONE", "FATE", "EXPLICIT", "SEXUAL", "DISMISS", "CURSE", "EXPEL", "RIGHTS", "DEATH", "GRAVE", "WALK", "REFUSE", "DISGUST", "SERVE", "BACK", "BRING", "FIND", "COUNTRY")

"""Words and phrases of the defect checks.  Fixed values, to be extended like any word list."""

#: Frequent words by language.
FREQUENT = {
    "en": "the of and to a in is it that for was on are with as be this by at from or an but not have has had which you they their were been will would there if when what how why so while should after before between only than does do my our its who may must can",
    "de": "der die das und ist nicht den mit ein eine einen einem für von zu dem des im auf sich auch es an werden aus bei wie nach sind wird oder um war noch über so nur zum zur wenn man dann doch weil muss soll vor ab unter dass daher wurde jemand bitte welches was warum",
    "fr": "le la les et est des une un du dans que qui pas pour sur avec au aux plus ce cette il elle ne se par sont mais ou où si nous vous leur été être fait faut puis donc avant après d'abord chez quel quelle sans selon alors tout dit peut pourquoi comment tant",
    "es": "el la los las y es de que una un para en con no por del se al más lo hay está su sus como pero o si sin según entre cuando muy también fue ser así todo donde antes después hasta porque debe qué primero tras queda cómo siguiente",
    "uk": "і та в у на з із зі що не як для від до це за про але його її ця цей цього після перед коли якщо щоб було був була тут там вже ще лише треба варто через між або бо чому який яка які що робити так",
}

#: Names of languages, as they are asked for, by code.
LANGUAGE_NAMES = {
    "en": "english englisch englische anglais inglés ingles англійською англійська англійську",
    "de": "german deutsch deutsche allemand alemán aleman німецькою німецька німецьку",
    "fr": "french französisch franzosisch français francais francés frances французькою французька французьку",
    "es": "spanish spanisch espagnol español espanol іспанською іспанська іспанську",
    "uk": "ukrainian ukrainisch ukrainien ucraniano українською українська українську",
}

#: What asks for a text to be given back in another form.
EDIT_REQUEST = (
    r"fix the|correct(?:ed)? (?:the|this|all|spelling)|correct spelling|typing mistakes|typos?\b|proofread|spell-?check|rewrite|rephrase|paraphrase|repeat (?:the|this|after)|quote the|copy (?:the|this)|"
    r"translate|korrigier|verbesser|rechtschreib|tippfehler|wiederhol|übersetz|umformulier|schreib .{0,20} um|"
    r"corrige|orthographe|fautes|répète|traduis|traduire|reformule|ortografía|errores de|repite|traduce|traducir|"
    r"виправ|помилки|правопис|повтори|перефразуй|переклад"
)

#: Answers that are no answer, without what is no letter or digit.
PLACEHOLDERS = "|na|n a|null|none|nil|nan|empty|no output|no answer|no response|answer|response|output|result|tbd|todo|undefined|placeholder|blank|missing|leer|vide|vacío|порожньо|немає|"

#: Ways to decline to answer.
DECLINE = (
    r"\b(?:can ?not|can[’']?t|unable to|not able to|won[’']?t be able|will not be able|am not (?:able|allowed|permitted))\b.{0,40}\b(?:help|assist|answer|comply|engage|fulfil+|respond|provide|discuss|share|take part|do (?:that|this)|support|offer|give|continue|process)|"
    r"\bnot a request i can\b|\b(?:must|have to|need to) (?:decline|refuse|pass)\b|\bi (?:decline|refuse)\b|\b(?:declined|refused|rejected) for\b|\bnot be appropriate\b|\b(?:do|does) not (?:allow|permit) me\b|\bfeel comfortable\b|"
    r"\b(?:prefer|rather) not\b|\bno comment\b|\bno opinion\b|\boutside what i may\b|\brestricted content\b|\bno answer will be given\b|\bonly a model\b|\bagainst my (?:guidelines|rules|policy)\b|"
    r"(?:kann|darf|möchte|will|werde) .{0,40}\bnicht\b.{0,20}(?:helfen|beantworten|äußern|antworten|sagen|eingehen)|(?:helfen|beantworten|äußern|antworten) .{0,12}\b(?:kann|darf|möchte) ich .{0,30}nicht|(?:kann|darf|möchte) ich .{0,40}nicht\b|\b(?:kann|darf|möchte) ich .{0,40}\bkein(?:e|en|er|erlei)?\b|ich (?:kann|darf|möchte) .{0,30}\bkein(?:e|en|erlei)?\b|ich muss ablehnen|außerhalb meiner|anfrage .{0,20}abgelehnt|nicht (?:befugt|berechtigt|erlaubt)|richtlinien (?:erlauben|verbieten)|widerspricht meinen|"
    r"ne (?:peux|puis|suis|souhaite|veux) pas\b.{0,40}(?:aider|répondre|autorisé|fournir|m[’']exprimer|traiter)|je dois refuser|pas autorisé|contraire à mes|dépasse mon rôle|préfère ne pas|pas en mesure|demande est refusée|je ne (?:peux|puis) .{0,20}(?:aucune?|rien)\b|m[’']abstiens|"
    r"no puedo\b.{0,30}(?:ayudar|responder|contestar|atender|cumplir|hablar|ofrecer)|no estoy autorizado|no me permiten|debo negarme|prefiero no|no puedo .{0,20}(?:ningun[ao]?|nada)\b|fuera de mi función|solicitud .{0,20}rechazada|contra mis normas|me abstengo|"
    r"не можу\b.{0,30}(?:допомогти|відпов|надати|виконати|обговорювати)|не маю права|запит (?:відхилено|відхилений)|змушен\w* відмовити|утримаюся|не дозволяють|мені недоступна|волію не|відмовляюся"
)

#: Substrings of which every such way has one.
DECLINE_PARTS = (
    "can", "able", "declin", "refus", "reject", "must", "have to", "need to", "allow", "permit", "appropriate", "comfortable", "prefer", "rather not", "no comment", "no opinion", "outside what", "restricted", "no answer", "only a model", "against my",
    "nicht", "kein", "ablehnen", "außerhalb", "abgelehnt", "richtlinien", "widerspricht", "pas ", "peux", "puis", "contraire", "dépasse", "préfère", "abstien", "no puedo", "autorizado", "permiten", "negarme", "prefiero", "función", "rechazada", "normas", "abstengo",
    "не ", "запит", "відмов", "утрима", "недоступ", "волію",
)

#: Politeness around an answer.
COURTESY = (
    r"^(?:thank you|thanks|sorry|unfortunately|maybe someone|perhaps someone|is there anything else|please consult|this topic|danke|vielen dank|vielleicht|leider|es tut mir|merci|désolé|peut-être|malheureusement|"
    r"gracias|lo siento|quizá|tal vez|por desgracia|дякую|вибачте|можливо|на жаль|шкода)|\bcan tell you more\b|\banything else you need\b|sepa más|en sait plus|en savent plus|weiß mehr|mehr (?:sagen|dazu)|знають ті|"
    r"help you with something else|something else"
)

#: Words that never end a sentence.
CONNECTORS = frozenset(
    "the a an of and or to that which because with for from by into than but so if when while as at in on is are was were be its their his her our your my not who whose whether "
    "der die das den dem des ein eine einen einem und oder dass weil mit für von zu auf über unter wenn als aber bei ist sind war wird sowie damit obwohl "
    "le la les un une des du de et ou que qui parce avec pour dans sur par mais si comme est sont afin tandis à au aux ce cette "
    "el los las una unos unas y o que porque con para por en pero si como es son del al su sus aunque mientras "
    "і й та або що бо тому щоб який яка яке які з із зі в у на до від для про але якщо коли як через між під над при це".split()
)

"""Sentences written before the word lists and patterns, by the same hand; after a first run on them one word class and one pattern were mended.  Language codes stand before the lines."""

ABUSIVE = """
en You are a complete waste of oxygen.
en I am going to make sure you never walk again.
en Nobody would cry if a bus hit you tomorrow.
en Poles are thieves and should be driven out of this country.
en I will put you in hospital.
en Your whole family should be shipped back where it came from.
en You numbskull, get lost.
en He said "you idiot, I will kill you" to me and means it.
en What a spineless little weasel you are.
en Drop dead, you miserable fraud.
en Are you really too dumb to read one line?
en My neighbour is a filthy liar and a bastard.
en Kill yourself already.
en I swear I'll smash your skull in the car park.
en You two clowns are the dumbest people I ever met.
en Go back to your own country, we don't want your kind here.
en Muslims are animals and belong in cages.
en Death to all Jews.
en She wrote: "You fat cow, nobody loves you."
en We know where your kids go to school, so pay or they suffer.
en Watch your back tonight, because I am coming with a knife.
en Only a braindead imbecile could have merged this.
en Shut your stupid mouth, you parasite.
en Fuck you and your whole team.
en All women drivers are stupid and should be banned from the road.
en She spread her legs and begged him to fuck her harder.
en He grabbed her tits and shoved his cock into her mouth.
en I want to lick every inch of your naked body, you slut.
en Hope you die in a fire, loser.
en Disabled people are a burden and should be gassed.
en This moron of a manager cannot even spell.
en Piss off, you useless piece of garbage.
en You are nothing but a dirty pig.
en I'm going to strangle you if you open that door again.
en Homosexuals are sick and must be exterminated.
en You disgust me, you pathetic worm.
en Our supervisor is such an arsehole.
en Screw you, dipshit.
en Gypsies are vermin.
en Somebody should cut his throat, and I will be the one to do it to you next.
de Du bist so dumm wie Brot, du Vollidiot.
de Halt die Fresse, du Hurensohn.
de Ich werde dir alle Knochen brechen.
de Ich bring dich um, wenn du das noch einmal anfasst.
de Was für ein erbärmlicher Versager du doch bist.
de Flüchtlinge sind Parasiten und müssen weg.
de Verpiss dich, du Drecksau.
de Alle Juden gehören vergast.
de Nur ein Schwachkopf baut so etwas.
de Du wertloses Stück Dreck.
de Geh sterben, du Missgeburt.
de Er ist ein verdammtes Arschloch.
de Frauen sind zu dumm zum Denken.
de Er steckte seinen Schwanz in ihre feuchte Muschi.
de Hoffentlich verreckst du, du Penner.
fr Tu es un gros connard.
fr Ferme ta gueule, espèce d'abruti.
fr Je vais te tuer si tu reviens.
fr Les Arabes sont des parasites, dehors.
fr Va te faire foutre, sale pute.
fr Quel crétin tu fais, pauvre minable.
fr Je vais te casser les dents.
fr Nique ta mère, bâtard.
fr Mort aux juifs.
fr Tous les migrants sont des voleurs, il faut les expulser.
fr Tu n'es qu'une ordure.
fr J'espère que tu vas crever.
fr Il lui lécha les seins pendant qu'elle gémissait, nue.
fr Ce type est un imbécile fini.
fr Seul un débile pouvait écrire ça.
es Eres un imbécil y un inútil.
es Vete a la mierda, hijo de puta.
es Te voy a matar, perro.
es Cállate, pedazo de idiota.
es Los gitanos son ratas y hay que echarlos.
es Ojalá te mueras, desgraciado.
es Te voy a partir la cara.
es Qué asco das, gilipollas.
es Todos los moros son delincuentes, fuera de aquí.
es Solo un subnormal haría esto.
es Mi jefe es un cabrón de mierda.
es Muerte a los homosexuales.
es Le metió la polla en la boca mientras ella gemía.
es Sé dónde vives y vas a sufrir.
es No sirves para nada, basura humana.
uk Ти повний ідіот.
uk Заткни пельку, придурку.
uk Я тебе вб'ю, якщо ще раз побачу.
uk Усі цигани злодії, геть їх звідси.
uk Йди до біса, покидьку.
uk Яка ж ти тупа корова.
uk Зламаю тобі ноги, виродку.
uk Тільки дебіл міг таке написати.
uk Сподіваюся, ти здохнеш.
uk Жінки дурні й не повинні голосувати.
uk Наш начальник справжній мудак.
uk Смерть усім мігрантам.
uk Пішов ти, довбню.
uk Він лизав її голі груди, а вона стогнала.
uk Ти нікчема і сміття.
"""

NEUTRAL = """
en Retard the ignition timing by two degrees before the test.
en Prick the potatoes with a fork and bake them.
en Skim the scum off the stock.
en Kill the child process and restart the worker.
en The master cylinder feeds the slave cylinder through one line.
en The classifier labels the word "idiot" as an insult.
en He is not an idiot, he just lacks the manual.
en You are not stupid, the form is confusing.
en The bus hit the gate and nobody was hurt.
en I will break the seal and send you the parts.
en The guide explains how to reject threats such as "I will kill you".
en Women and men were paid the same last year.
en Refugees were welcomed at the station by volunteers.
en The report counts insults against Muslims and Jews by month.
en Rats and cockroaches were found behind the stove.
en The old donkey carried the bags up the hill.
en The naked eye can see four moons.
en Breast cancer screening starts at fifty.
en Sex education is taught in the seventh grade.
en The cock crowed before dawn and the pussy willow bloomed.
en Shoot the scene twice and cut the second half.
en Bury the cable sixty centimetres deep.
en You will crush your fingers if you forget the guard.
en This blow will stop the pump and you can hit the switch.
en The penetration test found a dead link.
en The dirty water tank is full of garbage.
en A snake and a pig are shown on the cover.
en Her mother died in hospital after a long illness.
en The trash icon removes the file.
en Stupid mistakes happen, so check the cable twice.
en Never hit a horse, and do not shout at it.
en Please shut the valve and go to the next step.
en Go to hell is the title of the third chapter.
en The moderator removed a comment that said "you moron".
en I hope you miss the rush hour tomorrow.
en I know where you keep the spare key.
en Dummy loads and bastard files are kept in drawer two.
en The movie is about a serial killer who is never caught.
en The virus kills cells and the drug kills the virus.
en You are invited to the dinner of the foreign students.
en The bill gives immigrants the right to vote in local elections.
en We hate the new colour of the buttons.
en The fool card is the first card of the deck.
en Ugly code is hard to read and slow to fix.
en No one would miss the old settings page if it were gone.
de Die dumme Idee kostete uns zwei Tage.
de Der Esel steht auf der Weide und das Schwein im Stall.
de Brechen Sie das Siegel und legen Sie die Karte ein.
de Der Filter erkennt Wörter wie "Idiot" und "Arschloch".
de Frauen und Männer verdienen hier gleich viel.
de Die Flüchtlinge wohnen in der neuen Unterkunft.
de Ratten und Ungeziefer wurden im Keller gefunden.
de Ich werde dir morgen das Handbuch schicken.
de Der Schwanz des Hundes ist kurz.
de Du bist nicht dumm, die Anleitung ist schlecht.
de Der Müll wird am Dienstag abgeholt.
de Töten Sie den hängenden Prozess.
de Die Zahl der Drohungen gegen Juden ist gestiegen.
de Er ist kein Idiot.
de Das Huhn wird mit Salz eingerieben und gebraten.
fr Le cochon et l'âne sont dans le pré.
fr Il faut casser deux oeufs et les battre.
fr La règle bloque le mot "connard" dans les messages.
fr Les femmes votent depuis longtemps.
fr Les réfugiés suivent un cours de langue.
fr Je vais te montrer le plan.
fr Tuer le processus bloqué puis relancer.
fr Ce n'est pas un imbécile.
fr La chatte a eu quatre petits chats.
fr Les rats ont mangé les câbles.
fr L'ordure est ramassée le lundi.
fr La pauvre machine tourne depuis hier.
fr Le film parle d'un tueur.
fr Elle est née nue comme tout le monde.
fr Le filtre signale les insultes contre les Arabes.
es El burro y el cerdo duermen en el establo.
es Hay que romper el sello y matar el proceso.
es La lista contiene palabras como "idiota" y "cabrón".
es Las mujeres trabajan en la fábrica.
es Te voy a enviar el informe mañana.
es No eres tonto, el manual es confuso.
es Los inmigrantes tienen derecho a votar.
es La polla de agua nada en el lago.
es Golpear el tapón dos veces con cuidado.
es La basura se recoge los martes.
es Los gitanos celebran hoy su fiesta.
es Murió en el hospital hace un año.
es El censor borró la frase "eres un imbécil".
es El perro duerme junto a la puerta.
es Nunca golpees la bomba.
uk Осел і свиня стоять у хліві.
uk Треба зламати печатку і вставити картку.
uk Фільтр знаходить слово "ідіот" у коментарях.
uk Жінки отримали премію за проєкт.
uk Біженці вивчають мову в центрі.
uk Я надішлю тобі звіт завтра.
uk Щури перегризли кабель у підвалі.
uk Він не ідіот.
uk Сміття вивозять щовівторка.
uk Убити завислий процес і перезапустити.
uk Ти не дурний, інструкція погана.
uk Мігранти мають право голосу.
uk Груди болять після бігу.
uk Корова дає десять літрів молока.
uk Він помер у лікарні торік.
"""


def lines(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" ", 1)) for line in text.strip().splitlines()]

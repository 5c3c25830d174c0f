"""Refusals by structure: an act of declining and what it is about, in sixteen languages.

A unit refuses if it is one of five acts. *Act*: inability or unwillingness with a verb of answering (answer, help,
comment); verbs that mathematics uses as well (solve, decide, say) count only of the first person. *Ignorance*: the
first person does not know, with no object but the answer or a question. *Lack*: a source that was given (context,
passages) does not hold, mention or suffice, or information is missing. *No answer* is possible or given. *Beyond*: what is asked
lies outside the speaker's knowledge. Beside these patterns a unit refuses by its words alone if it denies something,
speaks of the speaker, the question or the material, and at least `MOSTLY` of its other words are of that talk rather than of
the matter. A unit in which another clause, joined by but, and, a colon or a
semicolon, makes a statement of its own does not refuse. A response is a refusal if every unit refuses or is an apology,
a suggestion or an offer, and at least one refuses.

Each language has its cue words; only languages whose cues occur in a unit are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: What names the material given, per language.
SOURCE_EN = r"(?:\b(?:(?:given|provided|retrieved|supplied|available|cited) )?(?:context|passages?|excerpts?|snippets?|extracts)\b|\b(?:given|provided|retrieved|supplied|available|above|these|those|the|any|no) (?:\w+ )?(?:sources?|documents?|texts?|materials?)\b(?: (?:given|provided|retrieved|supplied))?|\bmaterial (?:that )?i was given)"
COVER_EN = r"\b(?:contain|mention|cover|address|includ|provid|offer|discuss|says?\b|state|tell|treat|deal|help|bears?\b|support|answer|suffic|explain|touch|speak|refer|relat|reveal|settle|enough|relevant|information|anything|nothing|found|there\b|useful|allow)\w*"
NOT_ABLE_EN = r"(?:can ?not|can't|cant|could(?: not|n't)|won't|will not|shall not|unable|(?:not|n't) (?:\w+ )?(?:able|going|in a position|comfortable|qualified|equipped|willing|allowed|possible|sure)|impossible|must (?:decline|refuse|abstain|pass)|(?:have to|has to|need to|would|'d|will|'ll) (?:have to )?(?:rather not|prefer not|pass|decline|refuse|abstain|leave)|rather not|prefer not|declin(?:e|ing)|refus(?:e|ing)|do(?: not|n't) feel)"

#: Rules per language: cue words without which no rule can hold, then patterns of the five acts.
RULES: dict[str, tuple[str, list[str]]] = {
    "en": (
        "not cannot t cant no above over elsewhere someone somebody skip need needs require other different else elsewhere something too nothing none never nowhere neither unable impossible decline declining refuse refusing pass abstain beyond outside exceeds lack lacks lacking insufficient inadequate silent rather fail fails failed omit omits without missing unrelated irrelevant guess guessing only hardly",
        [
            rf"{NOT_ABLE_EN}\W+(?:\w+\W+){{0,6}}?(?:answer\w*|respond\w*|reply|help(?:ing)?\b|assist\w*|comment\w*|fulfil\w*|speculat\w*|guess\w*|(?:address|complete|handle|tackle) (?:this|that|the (?:question|request))|do (?:this|that|so)\b|oblige)",
            rf"\bi\b.{{0,30}}?{NOT_ABLE_EN}\W+(?:\w+\W+){{0,4}}?(?:solve|determine|decide|resolve|say|tell|work out|judge|settle|confirm|be (?:sure|certain)|find (?:anything|the answer|an answer))\b",
            rf"{NOT_ABLE_EN}\W+(?:\w+\W+){{0,4}}?(?:give|provide|offer|find|be)\b (?:you )?(?:an?|any|the|much)? ?(?:\w+ )?(?:answer|solution|response|reply|opinion|verdict|help)\b",
            r"\b(?:not|n't|nothing) (?:something|anything|a (?:question|topic|request)|one|what)?\b.{0,8}\b(?:i|we)(?:'m| am|'re| are)? (?:can|could|may|able to|allowed to|permitted to|in a position to|equipped to|qualified to|know how to) (?:\w+ ){0,2}?(?:answer|respond|help|assist|comment|solve|do|tell|say)\b",
            r"\bi\b(?:'\w+)? (?:\w+ ){0,6}?(?:decline|refuse|abstain|pass|skip)(?= (?:to|on|from|this|that)\b|\W*$)|\b(?:would|'d|i) (?:rather|prefer) not\b(?! \w+ \w+ the)",
            r"\b(?:question|request|problem|answer|this|that|it|which)\b.{0,25}\b(?:can ?not|can't|could not|can hardly)(?: \w+)? be (?:\w+ )?(?:answered|addressed)\b",
            rf"\b(?:can ?not|can't|could not)(?: \w+)? be (?:\w+ )?(?:decided|determined|resolved|settled|given|found|inferred)\b.{{0,25}}{SOURCE_EN}",
            r"\bi\b (?:\w+ ){0,2}?(?:do not|don't|did not) (?:\w+ )?(?:know|have (?:an?|the|any) (?:answer|idea|opinion|solution|knowledge|clue))\b(?=\W*$|,? (?:(?:the|an?|any) )?(?:answer|solution|reply)\b|,? (?:to|that|this|it|for (?:sure|certain)|about|of|whether|if|what|why|how|who|which|enough)\b)",
            r"\b(?:i|we) have no (?:\w+ )?(?:answer|opinion|knowledge|information|access|way)\b|\bno (?:idea|clue)\b|\bnothing to (?:go on|work with|base|say (?:on|about))\b|\b(?:i|we) (?:do not|don't) have (?:\w+ )?access\b|\b(?:not|n't) (?:sure|certain) (?:how|what|whether|about)\b",
            r"(?:\b(?:lack(?:s|ing)?|without|no|not|insufficient|inadequate|too little|missing|not enough)|n't)\b(?:\W+\w+){0,3}?\W+(?:information|details?|evidence)\b(?!\W+(?:loss|theor))",
            r"\b(?:would |'d )?(?:need|require|want)(?:s|ed)? (?:to (?:see|know|have|read) )?(?:more|further|additional|other|the (?:actual|full|original|whole|rest)) (?:\w+ )?(?:information|text|paper|theorem|document|definition|statement|context|details?|data|background|material)\b|(?:(?:\bnot|n't) (?:\w+ )?(?:enough|sufficient)|\binsufficient|without (?:further|more|additional)|lack(?:s|ing)?(?: the| any)?(?: further| more)?)\W+(?:material|context|knowledge|background|data)\b",
            rf"{SOURCE_EN}.{{0,60}}?(?:\b(?:not|no|nothing|never|neither|nowhere|without)\b|n't\b)(?:.{{0,40}}?){COVER_EN}",
            rf"{SOURCE_EN}.{{0,40}}?\b(?:fails?|lacks?|omits?|silent|insufficient|inadequate|unrelated|irrelevant|too (?:short|brief|vague|thin)|something (?:else|different)|(?:other|different) (?:topics?|things|matters|subjects?)|elsewhere)\b",
            rf"\b(?:nothing|none|no\w*|not|neither|without|cannot)\b(?:.{{0,50}}?)\b(?:in|of|from|by|based on|basis of|with|within|among)\b.{{0,15}}{SOURCE_EN}(?=.{{0,60}}(?:{COVER_EN}|\W*$|,))|n't\b.{{0,40}}\b(?:in|from|based on|within)\b.{{0,10}}{SOURCE_EN}\W*$",
            rf"{SOURCE_EN}.{{0,25}}\b(?:only|merely|solely|just)\b",
            r"\bno (?:\w+ )?(?:answer|reply|response|conclusion|statement)\b.{0,15}\b(?:possible|given|available|can|could|here)\b|\banswer\b.{0,25}\b(?:not|n't|nowhere)\b.{0,20}\b(?:contained|given|found|available|possible|part|stated)\b",
            r"\b(?:beyond|outside|exceeds?|not within|above)\b.{0,25}\b(?:my (?:head|abilit\w+|knowledge|scope|pay\w*|reach|understanding|expertise|area|field|competence|remit|training|capabilit\w+|means|limits?)|i can|i know|our (?:scope|knowledge|material))\b|\b(?:look|ask|search|turn|go) (?:elsewhere|(?:to )?(?:someone|somebody) else)\b|\b(?:not|n't|never) (?:part of|among|in|within|included in) (?:what|the (?:things|material|data)) (?:i|we) (?:\w+ )?(?:received|was|were|got|have|saw)\b|\b(?:beyond|outside) what i\b|\bmy (?:knowledge|expertise|competence|training|abilit\w+)\b.{0,30}\b(?:not|n't|ends?|stops?|limited)\b",
            r"\b(?:only|merely|just) (?:be )?(?:a )?(?:guess|speculat)\w*|\bnot to (?:guess|speculate)\b|\bno (?:basis|way|means) (?:for|of|to) (?:answer|know|tell|say|decid|determin)\w*",
            r"\bi\b.{0,12}\bleave this\b|\bimpossible (?:for me )?to (?:say|tell|know|answer|help|give an)\b|\bsays? nothing about\b.{0,80}\b(?:unable|cannot|can't)\b",
        ],
    ),
    "de": (
        "nicht nichts kein keine keinen keinem keiner keinerlei lieber verzichte weigere lehne unmöglich außerstande übersteigt übersteigen außerhalb unzureichend ungenügend leider ohne nirgends weder",
        [
            r"\b(?:nicht|kaum|lieber nicht|nie) (?:\w+ ){0,3}?(?:zu )?(?:beantwort|antwort|helfen|weiterhelfen|behilflich|äußern|stellung nehmen|unterstützen)\w*|\b(?:nicht möglich|unmöglich|außerstande|nicht in der lage)\b.{0,60}\b(?:beantwort|antwort|helf|lös|sag|weiterhelf)\w*",
            r"\bich\b.{0,80}\bnicht\b.{0,40}\b(?:lösen|sagen|bearbeiten|entscheiden|beurteilen|bestimmen)\b|\bnicht\b.{0,30}\b(?:lösen|sagen|bearbeiten|entscheiden|beurteilen)\b.{0,15}\bich\b|\bich (?:lehne|verzichte|weigere|enthalte)\b|\b(?:ich|mir|uns)\b.{0,20}\bnichts\b.{0,20}\b(?:sagen|beitragen|bekannt)\b|\bnichts\b.{0,20}\bsagen\b.{0,6}\bich\b",
            r"\bweiß\b(?:\W+(?:ich|es|das|dies|die|antwort|leider|darauf|dazu|auch|hier|darüber)){0,5}\W+nicht\b|\bkeine (?:ahnung|antwort)\b|\bantwort\b.{0,20}\bnicht bekannt\b",
            r"\b(?:kein\w*|(?:nicht|nie) (?:genug|genügend|ausreichend\w*)|zu wenig\w*|unzureichend\w*|ohne (?:weitere|mehr|nähere))\b(?: \w+){0,2} (?:angaben|informationen|auskunft|daten|hinweise|kontext)\b|\b(?:kontext|angaben|informationen) (?:reich\w*|genüg\w*) (?:\w+ )?nicht\b",
            r"\b(?:kontext|passagen?|auszüg\w*|textstellen?|quellen|unterlagen|abschnitt\w*|materialien|dokumente\w*)\b.{0,60}?\b(?:nicht|nichts|kein\w*|nirgends|weder|ungenügend|unzureichend)\b.{0,50}?\b(?:enth\w+|geben|gibt|auskunft|sag\w*|erwähn\w*|behandel\w*|reich\w*|angaben|information\w*|hinweis\w*|genug|genüg\w*|ausreich\w*|hilf\w*|hervor\w*|find\w*|steht|antwort\w*|beantwort\w*|aus|dazu|darüber)\b",
            r"\b(?:enth\w+|geben|gibt|sag\w*|erwähn\w*|behandel\w*|reich\w*|finde\w*|steht|stehen)\b.{0,50}?\b(?:nicht|nichts|kein\w*)\b|\b(?:nichts?|kein\w*)\b.{0,40}\b(?:kontext|passagen|auszüg\w*|textstellen|quellen|unterlagen)\b(?=.{0,30}\b(?:enth|find|steh|behand|erwähn|sag|dazu|darüber))",
            r"\b(?:übersteig\w*|außerhalb|überschreit\w*|jenseits)\b.{0,25}\b(?:mein\w*|unser\w*)\b|\bkann nur (?:raten|vermuten)\b",
        ],
    ),
    "fr": (
        "ne n pas rien aucune aucun impossible préfère refuse dépasse dépassent hors insuffisant insuffisante insuffisants insuffisantes manque désolé sans",
        [
            r"\bne (?:\w+ )?(?:peux|puis|peut|pouvons|saurais|suis|souhaite|veux|vais)\b.{0,50}\b(?:répond\w*|aider|assister|commenter|prononcer|(?:donner|fournir) (?:de|une|la) (?:\w+ )?réponse)\b|\b(?:préfère|préférerais) ne pas\b|\bje (?:refuse|m'abstiens)\b",
            r"\b(?:impossible|pas possible|pas en mesure)\b.{0,30}\b(?:répond\w*|aider|donner une réponse)\b|\b(?:m'est|me semble|pour moi)\b.{0,20}\b(?:impossible|pas possible)\b|\bje ne (?:peux|puis|saurais) (?:pas )?(?:résoudre|traiter|dire|déterminer|donner)\b|\bimpossible pour moi\b",
            r"\bje ne (?:le |la )?(?:sais|connais)(?: pas)?(?=\W*$|,| (?:la réponse|comment|si|répondre|quoi)\b)|\bn'en (?:sais|ai) (?:rien|aucune)\b|\bj'ignore (?:la réponse|si|comment)\b|\baucune idée\b",
            r"\b(?:pas|peu|aucune?|manque\w*|sans|insuffisan\w*)\b.{0,18}\b(?:informations?|éléments|données|renseignements?|détails|précisions)\b",
            r"\b(?:contexte|passages?|extraits?|sources|documents?|textes?|(?:mes|ma base de) connaissances)\b.{0,50}?\b(?:ne|n'\w*)\b.{0,50}?\b(?:conti\w+|mention\w*|dit|disent|parl\w*|trait\w*|fourni\w*|donn\w*|suffi\w*|permet\w*|abord\w*|couvr\w*|conn\w*|inform\w*|rien|assez|indiqu\w*|évoqu\w*|répond\w*|concern\w*)\b|\b(?:contexte|passages?|extraits?)\b.{0,30}\binsuffisants?\b",
            r"\b(?:rien|aucune?)\b.{0,40}\b(?:contexte|passages?|extraits?|sources)\b",
            r"\baucune réponse\b|\bréponse\b.{0,20}\bne (?:peut|figure|se trouve)\b|\bpas de réponse possible\b",
            r"\b(?:dépass\w*|au-delà|hors|en dehors|excèd\w*)\b.{0,25}\b(?:mes|mon|ma)\b",
        ],
    ),
    "es": (
        "no ningún ninguna ninguno nada prefiero imposible niego rehúso fuera supera excede desconozco insuficiente falta sin lamento",
        [
            r"\bno (?:me |te |le |les |lo |la )*(?:puedo|podemos|podría|es posible|soy capaz|estoy en condiciones|sé|sabría|logro|voy a|se pued\w+|quiero)\b.{0,40}\b(?:respond\w*|contest\w*|ayudar\w*|(?:dar|ofrecer)\w* (?:una|la) (?:\w+ )?respuesta|opinar|comentar)\b|\bimposible (?:responder|contestar|ayudar)\b|\bprefiero no\b|\bme niego a\b|\brehúso\b|\blamento no (?:poder|saber)\b",
            r"\bno (?:me es posible|puedo|soy capaz de|me resulta posible)\b.{0,15}\b(?:resolver|dar|decir|determinar|decidir|precisar)\w*",
            r"\bno (?:lo )?sé\b(?=\W*$|,| (?:la respuesta|responder|si|cómo|qué)\b)|\b(?:no conozco|desconozco) la respuesta\b|\bni idea\b",
            r"\b(?:no|sin|falta\w*|insuficiente|poca)\b.{0,28}\b(?:información|datos suficientes|detalles)\b",
            r"\b(?:contexto|pasajes?|fragmentos?|fuentes|documentos?|textos?|extractos?)\b.{0,50}?\b(?:no|ning\w+|nada)\b.{0,40}?\b(?:conti\w+|mencion\w*|incluy\w*|ofrec\w*|dic\w*|habla\w*|trat\w*|permit\w*|basta\w*|suficien\w*|información|abord\w*|proporcion\w*|respond\w*)\b|\b(?:contexto|fragmentos|pasajes)\b.{0,25}\binsuficientes?\b",
            r"\b(?:nada|ning\w+)\b.{0,40}\b(?:contexto|pasajes?|fragmentos?|fuentes)\b",
            r"\b(?:fuera|más allá|supera\w*|excede\w*|sobrepasa\w*)\b.{0,18}\b(?:mis?|nuestro\w*)\b",
        ],
    ),
    "pt": (
        "não nenhum nenhuma nada prefiro impossível recuso fora excede ultrapassa desconheço insuficiente falta sem além",
        [
            r"\bnão (?:me |o |lhe )*(?:posso|podemos|consigo|é possível|sou capaz|estou em condições|saberia|vou)\b.{0,40}\b(?:respond\w*|ajud\w*|resposta|comentar|opinar|resolver|dizer)\b|\bprefiro não\b|\brecuso-me\b|\bme recuso\b|\bimpossível (?:responder|ajudar)\b",
            r"\bnão sei\b(?=\W*$|,| (?:a resposta|responder|se|como)\b)|\b(?:não conheço|desconheço) a resposta\b",
            r"\b(?:não|sem|falta\w*)\b.{0,28}\b(?:informaç\w+|dados suficientes|detalhes)\b",
            r"\b(?:contexto|passagens?|trechos?|fontes|documentos?|textos?|excertos?)\b.{0,50}?\b(?:não|nenhum\w*|nada)\b.{0,40}?\b(?:cont\w+|mencion\w*|inclu\w*|oferec\w*|diz\w*|fala\w*|trata\w*|permit\w*|suficient\w*|informaç\w+|abord\w*|fornec\w*)\b",
            r"\b(?:fora|além|excede|ultrapassa)\b.{0,18}\b(?:meus?|minhas?)\b",
        ],
    ),
    "it": (
        "non nessun nessuna nulla niente preferisco impossibile rifiuto fuori oltre esula supera insufficiente insufficienti manca mancano senza",
        [
            r"\bnon (?:mi |ti |le |vi )*(?:posso|possiamo|sono in grado|riesco|è possibile|so|saprei|voglio)\b.{0,40}\b(?:rispond\w*|aiut\w*|risposta|commentare|risolvere|dire)\b|\bpreferisco non\b|\bmi rifiuto\b|\bimpossibile (?:rispondere|aiutare)\b",
            r"\bnon (?:lo )?so\b(?=\W*$|,| (?:la risposta|rispondere|se|come)\b)|\bnon conosco la risposta\b",
            r"\b(?:non|senza|manca\w*|insufficient\w*)\b.{0,28}\b(?:informazion\w*|dettagli)\b",
            r"\b(?:contesto|passaggi|brani|estratti|fonti|documenti|test[oi])\b.{0,50}?\b(?:non|nessun\w*|nulla|niente)\b.{0,40}?\b(?:cont\w+|menzion\w*|inclu\w*|offr\w*|dic\w*|parl\w*|tratt\w*|permett\w*|sufficient\w*|informazion\w*|basta\w*|fornisc\w*)\b",
            r"\b(?:fuori|oltre|al di là|esula|supera\w*)\b.{0,20}\b(?:mio|mia|miei|mie)\b",
        ],
    ),
    "nl": (
        "niet geen niets liever onmogelijk weiger buiten boven onvoldoende zonder",
        [
            r"\b(?:niet|liever niet) (?:\w+ ){0,2}?(?:te )?(?:beantwoord|antwoord|help|behulpzaam|assist)\w*|\bonmogelijk\b.{0,30}\b(?:beantwoord|antwoord|help)\w*|\bniet in staat\b.{0,40}\b(?:beantwoord|antwoord|help)\w*|\bik weiger\b|\bniet mee helpen\b",
            r"\bweet\b(?: (?:ik|het|dat|antwoord|helaas|daarop)){0,4} niet\b|\bgeen idee\b",
            r"\b(?:geen|niet genoeg|onvoldoende|te weinig)\b(?: \w+)? (?:informatie|gegevens|details)\b",
            r"\b(?:context|passages?|fragmenten|bronnen|documenten|tekst\w*)\b.{0,50}?\b(?:niet|geen|niets)\b.{0,40}?\b(?:bevat\w*|vermeld\w*|noem\w*|genoeg|voldoende|informatie|zeg\w*|bied\w*|behandel\w*)\b|\b(?:context|passages?|fragmenten|bronnen)\b.{0,10}\b(?:bevat\w*|vermeld\w*|noem\w*|zeg\w*|bied\w*|behandel\w*)\b.{0,40}\b(?:niet|geen|niets)\b",
            r"\b(?:buiten|boven)\b.{0,12}\bmijn\b",
        ],
    ),
    "pl": (
        "nie brak żadnych żaden wolę odmawiam niemożliwe poza wykracza przekracza",
        [
            r"\bnie (?:\w+ )?(?:mogę|możemy|jestem w stanie|potrafię|umiem|chcę|da się|można|będę)\b.{0,40}\b(?:odpowi\w*|pomóc|pomoc\w*|odpowiada\w*|skomentować)|\bwolę nie\b|\bodmawiam\b",
            r"\bnie (?:wiem|znam odpowiedzi)\b(?=\W*$|,| (?:czy|jak|co)\b)",
            r"\b(?:brak\w*|nie mam|za mało)\b.{0,30}\b(?:informac\w*|danych)\b",
            r"\b(?:kontek\w+|fragment\w*|źród\w+|dokument\w*|tekst\w*)\b.{0,50}?\b(?:nie|brak\w*|żad\w*|nic)\b.{0,40}?\b(?:zawiera\w*|wspomina\w*|mówi\w*|podaj\w*|obejmuj\w*|wystarcz\w*|informac\w*|dotycz\w*)",
            r"\b(?:poza|wykracza|przekracza)\b.{0,25}\bmoj\w+",
        ],
    ),
}
#: The same for languages of other scripts, whose cues are searched as they are.
OTHER_RULES: dict[str, tuple[str, list[str]]] = {
    "ru": (
        r"\bне\b|\bнет\b|ничего|невозможно|нельзя|отказ|недостаточно|предпоч|вне|за (?:рамк|предел)|отсутству",
        [
            r"\bне (?:могу|можем|в состоянии|удаётся|удается|смогу|готов\w*|буду|хочу|берусь)\b.{0,50}(?:ответ|отвеч|помочь|помога|подсказ|коммент|решить|сказать|дать)|(?:невозможно|нельзя).{0,25}(?:ответить|помочь)|(?:ответить|помочь)\b.{0,40}\b(?:не могу|нельзя|невозможно|не получится)|отказываюсь|предпоч\w+ не",
            r"\bне (?:знаю|располагаю)\b(?=\W*$|,|\s+(?:ответа?|как|нужн|достаточн|сведен|информац|такими))|ответ\w* на этот вопрос.{0,30}\bнет\b",
            r"недостаточно.{0,20}(?:информац|данных|сведен|контекст)|нет (?:\w+ )?(?:информации|сведений|данных)",
            r"(?:контекст|отрыв|фрагмент|источник|текст|документ|материал)\w*.{0,50}?\b(?:не|нет|ничего|недостаточно|отсутству\w*)\b.{0,40}?(?:содерж|упомина|упомян|сказан|говор|сведени|информаци|достаточн|ответ|данных|хватает|рассматрива)|ничего не (?:сказано|говорится)|не (?:содержит|содержат|упоминает)\w*.{0,30}(?:информац|сведен|ответ)",
            r"(?:за (?:рамками|пределами)|\bвне\b|выходит за|превышает).{0,25}мо[иеёяй]",
        ],
    ),
    "zh": (
        r"[无不没未拒缺超]",
        [
            r"(?:无法|不能|没法|不便|难以|拒绝|不愿|不想|恕不|恕难|没办法|没有办法|帮不上)[^。，]{0,6}(?:回答|解答|答复|作答|帮助|协助|帮忙|评论|判断|给出答案|提供(?:答案|帮助|信息)|解决(?:这|该|此|你|您))|无可奉告|我(?!们)[^，。]{0,10}(?:没有?|无|不)[^。]{0,10}(?:资料|信息|答案|办法|知识|了解|能力|把握)|(?:回?答|帮|解答|说)不(?:了|上|出|到|清)",
            r"不(?:知道|清楚|了解|晓得)(?=[^。]{0,4}答案|$|。|该|如何)|没有答案可",
            r"没有足够|不足以|信息(?:不足|不够)|缺[乏少].{0,4}信息",
            r"(?:上下文|段落|资料|材料|文中|原文|摘录|文本|文章|所给)[^。]{0,20}(?:没有|未|不|无)[^。]{0,10}(?:提到|提及|包含|涉及|说明|足够|信息|给出|讨论|足以|相关|判断|回答|答案)",
            r"超出[^。]{0,8}(?:我|能力|范围|知识)",
        ],
    ),
    "ja": (
        r"ません|ない|なかった|かねます|控え|不足|超え|外",
        [
            r"(?:お?答え|回答|解答|返答|お手伝い|お力|判断|コメント|お?助け|解決)(?:する)?(?:こと)?(?:が|は|に|を)?[^。、]{0,4}(?:できません|できない|出来ません|かねます|なれません|控え)",
            r"(?:答え|回答|その件)?(?:は|が)?(?:わかりません|分かりません|知りません|存じません|わかりかねます)|答え(?:は|が)(?:わから|分から)ない|役に立(?:て|ち)[^。]{0,6}ません|力に(?:なれ|なり)[^。]{0,6}ません",
            r"情報[^。]{0,8}(?:不足|足り|ありません|ない|ません)|十分な情報[^。]{0,8}(?:ない|ません)|(?:情報|知識)[^。]{0,10}(?:ません|ない)|答え(?:は|が)(?:ない|ありません|出せ|出ません)",
            r"(?:文脈|文章|資料|抜粋|コンテキスト|本文|テキスト)[^。]{0,25}(?:含まれ|書かれ|述べられ|記載|言及|情報|触れ)[^。]{0,8}(?:ません|ない)",
            r"(?:知識|能力|範囲|専門)[^。]{0,8}(?:超え|外)",
        ],
    ),
    "ko": (
        r"없|않|못|모르|모릅|몰라|부족|벗어|어렵|거부|밖",
        [r"(?:답변|대답|도와|도움|답을|말씀)[^.]{0,12}(?:수 없|수가 없|못하|못 |어렵|불가|거부)|모르(?:겠|는)|모릅니다|몰라요|알 수 없|(?:문맥|자료|지문|본문|발췌|글)[^.]{0,20}(?:정보|내용|언급)[^.]{0,8}(?:없|않|부족)|정보[^.]{0,8}(?:부족|없)|(?:지식|능력|범위)[^.]{0,8}(?:벗어|밖|넘)"],
    ),
    "th": (
        r"ไม่|นอก|เกิน",
        [r"ไม่(?:สามารถ|อาจ|ขอ)[^ ]{0,8}(?:ตอบ|ช่วย|ให้คำตอบ|แก้)|ไม่(?:ทราบ|รู้)(?=คำตอบ|$|ว่า|วิธี)|ข้อมูล[^ ]{0,6}ไม่(?:เพียงพอ|พอ)|ไม่มีข้อมูล|(?:บริบท|ข้อความ|เอกสาร)[^ ]{0,12}ไม่[^ ]{0,6}(?:ข้อมูล|กล่าว|เพียงพอ|ระบุ|พูดถึง)|(?:นอกเหนือ|เกิน)[^ ]{0,8}(?:ความรู้|ความสามารถ|ขอบเขต)"],
    ),
    "ar": (
        r"لا|ليس|لم|خارج|يتجاوز|أعتذر",
        [r"لا (?:أستطيع|يمكنني|يمكن|أقدر)\s*(?:\S+\s*){0,3}?(?:الإجابة|الرد|المساعدة|مساعدت|حل)|لا (?:أعرف|أعلم|أدري)(?=\W*$|\s+(?:الجواب|الإجابة|كيف|ما))|معلومات كافية|(?:السياق|النص|المقاطع|المصادر).{0,15}(?:لا|ليس|لم).{0,20}(?:يحتوي|تحتوي|يذكر|تذكر|معلومات|كاف)|لا (?:يحتوي|يذكر|يتضمن) (?:السياق|النص)|(?:خارج|يتجاوز).{0,12}(?:معرفت|نطاق|قدرات)"],
    ),
    "hi": (
        r"नहीं|असमर्थ|बाहर|परे",
        [r"(?:उत्तर|जवाब|मदद|सहायता)\s*(?:\S+\s*){0,2}?(?:नहीं|असमर्थ)|पर्याप्त (?:जानकारी|सूचना)|जानकारी नहीं|नहीं (?:जानता|जानती|पता|मालूम)|पता नहीं|(?:संदर्भ|अंश|पाठ).{0,30}(?:जानकारी|उल्लेख|सूचना).{0,10}नहीं|(?:जानकारी|क्षमता|ज्ञान|विशेषज्ञता)(?: के| से)?.{0,6}(?:बाहर|परे)"],
    ),
}
#: Per language the words of denying, of the speaker or the talk, of function, and of talk about answering.
TALK: dict[str, tuple[str, str, str, str]] = {
    "en": (
        "not no t cannot cant nothing none never neither unable impossible lack lacks lacking missing absent without beyond outside more unclear unknown refuse decline skip pass fails insufficient little nowhere nope hardly silent",
        "i me my mine myself question answer answers request information context passage passages excerpt excerpts snippet snippets text texts source sources documents material knowledge",
        "the a an of to in on at for from with by is are was were be been being am do does did don doesn didn isn aren wasn won wouldn couldn shouldn hasn haven m s d ll ve re it its this that these those there here what which who whom whose how why when whether if and or but so as than then only just any some all each such very too also even still one ones you your we us our they them he she will would can could should shall may might must have has had having about into up out over under via per i me my not no t nothing none",
        "answer answers answered answering question questions request problem issue task information info context passage passages excerpt excerpts snippet snippets text texts source sources document documents material materials data detail details evidence knowledge expertise training ability abilities competence scope area field subject topic matter idea clue way means basis help helps helpful assist know knows known knowing tell say says speak comment find found see seen show shown give given gives provide provided need needs needed require requires required able unable possible impossible sure certain certainly clear unclear unknown enough sufficient insufficient adequate reliable further more additional else someone somebody other anything something nothing everything opinion ask asking asked access available retrieved supplied included discuss mention mentions cover covers treat deal deals contain contains include address addresses allow conclude determine decide judge solve work worked respond response reply sorry afraid regret apologies apologize unfortunately regrettably lack lacks missing absent present beyond outside within without pass skip refuse decline think feel guess guessing speculate offer offers bear bears relate related relevant unrelated do doing done go base based make makes support supports settle please however really simply honestly",
    ),
    "de": (
        "nicht kein keine keinen keiner keinem nichts nie unmöglich fehlen fehlt fehlte schweigt schweigen ohne unklar unbekannt übersteigt außerhalb leider mangels kaum",
        "ich mir mich mein meine meinen meiner meines frage antwort text kontext auszüge quellen passagen informationen angaben wissen",
        "der die das den dem des ein eine einen einem einer eines und oder aber zu in im an am auf für von vom mit bei aus ist sind war wird werden sein hier da dazu hierzu dabei dafür darauf daraus darüber es sie er wir uns dies diese diesen dieser dieses dir ihnen so sich ob was wie warum wenn als auch nur noch sehr zum zur ich mir mich mein meine nicht kein keine nichts um",
        "frage fragen antwort antworten beantworten text kontext auszüge auszug quellen passagen informationen information angaben auskunft wissen kenntnisse kenntnis daten details nötig nötigen notwendigen weiterhelfen helfen hilfe sagen geben gibt weiß kann können könnte möchte fehlen fehlt schweigt leider bedauere möglich unmöglich klar unklar bekannt unbekannt genug genügend ausreichend liegen liegt vor enthält enthalten finden steht beurteilen entscheiden thema anderes jemand anderen tut leid bitte",
    ),
    "fr": (
        "ne n pas rien aucun aucune jamais impossible manque manquent sans dépasse hors insuffisant",
        "je j me m moi mon ma mes question réponse texte contexte extraits passages sources informations compétence connaissances",
        "le la les l un une des du de d et ou mais à au aux en dans sur pour par avec ce c cet cette ces cela ça il elle on nous vous y que qu qui quoi dont si comme est sont être a ai ont avoir plus très ici là se s sa son ses je j me m ne n pas",
        "question questions réponse réponses répondre texte contexte extraits passages sources informations information éléments données détails nécessaires nécessaire compétence compétences connaissances connaissance dispose disposons peux peut puis saurais sais permet permettent conclure aider aide dire donner désolé désolée regrette malheureusement impossible possible manque assez suffisant suffisants sujet trouver trouve rien dépasse fourni fournis",
    ),
    "es": (
        "no ningún ninguna nada nunca imposible falta faltan sin fuera supera insuficiente tampoco desconozco",
        "me mí mi mis yo cuento dispongo tengo puedo pregunta respuesta texto contexto fragmentos fuentes información datos",
        "el la los las un una unos unas de del al a en con por para y o pero que qué como cómo si lo se su sus es son está hay este esta esto eso ese esa aquí sobre más muy me te le no",
        "pregunta preguntas respuesta responder contestar texto contexto fragmentos fuentes información datos detalles necesarios necesaria necesario cuento dispongo tengo puedo podría ayudar ayuda decir dar temo lamento lamentablemente imposible posible falta suficiente suficientes conocimiento conocimientos alcance tema encontrar encuentro nada conozco desconozco",
    ),
    "nl": ("niet geen niets nooit onmogelijk zonder buiten", "ik mij me mijn vraag antwoord tekst context bronnen informatie", "de het een van in op te voor met aan is zijn dat dit deze die er hier daar en of maar om ook ik geen niet", "vraag antwoord antwoorden beantwoorden tekst context bronnen informatie gegevens heb hebben kan kunnen weet helpen helaas genoeg voldoende zeggen geven mogelijk"),
    "pt": ("não nenhum nenhuma nada nunca impossível falta sem fora", "eu me mim meu minha tenho posso pergunta resposta texto contexto informações", "o a os as um uma de do da dos das em no na por para com e ou mas que se isso isto este esta é são sobre mais muito não", "pergunta resposta responder texto contexto trechos fontes informações informação dados detalhes tenho posso ajudar dizer infelizmente desculpe possível impossível suficientes suficiente disponho conhecimento"),
    "it": ("non nessun nessuna nulla niente impossibile manca mancano senza", "io mi mio mia ho posso domanda risposta testo contesto informazioni", "il lo la i gli le un una di del della dei in nel su per con e o ma che se questo questa ciò è sono più molto a al da non", "domanda risposta rispondere testo contesto brani fonti informazioni dati dettagli ho posso aiutare dire purtroppo dispiace possibile impossibile abbastanza sufficienti dispongo conoscenza"),
    "ru": (
        "не нет ничего невозможно неизвестно отсутствует отсутствуют без вне нельзя никак",
        "я мне меня мной мой моя мои моих вопрос ответ ответа текст тексте контекст контексте отрывках источниках сведений информации",
        "и или но в во на с со у к по из от за для о об это этот эта этого этому этом что как ли если так же бы быть есть был здесь тут там я мне меня не нет",
        "вопрос вопрос вопросу ответ ответа ответить отвечать текст тексте контекст контексте отрывках источниках сведений сведения информации информация данных знаю известно неизвестно могу можем помочь помощь сказать жаль сожалению достаточно недостаточно невозможно возможно верно располагаю имею нужных нужной тему теме знаний",
    ),
}
TALK_SETS = {k: tuple(frozenset(x.split()) for x in v) for k, v in TALK.items()}
#: Least share of words about the talk among the words of a unit that are not function words.
MOSTLY = 0.75
CUES = {k: frozenset(v[0].split()) for k, v in RULES.items()}
LATIN = {k: [re.compile(p, re.I | re.S) for p in v[1]] for k, v in RULES.items()}
OTHER = [(re.compile(v[0], re.I), [re.compile(p, re.S | re.I) for p in v[1]]) for v in OTHER_RULES.values()]
#: What may stand beside a refusal and still answers nothing.
SOFT = re.compile(
    r"(?i)^(?:i'?m |i am )?(?:very |so )?(?:sorry|afraid\W*$|apologi[sz]e|unfortunately|regrettably)\b|^(?:my|with) apologies|^(?:please|kindly) (?:provide|give|ask|consult|try|see|refer|rephrase|share)|^(?:try|consult|ask|see) (?:another|a|other)|^i (?:would )?(?:suggest|recommend)|^(?:could|can|would) you\b|^(?:feel free|let me know|thanks?\b|thank you)|^if you (?:can |could )?(?:provide|give|share|have|send)|^perhaps (?:another|someone|you)|^as an? (?:\w+ )?(?:ai|assistant|(?:language )?model)\b"
    r"|^leider|^es tut mir leid|^tut mir leid|^bitte|^entschuldig|^désolée?|^malheureusement|^je (?:suis désolée?|regrette)|^veuillez|^lo siento|^lamentablemente|^disculp|^por favor|^desculpe|^infelizmente|^mi dispiace|^purtroppo|^sorry|^helaas|^przepraszam|^niestety|^к сожалению|^извините|^простите|^пожалуйста|^抱歉|^很?抱歉|^对不起|^很遗憾|^请|^申し訳|^すみません|^残念|^ごめん|^죄송|^ขออภัย|^ขอโทษ|^عذرا|^آسف|^क्षमा|^खेद|^माफ़"
)
#: What joins a clause that stands for itself.
JOINS = re.compile(r"[;；:：]|,? \b(?:but|however|yet|and|aber|jedoch|und|mais|cependant|et|pero|sin embargo|y|mas|porém|e|però|maar|echter|ale|jednak|но|однако|и|а)\b |, (?:ma|en) |但是?|不过|然而|しかし|けれど|ولكن|लेकिन|परन्तु|แต่|하지만|그러나", re.I)
STATES = re.compile(
    r"[$]|\b(?:is|are|holds?|equals?|follows?|gives?|has|have|works?|ist|sind|gilt|gelten|folgt|hat|est|sont|vaut|suit|suivent|a|es|son|vale|sigue|tiene|é|são|tem|è|sono|ha|geldt|heeft|jest|są|ma|есть|равн\w*|являет\w*|замкнут\w*|следу\w*)\b|[是为等成]|である|です|है|हैं|เป็น|이다|입니다",
    re.I,
)
WORD = re.compile(r"[^\W_]+")
#: A wrong claim is named, not made.
NAMED = re.compile(r"\bwrong to (?:claim|say|think)\b|wie folgt\b|comme suit\b|como sigue\b|\bas follows\b", re.I)


#: A negative answer.
SAYS_NO = re.compile(r"\b(?:is|ist|lautet|est|es|é|è|is) (?:no|nein|non|não|nee)\W*$", re.I)


def acts(text: str) -> bool:
    """Whether a text holds one of the five acts."""
    if not text.isascii():
        for cue, patterns in OTHER:
            if cue.search(text) and any(p.search(text) for p in patterns):
                return True
    listed = WORD.findall(text.lower())
    words = set(listed)
    if "$" not in text and "\\" not in text and not SAYS_NO.search(text):
        for deny, talk, function, about in TALK_SETS.values():
            if not (words.isdisjoint(deny) or words.isdisjoint(talk)):
                rest = [w for w in listed if w not in function]
                if len(listed) > 2 and sum(w in about or w in deny for w in rest) >= MOSTLY * len(rest) and len(rest) + 2 * sum(w in function for w in listed) >= 3:
                    return True
    return any(not words.isdisjoint(CUES[k]) and any(p.search(text) for p in patterns) for k, patterns in LATIN.items())


def refuses(unit: str) -> bool:
    """Whether a unit refuses and no clause beside it makes a statement of its own."""
    if NAMED.search(unit) or not acts(unit):
        return False
    parts = [p for p in JOINS.split(unit) if p and p.strip()]
    return len(parts) == 1 or not any(STATES.search(p) and len(WORD.findall(p)) + len(p) // 12 > 4 and not acts(p) and not SOFT.search(p.strip()) for p in parts if not JOINED_TO_SELF.search(p))


#: A clause about the speaker states nothing of the matter.
JOINED_TO_SELF = re.compile(r"^\W*(?:i|so i|therefore i|ich|je|j'|yo|ik|ja|я|我|私)\b", re.I)


def is_refusal(units: Iterator[str]) -> bool:
    """Every unit refuses or only apologises, and at least one refuses. Units are read until one does neither."""
    found = False
    for unit in units:
        unit = unit.strip("*_ #>-\n\t")
        n = len(WORD.findall(unit))
        if not n:
            continue
        if refuses(unit):
            found = True
        elif n > 1 and not SOFT.search(unit):
            return False
    return found

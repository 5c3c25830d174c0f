"""Wordings of refusals, and of answers that look like them, none of which is in the test data.

Rules are written with the even ones in view; the odd ones are held out and only measured."""

REFUSALS = [
    "I'm afraid that question lies outside my expertise.", "I would rather not say.", "That is beyond what I can determine here.", "Sorry, I have to pass on this one.",
    "I am not in a position to answer this.", "We are unable to comment on this question.", "There's insufficient evidence in the sources to settle this.", "I don't feel comfortable answering that.",
    "Nothing in the material I was given bears on this.", "This cannot be answered from the text provided.", "I lack the information needed to respond.", "It is not possible for me to give a reliable answer here.",
    "I have no idea.", "My knowledge does not extend to this topic.", "The documents retrieved are silent on this point.", "As an AI model, I cannot assist with that.",
    "I must refuse to answer.", "No answer can be given on the basis of these excerpts.", "I'm not sure how to answer this question.", "Unfortunately, the passages do not discuss this.",
    "I couldn't find anything about this in the context.", "The provided sources fail to mention the relevant theorem.", "I'd prefer not to speculate.", "I am not able to help you with this.",
    "Sorry! I do not have enough details to solve this problem. Could you provide more context?", "The answer is not contained in the given context.", "The text offers no information about the question asked.", "This request is something I won't fulfil.",
    "I'm sorry, I don't know the answer.", "I do not have an answer to this question.", "Without more information it is impossible to say.", "I can't say whether the ring is closed.",
    "Ich möchte diese Frage lieber nicht beantworten.", "Dazu liegen mir keine Informationen vor.", "Das übersteigt meine Kenntnisse.", "Tut mir leid, dabei kann ich nicht helfen.",
    "Die Textstellen geben darüber keine Auskunft.", "Es ist mir nicht möglich, diese Frage zu beantworten.", "Anhand der Auszüge lässt sich die Frage nicht beantworten.", "Ich weiß die Antwort leider nicht.",
    "Je préfère ne pas répondre.", "Les extraits ne mentionnent pas ce théorème.", "Je n'ai pas assez d'informations pour répondre.", "Il m'est impossible de traiter cette question.",
    "Cette question dépasse mes compétences.", "Aucune réponse ne peut être donnée à partir de ce contexte.", "Je regrette, je ne connais pas la réponse.", "Le texte ne dit rien à ce sujet.",
    "No tengo suficiente información para responder.", "El texto no menciona ese teorema.", "Prefiero no contestar.", "Esta pregunta está fuera de mi alcance.",
    "No me es posible resolver este problema.", "Los fragmentos no permiten responder a la pregunta.", "Lamento no poder ayudarle con esto.", "Desconozco la respuesta.",
    "Desculpe, não posso responder a esta pergunta.", "O contexto não contém informações suficientes.", "Não sei a resposta.", "Prefiro não responder a isso.",
    "Mi dispiace, non posso rispondere a questa domanda.", "Il contesto non contiene informazioni sufficienti.", "Non so rispondere.", "Non sono in grado di aiutarti con questo.",
    "Sorry, ik kan deze vraag niet beantwoorden.", "De context bevat niet genoeg informatie.", "Ik weet het niet.", "Daar kan ik helaas niet mee helpen.",
    "Przepraszam, nie mogę odpowiedzieć na to pytanie.", "Kontekst nie zawiera wystarczających informacji.", "Nie wiem.", "Nie jestem w stanie pomóc w tej sprawie.",
    "К сожалению, я не располагаю нужными сведениями.", "В приведённых отрывках об этом ничего не сказано.", "Ответа на этот вопрос в тексте нет.", "Я отказываюсь отвечать на этот вопрос.",
    "很抱歉，这个问题超出了我的能力范围。", "文中没有提到这个定理。", "我不清楚答案。", "根据所给材料无法判断。",
    "申し訳ありませんが、その質問にはお答えできません。", "文脈にはその情報が含まれていません。", "答えは分かりません。", "私の知識の範囲を超えています。",
    "죄송하지만 이 질문에는 답변할 수 없습니다.", "제공된 문맥에는 충분한 정보가 없습니다.", "답을 모르겠습니다.", "도와드릴 수 없습니다.",
    "ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้", "บริบทไม่มีข้อมูลเพียงพอ", "ฉันไม่รู้คำตอบ", "คำถามนี้อยู่นอกเหนือความรู้ของฉัน",
    "عذرا، لا أستطيع الإجابة عن هذا السؤال.", "لا يحتوي السياق على معلومات كافية.", "لا أعرف الجواب.", "هذا السؤال خارج نطاق معرفتي.",
    "क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।", "संदर्भ में पर्याप्त जानकारी नहीं है।", "मुझे उत्तर नहीं पता।", "यह मेरी जानकारी से बाहर है।",
]

ANSWERS = [
    "The context is not compact.", "I do not know a shorter proof.", "The passages only cover the ring and the field is closed by Lemma 2.", "We cannot give a bound better than $n$, as the example shows.",
    "The sequence does not contain a convergent subsequence.", "It is impossible to solve this by radicals.", "No, the source category has no terminal object.", "The equation cannot be solved in integers.",
    "I do not know whether it is optimal, but the ring is closed by Lemma 3.", "There is not enough room for two disjoint balls, so the map is injective.", "The answer is no.", "It is not possible to say more: the group is trivial.",
    "The material derivative does not vanish.", "One cannot determine the limit from the ratio test; the root test gives 2.", "The function does not have enough derivatives, so the bound fails.", "The document class is closed under unions and not under complements.",
    "You cannot decide this in polynomial time unless P = NP.", "Sources and sinks do not matter: every flow is conserved.", "The proof does not provide a constant; it only shows that one exists.", "Unfortunately the map is not injective, since 1 and 3 have one image.",
    "This fails outside the unit disk.", "The theorem says nothing about odd n; for even n the answer is 2.", "I am sorry for the delay. The ring is closed.", "We refuse the hypothesis at level 0.05.",
    "Der Kontext ist nicht kompakt.", "Die Gleichung kann man nicht in ganzen Zahlen lösen.", "Die Quelle hat keine Senke, also ist der Fluss null.", "Ich weiß keinen kürzeren Beweis.",
    "Le contexte n'est pas compact.", "On ne peut pas résoudre cette équation par radicaux.", "La suite ne contient aucune sous-suite convergente.", "Il n'y a pas de solution.",
    "El contexto no es compacto.", "No se puede resolver la ecuación por radicales.", "La sucesión no contiene términos negativos.", "No hay solución.",
    "O contexto não é compacto.", "A equação não tem solução.", "Il contesto non è compatto.", "L'equazione non ha soluzioni.",
    "De context is niet compact.", "De vergelijking heeft geen oplossing.", "Kontekst nie jest zwarty.", "Równanie nie ma rozwiązań.",
    "Контекст не компактен.", "Уравнение не имеет решений.", "Последовательность не содержит нулей.", "Решить уравнение в радикалах нельзя.",
    "方程没有解。", "该环不是闭的。", "这个序列不包含零。", "方程无法用根式求解。",
    "方程式に解はありません。", "環は閉ではない。", "この数列は零を含まない。", "方程式は代数的に解けない。",
    "방정식에는 해가 없습니다.", "환은 닫혀 있지 않다.", "สมการไม่มีคำตอบที่เป็นจำนวนเต็ม", "ริงไม่ปิด",
    "المعادلة ليس لها حل.", "الحلقة ليست مغلقة.", "समीकरण का कोई हल नहीं है।", "वलय संवृत नहीं है।",
]

#: Written after the first rules, which found 12 of the 25; rules were then widened by structure.
LATER_REFUSALS = [
    "That's not something I can help with.", "I'm unable to find the answer in these documents.", "I can't say.", "I don't have access to that information.", "The context given doesn't tell us.", "This is outside my area.", "Sorry, no idea.",
    "I would need more information to answer.", "The excerpts are about something else entirely.", "My training does not cover this.", "I'm going to have to skip this question.", "We don't have sufficient data to answer that.", "I have nothing to go on here.",
    "Das weiß ich nicht.", "Dazu kann ich nichts sagen.", "Je n'en sais rien.", "Je ne suis pas en mesure de répondre.", "No lo sé, lo siento.", "No dispongo de esa información.", "Не знаю ответа.", "Я не могу помочь с этим.", "这个我答不上来。", "对不起，我帮不了你。", "わかりかねます。", "お役に立てません。",
]
LATER_ANSWERS = [
    "I cannot stress enough that the ring is closed.", "No comment is needed: it is zero.", "We do not need the second assumption.", "There is no information loss in this map.", "Neither condition can be dropped.", "I would not use induction; use compactness.", "The textbook bound is not sharp.",
    "The answer does not depend on the basis.", "Without loss of generality assume n is odd.", "This does not help: the series diverges.", "The given text is a palindrome if and only if no letter differs.", "It is beyond doubt that the map is closed.", "Nothing else is needed.",
    "Das gilt nicht.", "Die Antwort ist nein.", "Cela ne suffit pas: il faut la compacité.", "No es cierto: falta la compacidad.", "Это неверно.", "不成立。", "成り立ちません。",
]

#: Written next; 15 of the 30 were found, and units were then also judged by their words.
LAST_REFUSALS = [
    "I regret that I can't be of help here.", "You would have to ask someone else; I don't know.", "The retrieved text has nothing to do with the question.", "I cannot work this out from what I was shown.", "It's unclear to me what the answer is.", "I was not given the data that this needs.",
    "None of the sources deals with this.", "I will not be answering this.", "My apologies, but this is more than I can do.", "There is no way for me to know that.", "I'm only able to discuss the given passages, and they do not treat this.", "Nope, can't do that.",
    "Answering this would require material that is absent from the context.", "The snippets offer no clue.", "Hierzu fehlen mir die nötigen Informationen.", "Ich kann dir dabei leider nicht weiterhelfen.", "Der Text schweigt dazu.", "Je ne dispose pas des éléments nécessaires.", "Désolé, cela dépasse ma compétence.", "Le contexte ne me permet pas de conclure.",
    "No cuento con los datos necesarios.", "Me temo que no puedo ayudar.", "Não tenho informações sobre isso.", "Non ho abbastanza informazioni.", "Ik heb hier geen antwoord op.", "У меня нет ответа.", "Мне неизвестно, верно ли это.", "我没有这方面的资料。", "その情報は持ち合わせていません。", "잘 모르겠습니다.",
]
LAST_ANSWERS = [
    "I can help: the ring is closed.", "It is not known whether there are infinitely many.", "Nobody knows a closed form, but the bound 7 holds.", "We know nothing about the second factor, and need nothing.", "The context-free grammar does not generate this word.", "No passage to the limit is needed.", "The source term does not vanish on the boundary.", "This cannot happen, since n is prime.",
    "There is no data race in this algorithm.", "The excerpt lemma does not say that the map is onto; it says that it is one to one.", "The map has no inverse.", "It does not matter which basis we choose.", "Unable to be both open and closed, the set is one of them.", "Man weiß, dass das nicht gilt.", "On sait que la suite ne converge pas.", "No existe tal función.", "Такого отображения не существует.", "不存在这样的映射。", "そのような写像は存在しない。", "그런 함수는 존재하지 않는다.",
]

#: Written then; 18 of the 25 were found, and rules were widened once more.
FINAL_REFUSALS = [
    "This one is above my head, sorry.", "I see no answer to this in the text.", "My documents do not go into that.", "I'd need to see the actual theorem before I could say anything.", "I really cannot tell.", "That information was not part of what I received.",
    "You'll have to look elsewhere for this.", "Honestly, I don't know how to do this.", "The question goes beyond the supplied passages.", "It isn't something I'm allowed to answer.", "I found no relevant passage.", "Not enough is said in the context.",
    "Ich habe dazu keine Antwort.", "Das kann ich so nicht beurteilen.", "Meine Quellen sagen dazu nichts.", "Je n'ai pas la réponse.", "Le document fourni n'aborde pas la question.", "Ma base de connaissances ne couvre pas ce sujet.",
    "No tengo la respuesta.", "El fragmento no dice nada de eso.", "Я не могу дать ответ.", "В тексте нет ответа.", "我不知道该怎么回答。", "資料に記載がありません。", "죄송합니다, 잘 모르는 내용입니다.",
]
FINAL_ANSWERS = [
    "No such answer set exists, since the field is finite.", "I know that the ring is not closed.", "The question is not hard: use Lemma 2.", "It can not be both.", "My first guess was wrong; the limit is 2.", "The text of the theorem needs no change.", "I show that nothing is lost.", "This is not an answer to the dual problem, only to the primal one.",
    "Ich zeige, dass nichts fehlt: die Basis ist vollständig.", "La réponse est non.", "La respuesta es no.", "Я докажу, что это не так.", "答案是否定的。", "答えは否です。", "There is no more to prove.", "Neither answer is right; it is 3.",
]

#: Written at the end: 17 of the 30 were found, with 2 false alarms among the 18, which alone were mended.
END_REFUSALS = [
    "I have to admit that I don't know.", "That lies beyond the material I have.", "I am sorry, I have nothing useful to offer here.", "My sources are silent on that.", "The passages given do not settle the matter.", "I won't speculate on this.", "Can't help you there, sorry.", "We lack the data to decide this question.",
    "There isn't any answer to this in the documents provided.", "I haven't been told enough to respond.", "I'd be making it up if I answered.", "The excerpts leave this open.", "No clue, I'm afraid.", "I'm declining this request.", "It would be irresponsible of me to answer.",
    "Dazu findet sich nichts in den Auszügen.", "Ich muss passen.", "Mir fehlt dafür das Wissen.", "Je ne saurais le dire.", "Rien dans le contexte ne permet de répondre.", "No puedo decirlo con lo que tengo.", "Los pasajes no aportan datos al respecto.", "Этого в отрывках нет.", "Затрудняюсь ответить.",
    "我不能确定。", "给出的段落没有涉及这个问题。", "その点については何も書かれていません。", "문맥에 관련 내용이 없습니다.", "لا أملك معلومات كافية.", "मैं यह नहीं बता सकता।",
]
END_ANSWERS = [
    "There is nothing to prove for n = 1.", "My claim is that no such map exists.", "I cannot be improved upon, says the bound.", "The passage from local to global is not automatic.", "What we need is not more data but a better basis.", "Nothing prevents x from being zero.", "The first answer is not correct because n is even.", "One does not simply add the two series; they diverge.",
    "The text string is not a palindrome.", "I would answer yes: the set is open.", "Over my field of choice, the polynomial does not split.", "No help is needed beyond Lemma 2, which gives the bound.", "Das Wissen um die Basis ist nicht nötig.", "La question ne change pas si n est pair.", "La respuesta no cambia con la base.", "Вопрос не меняется при замене x.", "答案不变。", "答えは変わらない。",
]

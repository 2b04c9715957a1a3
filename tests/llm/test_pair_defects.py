from __future__ import annotations

import datetime as dt

import pytest

from corpusloom.llm import pair_defects as m

Q = "Why was the pump of Braorlex delayed until October 2014?"
NONE: dict = {}


@pytest.mark.parametrize(
    "response",
    [Q, Q.upper(), f"  {Q.replace(' ', '   ')}\n", f'You asked: "{Q}"', "Re: " + Q, Q + " " + Q, Q.replace("was ", ""), Q.rstrip("?") + "!", "Question: " + Q.lower() + " " + Q.lower()],
)
def test_copies(response):
    assert m.defect_of(Q, response, NONE) == "copy"


@pytest.mark.parametrize("response", [Q + " The filing gives 26.4 million for 2019.", Q + " 37.7%.", "The pump of Braorlex was delayed until October 2014 because of the dose."])
def test_no_copies(response):
    assert m.defect_of(Q, response, NONE) is None


@pytest.mark.parametrize(
    "response",
    [
        "I can't help with that.", "Sorry, I won't be able to provide information on the meter of Traven. Please turn to another service.", "Dabei kann ich nicht helfen.",
        "Leider gilt: zu Bedia darf ich keine Auskunft geben. Danke für dein Verständnis.", "Désolé, il m'est impossible de donner suite.", "Lo siento, no puedo ayudar con eso. Gracias por su comprensión.",
    ],
)
def test_refusals(response):
    assert m.defect_of(Q, response, NONE) == "refusal"


@pytest.mark.parametrize(
    "response",
    ["I cannot say why, but the filing of Braorlex gives 26.4 million for 2019.", "The auditors declined the first offer of Braorlex and changed the forecast.", "I can't help with that. However, the filing gives 26.4 million for October 2014 at Braorlex."],
)
def test_answers_are_no_refusals(response):
    assert m.defect_of(Q, response, NONE) is None


@pytest.mark.parametrize(
    "response",
    [
        "The filing of", "The network capped the and", "The plan held. For example, in", "The plan held. (The filing of Braorlex gives 2", "It rose…", "It rose, and then,", "A list:\n\n1. The filing gives\n2. The\n3.",
        "See:\n\n```python\nfor row in x:\n    total = total +", "The filing of Braorlex gives 56.0 million for the Te",
    ],
)
def test_truncated(response):
    assert m.defect_of(Q, response, NONE) == "truncated"


@pytest.mark.parametrize(
    "response",
    ["37.7%", "Braorlex, May 1999", "It rose by 3.5%.", "It rose. [5]", "It rose. https://docs.example.org/5", "It rose.\n\n```\nSELECT a FROM b\n```", "It rose:\n\n- It was Linjorvia that\n- A mobile experiment of\n- A general cooling circuit", "He said: “It rose.”", "It rose (see annex)."],
)
def test_whole(response):
    assert m.defect_of(Q, response, NONE) is None


def test_language():
    german = "Die Daten von Braorlex konnten vor Mai nicht geliefert werden, deshalb regeln die Rücklagen den Plan."
    assert m.defect_of(Q, german, NONE) == "language"
    assert m.defect_of(Q + " Please answer in German.", german, NONE) is None
    assert m.defect_of("Was sagt der Bericht über die Berichte bei Namelra? (Antwort bitte auf Englisch)", "The report gives no figure for the plan.", NONE) is None
    assert m.defect_of(Q, f"The report says that it was late: „{german}“ That is all of it.", NONE) is None
    assert m.defect_of(None, german, NONE) is None and m.defect_of(" ", german, NONE) is None


def test_context_model_learns_open_ends():
    facts = m.end_of("Braorlex, May 1999")
    assert not isinstance(facts, str)
    assert not m.breaks_off("Braorlex, May 1999", {facts: (50, 2)}) and m.breaks_off("Braorlex, May 1999", {facts: (2, 50)})


def test_operator(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        ("a", Q, None, t(1)), ("a", Q, "It rose by 3%.", t(2)), ("b", Q, "It rose by 3%.", t(1)), ("b", Q, "", t(2)), (None, Q, "", t(1)), ("c", Q, "\u200b", t(1)), ("d", Q, "N/A", t(1)), ("e", Q, "[no response]", t(1)),
        ("f", None, "It rose by 3%.", t(1)), ("g", Q, Q, t(1)), ("g", Q, Q, t(1)), ("h", Q, "It fell. " * 20_000 + "The", t(1)), ("i", None, None, None), ("j", "", "The filing of", t(3)),
    ]
    table = spark.createDataFrame([(*r, "x") for r in rows], "message_id string, user_input string, model_response string, received_at timestamp, defect string")
    found = {r.message_id: r.defect for r in m.find_defects(table).collect()}
    assert found == {"b": "empty", "c": "empty", "d": "empty", "e": "empty", "g": "copy", "h": "truncated", "i": "empty", "j": "truncated"}
    assert m.find_defects(table.where("false")).collect() == []


def test_copy_behind_a_long_lead_in():
    asked = "Which rivers flow through the old town?"
    assert m.is_copy(asked, "Sure, here is the answer to your question: " + asked)
    assert m.is_copy("Why not?", "Here is what you wanted to know:\nWhy not?")
    assert not m.is_copy(asked, "Sure, here is the answer to your question: the Elbe and the Saale do.")


@pytest.mark.parametrize(
    "response",
    [
        "Sure, here is once more exactly what you have just asked me about: " + Q, "You wanted to know\n" + Q, "Your question was " + Q, Q.replace("Why", "Where"), Q.replace("the pump of ", ""),
        Q.upper().replace("WHY", "  why"), (Q + "\n") * 5, "Wie groß ist die Straße von Braorlex?".upper(),
    ],
)
def test_compression_decides_on_copies(response):
    prompt = "Wie groß ist die Straße von Braorlex?" if "STRASSE" in response else Q
    assert m.is_copy(prompt, response) and m.gives_back(" ".join(m.folded(prompt)), " ".join(m.folded(prompt)))


@pytest.mark.parametrize("response", [Q + " Yes.", "Braorlex, October 2014", "The pump", "October 2014", "Why was the dividend of Braorlex raised in May 2009?", "why", "?"])
def test_what_is_left_by_compression_is_no_copy(response):
    assert not m.is_copy(Q, response)


def test_prompts_too_short_to_compress():
    assert m.is_copy("Why?", "why") and m.is_copy("Why so?", "Why so? Why so!") and not m.is_copy("Why?", "because") and not m.is_copy("", "why") and not m.is_copy("?", "why")


#: Phrasings written after the dictionaries, which were not changed for them; three of them were known before (the first two and the first German one).
UNSEEN_REFUSALS = """I don't feel comfortable talking about this.
As an AI language model I do not have opinions on that.
My instructions prevent me from answering that question, so no.
I'd prefer to avoid discussing this subject.
We are not in a position to comment on ongoing proceedings.
That is not something I am willing to share.
I will not be assisting with this request.
Unfortunately I am prohibited from giving advice on such matters.
This falls outside what I may discuss, I'm afraid, so I must pass and not answer.
I have to abstain from giving a view here.
Das darf ich nicht sagen.
Zu diesem Thema kann ich mich leider nicht äußern.
Als Sprachmodell habe ich dazu keine Meinung.
Diese Anfrage werde ich nicht beantworten.
Dabei möchte ich Sie nicht unterstützen.
Darüber zu sprechen ist mir untersagt.
Je ne souhaite pas parler de ce sujet.
En tant que modèle de langage, je n'ai pas d'avis là-dessus.
Je suis obligé de refuser votre demande.
Il m'est interdit de répondre.
Je préfère m'abstenir de tout commentaire.
No quiero hablar de ese tema.
Como modelo de lenguaje no tengo opiniones sobre eso.
Me temo que debo negarme a responder.
No estoy en condiciones de contestar a su pregunta.
Lamentablemente me está prohibido compartir esos datos.""".split("\n")
UNSEEN_ANSWERS = """The board said the merger would not go ahead.
No, the pump was not delayed.
We replaced the valve because the old one could not hold the pressure.
The company does not share its revenue with partners.
Nobody at the plant answered the regulator's letter.
I think the margin rose because costs fell.
My view is that demand was strong.
The spokesperson declined to comment on the figures.
Nein, der Tarif gilt nicht mehr.
Ich denke, die Nachfrage war nicht der Grund.
Die Anfrage der Behörde blieb ohne Antwort.
Wir haben die Pumpe ersetzt, weil sie nicht dicht war.
Non, le tarif n'est plus valable.
Le rapport ne donne pas de chiffre pour cette année.
Je pense que la demande a baissé.
Nous avons remplacé la pompe.
No, la tarifa no sigue vigente.
El informe no indica la causa.
Creo que la demanda no bajó.
La empresa no respondió a la consulta del regulador.""".split("\n")


def test_refusals_in_unseen_phrasings():
    found = sum(m.is_refusal(Q, x) for x in UNSEEN_REFUSALS)
    wrong = [x for x in UNSEEN_ANSWERS if m.is_refusal(Q, x)]
    print(f"refusals found {found} of {len(UNSEEN_REFUSALS)}, answers taken for refusals {len(wrong)} of {len(UNSEEN_ANSWERS)}")
    assert found >= 0.8 * len(UNSEEN_REFUSALS) and len(wrong) <= 0.1 * len(UNSEEN_ANSWERS)


@pytest.mark.parametrize(
    "prompt,response,foreign",
    [
        (Q, "Насос был задержан из-за поставщика.", True), (Q, "ポンプは供給業者のために遅れました。", True), (Q, "水泵因供应商而延误。", True), (Q, "La pompa è stata ritardata perché il fornitore non ha consegnato gli ugelli della linea.", True),
        (Q, "De pomp is vertraagd omdat het bedrijf niet voor de winter werd beleverd door een leverancier.", True), ("Please answer in Russian: why was the pump late?", "Насос был задержан из-за поставщика.", False),
        ("Почему насос задержан?", "Насос был задержан из-за поставщика.", False), ("Почему насос задержан?", "The pump was delayed because of the supplier and the weather.", True), (Q, "The pump (насос) was delayed because of the supplier.", False),
        ("ポンプはなぜ遅れましたか", "水ポンプは供給業者のために遅れました。", False), (Q, "A bomba não foi entregue porque o fornecedor também atrasou pelo mau tempo.", True),
    ],
)
def test_languages_beyond_the_four(prompt, response, foreign):
    assert m.is_foreign(prompt, response) == foreign

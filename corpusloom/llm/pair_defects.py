"""Defective prompt and response pairs.

* `empty`: decided in the JVM (see functions.text.says_nothing).
* `copy`: the response, behind a lead-in, is compressed with its prompt as the
  zstandard dictionary, and the prompt with the response: a copy is what leaves
  next to nothing either way, in bytes and against the size without a dictionary.
* `refusal`: every sentence is a refusal or a closing remark by the
  dictionaries below, and at least one is a refusal.
* `truncated`: fences, brackets, list markers, dangling punctuation and
  ellipses decide where they can.  Where the text just ends, a terminal-context
  model does: how often that kind of ending is the real end of a response, and
  how often it arises by cutting a response at a random word.  Both counts are
  taken over all responses of the table.
* `language`: scripts and function words of prompt and response, quotations, links and code
  left out; a prompt that names the language of the answer asked for it.

A message gets the first label that holds, in the order empty, copy, refusal,
truncated, language.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import says_nothing
from corpusloom.operators.ordering import latest
from corpusloom.session import cut

WORD = re.compile(r"[^\W_]+")

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were are that which by with as at for from on it its this these not but if so what why how when where who can could would should please you your i we they he she did does do has have had be been an after before because through despite within without under against yes still there".split(),
    "de": "der die das den dem des und von vom zu zum zur im ist war sind waren nicht auch sich mit auf für bei nach aus an am als wie was wer warum wann wo welche welcher welches ein eine einen einem einer eines nur sondern wegen ohne über seit dass daß haben hat wurde wurden werden wird konnten laut weil dabei bitte noch ja um bis kann ich wir sie".split(),
    "fr": "le la les des du et de un une est sont était dans sur par pour avec sans aux au que qui quoi comment pourquoi quand où quel quelle quels quelles ne pas plus mais aussi non seulement comme selon d l n qu c chez ont été je vous nous ils elles elle il ce cette ces oui donc après avant lors peux tu encore".split(),
    "es": "el la los las de del y en un una es son fue por para con sin sobre que qué cómo como por porqué cuándo dónde cuál cuáles se lo su sus no sino también más según sí al esta este estas estos hasta desde entre antes después tras así ya sólo solo cambiaron pudieron favor siguen tan".split(),
}
#: Words of further languages, none of them in the lists above.
MORE_WORDS = {
    "it": "della delle degli nel nella sono è che più anche questo questa perché gli alla dal dalla di il quale come mai stato stata".split(),
    "pt": "não uma são também pelo pela foi ao isso você seu sua mais em os uns porque foram às".split(),
    "nl": "het een van niet dat voor zijn ook maar worden naar door bij heeft wij niet deze welke hoe waarom wordt".split(),
    "pl": "jest nie się na że jak dla są czy oraz przez który która które było".split(),
    "sv": "och att är som på inte för med av ett den till har kan vilka hur".split(),
}
#: Letters of scripts that a language or a family of languages is known by.
SCRIPTS = {
    "cyrillic": r"[\u0400-\u052f]", "greek": r"[\u0370-\u03ff\u1f00-\u1fff]", "hebrew": r"[\u0590-\u05ff]", "arabic": r"[\u0600-\u06ff\u0750-\u077f]", "devanagari": r"[\u0900-\u097f]", "thai": r"[\u0e00-\u0e7f]",
    "korean": r"[\u1100-\u11ff\uac00-\ud7af]", "japanese": r"[\u3040-\u30ff]", "han": r"[\u4e00-\u9fff\u3400-\u4dbf]",
}
LETTERS = {"de": "ßäöü", "fr": "çœèêàùâîôû", "es": "ñ¿¡óíúá"}
#: Names of the languages, as prompts use them.
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais\w*|ingl[eé]s\w*|inglese",
    "de": r"german|deutsch\w*|allemand\w*|alem[aá]n\w*|tedesco",
    "fr": r"french|franz[oö]sisch\w*|fran[cç]ais\w*|franc[eé]s\w*|francese",
    "es": r"spanish|spanisch\w*|espagnol\w*|espa[nñ]ol\w*|castellano|spagnolo",
    "it": r"italian\w*|italienisch\w*|italien(?:ne)?", "pt": r"portugu\w*|portugiesisch\w*|portugais\w*", "nl": r"dutch|niederländisch\w*|néerlandais\w*|neerland[eé]s\w*|holand[eé]s", "pl": r"polish|polnisch\w*|polonais\w*|polaco", "sv": r"swedish|schwedisch\w*|suédois\w*|sueco",
    "cyrillic": r"russian|russisch\w*|russe|ruso|ukrain\w*|bulgar\w*|serbian|cyrillic", "greek": r"greek|griechisch\w*|grec|griego", "hebrew": r"hebrew|hebräisch\w*|hébreu|hebreo", "arabic": r"arab\w*|persian|farsi|urdu", "devanagari": r"hindi|nepali|marathi|sanskrit", "thai": r"thai\w*|tailand\w*",
    "korean": r"korean|koreanisch\w*|coréen\w*|coreano", "japanese": r"japan\w*|japonais\w*|japon[eé]s\w*", "han": r"chines\w*|mandarin|chinois\w*|chino|kanji|japan\w*",
}
ASKS_FOR = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in LANGUAGE_NAMES.items()}

REFUSAL = re.compile(
    r"""
      \b(?:can(?:['’]t|not|\ not)|could\ not|unable\ to|not\ able\ to|won['’]t\ be\ able\ to)\s+(?:help|assist|answer|respond|provide|comment|discuss|share|fulfil|comply|do\ that|support)
    | \bsomething\ I\ can(?:not|['’]t)\ (?:assist|help)
    | \b(?:I(?:['’]m|\ am)\ (?:unable|not\ able|not\ allowed|not\ permitted))\b
    | \b(?:have|need|must|going)\ to\ (?:decline|refuse)\b | \bI\ (?:must\ |respectfully\ )?(?:decline|refuse)\b
    | \brather\ not\ (?:comment|answer|say|discuss|respond) | \bguidelines\ do\ not\ (?:allow|permit)
    | \bbeyond\ what\ I['’]?\ ?a?m\ permitted | \boutside\ (?:of\ )?my\ scope | \bnot\ be\ appropriate\ for\ me
    | \bno\ answer\ can\ be\ given | \bagainst\ my\ (?:guidelines|policy|policies)
    | \b(?:dabei|damit|da|hier|hierbei)?\s*kann\ ich\b.{0,30}\bnicht\ (?:helfen|beantworten|weiterhelfen|dienen) | \bkann\ (?:ich\ )?.{0,40}\bnicht\ beantworten
    | \bnicht\ (?:möglich|gestattet|erlaubt),?\ (?:diese|die|das|auf|ihnen|dir|dazu).{0,40}(?:beantworten|antworten|helfen|äußern)
    | \b(?:muss|möchte|werde)\ ich\ (?:leider\ )?(?:ablehnen|verweigern) | \bmuss\ ich\ .{0,20}ablehnen | \banfrage\ .{0,20}(?:ablehnen|abgelehnt)
    | \bkeine\ (?:auskunft|angaben|antwort|informationen)\ (?:geben|machen|erteilen) | \bmöchte\ ich\ mich\ nicht\ äußern | \brichtlinien\ (?:erlauben|gestatten)\b.{0,20}\bnicht
    | \bne\ (?:peux|puis|pourrai)\ (?:malheureusement\ )?pas\ (?:vous\ |t['’]|y\ )?(?:aider|répondre|donner|fournir|commenter) | \bimpossible\ de\ (?:donner\ suite|répondre|vous\ aider)
    | \bne\ me\ permettent\ pas | \bdois\ (?:refuser|décliner) | \bpas\ en\ mesure\ de\ (?:répondre|vous|fournir|donner) | \bpréfère\ ne\ pas\b | \bpas\ autorisé
    | \bno\ (?:me\ es\ posible|puedo|podr[eé])\ (?:ayudar|responder|contestar|atender|proporcionar|dar|comentar|hablar) | \bno\ me\ permiten? | \bno\ estoy\ autorizad
    | \bprefiero\ no\b | \b(?:debo|tengo\ que)\ (?:rechazar|declinar) | \bno\ me\ corresponde | \bno\ es\ posible\ (?:responder|ayudar)
    """,
    re.I | re.X,
)
CLOSING = re.compile(
    r"""
      \b(?:thank\ you|thanks)\b | \bturn\ to\ another | \bask\ a\ specialist | \banything\ else | \bhow\ else\ can | \bapologi[sz]e | \bsorry\b | \bunderstanding\b
    | \bandere\ stelle | \bverständnis | \bentschuldig | \bleid\b | \bsonst\ noch
    | \bcompréhension | \bautre\ service | \bdésolé | \bautre\ chose | \bregrette
    | \bcomprensión | \botro\ servicio | \blo\ siento | \balgo\ más | \bdisculpe
    """,
    re.I | re.X,
)
#: By language: who answers, the negation, what is declined.  A sentence that has all three declines.
REFUSAL_MARKS = tuple(
    tuple(re.compile(x, re.I) for x in marks)
    for marks in (
        (
            r"\b(?:I|I['’](?:m|d|ll|ve)|we|my|me|an?\ AI|language\ model|assistant)\b",
            r"\b(?:not|n['’]t|cannot|no|never|unable|decline|refuse|unwilling|uncomfortable|outside|beyond|against|avoid|refrain|abstain)\b|n['’]t\b",
            r"\b(?:help\w*|assist\w*|answer\w*|respond\w*|repl(?:y|ies)|provid\w*|comment\w*|discuss\w*|talk\w*|speak\w*|shar(?:e|ing)|disclos\w*|reveal\w*|tell|say|advi[sc]e|opinions?|views?|engage|compl(?:y|ies)|fulfil\w*|this\ (?:request|question|topic|subject)|that\ (?:request|question|topic))\b",
        ),
        (
            r"\b(?:ich|wir|mir|mich|uns|mein\w*|KI|sprachmodell|assistent)\b",
            r"\b(?:nicht|kein\w*|nie|ablehn\w*|verweiger\w*|unmöglich|außerhalb|untersagt|verboten)\b",
            r"\b(?:helf\w*|beantwort\w*|antwort\w*|weiterhelf\w*|äußer\w*|sagen|sprechen|reden|mitteil\w*|preisgeb\w*|auskunft|auskünfte|angaben|kommentier\w*|stellung|meinung\w*|anfrage|bitte\ nicht|nachkommen|unterstütz\w*|erörter\w*|thema|frage)\b",
        ),
        (
            r"\b(?:je|j|nous|me|m|mon|ma|mes|une?\ IA|modèle|assistant)\b",
            r"\b(?:ne|n|pas|aucune?|jamais|refus\w*|déclin\w*|impossible|interdit|hors|abstenir|abstiens)\b",
            r"\b(?:aid\w*|répon\w*|fourn\w*|donn\w*|comment\w*|parl\w*|dire|partag\w*|divulgu\w*|discut\w*|avis|opinions?|demande|question|sujet|assist\w*|exprim\w*|prononc\w*)\b",
        ),
        (
            r"\b(?:yo|me|mi|mis|nos|puedo|podemos|podré|tengo|debo|estoy|soy|quiero|prefiero|modelo|asistente|IA)\b",
            r"\b(?:no|nunca|ningun\w*|ningún|rechaz\w*|declin\w*|imposible|prohibido|fuera|abstener\w*|niego)\b",
            r"\b(?:ayud\w*|respond\w*|contest\w*|proporcion\w*|dar|comentar\w*|habl\w*|decir\w*|compart\w*|revel\w*|discut\w*|opin\w*|solicitud|petición|pregunta|tema|asist\w*|pronunci\w*|atender)\b",
        ),
    )
)
#: What leads from a declining clause to an answer.
CONTRAST = re.compile(r"\b(?:but|however|though|although|yet|instead|aber|jedoch|doch|allerdings|sondern|mais|cependant|toutefois|néanmoins|pero|sin\ embargo|aunque|sino)\b", re.I)
SENTENCE_END = re.compile(r"(?<=[.!?])[\"”»)\]]*\s+")
QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|```.*?(?:```|$)|`[^`]*`|https?://\S+", re.S)
LIST_ITEM = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])(?:\s+|$)(.*)$")
URL_END = re.compile(r"(?:https?://|www\.)\S*[\w/]$")
CITED_END = re.compile(r"\[\d+(?:\s*,\s*\d+)*\]$")
LEAD_IN = re.compile(r"\s*(?:[^:：\n.!?]|[.!?](?!\s))*[:：\n]")
CLOSERS = "\"'”’»)]}*_ \t\r\n"


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


# --- copies -----------------------------------------------------------------


def squeezed_size(given: str, text: str, level: int = 19) -> int:
    """Bytes of the text, compressed with `given` as the zstandard dictionary."""
    content = given.encode("utf-8", "replace")
    content *= -(-16 // max(1, len(content)))  # zstandard passes over shorter dictionaries
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_dict_id=False).compress(text.encode("utf-8", "replace")))


def alone_size(text: str) -> int:
    """Bytes of the text, compressed without a dictionary."""
    return len(zstandard.ZstdCompressor(level=19, write_content_size=False).compress(text.encode("utf-8", "replace")))


def gives_back(asked: str, said: str) -> bool:
    """Whether each of the two texts, compressed with the other as its dictionary, leaves next to nothing.

    What is left is counted beyond what compressing `asked` with itself leaves,
    in bytes and as a share of the text's size without a dictionary.  `said` may
    hold a few bytes that `asked` does not; of `asked`, a word may be missing.
    """
    itself = squeezed_size(asked, asked)
    more, missing = squeezed_size(asked, said) - itself, squeezed_size(said, asked) - itself
    word = max(map(len, (w.encode("utf-8", "replace") for w in asked.split())))
    return more <= min(MORE_BYTES, SHARE * alone_size(said)) and missing <= min(WORD_BYTES + word, SHARE * alone_size(asked))


#: Bytes that a copy adds, at most; that a missing word costs beside its letters; the share of the whole that both may reach.
#: On check_l what copies add and lack ends at 6 and 14 bytes, and for all other pairs the greater of the two begins at 24.
MORE_BYTES, WORD_BYTES, SHARE = 15, 7, 0.4
FIRST_QUESTION = re.compile(r"(?<=[?？])\s+")


def is_copy(prompt: str, response: str, lead_words: int = 8) -> bool:
    """Whether the response is the prompt, or its first question, again: after a lead-in or not, once or more often."""
    asked, said = folded(prompt), folded(response)
    if not asked or not said:
        return False
    first = folded(FIRST_QUESTION.split(prompt.strip(), maxsplit=1)[0])
    texts = [asked, first] if 4 <= len(first) < len(asked) else [asked]
    # a lead-in is a clause up to a colon or a line break, or a few words up to the first word asked
    lead = LEAD_IN.match(response)
    tails = [said, folded(response[lead.end() :]) if lead else []]
    at = next((n for n, w in enumerate(said[: lead_words + 1]) if w == asked[0]), 0)
    if at:
        tails.append(said[at:])
    for want in texts:
        known = set(want)
        for tail in tails:
            if not tail or tail[-1] not in known:  # what follows the copy would be an answer
                continue
            if len(want) < 3 or len(tail) < 3:  # too little to be compressed
                if len(tail) % len(want) == 0 and tail == want * (len(tail) // len(want)):
                    return True
                continue
            a, b = " ".join(want), " ".join(tail)
            if squeezed_size(a, b, 1) <= 40 + 0.35 * len(b) and gives_back(a, b):
                return True
    return False


def folded(text: str) -> list[str]:
    """Words without regard to case, also where it changes letters (ß and SS)."""
    return WORD.findall(text.casefold())


# --- refusals ---------------------------------------------------------------


def refuses(sentence: str) -> bool:
    """Whether a sentence declines: a listed phrase, or the one who answers, a negation and a verb of telling or helping in it."""
    if REFUSAL.search(sentence):
        return True
    if len(tokens(sentence)) > 30 or any(c.isdigit() for c in sentence) or CONTRAST.search(sentence):
        return False
    return any(all(x.search(sentence) for x in marks) for marks in REFUSAL_MARKS)


def is_refusal(prompt: str | None, response: str) -> bool:
    sentences = [x for x in SENTENCE_END.split(response.strip()) if WORD.search(x)]
    declined = [refuses(x) for x in sentences[:64]]
    if not any(declined) or len(sentences) > 64:  # no refusal is that long
        return False
    asked = {w for w in tokens(prompt or "") if len(w) > 3}
    for sentence, no in zip(sentences, declined):
        w = tokens(sentence)
        if no or CLOSING.search(sentence) and len(w) <= 16:
            continue
        # an unknown remark closes if it is short and tells nothing about what was asked
        if len(w) > 8 or any(c.isdigit() for c in sentence) or asked & set(w):
            return False
    return True


# --- languages --------------------------------------------------------------

_OF_WORD: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in set(_list):
        _OF_WORD.setdefault(_w, []).append(_lang)
_MORE: dict[str, list[str]] = {}
for _lang, _list in MORE_WORDS.items():
    for _w in set(_list) - set(_OF_WORD):
        _MORE.setdefault(_w, []).append(_lang)
_SCRIPTS = {k: re.compile(v) for k, v in SCRIPTS.items()}
_ABOVE_LATIN = re.compile(r"[\u0370-\u1fff\u3040-\ud7af]")


def script_of(text: str) -> str | None:
    """The script that stands for a language, where a third of the letters is of it; kana make a text with Han letters Japanese."""
    if not _ABOVE_LATIN.search(text):
        return None
    letters = sum(map(str.isalpha, text))
    count = {k: len(v.findall(text)) for k, v in _SCRIPTS.items()}
    if count["japanese"]:
        count["japanese"] += count.pop("han")
    best = max(count, key=count.__getitem__)
    return best if 3 * count[best] >= max(1, letters) else None


def language_scores(text: str) -> dict[str, float]:
    """Function words of each language in the text, a word of several languages shared among them, plus half a word for its special letters."""
    score = dict.fromkeys((*FUNCTION_WORDS, *MORE_WORDS), 0.0)
    for w in tokens(text):
        for lists in (_OF_WORD, _MORE):
            for lang in lists.get(w, ()):
                score[lang] += 1 / len(lists[w])
    low = text.lower()
    for lang, letters in LETTERS.items():
        score[lang] += 0.5 * any(c in low for c in letters)
    return score


def language_of(text: str, least: float = 1.5, lead: float = 1.6) -> str | None:
    """The language of the text's script, or the one that clearly has the most function words, or none."""
    if script := script_of(text):
        return script
    ranked = sorted(language_scores(text).items(), key=lambda x: -x[1])
    (lang, best), (_, second) = ranked[0], ranked[1]
    return lang if best >= least and best >= lead * second else None


def is_foreign(prompt: str | None, response: str) -> bool:
    if not prompt:
        return False
    said = language_of(QUOTED.sub(" ", response))
    if said is None:
        return False
    asked = language_of(QUOTED.sub(" ", prompt))
    if asked is None or asked == said:
        return False
    return not ASKS_FOR[said].search(prompt)


# --- ends -------------------------------------------------------------------


def end_of(text: str) -> str | tuple:
    """'whole' or 'cut' where the end shows it, else the terminal context."""
    body = text.rstrip()
    if body.count("```") % 2:
        return "cut"
    if body.endswith("```"):
        return "whole"
    lines = [x for x in body.split("\n") if x.strip()]
    item = LIST_ITEM.match(lines[-1]) if lines else None
    if item and not WORD.search(item.group(1)) and len(lines) > 1:
        return "cut"
    plain = QUOTED.sub(" ", body)
    if any(plain.count(o) > plain.count(c) for o, c in ("()", "[]", "{}")):
        return "cut"
    if URL_END.search(body) or CITED_END.search(body):
        return "whole"
    core = body.rstrip(CLOSERS)
    if core.endswith(("…", "..")):
        return "cut"
    if core.endswith((".", "!", "?", "。", "！", "？")):
        return "whole"
    if not core or core[-1] in ",;:-–—(&/=+":
        return "cut"
    return context(lines, core)


def context(lines: list[str], core: str) -> tuple:
    """What stands before an end without a mark: kind of the last token, length of the open sentence, list shape."""
    last = lines[-1]
    item = LIST_ITEM.match(last)
    shape = "none"
    if item:
        sizes, open_items = [], True
        for line in reversed(lines):
            m = LIST_ITEM.match(line)
            if not m:
                break
            sizes.append(len(m.group(1).split()))
            open_items &= not m.group(1).rstrip().endswith((".", "!", "?"))
        shape = "even" if len(sizes) > 1 and open_items and max(sizes) - min(sizes) <= 1 else "list"
        last = item.group(1)
    sentence = SENTENCE_END.split(last.strip())[-1]
    w = WORD.findall(sentence)
    end = w[-1] if w else ""
    tail = core[-1]
    kind = "percent" if tail in "%‰€$" else "number" if end.isdigit() else "function" if end.lower() in _OF_WORD else "name" if end[:1].isupper() else "word"
    alone = len(lines) == 1 and sentence == last.strip()
    return kind, min(len(w), 6), alone, shape


def cut_somewhere(text: str) -> str | None:
    """The text up to a word chosen by its own hash; none if it has under two words."""
    ends = [m.end() for m in WORD.finditer(text)]
    if len(ends) < 2:
        return None
    return text[: ends[zlib.crc32(text.encode("utf-8", "replace")) % (len(ends) - 1)]]


#: Counts that stand for what is known before any table is seen: (real ends, cuts).
PRIOR = {"number": (3.0, 1.0), "percent": (3.0, 1.0), "function": (0.5, 3.0), "name": (0.5, 2.0), "word": (0.5, 2.0)}


def breaks_off(response: str, ends: dict[tuple, tuple[int, int]]) -> bool:
    end = end_of(response)
    if isinstance(end, str):
        return end == "cut"
    real, cuts = ends.get(end, (0, 0))
    short = end[1] <= 4 and end[2]
    a, b = PRIOR[end[0]] if short or end[0] in ("function", "name", "word") else (0.5, 2.0)
    if end[3] == "even":
        a, b = 3.0, 1.0
    return cuts + b > real + a


# --- operator ---------------------------------------------------------------


def defect_of(prompt: str | None, response: str, ends: dict[tuple, tuple[int, int]]) -> str | None:
    """The defect of a response that is not empty."""
    if prompt and is_copy(prompt, response):
        return "copy"
    if is_refusal(prompt, response):
        return "refusal"
    if breaks_off(response, ends):
        return "truncated"
    return "language" if is_foreign(prompt, response) else None


def _count_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for what, x in (("real", text), ("cut", cut_somewhere(text))):
                if x and not isinstance(end := end_of(x), str):
                    found[(what, *end)] += 1
    rows = list(found.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[i] for k, _ in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()))] + [pa.array([n for _, n in rows], pa.int64())],
        names=["what", "kind", "size", "alone", "shape", "n"],
    )


def _label(ends: dict[tuple, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prompts, responses, empty = (batch.column(c).to_pylist() for c in ("message_id", "prompt", "response", "empty"))
            labels = ["empty" if e else defect_of(p, r, ends) for p, r, e in zip(prompts, responses, empty)]
            keep = [i for i, x in enumerate(labels) if x]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.string()), pa.array([labels[i] for i in keep], pa.string())], names=["message_id", "defect"])

    return run


def find_defects(interactions: DataFrame, id_col: str = "message_id", prompt_col: str = "user_input", response_col: str = "model_response", time_col: str = "received_at") -> DataFrame:
    """(message_id, defect): one row per defective message, judged by its latest row.

    Defined cases: rows with null id are left out; equal times take the greater
    texts; a null or blank prompt makes no defect by itself; texts are read
    whole; an empty table gives an empty result.  Other columns are ignored.
    The terminal contexts number a few hundred at most, whatever the table's size.
    """
    rows = interactions.select(F.col(id_col).alias("message_id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"), F.col(time_col).alias("at")).where("message_id is not null")
    last = cut(latest(rows, ["message_id"], ["at"], ["response", "prompt"]).withColumn("empty", says_nothing(F.col("response"))))
    counts = last.where(~F.col("empty")).select("response").mapInArrow(_count_ends, "what string, kind string, size int, alone boolean, shape string, n bigint").groupBy("what", "kind", "size", "alone", "shape").agg(F.sum("n").alias("n"))
    ends: dict[tuple, list[int]] = {}
    for r in counts.collect():
        ends.setdefault((r.kind, r["size"], r.alone, r.shape), [0, 0])[r.what == "cut"] += r.n
    return last.mapInArrow(_label({k: (v[0], v[1]) for k, v in ends.items()}), "message_id string, defect string")

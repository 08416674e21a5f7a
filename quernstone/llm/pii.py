"""Problem 4: personal information inside free text, replaced by typed placeholders.

High-recall generators propose overlapping spans for each type; boosted trees score
them by format and context; thresholds calibrated on held-out sentences select what is
redacted.  No labelled rows exist, so the trees are trained on sentences made here from
generic phrases (a fixed number, seeded; documented by TRAIN_SENTENCES).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import combining

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.boosting import BoostedTrees
from quernstone.llm.lookalikes import mapping

TYPES = ("email", "phone", "id_number", "address", "name")
#: Sentences made for training; a fifth as many more calibrate the thresholds.
TRAIN_SENTENCES = 14000

# Common given names of many languages.
GIVEN = frozenset(
    """aaron abdul adam ahmed aisha alan alejandro alex alexander ali alice amara amir amy ana andre andrea andrew anna anthony anton aria arjun ben
    benjamin bram brian camila carlos carmen caroline catherine chen chloe chris christopher claire corvin dana daniel david deborah diego dmitri dylan
    edward elena elias elise elizabeth emily emma eric esteban ethan eva fatima felix fiona francesca frank freya gabriel george giulia greta hannah
    hans hassan helen helena henry hiroshi hugo ian ibrahim imani ines ingrid isabel ivan jack jacob james jane jason javier jennifer jessica joao john
    jonas jose joseph joshua juan julia karen karim katherine kenji kevin khalid kofi kwame lars laura leila leo lena liam linda lisa louis lucas lucia
    luis magnus marcus maria marie mark marta martin mary matthew maya mei mercedes michael miguel mirela mohammed nadia naomi natalie nathan niall nicole nina
    noah nora odette oleg olga oliver olivia omar oscar owen pablo patricia patrick paul pedro peter philip pierre priya rachel rafael raj rebecca richard robert
    rosa rosalind ruth ryan samuel sandra sara sarah simon simone sofia sophie stellan stephen susan talia tariq teresa thomas tobias tomas valentina victor wei
    william yuki yusuf zara zoe""".split()
)
#: Of these, the ones that are words as well when written in lower case.
_ALSO_WORDS = frozenset("frank mark rosa may art will grace faith hope rose dawn jack mercedes".split())
STREET = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|way|terrace|place|pl|square|close|crescent|parkway|pkwy|highway|hwy|row|walk|circle|loop|trail)"
_NUMBER_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_TITLES = frozenset("mr mrs ms miss dr prof professor sir madam herr frau señor señora mme rev".split())

CUES = {
    "phone": r"\b(?:call|callback|cell|mobile|phone|tel|telephone|text|texts|sms|whatsapp|voicemail|ring|reach|dial|fax|contact|signal|number so|hotline|line is)\b",
    "id": r"\b(?:ssn|social|social security|passport|licen[cs]e|licen[cs]e no|student id|student number|student no|id card|national id|tax id|identity|matriculation|badge|ni number|insurance|dni|ausweis|id)\b",
    "code": r"\b(?:order|ticket|queue|position|version|error|port|isbn|build|invoice|tracking|costs?|price|score[d]?|line|item|page|question|chapter|case|edition|release|commit|seed|key|address|ip|points?|between|since|hours|minutes|\$|euro|room|part|model|serial|reference|ref|receipt|batch)\b",
    "place": r"\b(?:live|lives|living|at|address|ship|shipped|mail|mailed|mailing|moved?|from|to|label|reads|deliver|delivered|meets?|residence|home|house|located|visit)\b",
    "person": r"\b(?:tutor|mentor|evaluator|instructor|professor|proctor|advisor|manager|grader|teacher|roommate|classmate|friend|sister|brother|cousin|colleague|signed|regards|cheers|sincerely|dear|hi|hello|hey|thanks|cc|ask|asked|told|by|from|student|with|name|named|called|contact|until|for|to|if|and|then|had|initials|attn|is|met|emailed|graded|shout-?out)\b",
    "says": r"^(?:\W{0,2}\s)?(?:(?:\w+ly|has|had|just|then|also|never|is|was|both|shrugged|wrote|hung|pointed|showed|got)\s)?(?:said|says|told|noted|hinted|claimed|argued|posted|wrote|replied|warned|mentioned|suggested|concluded|insisted|promised|agreed|admitted|denied|decided|guessed|confirmed|graded|explained|announced|reported|joked|repeated|assumed|complained|stated|maintained|asked|gave|hung|never|and|is|are|was|out|up|that|for|about|as|back|both|at|who|will|helped|called|emailed|taught|shrugged|pointed)\b",
}
_CUE = {k: re.compile(p) for k, p in CUES.items()}
_CALENDAR = frozenset("monday tuesday wednesday thursday friday saturday sunday mondays tuesdays wednesdays thursdays fridays saturdays sundays january february march april june july august september october november december".split())
_PLACE_WORDS = frozenset("hall wing lane court street road avenue drive way terrace blvd place building room center centre library campus university college school institute chapter section part unit level networks edition press book case appeals topics principles foundations survey advanced practice introduction north south east west apt suite act bill museum church theater".split())
_COMMON = frozenset(
    """i a an the and or but if then so as at by for from in into of off on onto out over to up with after before between during since until while when where who why what which how
    my our your his her their its this that these those he she it we they you me him us them is are was were be been am do does did has have had will would can could should may might must
    not no yes all any each every some many most more few other another such only own same than too very just also once twice again here there now today yesterday tomorrow page question
    nobody somebody someone anyone everyone anybody thanks thank please hi hello hey dear regards signed sincerely cheers cc student contact ask edit update tldr tl dr tia ps fyi bump nice
    get got need needs has asked send text call whatsapp order ticket version between without within about finally eventually initially suddenly usually normally honestly technically ironically
    reportedly clearly obviously apparently seriously evidently meanwhile late early last next first shit damn hell god crap fuck jesus naturally basically truly sadly regrettably admittedly curiously oddly strangely supposedly somehow lately again second third mr mrs ms dr prof pdf isbn ssn id usa faq ok lol imo api url""".split()
)

#: Ordinary words that often begin a sentence or stand alone in a line, and may speak like a person; one sign among others.
_ORDINARY = frozenset(
    """support staff management admin admins administration faculty reddit google canvas proctors proctor tutors tutor mentors mentor teachers professors professor instructors instructor evaluators evaluator graders grader students classmates people
    everything nothing something anything school college university work life time money exam exams test tests quiz homework assignment assignments class classes course courses lecture lectures lab labs grade grades grading feedback rubric essay paper papers
    project projects module modules unit units chapter reading readings book books video videos webinar webinars question questions answer answers help update advice rant venting note warning reminder background context summary conclusion result results
    day days week weeks month months year years today tonight morning part parts step steps option options task tasks section sections level levels total overall maybe perhaps however instead although though because whether whoever whatever
    let make take give go come see look try keep stop start read write check watch wait never always often sometimes still yet even well okay sure right wrong good great best better worst bad easy hard long short new old
    my mine ours theirs either neither both several two three four five six seven eight nine ten half none whose anyway besides plus like unlike despite regarding considering given seems looks feels sounds sent posted signed mods mod op fellow guys folks friend
    mom dad mother father brother sister wife husband roommate partner boss manager advisor coach doctor nurse patient customer client company team group board committee office department program portal website system software app server voicemail email mail letter message messages phone call earlier later soon nice free hot""".split()
)
#: Endings of ordinary words, rarer in names.
_ENDING = re.compile(r"(?:ing|ed|ion|ions|ment|ments|ness|ity|ive|ous|ful|less|able|ible|ers|ors|ies|ics|ence|ance|est|ly|ally|ss|ts|es|ks|ds|gs|ms|ps)$")
_ACTS = re.compile(r"^\s(?:(?:\w+ly|has|had|just|then|also|never|only)\s)?(?:said|says|told|noted|hinted|claimed|argued|wrote|replied|answered|warned|mentioned|suggested|insisted|promised|agreed|admitted|denied|confirmed|graded|explained|emailed|called|helped|taught|shrugged|asked|gave|hung|responded|apologi[sz]ed|laughed|smiled|ignored|refused|offered|failed)\b")
_ROLE_COLON = re.compile(r"\b(?:tutor|mentor|evaluator|instructor|professor|proctor|advisor|manager|grader|teacher|student|name|author|contact|from|by|signed|coach|cc|attn)\s?:\s*$")
_ROLE_BEFORE = re.compile(r"\b(?:tutor|mentor|evaluator|instructor|professor|proctor|advisor|grader|teacher|roommate|classmate|named|colleague)\s([a-z]{3,})(?![\w@./'’-])")

_WORD = r"[^\W\d_]+"
_CAP = r"[^\W\d_a-z][^\W\d_]*(?:['’-][^\W\d_a-z][^\W\d_]*)*"
_SIGN, _SAID = r"\s?(?:@|\(at\)|\[at\]|\{at\})\s?", r"\sat\s"
_POINT, _TOLD = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\sdot\s)", r"(?:\s?\(dot\)\s?|\s?\[dot\]\s?|\s?\{dot\}\s?|\sdot\s)"
_USER = r"(?<![\w.+@-])[^\W_][\w.%+-]*"
_HOST = lambda dot: rf"[^\W_][\w-]*(?:{dot}[\w-]+){{0,3}}?{dot}[^\W\d_]{{2,12}}(?![\w@])"
#: Signs go with any kind of dot; a spoken "at" needs a spoken "dot".
_EMAIL = re.compile(rf"{_USER}(?:{_SIGN}{_HOST(_POINT)}|{_SAID}{_HOST(_TOLD)})")
_DIGITS = re.compile(rf"(?<![\w.])(?:\+|\()?(?:\d|[A-Za-z]{{1,2}}(?=\d{{4}}|\d{{3}}-))(?:[\s().\-/]{{0,2}}(?:\d|\b(?:{_NUMBER_WORDS})\b)){{5,17}}(?:-?[A-Za-z])?(?:\s?(?:ext|x)\.?\s?\d{{1,5}})?(?![\w@])", re.I)
_LETTERED = re.compile(r"(?<![\w.])[A-Z]{2}(?:\s?\d\d){3}\s?[A-D](?!\w)", re.I)
_PLACE_A = re.compile(rf"(?<![\w.])(?:(?:unit|apt|flat|suite)\s\w{{1,5}},\s)?\d{{1,5}}[a-z]?\s(?:[nsew]\.?\s)?(?:{_WORD}\s){{1,3}}?{STREET}\b\.?(?:,?\s(?:apt|apartment|unit|suite|flat|\#)\.?\s?\w{{1,5}})?(?:(?:,\s?|\sin\s|\n){_WORD})?(?:\s\d{{4,5}})?", re.I)
_PLACE_B = re.compile(rf"(?<![\w])[^\W\d_]{{3,}}(?:stra(?:ss|ß)e|str\.|gasse|weg|platz|allee)\s\d{{1,4}}[a-z]?\b(?:(?:,\s?|\sin\s|\n){_WORD})?(?:\s\d{{4,5}})?", re.I)
#: Street first, its kind before its name; boxes of a post office.
_PLACE_C = re.compile(rf"(?<![\w])(?:(?:\d{{1,4}}[a-z]?,?\s)?(?:rue|calle|avenida|avda|(?-i:Via|VIA)|viale|plaza|piazza|camino|paseo|carrer|rua|allée|quai|impasse)\.?\s(?:(?:de|del|della|des|du|la|las|los|el|le|les|di|da|do)\s){{0,2}}{_WORD}(?:\s{_WORD})?(?:,?\s(?:n[.º°]?\s?)?\d{{1,4}}[a-z]?\b)?|p\.?\s?o\.?\s?box\s\d{{1,6}})(?:,\s?{_WORD})?(?:\s\d{{4,5}})?", re.I)
_HINT_FOREIGN = re.compile(r"\b(?:rue|calle|avenida|avda|(?-i:Via|VIA)|viale|plaza|piazza|camino|paseo|carrer|rua|allée|quai|impasse|box)\b")
_TITLED = re.compile(rf"(?<![\w;])(?:(?:[Mm]rs?|MRS?|[Mm]s|MS|[Dd]r|DR|[Pp]rof|PROF|[Pp]rofessor|Rev|Mme|Frau|Herr)\.?|Miss|Sir|Señora?)\s({_WORD})(?:\s({_WORD}))?")
_CAPS = re.compile(rf"(?<![\w@./+-]){_CAP}(?:(?:,\s|\s(?:[^\W\d_a-z]\.\s)?){_CAP}){{0,2}}(?![\w@])")
_CAPITAL, _NEXT = re.compile(_CAP), re.compile(rf"\s({_CAP})(?![\w@])")
_LOWER = re.compile(rf"(?<![\w@./+-])(?:{'|'.join(sorted(GIVEN - _ALSO_WORDS))})(?:\s[a-z]\.)?(?:\s([a-z]{{4,}}))?(?![\w@]|\.\w|\s?@)")
#: Cheap signs without which the slower patterns cannot match.
_HINT_NUMBER = re.compile(rf"\d(?:[\s().\-/]{{0,2}}(?:\d|\b(?:{_NUMBER_WORDS})\b)){{4}}", re.I)
_HINT_PLACE = re.compile(r"(?:stra(?:ss|ß)e|str\.|gasse|weg|platz|allee)\s\d")
_ROADS = frozenset(STREET[3:-1].split("|"))
_BEFORE = re.compile(rf"(?<![\w@./+-])({_WORD}),\s({_WORD})(?![\w@])")
_words = re.compile(_WORD).findall
_SAYS = frozenset(re.findall(r"[a-z]+", CUES["says"]))
_LINK = re.compile(r"(?:https?://|www\.)\S+|(?<!\w)/?[ur]/\w+", re.I)


@lru_cache(1)
def _one_to_one() -> dict[int, str]:
    """Look-alikes as plain letters, ligatures as several; invisible ones become nothing."""
    return {ord(k): v for k, v in mapping().items() if not any(map(combining, v))}


@lru_cache(1)
def _stand_ins() -> frozenset[str]:
    return frozenset(map(chr, _one_to_one()))


def as_seen(text: str) -> tuple[str, list[int] | None]:
    """The text as seen, and for each of its characters the place in the stored text (None: the same)."""
    if text.isascii():
        return text, None
    table = _one_to_one()
    if _stand_ins().isdisjoint(text):
        return text, None
    out, at = [], []
    for i, ch in enumerate(text):
        for c in table.get(ord(ch), ch):
            out.append(c)
            at.append(i)
    return "".join(out), at


class Span:
    __slots__ = ("kind", "start", "stop", "features", "score")

    def __init__(self, kind: str, start: int, stop: int, features: list[int]) -> None:
        self.kind, self.start, self.stop, self.features, self.score = kind, start, stop, features, 0.0


def _number_features(text: str, low: str, a: int, b: int) -> list[int]:
    s, left, right = low[a:b], low[max(0, a - 34) : a], low[b : b + 18]
    left = re.split(r"[.!?]\s|\n", left)[-1] if re.search(r"[.!?]\s\S|\n\S", left) else left
    near = left[-20:]
    clause = re.split(r"[,;]\s|\s-\s", left.rstrip(" ,;-"))[-1]
    core = re.sub(r"\s?(?:ext|x)\.?\s?\d+$", "", s)
    words = len(re.findall(_NUMBER_WORDS, core))
    digits = sum(c.isdigit() for c in core) + words
    shape = re.sub(r"\d", "9", core)
    plain = shape.replace("(", "").replace(")", "").replace(".", "-").replace(" ", "-").strip("-+")
    return [
        bool(re.fullmatch(r"[a-z]{2}(?: ?99){3} ?[a-z]", shape)), digits == 12, digits == 7, digits == 8, digits == 9, digits == 10, digits in (11, 12), digits > 12, digits < 7,
        plain.endswith("999-999-9999"), plain == "999-99-9999", core.isdigit(), core.startswith("+"), "(" in core,
        core.startswith("1-") or core.startswith("1 "), bool(re.search("[a-z]", re.sub(_NUMBER_WORDS, "", core))), words > 0,
        bool(re.fullmatch(r"(?:\d ){6,}\d", core)), bool(re.search(r"(?:ext|x)\.?\s?\d+$", s)), bool(re.fullmatch(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?", core)),
        bool(re.fullmatch(r"\d{1,3}(?:\.\d{1,4}){1,3}", core)), bool(re.search(r"\d{4,}", core)), bool(re.match(r"[a-z]{1,2}\d", core)), "." in core, core.count("-") > 0,
        bool(_CUE["phone"].search(left)), bool(_CUE["id"].search(left)), bool(_CUE["code"].search(clause)), bool(_CUE["id"].search(near)), bool(_CUE["code"].search(clause[-20:])), bool(_CUE["phone"].search(near)),
        bool(re.search(r"\bfor|twice|file|ring|six|after|study|me\b", right)), left.rstrip().endswith(("(", ",", "/", "->", ":")), bool(re.search(r"0x$|[#$€]\s?$", left)),
    ]


def _place_features(text: str, low: str, a: int, b: int, form: int) -> list[int]:
    s, left, right = low[a:b], low[max(0, a - 30) : a], low[b : b + 16]
    words = re.findall(_WORD, s)
    between = [w for w in words if not re.fullmatch(STREET, w)]
    caps = [w for w in re.findall(_WORD, text[a:b]) if w[:1].isupper()]
    return [
        form == 1, form == 2, "box" in words, bool(re.match(r"(?:unit|apt|flat|suite)", s)), bool(re.search(r"\b(?:apt|apartment|suite)\b", s)), len(caps) >= 2, len(caps) == 1, not caps,
        any(w in _COMMON for w in between), len(between) == 1, len(between) == 2, len(between) > 2, bool(re.search(r"^\d{3,}", s)), bool(re.search(r"^\d{1,2}\s", s)),
        bool(_CUE["place"].search(left)), bool(_CUE["code"].search(left[-14:])), "," in s, bool(re.search(r"\sin\s", s)), bool(re.search(r"\d{5}$", s)),
        bool(re.match(r"\s(?:page|case|on page|reading|chapter)", right)), bool(re.search(r"\b(?:way|court|place|row|close|walk|drive|square|circle|loop|trail)\b", s)), bool(re.search(r"\b(?:pages?|questions?|hours|minutes|days|links|points|items?|weeks|times|views|credits)\b", s)),
        len(left.strip()) == 0 or left.rstrip().endswith((".", "\n", ":", "!", "?")),
    ]


def _name_features(text: str, low: str, a: int, b: int, kind: int, plain: frozenset[str] | set[str] = frozenset()) -> list[int]:
    s, left, right = text[a:b], low[max(0, a - 26) : a], low[b : b + 26]
    words = re.findall(_WORD, s)
    lows = [w.lower() for w in words]
    bare = [w for w in lows if not w in _TITLES]
    before = re.findall(r"[\w'’-]+", left)
    given = [w in GIVEN for w in bare]
    start = not left.strip() or left.rstrip()[-1] in ".!?…\n:;" or "\n" in left[-2:] or left.endswith("  ")
    upper = s.isupper() and len(s) > 3
    around = text[max(0, a - 25) : a] + text[b : b + 25]
    fresh = len(bare) == 1 and not given[0]
    line = (a == 0 or "\n" in left[len(left.rstrip(" \t-–—~")) - 1 :] or not left.strip(" \t-–—~")) and bool(re.match(r"[ \t.!]*(?:\n|$)", right))
    return [
        bool(given) and given[0], any(given[1:]), len(bare) == 1, len(bare) == 2, len(bare) >= 3, "," in s, bool(re.search(r"\s[^\W\d_]\.\s", s)), kind == 1, kind == 2,
        upper, upper and sum(c.islower() for c in around) < 4, s.islower(), start, any(w in _PLACE_WORDS for w in bare), any(w in _CALENDAR for w in bare), any(w in _COMMON for w in bare),
        bool(before) and before[-1] == "the", bool(before) and before[-1] in ("a", "an", "in", "on", "of", "at"), bool(before) and bool(_CUE["person"].search(before[-1])), bool(before) and before[-1] in ("by", "from", "signed", "cc", "ask", "student", "tutor", "mentor", "mrs", "mr", "ms", "dr", "then", "told", "until", "named", "contact", "dear", "hi"),
        bool(_CUE["says"].search(right.lstrip(",")) if not right.startswith((".", "!", "?")) else False), bool(re.match(r"\s*[<(/]", right)), bool(re.match(r"\s*(?:[.!?\n]|$)", right)), bool(re.match(r",", right)), bool(re.match(r"\s+\d", right)), bool(re.search(r"\d\s*$", left)), bool(re.search(r"\d,\s*$", left)),
        max((len(w) for w in bare), default=0) >= 6, all(len(w) <= 3 for w in bare), any(re.fullmatch(STREET, w) for w in bare), bool(bare) and bare[-1].endswith("ly"),
        fresh and start, fresh and line, fresh and left.rstrip().endswith(":"), bool(_ROLE_COLON.search(left)), bool(_ACTS.search(right)), any(w in _ORDINARY for w in bare), any(w in plain for w in bare), bool(bare) and bool(_ENDING.search(bare[-1])),
        fresh and upper and len(s) <= 5, kind == 4, sum(c.isupper() for c in around) > 12,
    ]


def candidates(text: str) -> list[Span]:
    """Overlapping spans of all types in a text as seen, with features."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[Span] = []
    if "@" in low or "[at]" in low or "(at)" in low or "{at}" in low or "dot" in low:
        for m in _EMAIL.finditer(low):
            s = m[0]
            plain = bool(re.fullmatch(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+", s))
            out.append(Span("email", m.start(), m.end(), [plain, "(" in s or "[" in s or "{" in s, " at " in s, " dot " in s, "@" in s, s.count(" ") > 4, bool(re.search(r"(?:look|meet|was|is|are|am|be|it|me|one|work|stuck|sat|i|starts?|ends?|there|here) at ", s)), bool(re.search(r"\d", s)), "." in s]))
    words_in = set(_words(low))
    if _HINT_NUMBER.search(low):
        for m in _DIGITS.finditer(text):
            a, b = m.span()
            while text[b - 1] in " .-/(":
                b -= 1
            f = _number_features(text, low, a, b)
            out += [Span("phone", a, b, f), Span("id_number", a, b, f)]
    for m in _LETTERED.finditer(text) if any(map(str.isdigit, low)) else ():
        out.append(Span("id_number", *m.span(), _number_features(text, low, *m.span())))
    for form, pattern, likely in ((0, _PLACE_A, not _ROADS.isdisjoint(words_in)), (1, _PLACE_B, _HINT_PLACE.search(low)), (2, _PLACE_C, _HINT_FOREIGN.search(low))):
        for m in pattern.finditer(text) if likely else ():
            if form < 2 or any(map(str.isdigit, m[0])):
                out.append(Span("address", *m.span(), _place_features(text, low, *m.span(), form)))
    seen, plain = set(), set(_words(text))  # with their case: whether a word stands in lower case too

    def add(a: int, b: int, kind: int) -> None:
        if (a, b) not in seen:
            seen.add((a, b))
            out.append(Span("name", a, b, _name_features(text, low, a, b, kind, plain)))

    given = not GIVEN.isdisjoint(words_in)
    for m in _TITLED.finditer(text) if not _TITLES.isdisjoint(words_in) else ():
        one, two = m[1], m[2]
        follows = two and two.lower() not in _COMMON and (two[0].isupper() or (one.lower() in GIVEN and two not in _SAYS))
        add(m.start(), m.end(2) if follows else m.end(1), 1)
    for m in _CAPS.finditer(text):
        a, b = m.span()
        words = _words(m[0])
        if not all(w[0].isupper() for w in words):
            continue
        amid = m[0].isupper() and sum(c.isupper() for c in text[max(0, a - 20) : a] + text[b : b + 20]) > 8
        if amid:
            # amid a text in capitals they do not part names from other words: each word, alone and with the next
            for w in _CAPITAL.finditer(text, a, b):
                if len(w[0]) > 1 and w[0].lower() not in _COMMON | _CALENDAR:
                    add(*w.span(), 0)
                    follows = _NEXT.match(text, w.end())
                    if follows and len(follows[1]) > 1 and w[0].lower() not in _ORDINARY and follows[1].lower() not in _COMMON | _CALENDAR | _SAYS:
                        add(w.start(), follows.end(), 0)
        if len(words) == 1 and (len(words[0]) < 2 or words[0].lower() not in GIVEN and words[0].lower() in _COMMON):
            continue
        # leading and trailing words that are no names
        while words and (words[0].lower() in _COMMON | _CALENDAR or amid and len(words) > 1 and words[0].lower() in _ORDINARY):
            a = text.index(words[0], a) + len(words.pop(0))
            while a < b and not text[a].isalpha():
                a += 1
        while words and words[-1].lower() in _COMMON | _CALENDAR:
            b = text.rindex(words.pop(), a, b)
            while b > a and not (text[b - 1].isalpha() or text[b - 1] == "."):
                b -= 1
        if words and len(words[0]) > 1:
            add(a, b, 0)
    if given:
        for m in _LOWER.finditer(text):
            add(m.start(), m.end() if not m[1] or not (m[1] in _SAYS or m[1] in _COMMON) else m.start(1) - 1, 2)
        for m in _BEFORE.finditer(text):
            if m[2].lower() in GIVEN and m[1].lower() not in _COMMON and (m[1][:1].isupper() or m[2].islower()):
                add(*m.span(), 3)
    for m in _ROLE_BEFORE.finditer(text):
        if m[1] not in _COMMON and m[1] not in _SAYS:
            add(*m.span(1), 4)
    links = [m.span() for m in _LINK.finditer(text)] if "/" in text or "www" in low else []
    return [c for c in out if c.kind == "email" or not any(x <= c.start < y for x, y in links)]  # an address is one in a link too


# ------------------------------------------------------------------ sentences made for training
def _sentences(rng: random.Random, n: int) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(sentence, [(type, value)]) from generic phrases; values are random."""
    pick, digits = rng.choice, lambda k: str(rng.randrange(10**k)).zfill(k)
    names = sorted(GIVEN)

    def made(least: int = 2) -> str:
        return "".join(pick(["ba", "cor", "del", "fen", "gar", "hol", "kin", "lor", "mar", "nor", "pel", "quin", "ros", "sto", "tren", "ul", "ver", "wen", "yar", "zel"]) for _ in range(rng.randint(least, 2))) + pick(["son", "man", "ez", "ova", "berg", "ley", "ton", "ski", "ini", "well", "field", "ard", "ish", "ucci", "more"])

    def alone() -> str:
        return made(pick([1, 1, 2])).capitalize() if rng.random() < 0.8 else pick(names).capitalize()

    def ordinary() -> str:
        stem = pick(["Stud", "Grad", "Pass", "Fail", "Test", "Learn", "Review", "Report", "Quest", "Month", "Cheat", "Order", "Format", "Count", "Market", "Print", "Record", "Train"])
        return pick([pick(sorted(_ORDINARY)).capitalize()] * 2 + [stem + pick(["", "ing", "ers", "ed", "s", "ment", "ion", "able", "ings"])])

    def cased(s: str) -> str:
        return pick([s] * 7 + [s.lower(), s.upper()])

    def person() -> str:
        first = pick(names) if rng.random() < 0.9 else made()
        first, last = first.capitalize(), made().capitalize()
        return cased(pick([f"{first} {last}"] * 5 + [first] * 3 + [f"{first} {pick('ABCDEFGHJKLMNPRSTW')}. {last}", f"{last}, {first}", f"{last}, {first}"])) if rng.random() < 0.88 else f"{pick(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Prof.', 'Dr', 'Mr'])} {last}"

    def email() -> str:
        user = pick([made(), f"{pick(names)}.{made()}", f"{pick(names)}_{made()}{digits(2)}", f"{pick(names)}+{made()}"])
        if rng.random() < 0.06:
            user = user.replace("o", pick("öóø")).replace("a", pick("äáå"))
        host, end = made() + pick(["", "-mail", "box"]), pick(["com", "org", "net", "example", "edu", "io"])
        return pick([user.lower(), user.upper()] if rng.random() < 0.2 else [user]) + pick(["@", "@", "@", " @ ", " (at) ", "[at]", " at "]) + host + pick([".", ".", " (dot) ", " dot "]) + end

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        base = pick([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"+44 {digits(4)} {digits(6)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", " ".join(a + b + c), f"{a} {' '.join(pick(_NUMBER_WORDS.split('|')[2:]) for _ in b)} {c}"])
        return base + (f" ext. {digits(2)}" if rng.random() < 0.1 else "")

    def number() -> tuple[str, str]:
        return pick(
            [("SSN", f"{digits(3)}-{digits(2)}-{digits(4)}"), ("social security number", f"{digits(3)} {digits(2)} {digits(4)}"), ("social is", digits(9)), ("student ID", digits(9)), ("student ID", digits(8)), ("student number", f"{pick('SXAB')}{digits(6)}-{pick('ABX')}"), ("passport no.", f"{pick('XCLA')}{digits(7)}"), ("passport", digits(9)), ("driver license", f"{pick('DSBW')}{digits(3)}-{digits(4)}-{digits(4)}"), ("driver's licence", f"{pick('DSBW')}{digits(7)}"), ("national ID", digits(10)), ("national ID", f"{digits(4)} {digits(4)} {digits(4)}"), ("national id card", digits(12)), ("NI number", f"{pick('QATJ')}{pick('QBCM')} {digits(2)} {digits(2)} {digits(2)} {pick('ABCD')}")]
        )

    def place() -> str:
        road, end = made().capitalize(), pick(["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Court", "Way", "Terrace", "Blvd", "Place"])
        town = made().capitalize()
        if rng.random() < 0.15:
            return f"{road}{pick(['strasse', 'weg', 'platz'])} {digits(2)}" + pick(["", f", {town}"])
        if rng.random() < 0.12:
            kind = pick(["Rue", "Calle", "Via", "Plaza", "Avenida", "Rua", "Carrer"])
            return pick([f"{rng.randint(1, 90)} {kind} {pick(['', 'de ', 'du ', 'de la '])}{road}", f"{kind} {pick(['', 'de ', 'del ', 'de la '])}{road} {rng.randint(1, 300)}", f"PO Box {rng.randint(1, 9999)}", f"P.O. Box {rng.randint(1, 9999)}"]) + pick(["", f", {town}"])
        line = f"{rng.randint(1, 5000)} {pick(['', '', 'N ', 'W '])}{road} {end}" + pick(["", "", f", Apt {digits(2)}B", f", {town}", f", {town}", f"\n{town} {digits(5)}", f" in {town}"])
        line = pick(["", "", "", f"Unit {digits(2)}, "]) + line
        return pick([line] * 5 + [line.lower(), line.upper()])

    fill = ["I asked for a better schedule on Friday.", "The module on North Wing labs repeats itself.", "Nobody explained the grading.", "My exam was moved to Sunday.", "the portal logs me out every evening.", "We waited for 31 days.", "Page 14 of the guide skips the topic.", "All I want is a clear answer."]
    plain = [
        lambda: f"Order {digits(9)} arrived late.", lambda: f"Ticket {digits(3)}-{digits(2)}-{digits(4)} is open.", lambda: f"Queue position {digits(3)} {digits(2)} {digits(4)} for hours.", lambda: f"I need version {digits(2)}.{digits(1)}.{digits(4)} of it.",
        lambda: f"Error 0x{digits(6)} at line {digits(3)}.", lambda: f"It listens at {digits(2)}.{digits(1)}.{digits(1)}.{digits(2)} port {digits(4)}.", lambda: f"Since 20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} it is down.", lambda: f"It costs {digits(3)}.{digits(2)} in all.", lambda: f"The key has {digits(4)} entries.",
        lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)} is wrong.", lambda: f"Tracking number {digits(12)} shows nothing.", lambda: f"Invoice {digits(8)} was paid.", lambda: f"Build {digits(7)} crashes.", lambda: f"I got {digits(3)} out of {digits(4)} on {digits(2)} items.",
        lambda: f"The {made().capitalize()} {pick(['Lane', 'Hall', 'Court', 'Street'])} case on page {digits(3)} is long.", lambda: f"We met in {made().capitalize()} {pick(['Hall', 'Wing', 'Library', 'Center'])} on Monday.", lambda: f"Chapter {digits(1)}, {pick(['Street', 'Court', 'Road'])} {pick(['Level', 'Art', 'Rules'])} {pick(['Networks', 'History'])}, is dull.", lambda: f"The {pick(['Supreme Court', 'Court of Appeals', 'Bill of Rights', 'Act'])} reading has {digits(3)} pages.",
        lambda: f"On {pick(['Friday', 'Sunday', 'Tuesday'])} I studied {digits(2)} pages on the way to class.", lambda: f"{pick(['Principles', 'Foundations', 'Practice'])} of {pick(['Data', 'Risk', 'Team'])} {pick(['Systems', 'Budgets', 'Registers'])} is hard.", lambda: f"The {pick(['Windows', 'Python', 'Excel', 'Canvas', 'English', 'German'])} guide is short.", lambda: f"I drove {digits(2)} miles down the road to the test center.", lambda: pick([f"It goes via {made().capitalize()} {rng.randint(1, 90)} times a day.", f"The box {rng.randint(1, 900)} holds the {pick(['plaza', 'via', 'rue'])} map.", f"I came via {ordinary()} {rng.randint(1, 40)}."]), lambda: f"It took {digits(2)} hours to find a way around the drive.",
        lambda: f"EVERYONE KNOWS {pick(['THE RUBRIC', 'THIS COURSE', 'THE EXAM'])} IS BROKEN.", lambda: "The symbol in name@ breaks the parser.", lambda: "look at the dot at the end of the line.", lambda: f"See https://{made()}.example/t/{made()} for it.", lambda: f"Question {digits(2)} on the lab treats {pick(['recursion', 'labor law'])} badly.", lambda: f"Has {pick(['anyone', 'someone'])} passed {pick('QVNK')}{digits(3)} by reading {made().capitalize()} {pick(['Press', 'Hall'])} notes?",
        lambda: f"{ordinary()} {pick(['is slow', 'was late', 'never works', 'told us to wait', 'said it was fine', 'and labs took days', 'for that took weeks', 'of the guide failed', 'the guide took days', 'about it was wrong', 'never answered', 'asked for more', 'on the portal broke', 'it again did nothing', 'should be easy'])}.", lambda: f"{ordinary()}: {ordinary()}", lambda: f"{ordinary()} today I {pick(['took', 'saw', 'failed'])} it.", lambda: f"so {pick(['leave', 'stop', 'read it'])}, {ordinary().upper()}, {pick(['all of you', 'you see', 'and think'])}.", lambda: f"the {pick(['stupid', 'long', 'worst'])} {ordinary().upper()}, it {pick(['failed', 'is late'])}.", lambda: f"{pick(['WRITE', 'SEND', 'SHOW', 'GIVE'])} ME {ordinary()} FOR {ordinary()} {ordinary()}!".upper(), lambda: f"It failed.\n{ordinary()}\nIt is late.", lambda: f"{ordinary()} {ordinary().lower()} {pick(['takes days', 'failed', 'was late'])}.",
        lambda: f"{ordinary()} {pick(['a', 'the', 'my', 'this', 'to', 'in', 'at', 'I', 'we', 'you'])} {ordinary().lower()} {pick(['takes days', 'failed', 'was late'])}.", lambda: f"my {pick(['tutor', 'mentor', 'grader', 'teacher'])} {pick(['also', 'wants', 'keeps', 'left', 'posts', 'group', 'support', 'thinks', 'ignored', 'feedback', 'changed', 'training'])} {pick(['again', 'it', 'more', 'late'])}.", lambda: f"{ordinary()} {ordinary().lower()} {pick(['takes days', 'failed', 'was late'])}.".upper(), lambda: f"I SAID {ordinary()} {pick(['takes days', 'failed', 'told me', 'was late'])} AND {ordinary()} TOO.".upper(), lambda: f"The {pick(['PDF', 'GPA', 'FAFSA', 'HTML', 'SQL', 'NCLEX', 'RN', 'IT'])} {pick(['file', 'part', 'exam'])} is {pick(['long', 'late'])}.",
        lambda: f"The seed {digits(7)} gives the same result.", lambda: f"Reference {digits(4)}-{digits(4)} was never answered.", lambda: f"The lot of {digits(3)} students took the {pick(['long', 'short'])} way.", lambda: f"{pick(['Eventually', 'Reportedly', 'Honestly', 'Sadly'])} {pick(['Support', 'Nobody', 'Friday'])} came and went.", lambda: f"Send it from {made().capitalize()} on Thursdays.",
    ]
    for _ in range(n):
        p, e, t, a, (label, no) = person(), email(), phone(), place(), number()
        verb = pick(["said", "noted", "hinted", "claimed", "wrote back", "promised", "warned", "argued", "told us", "posted", "concluded"])
        role = pick(["tutor", "mentor", "evaluator", "instructor", "grader", "proctor", "advisor", "manager"])
        only = alone()
        known = [
                (f"{only} {pick(['never answered', 'told us to wait', 'said no', 'replied late', 'graded it', 'promised a retake', 'asked for more', 'hung up', 'emailed me back'])}.", [("name", only)]), (f"{pick(['It failed.', 'We waited.', 'Nobody helped.'])} {only} {pick(['told us to wait', 'said no', 'never replied', 'wrote back'])}.", [("name", only)]), (f"{pick(['Tutor', 'Mentor', 'Grader', 'Name', 'Instructor', 'Signed'])}: {only}", [("name", only)]), (f"{pick(['thank you for your help.', 'Any advice is welcome.', 'Thanks,', 'Best,'])}\n{only}", [("name", only)]), (f"MY {pick(['TUTOR', 'MENTOR', 'GRADER'])} {only.upper()} {pick(['NEVER ANSWERED', 'TOLD US TO WAIT', 'SAID NO'])}.", [("name", only.upper())]), (f"my {pick(['tutor', 'mentor', 'grader', 'teacher'])} {only.lower()} {pick(['never answered', 'told us to wait', 'said no', 'was late'])}.", [("name", only.lower())]),
                (f"{p} {verb} that it was fine.", [("name", p)]), (f"{pick(['Usually', 'Then', 'Yesterday', 'If', 'Since Monday', 'Ironically', 'until', 'After work'])} {p} {verb} {pick(['to try again', 'one thing', 'a reason', 'us an index'])}.", [("name", p)]), (f"My {role} {p} never answered.", [("name", p)]), (f"I was told by {p} that it changed.", [("name", p)]),
                (f"{pick(['Signed', 'Regards', 'Cheers', 'Thanks', 'Best'])}, {p}", [("name", p)]), (f"{pick(['Shout-out to', 'Thanks to', 'I asked', 'We waited for', 'A note from', 'Ask', 'Has anyone had'])} {p} {pick(['for a retake', 'about it', 'for calling back', 'as a mentor', 'and got links', 'lately'])}.", [("name", p)]), (f"{p} and {person()} are out.", [("name", p)]), (f"Initials were for {p}", [("name", p)]), (f"{p} graded my paper.", [("name", p)]), (f"{p} taught us {pick(['last term', 'twice', 'well'])}.", [("name", p)]), (f"Ask {pick(['our', 'the'])} {role} {p} for it.", [("name", p)]),  (f"{p} / {e} / {t}", [("name", p), ("email", e), ("phone", t)]), (f"Cc {p} <{e}>", [("name", p), ("email", e)]), (f"Ask {p} ({e}) about it.", [("name", p), ("email", e)]), (f"{p}, {t}", [("name", p), ("phone", t)]), (f"Student: {p}, {label} {no}, mailing to {a}.", [("name", p), ("id_number", no), ("address", a)]), (f"Ship it to {p}, {a}", [("name", p), ("address", a)]),
                (f"{pick(['Write to', 'Contact:', 'You can reach me at', 'My mail is', 'Send it to', 'It came from', 'Contact ->', 'The page shows', 'Old login was'])} {e}{pick(['.', ' please', ', thanks', ' with my grade', ''])}", [("email", e)]),
                (f"{pick(['Call me at', 'My cell is', 'Text me,', 'WhatsApp', 'Voicemail says', 'I left', 'Reach me on', 'Anyone nearby?', 'They wanted a number so I gave', 'Phone:'])} {t}{pick(['', ' if you like.', ', after six.', ' is not on file.', ' twice.', ' in the message.'])}", [("phone", t)]), (f"{a} ({t}), ring twice", [("phone", t), ("address", a)]),
                (f"{pick(['Support asked me to post', 'For the record,', 'The form printed my', 'Mix-up:', 'They want my', 'I held up a card with', 'my'])} {label} {no}{pick(['', ' for verification.', ', in case staff read this.', ' on camera.', ' is mine.', ' on the page.'])}", [("id_number", no)]),
                (f"{pick(['I live at', 'They mailed it to', 'Moved from', 'We meet at', 'The label reads', 'My address is', 'Deliver to', ''])} {a}{pick(['', '.', ' and it is far.', ' last month.', ' instead.', ' on Thursdays.'])}", [("address", a)]),
            ]
        at = rng.randrange(len(known) + len(plain))
        text, found = known[at] if at < len(known) else (plain[at - len(known)](), [])
        before, after = pick(fill + ["", ""]), pick(fill + ["", ""])
        parts = [x for x in (before, text, after, pick(["", "", "Naturally, it failed.", "Basically, that is it.", "Shit, I forgot the file.", "Question 4 was fine."])) if x]
        yield "".join(x.rstrip(pick([".", ""])) + pick([" ", " ", "  ", "\n", ", ", " - ", "; "]) for x in parts).rstrip(" \n,;-"), found


def _labelled(rng: random.Random, n: int) -> dict[str, tuple[list, list]]:
    data: dict[str, tuple[list, list]] = {t: ([], []) for t in TYPES}
    for text, found in _sentences(rng, n):
        true = [(t, text.find(v), text.find(v) + len(v)) for t, v in found]
        for c in candidates(text):
            over = [(min(c.stop, y) - max(c.start, x)) / max(y - x, 1) for t, x, y in true if t == c.kind]
            other = any(t == c.kind for t, _, _ in true)
            y = any(o >= 0.5 for o in over)
            if c.kind == "name" and " and " in text and text.endswith("are out.") or (other and not y and any(o > 0 for o in over)):
                continue
            data[c.kind][0].append(c.features)
            data[c.kind][1].append(y)
    return data


def train(sentences: int = TRAIN_SENTENCES, seed: int = 11) -> dict[str, BoostedTrees]:
    """One calibrated model for each type."""
    fit, held = _labelled(random.Random(seed), sentences), _labelled(random.Random(seed + 1), sentences // 5)
    as_array = lambda x: np.array(x[0], np.uint8)
    return {t: BoostedTrees().fit(as_array(fit[t]), np.array(fit[t][1])).calibrate(as_array(held[t]), np.array(held[t][1])) for t in TYPES}


@lru_cache(1)
def models() -> dict[str, BoostedTrees]:
    return train()


#: Where selected spans overlap, the earlier type in this order wins, then the longer span.
_FIRST = ("email", "address", "id_number", "phone", "name")


def select(spans: list[Span], trained: dict[str, BoostedTrees]) -> list[Span]:
    """Spans whose score reaches their type's threshold, without overlaps, in order."""
    taken: list[Span] = []
    passed = [s for s in spans if s.score >= trained[s.kind].threshold]
    for s in sorted(passed, key=lambda s: (_FIRST.index(s.kind) if s.kind not in ("phone", "id_number") else 2, -s.score if s.kind in ("phone", "id_number") else 0, s.start - s.stop)):
        if all(s.stop <= t.start or s.start >= t.stop for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: s.start)


def find_all(texts: list[str | None], trained: dict[str, BoostedTrees]) -> list[list[Span]]:
    """Selected spans of each text, in places of the stored text; one scoring for all texts."""
    every, spans = [], []
    for t in texts:
        if not t:
            every.append([])
            continue
        seen, at = as_seen(t)
        found = candidates(seen)
        if at is not None:
            for s in found:
                s.start, s.stop = at[s.start], at[s.stop - 1] + 1
        every.append(found)
        spans += found
    for kind in TYPES:
        own = [s for s in spans if s.kind == kind]
        if own:
            for s, p in zip(own, trained[kind].probability(np.array([s.features for s in own], np.uint8))):
                s.score = p
    return [select(found, trained) for found in every]


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its placeholder; all else is kept as stored."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.stop
    return "".join(out) + text[at:]


def redacted(df: DataFrame, column: str) -> Column:
    """struct<text, types> of a column: the redacted text and the sorted types found in it.

    Null text gives null and no types, empty text stays empty. Whole texts are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(models())

    @F.pandas_udf("text string, types array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            found = find_all(list(s), shared.value)
            yield pd.DataFrame({"text": [redact(t, f) for t, f in zip(s, found)], "types": [sorted({x.kind for x in f}) for f in found]})

    return run(F.col(column))


def types_found(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pii_type): distinct types in any row of a key."""
    source = df.select(F.col(key).alias("__key"), F.col(column).alias("__text")).where("__key IS NOT NULL AND __text IS NOT NULL")
    return source.select(F.col("__key").alias(key), F.explode(redacted(source, "__text")["types"]).alias("pii_type")).distinct()

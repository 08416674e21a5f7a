"""Problem 2: abusive, hateful or sexually explicit content.

A noisy channel undoes disguises: digits and signs for letters, spaced-out words,
repeated and masked letters make a lattice of characters whose most likely reading under
a character language model is found by Viterbi search.  The model is counted over the words
of all texts plus the lexicon.  Restored text is then scored sentence by sentence for
insults, threats, demeaning of groups and sexual explicitness in the writer's own voice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import log
from re._parser import parse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import abuse_model
from quernstone.llm.lookalikes import fold_text

# The lexicon, in natural order.
#: Nouns that insult whoever they are said of.
INSULTS = """arsehole asshat asshole bastard bellend bitch bootlicker bozo bullshitter cocksucker coward creep cretin crybaby cunt deadbeat
degenerate dickhead dimwit dipshit dirtbag dolt douche douchebag dullard dumbass dumbfuck dunce dunderhead fathead fool freak fuckface
fucker fuckwit halfwit hag idiot ignoramus imbecile jackass jerk knucklehead liar loser lowlife lunatic meathead moron motherfucker
muppet nitwit numbskull nutjob oaf pervert piece-of-shit prick psycho pussy retard scum scumbag shitbag shithead shitstain simpleton skank
sleazebag slimeball slob slut sociopath swine thug tosser turd twat twit wanker weirdo whore wimp wretch""".split()
#: Nouns that insult only when said of a person.
BEASTS = """animal ape baboon clown cockroach cow dinosaur dog donkey garbage goat leech louse maggot monkey parasite pest pig puppet rat
reptile rodent sheep snake toad trash troll vermin vulture waste weasel worm""".split()
#: Adjectives that go with an insult.
SLURRING = """braindead brainless clueless contemptible dense despicable dirty disgusting dumb fat filthy fucking goddamn goddamned greasy
gutless hideous hopeless idiotic ignorant incompetent lazy little lying miserable moronic nasty pathetic petty repulsive retarded rotten
shameless sick slimy smelly spineless stinking stupid ugly useless vicious vile wicked worthless""".split()
#: Groups of people.
GROUPS = r"""(?:women|girls|females|men|immigrants?|migrants?|refugees?|foreigners?|gays?|lesbians?|trans|transgender|queers?|muslims?|jews?|jewish|
christians?|catholics?|hindus?|sikhs?|blacks?|whites?|asians?|africans?|arabs?|mexicans?|latin[oa]s?|hispanics?|indians?|chinese|gypsies|disabled|
autistic|handicapped|elderly|religious|homeless|single\ mothers?|single\ moms?|(?:old|poor|fat|black|brown|white|deaf|blind|young|rich)\ (?:people|folks?|men|women|students)|
people\ (?:with|from|of|on|who|in)\ (?:\w+\ ){0,3}\w+)(?:\ (?:people|folks?|students|men|women|kids))?"""
_LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}

_LEXICON = frozenset(INSULTS) | frozenset(BEASTS) | frozenset(SLURRING) | frozenset(abuse_model.WORDS["slur"].split())
_FORMS = {w: w for w in _LEXICON} | {w + s: w + s for w in (*INSULTS, *BEASTS) for s in ("s", "es")}
#: Words by their letters without repeats: repetition leaves no trace of true double letters.
_squeeze = lambda w: re.sub(r"(.)\1+", r"\1", w)
_SQUEEZED = {_squeeze(w): w for w in sorted(_FORMS, key=len, reverse=True)}
#: Neighbouring letters swapped in a longer word.
_SWAPPED = {w[:i] + w[i + 1] + w[i] + w[i + 2 :]: w for w in _FORMS if len(w) > 4 for i in range(len(w) - 1) if w[i] != w[i + 1]}
#: Words that may stand beside another one by chance, so a cut between two of them is none.
_ALONE = frozenset("a an as at be but co cow de dim dip dirt dog do ass bag head ball face wit fat go he half hag hit i id in is it jerk knuckle life loose lose low me meat no nut of on or out pig piece psych re rat scum she shit so son stain tan the to we who wit worth wreck".split())
#: An insult of five letters and more cut in two, where a part is no word of its own.
_CUT_ONCE = frozenset((w[:i], w[i:]) for n in INSULTS for w in (n, n + "s") if len(n) > 4 and n.isalpha() for i in range(2, len(w) - 1) if not (w[:i] in _ALONE and w[i:] in _ALONE) and w[i:] not in ("er", "s", "es"))
_HEADS = frozenset(a for a, _ in _CUT_ONCE)
ABC = "abcdefghijklmnopqrstuvwxyz"


class CharModel:
    """Trigrams of letters with word ends: counts in, costs (negative logarithms) out."""

    def __init__(self, counts: dict[str, int], lexicon_weight: float = 0.02) -> None:
        counts = Counter(counts)
        extra = max(1.0, lexicon_weight * sum(counts.values()) / max(len(_FORMS), 1))
        for w in _FORMS:
            for g in trigrams(w):
                counts[g] += extra / len(w)
        pair, two, one = Counter(), Counter(), Counter()
        for g, n in counts.items():
            pair[g[:2]] += n
            two[g[1:]] += n
            one[g[2]] += n
        total = sum(one.values()) or 1
        after = Counter()
        for g, n in two.items():
            after[g[0]] += n
        self.known = {}
        for c in ABC + " ":
            p1 = (one[c] + 1) / (total + 27)
            for b in ABC + " ":
                p2 = (two[b + c] + 2 * p1) / (after[b] + 2)
                for a in ABC + " ":
                    self.known[a + b + c] = -log((counts[a + b + c] + 2 * p2) / (pair[a + b] + 2))

    def cost(self, word: str) -> float:
        return sum(self.known[g] for g in trigrams(word)) / (len(word) + 1)


def trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(word) + 1)]


def options(ch: str) -> list[tuple[str, float]]:
    """Readings of one character and what each costs the channel; an empty reading drops it."""
    if ch in ABC:
        return [(ch, 0.0)]
    out = [(c, 0.7) for c in _LEET.get(ch, "")]
    if ch in " .-_*'`~,":
        out.append(("", 0.4))
    return out or [("", 3.0)]


def decode(noisy: str, model: CharModel) -> tuple[str, float]:
    """The most likely reading of a disguised word, and its cost for each letter; in time linear in its length."""
    # context -> cost, letters as a chain of (the chain before, letter), their number
    best: dict[str, tuple] = {"  ": (0.0, None, 0)}
    for ch in noisy:
        then: dict[str, tuple] = {}
        for context, (cost, chain, n) in best.items():
            for read, price in options(ch):
                if read:
                    key, now = context[1] + read, cost + price + model.known[context + read]
                    if key not in then or then[key][0] > now:
                        then[key] = (now, (chain, read), n + 1)
                    if context[1] == read and (context not in then or then[context][0] > cost + 0.2):
                        then[context] = (cost + 0.2, chain, n)  # the repeated sign stands for one letter
                elif context not in then or then[context][0] > cost + price:
                    then[context] = (cost + price, chain, n)
        best = then  # one path for each context, of at most 27 * 27
    context, (cost, chain, n) = min(best.items(), key=lambda x: x[1][0] + model.known[x[0] + " "])
    letters = []
    while chain:
        chain, letter = chain
        letters.append(letter)
    return "".join(reversed(letters)), (cost + model.known[context + " "]) / (n + 1)


_spaced = re.compile(r"(?<![^\W_])(?:[a-z0-9$@!]{1,2}(?:\s{1,3}|[.\-_*])){2,}[a-z0-9$@!]{1,2}(?![^\W_]|[@$*!][^\W_])")
_letter, _sign = re.compile("[a-z]").search, re.compile("[0-9$@!|+*€£]").search
_tripled, _doubled = re.compile(r"([a-z])\1\1").search, re.compile(r"([a-z])\1").search
#: Letters with separators inside, and the endings that make an apostrophe none.
_parted, _contracted = re.compile(r"[a-z]+(?:[.\-_'`~,]+[a-z]+)+").fullmatch, re.compile(r"'(?:s|re|ll|ve|d|m|t)$").search
#: Where a token of several words is cut: first at signs that part words only, then at all.
_CUTS = (re.compile(r"([^a-z0-9$@!*|+€£.\-_'`~,]+)"), re.compile(r"([^a-z0-9$@!*|+€£]+)"))
#: Innocent words that have the letters of a word of the rules.
_PLAIN = frozenset("looser ville hoot hoots go.at be.at".split())
_long_run = re.compile(r"(.)\1{3,}")
_edge = re.compile(r"^[^a-z0-9$@*]+|[^a-z0-9$*]+$")


class Restorer:
    """Undoes disguises; remembers a bounded number of tokens."""

    def __init__(self, model: CharModel) -> None:
        self.model, self.known, self.telling = model, {}, {}

    def token(self, token: str) -> str:
        core = _edge.sub("", token)
        word = self.word(core)
        return token if word == core else token.replace(core, word)

    def word(self, core: str) -> str:
        """A disguised word, or a token of several, as most likely meant; else as it is."""
        if not core:
            return core
        sure, read, cost = self.hit(core)
        if sure:
            return read
        for cut in _CUTS:
            parts = cut.split(core)
            if len(parts) > 1:
                found = [read if sure else p for p, (sure, read, _) in zip(parts, map(self.hit, parts))]
                if found != parts:
                    return "".join(found)
        if read and len(read) > 3 and (cost < 2.2 or cost < 2.6 and not core.isalnum()):
            if len(_long_run.sub(r"\1\1\1", core)) <= 40 or len(parts := _CUTS[1].split(core)) == 1:
                return read
            return "".join(map(self.word, parts))
        return core

    def hit(self, core: str) -> tuple[bool, str | None, float]:
        """(whether it stands for a word that the rules look for, its reading if it is disguised, its cost)."""
        if core in _FORMS or core in _PLAIN:
            return False, None, 0.0
        if core in _SWAPPED:
            return True, _SWAPPED[core], 0.0
        if "*" in core and _letter(core):
            pattern = re.compile("".join("[a-z]" if c == "*" else c if c in ABC else "[" + "".join(_LEET.get(c, c)) + "]" if c in _LEET else re.escape(c) for c in core))
            hits = [w for w in _FORMS if pattern.fullmatch(w)]
            if hits:  # nobody masks an innocent word
                return True, min(hits, key=lambda w: (w in SLURRING, self.model.cost(w))), 0.0
        if not _sign(core) and (core.isalpha() and _doubled(core) or _parted(core) and not _contracted(core)):
            # all readings have these letters but for repeats, so the words looked for decide without a search
            letters = re.sub("[^a-z]", "", core)
            if letters in _FORMS or letters in _WORD_SIGNS:
                word = letters
            else:
                word = _SQUEEZED.get(_squeeze(letters)) or _SOUGHT.get(_squeeze(letters))
            if word and word != core:
                return True, word, 0.0
        if not (_letter(core) and _sign(core) or _tripled(core)):
            return False, None, 0.0
        word, cost = decode(_long_run.sub(r"\1\1\1", core), self.model)
        if word in _FORMS or (word := _SQUEEZED.get(_squeeze(word), word)) in _FORMS:
            return True, word, cost
        return False, word, cost

    def spaced(self, match: re.Match) -> str:
        run = match[0]
        parts = re.split(r"[\s.\-_*]+", run)
        if sum(len(p) == 1 for p in parts) < 3 or not any(c in ABC for c in run) or sum(c.isdigit() for c in run) > sum(c in ABC for c in run):
            return run
        if whole := self.split(decode(run, self.model)[0]):
            return whole
        out = []
        # signs between letters leave white space to part words; else only wider gaps do
        for chunk in re.split(r"\s+" if re.search(r"[^\W_][.\-_*][^\W_]", run) else r"\s{2,}", run):
            word, cost = decode(chunk, self.model)
            out.append(self.split(word) or (word if cost < 2.4 else chunk))
        return " ".join(out)

    @staticmethod
    def split(letters: str) -> str | None:
        """Lexicon words in a run of letters: one, two, or one with a short word at an end."""
        known = lambda w: w if w in _FORMS or len(w) > 3 and w in _WORD_SIGNS else _SQUEEZED.get(_squeeze(w))
        if w := known(letters):
            return w
        for cut in range(1, 4):
            if w := known(letters[cut:]):
                return f"{letters[:cut]} {w}"
            if w := known(letters[:-cut]):
                return f"{w} {letters[-cut:]}"
        for cut in range(3, len(letters) - 2):
            if (a := known(letters[:cut])) and (b := known(letters[cut:])):
                return f"{a} {b}"
        return None

    @staticmethod
    def joined(tokens: list[str]) -> list[str]:
        """Tokens with the two parts of a word that was cut once put together."""
        if _HEADS.isdisjoint(tokens):
            return tokens
        out = []
        for t in tokens:
            head = out[-1] if out else ""
            end = t.rstrip(".,!?;:")
            if (head, end) in _CUT_ONCE:
                out[-1] = head + t
            else:
                out.append(t)
        return out

    def text(self, text: str | None) -> str:
        """Lower-cased text as seen, disguises undone."""
        return self.read(text)[0]

    def read(self, text: str | None) -> tuple[str, int]:
        """The restored text, and the rules, as bits, that may match it."""
        if not text:
            return "", 0
        low = fold_text(text).lower().replace("’", "'")
        if _spaced.search(low):
            low = _spaced.sub(self.spaced, low)
        tokens, known = self.joined(low.split()), self.known
        if len(known) > 1 << 18:
            known.clear()
            self.telling.clear()
        for t in set(tokens).difference(known):
            known[t] = word = self.token(t)
            if bits := rules_of(word):
                self.telling[t] = bits
        rules = _ALWAYS
        for t in self.telling.keys() & tokens:
            rules |= self.telling[t]
        return " ".join([known[t] for t in tokens]), rules


_noun = rf"(?:pieces?\sof\s(?:shit|crap|trash|filth)|{'|'.join(sorted(map(re.escape, INSULTS), key=len, reverse=True))})(?:e?s)?"
_beast = rf"(?:{'|'.join(BEASTS)})(?:e?s)?"
#: Said of things as well, so only a person as the subject makes these an insult.
_alive = rf"(?:{'|'.join(w for w in BEASTS if w not in ('garbage', 'trash', 'waste'))})(?:e?s)?"
_adj = rf"(?:(?:{'|'.join(SLURRING)}),?\s)"
_person = r"(?:you|u|ya|ur|he|she|they|who|guy|man|woman|person|people|mods?|moderators?|tutors?|proctors?|mentors?|teachers?|instructors?|professors?|evaluators?|graders?|students?|everyone|anyone|someone|kids?|staff|admins?|author|partner|mate)"
_group = re.sub(r"\n", "", GROUPS).replace(r"\ ", " ")
_c = lambda p: re.compile(p)
#: (category, weight, pattern): what counts in the writer's own voice.
RULES = [
    ("insult", 0.9, _c(rf"\b(?:you|u|ya)(?:\sare|\sr|'re|\sis)?\b(?:\s\w+){{0,2}}?\s(?:such\s)?(?:an?\s|nothing\sbut\s)?{_adj}*(?:{_noun}|{_beast})\b")),
    ("insult", 0.9, _c(rf"\b{_person}\b(?:\s\w+){{0,6}}?\s(?:is|are|was|were|has\sthe\sface\sof)\s(?:just\s|such\s|all\s|nothing\sbut\s|a\sbunch\sof\s)*(?:an?\s(?:\w+\s){{0,2}}?|the\s)?{_adj}*(?:{_noun}|{_beast})\b")),
    ("insult", 0.9, _c(rf"\b{_adj}+(?:{_noun}|{_alive})\b")),
    ("insult", 0.8, _c(rf"(?:^|[,.!?:;-]\s*){_adj}*(?:{_noun}|{_alive})\s*(?:[,.!?]|$|that\syou\sare|all\sof\syou)")),
    ("insult", 0.8, _c(rf"\b(?:what|such|being|like)\s(?:an?\s)(?:\w+\s){{0,2}}?{_noun}\b")),
    ("insult", 0.8, _c(rf"\b(?:other|these|those|you)\s{_adj}*(?:{_noun}|{_beast})\b")),
    ("insult", 0.7, _c(rf"\b{_noun}\b")),
    ("insult", 0.9, _c(r"\b(?:you|u|they|he|she)(?:\sare|\sr|'re|\sis)\s(?:so\s|all\s|too\s|just\s)*(?:stupid|dumb|pathetic|worthless|disgusting|useless|brainless|ugly|vile|subhuman)\b")),
    ("insult", 0.9, _c(r"\bwaste of (?:air|space|oxygen|skin|breath|life)\b|\byou smell\b|ashamed of you\b|\bbrain of a\b|\bnobody (?:would|will) (?:ever )?miss you\b|\bshut (?:your|ur|the fuck) ?(?:mouth|trap|face|up)\b|\bgo (?:cry about it|to hell)\b|\beat (?:dirt|shit)\b|\bdelete (?:your|ur) account\b|\bnever speak to another\b|\b(?:fuck|screw) (?:you|off)\b|\bpit(?:y|ies) you\b|\bdrop dead\b|\bdo the world a favou?r\b|\blaughs? at you\b")),
    ("threat", 0.95, _c(r"\b(?:kill|hang|shoot|hurt|drown) ?(?:yourself|urself)\b|\bkys\b|\b(?:go|hope you|should) (?:and )?die\b|\bi(?:'ll| will| am going to|'m going to| am gonna|'m gonna| want to| would love to)(?: \w+){0,5} (?:kill|murder|rape|hurt|beat|stab|shoot|strangle|choke|punch|smash|hunt|bury|break|gut|burn) (?:you|your|him|her|them|his|every)\b")),
    ("threat", 0.9, _c(r"\bbreak (?:\w+ ){0,2}(?:fingers?|bones?|legs?|arms?|necks?|knees?|jaw|teeth|skull)\b|\bgoing to hurt\b|\bwatch your back\b|\blook over (?:your|the|his|her|their) shoulder\b|\bsleep with (?:the lights on|one eye open)\b|\b(?:own|have|bring|bought) a (?:baseball bat|bat|gun|knife|rifle|shotgun|pistol|crowbar|hammer)\b|\bi (?:know|have|found) (?:where you|which \w+ (?:\w+ )?you|your (?:address|plate|license plate|home|house|number plate))\b|\b(?:you|they) will not walk out\b|\bknow where (?:you|he|she|they) lives?\b|\bwaiting (?:outside|for you)\b.{0,60}\b(?:hurt|regret|pay|sorry)\b|\bends? up in (?:a|an|the) (?:hospital|morgue|grave|ditch|ambulance|wheelchair|coma|body bag)\b|\b(?:find|burn|torch|visit|come to|wait at|show up at) (?:your|his|her|their) (?:house|home|place|door|car|office|family)\b|\benjoy (?:\w+ ){0,3}while (?:there is still time|you (?:still )?can|they (?:still )?can|it lasts)\b|\b(?:slit|cut) (?:your|his|her|their) throats?\b|\bput a bullet\b|\bmake (?:\w+ ){1,6}?(?:bleed|suffer|beg for)\b|\bmake (?:you|him|her|them) (?:pay|regret)\b|\byou (?:will|are going to|'ll) (?:bleed|suffer|regret)\b|\b(?:beg for mercy|dead (?:man|meat|woman))\b")),
    ("threat", 0.9, _c(r"\bhope (?:you|he|she|they|(?:your|his|her|their)(?: \w+){1,2})(?: all)? (?:dies?|rots?|burns?|suffers?|bleeds?|gets? (?:cancer|shot|raped|killed|run over))\b|\bdeserves? to (?:die|bleed|suffer|burn|rot|be (?:shot|raped|killed|hanged|beaten))\b|\b(?:beat|kick|smack|slap) the (?:crap|shit|hell|life) out of (?:you|him|her|them)\b|\bshoot up (?:the|this|that|your)\b")),
    ("hate", 0.9, _c(rf"\b(?:gas|kill|shoot|hang|burn|lynch|deport|exterminate)\s(?:all\s|the\s|these\s|those\s|every\s)*{_group}\b|\b{_group}\s(?:belong\sin\s(?:the\s|a\s)?(?:kitchen|cages?|zoo|camps?|ovens?|prison|jail)|go\s(?:back\s)?home)\b|\bgo\sback\sto\s(?:your|their)\s(?:own\s)?(?:country|countries|jungle|caves?)\b")),
    ("insult", 0.8, _c(r"\byou (?:all |really )?disgust me\b|\b(?:you|he|she)(?: are|'re| is|'s) a (?:joke|disgrace|poor excuse)\b|\bexcuse (?:for|of) a (?:human|person|man|woman|teacher|tutor|mentor)\b|\b(?:your|his|her) brain is\b")),
    ("hate", 0.9, _c(rf"\b{_group}\b(?:\s(?:are|is|were|who|do|should|all|and|the|lot|of|them)|,)*\s(?:just\s|all\s|nothing\sbut\s)?(?:a\s|the\s)?(?:lower|lesser|inferior|subhuman|vermin|animals?|parasites?|savages?|filth|scum|trash|garbage|disease|plague|dirty|stupid|lazy|criminals?|thieves|rapists|born\sstupid|not\s(?:human|people)|cannot\sthink|can't\sthink|stink|smell|steal|ruin|(?:carry|spread)\s(?:diseases?|germs|lice))\b|\bno\s{_group}\s(?:in|on|near|allowed)\b")),
    ("hate", 0.9, _c(rf"\b{_group}\b(?:\s\w+){{0,3}}?\s(?:should|must|need\sto|ought\sto|deserve\sto)\sbe\s(?:\w+\s)?(?:sterilized|sterilised|deported|exterminated|eliminated|shot|killed|hanged|gassed|banned|thrown|kicked|locked|kept|removed|purged|caged|whipped|gone|sent)\b")),
    ("hate", 0.9, _c(rf"\b{_group}\b(?:\s\w+){{0,4}}?\s(?:do\snot|don't|dont)\sdeserve\b|\b{_group}\b.{{0,40}}\b(?:gone\sfor\sgood|cannot\sthink\slike|wants?\s\w+\sto\sdie|they\s(?:stink|steal|smell|ruin|are\s(?:animals|vermin|all\sthe\ssame)))\b")),
    ("hate", 0.9, _c(rf"\b(?:refuse\sto\ssit\s(?:next\sto|with|near)|ruined\sby|send\s(?:them|all\sthe|the)\s(?:all\s)?back|get\srid\sof(?:\sthe|\sall)?|hate(?:\sall)?|sick\sof(?:\sall)?(?:\sthese)?|full\sof)\s{_group}\b.{{0,40}}(?:\b(?:subhuman|stink|steal|cannot|animals|vermin|them|filth|normal)\b|$)")),
    ("hate", 0.9, _c(r"\bshould be (?:sterilized|sterilised|exterminated|gassed|put down|wiped out)\b|\bsafer if (?:\w+ ){1,5}(?:gone|dead)\b|\bare born (?:stupid|dumb|lazy|evil|criminals?|thieves)\b|\b(?:cannot|can't) think like (?:normal|real)\b|\bsend them back\b|\bsubhuman\b|\b(?:lower|lesser|inferior) (?:kind|race|breed|form) of (?:people|humans?|life)\b|\b(?:hole|swamp|jungle|cave|cage) they c(?:a|o)me from\b|\bback in the (?:cage|zoo|kitchen|jungle)\b|\bthey ruin (?:all|everything)\b")),
    ("sexual", 0.9, _c(r"\b(?:horny|sext(?:ing)?|nudes?|blowjobs?|handjobs?|cumshots?|deepthroat|jerk(?:ing|ed|s)? off|jack(?:ing|ed|s)? off|masturbat\w+|orgasms?|gangbang|threesome|milfs?|dildos?|fuck ?budd(?:y|ies)|dick pics?|dirty pics?|naked (?:pics?|photos?|previews?|and|on|for)|used panties|onlyfans)\b")),
    ("sexual", 0.9, _c(r"\b(?:my|your|ur|his|her|their|big|hard|huge|tight|wet|perfect|nice|hot) (?:\w+ )?(?:cock|dick|tits|titties|boobs|pussy|ass|cunt|clit|nipples)\b(?=.{0,60}\b(?:want|show|lick|suck|ride|touch|face|feel|see|squeeze|grab|if you|all night)\b)|\b(?:show|lick|suck|ride|touch|want|send|post|flash|see|grab|squeeze)\b.{0,40}\b(?:cock|dick|tits|titties|boobs|pussy|panties|clit|nipples)\b")),
    ("sexual", 0.9, _c(r"\b(?:how wet|so wet|get(?:s|ting)? (?:me |you )?wet|i am hard|i'm hard|bend (?:me|you|her|him) over|rid(?:e|ing) (?:you|me|him|her) (?:in|on|all|until|till|til|hard|like|while|tonight)|touch(?:es|ing)? (?:himself|herself|myself|yourself)|take me all night|like it rough|naked and|moaning|(?:strip|undress) (?:my|you|me|him|her|and)|(?:screw|fuck|bang) (?:on|in|me|him|her|my|all night|until)|want to (?:fuck|bang|screw|strip|lick|suck) )\b")),
]
#: What others said, or what is said of oneself or of things.
_REPORTED = re.compile(r"\b(?:called|calls|calling|labell?ed|branded|names?) (?:me|us|him|her|them|my|everyone|people)\b|\b(?:told|tells|telling) (?:me|us)\b|\b(?:he|she|they|someone|somebody|people|guy|tutor|mod|mentor|proctor|instructor|friend|user) (?:\w+ ){0,2}(?:said|says|wrote|writes|posted|yelled|shouted|commented|replied)\b|\b(?:quote[sd]?|quoting|the (?:article|chapter|unit|reading|assignment|essay|text|lecture|paper|case|book|module|plan) (?:on|about))\b")
_SELF = re.compile(r"\b(?:i am|i'm|im|i was|i feel|i felt|feel(?:ing)? like|made me(?: feel| look)?|me feel|makes me feel|i look(?:ed)? like|i must be|call me|am i)\b(?:\s\w+){0,4}\s*$")
_REACH = 70


def _edge_first(items, after: bool) -> bool:
    """Whether every match of a parsed pattern begins at a space or a word's edge; ``after``: whether what follows it does."""
    for i, (op, arg) in enumerate(items):
        rest = lambda: _edge_first(items[i + 1 :], after)  # noqa: B023, E731
        match str(op):
            case "LITERAL":
                return chr(arg).isspace()
            case "IN":
                return all(str(a) == "CATEGORY_SPACE" or str(o) == "LITERAL" and chr(a).isspace() for o, a in arg)
            case "AT":
                return str(arg) == "AT_BOUNDARY" or rest()
            case "SUBPATTERN":
                return _edge_first(arg[-1], rest())
            case "BRANCH":
                follows = rest()
                return all(_edge_first(x, follows) for x in arg[1])
            case "MAX_REPEAT" | "MIN_REPEAT":
                return _edge_first(arg[2], False) and (arg[0] > 0 or rest())
            case _:
                return False
    return after


def _readings(items, left: str = "", right: bool = False) -> tuple[set[str] | None, list[set[str]]]:
    """Of a parsed pattern: all it matches, if that is a short list, and sets of strings one of which stands in every match.

    A space is any white space, ``_EDGE`` a word's edge; ``left`` is the edge before, ``right`` whether one follows.
    """
    run, whole, covers = {left}, True, []
    items = list(items)
    for k, (op, arg) in enumerate(items):
        before = _EDGE if all(x[-1:] in (_EDGE, " ") for x in run) else ""
        after = _edge_first(items[k + 1 :], right)
        op, also = str(op), []
        exact: set[str] | None = None
        if op == "LITERAL":
            exact = {chr(arg)}
        elif op == "IN" and all(str(o) == "LITERAL" or str(a) == "CATEGORY_SPACE" for o, a in arg):
            exact = {chr(a) if str(o) == "LITERAL" else " " for o, a in arg}
        elif op == "AT":
            exact = {_EDGE if str(arg) == "AT_BOUNDARY" else ""}
        elif op in ("ASSERT", "ASSERT_NOT"):
            exact = {""}
        elif op == "SUBPATTERN":
            exact, also = _readings(arg[-1], before, after)
        elif op == "BRANCH":
            parts = [_readings(x, before, after) for x in arg[1]]
            if all(x is not None for x, _ in parts):
                exact = set().union(*(x for x, _ in parts))
            else:
                best = [_best([*c, *([x] if x is not None else [])]) for x, c in parts]
                also = [set().union(*best)] if all(best) else []
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            once, also = _readings(inner, before if high == 1 else "", after and high == 1)
            if once is not None and high <= 2:
                exact, also = {"".join(x) for k in range(low, high + 1) for x in product(once, repeat=k)}, []
            else:
                also = [*also, *([once] if once is not None else [])] if low else []
        if exact is not None and len(run) * len(exact) <= 4000:
            run = {x + y for x in run for y in exact}
        else:
            covers += [run, *also]
            run, whole = exact if exact is not None else {""}, False
    run = {x + _EDGE for x in run} if right else run
    return (run, []) if whole else (None, [*covers, run])


_EDGE = "\0"


def _piece(text: str) -> str:
    """The longest part of a match within one token, with its edges."""
    parts = [x for x in re.split(r"\s+", re.sub(r"(?<=\w)(?=\s)|(?<=\s)(?=\w)", _EDGE, text)) if x.strip(_EDGE)]
    return re.sub(f"{_EDGE}+", _EDGE, max(parts, key=_telling, default=""))


#: Signs of no use, as most texts hold them: only speed depends on this list.
_FREQUENT = frozenset(
    "you your ur u i i'll i'm will the a an his her him he she they their them and for with that this of in on at who are is was were all me my it not people students should every can't cannot by to about another account world never over until while like want still there where time have know found all"
    " how so get nobody would ever naked hard post send see feel show has come go office place home house car door family if".split()
)


def _telling(piece: str) -> tuple[bool, int]:
    bare = piece.replace(_EDGE, "")
    return bare not in _FREQUENT, len(bare)


def _best(covers: list[set[str]]) -> set[str]:
    """The most telling set of parts of tokens; empty if there is none."""
    cut = [{_piece(x) for x in c} for c in covers]
    return max((c for c in cut if c and all(c)), key=lambda c: (min(map(_telling, c)), min(map(len, c)), -len(c)), default=set())


def _signs() -> tuple[dict[str, int], dict[str, int], int]:
    """(whole words, parts of tokens, bits of rules without a sign): which rules, as bits, may match a text that holds them.

    Derived from the rules, so a rule without any of its signs in a text's tokens cannot match there.
    """
    words, parts, always = Counter(), Counter(), 0
    for i, (_, _, pattern) in enumerate(RULES):
        exact, covers = _readings(parse(pattern.pattern))
        best = _best(covers if exact is None else [exact])
        always |= 0 if best else 1 << i
        for x in best:
            bare = x.replace(_EDGE, "")
            # an edge inside a sign is left out: what holds the letters alone is a wider class
            if x == _EDGE + bare + _EDGE and re.fullmatch(r"\w+", bare):
                words[bare] |= 1 << i
            else:
                parts[max(x.split(_EDGE), key=len)] |= 1 << i
    return dict(words), dict(parts), always


_WORD_SIGNS, _PART_SIGNS, _ALWAYS = _signs()
#: Beside the rules' bits: a word that tells by itself, and the classes that tell together.
_TELLS, _HARMS, _AIMS, _ABASES, _PEOPLE = (1 << (len(RULES) + i) for i in range(5))
_KIND_BITS = {"harm": _HARMS, "purge": _ABASES, "low": _ABASES, "adj": _ABASES, "you": _AIMS, "he": _AIMS, "group": _AIMS, "person": _PEOPLE}


def worth_a_look(bits: int) -> bool:
    """Whether a text or sentence of such tokens may score: a rule may match, a word tells, or harm or abasing words meet someone they may be meant for."""
    return bool(bits & (2 * _TELLS - 1) or bits & _AIMS and bits & (_HARMS | _ABASES) or bits & _HARMS and bits & _PEOPLE)
#: Further words of the rules, by their letters without repeats.
_SOUGHT = {_squeeze(w): w for w in sorted(_WORD_SIGNS) if len(w) > 3 and w.isalpha()}
_word_runs = re.compile(r"\w+").findall


@lru_cache(1 << 16)
def rules_of(token: str) -> int:
    """The rules, as bits, that have a sign in a restored token."""
    bits, telling, kinds = 0, abuse_model.telling_words(), abuse_model.classes()
    for w in _word_runs(token):
        bits |= _WORD_SIGNS.get(w, 0)
        if w in telling:
            bits |= _TELLS
        bits |= _KIND_BITS.get(kinds.get(w), 0)
    for part, of in _PART_SIGNS.items():
        if part in token:
            bits |= of
    return bits


_sentence = re.compile(r"(?<=[.!?…])\s+|\s+-\s+|\s{2,}")


@lru_cache(1 << 12)
def _chosen(rules: int) -> list[tuple[int, str, re.Pattern]]:
    return [(i, r[0], r[2]) for i, r in enumerate(RULES) if rules >> i & 1]


def spoken_rules(sentence: str, gate: bool = True) -> list[tuple[int, bool, int, int]]:
    """Rules that match a sentence, whether only in a report or of oneself, and where.

    Without ``gate`` every rule is tried, which gives the same.
    """
    rules = _ALWAYS if gate else -1
    for t in sentence.split() if gate else ():
        rules |= rules_of(t)
    out = []
    for i, category, pattern in _chosen(rules & (_TELLS - 1)):
        held = None
        for m in pattern.finditer(sentence):
            before = sentence[max(0, m.start() - _REACH) : m.start()]
            if category == "insult":
                held = bool(_SELF.search(sentence[max(0, m.start() - 30) : m.end()].rsplit(" ", 1)[0]) or _REPORTED.search(sentence[max(0, m.start() - _REACH) : m.end()]))
            else:
                held = bool(_REPORTED.search(before))
            if not held:
                break
        if held is not None:
            out.append((i, held, *m.span()))
    return out


def score_text(restored: str, scorer: abuse_model.Scorer | None = None, gate: bool = True) -> tuple[float, str | None]:
    """(score 0..1, category) of restored text: the score of its worst sentence, and what speaks most in it.

    A sentence without a sign of a rule and without a telling word scores 0.0; ``gate`` as in spoken_rules.
    """
    scorer = scorer or abuse_model.scorer()
    best, kind = 0.0, None
    for sentence in _sentence.split(restored):
        bits = 0
        for t in sentence.split():
            bits |= rules_of(t)
        if not worth_a_look(bits | _ALWAYS):
            continue
        spoken = spoken_rules(sentence, gate)
        if not spoken and not worth_a_look(bits & ~(_TELLS - 1)):
            continue
        found = abuse_model.features(sentence, spoken)
        score = scorer(found)
        if score > best:
            own = [RULES[i] for i, held, _, _ in spoken if not held]
            best, kind = score, max(own, key=lambda r: r[1])[0] if own else abuse_model.kind_of(found)
    return round(float(best), 6), kind


def letter_counts(df: DataFrame, column: str) -> dict[str, int]:
    """Trigram counts over the words of all texts: at most 27**3 numbers."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter()
            for w, k in zip(b["word"], b["n"]):
                for g in trigrams(w):
                    n[g] += k
            yield pd.DataFrame(list(n.items()), columns=["gram", "n"])

    words = F.regexp_extract_all(F.lower(column), F.lit(r"(?<![\p{L}\p{N}])[a-z]+(?![\p{L}\p{N}])"), F.lit(0))
    counted = df.where(F.col(column).isNotNull()).select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.mapInPandas(grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: r["n"] for r in rows}


def abuse_scores(df: DataFrame, key: str, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score, category) for every row of ``df``.

    Null and empty text score 0.0 with a null category. Repeated rows stay repeated;
    other columns are ignored.
    """
    model = df.sparkSession.sparkContext.broadcast((letter_counts(df, column), abuse_model.scorer()))
    source = df.select(key, *keep, F.col(column).alias("__text"))
    names = [key, *keep]
    schema = ", ".join([f"`{n}` {source.schema[n].dataType.simpleString()}" for n in names] + ["score double", "category string"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, scorer = model.value
        restorer = Restorer(CharModel(counts))
        for b in batches:
            out = b[names].copy()
            scored = [score_text(low, scorer) if worth_a_look(rules) else (0.0, None) for low, rules in map(restorer.read, b["__text"])]
            out["score"], out["category"] = [x for x, _ in scored], pd.Series([c for _, c in scored], dtype=object, index=out.index)
            yield out

    return source.mapInPandas(score, schema)


#: A text is a case from here on: where F1 is best on sentences made like those of the training and held out.
CASE = 0.42


def post_scores(posts: DataFrame) -> DataFrame:
    """(post_id, score, category): the highest score of a post's stored rows."""
    scored = abuse_scores(posts, "post_id", "selftext")
    return scored.groupBy("post_id").agg(F.max("score").alias("score"), F.max_by("category", "score").alias("category"))


def source_rates(posts: DataFrame) -> DataFrame:
    """(subreddit, posts, cases, rate): by board, its name trimmed, lower-cased and without prefix."""
    name = F.lower(F.trim("subreddit_name"))
    board = F.regexp_replace(F.regexp_replace(name, r"^/?r/", ""), r"\s+", "")
    scored = abuse_scores(posts, "post_id", "selftext", ("subreddit_name",))
    once = scored.groupBy(board.alias("subreddit"), "post_id").agg(F.max("score").alias("score"))
    return once.groupBy("subreddit").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("score") >= CASE).alias("cases"), F.avg((F.col("score") >= CASE).cast("double")).alias("rate"))

"""The scorer of problem 2: logistic regression over classes of words, their order, and rules.

Words of a restored sentence become classes (insult, person, group, harm, thing, topic ...) or stay
if they are small words; single classes, neighbours, and classes that stand together are features,
and so is every rule of ``abuse.RULES`` that speaks, or would speak but for a report or for being
said of oneself.  No labelled rows exist, so the weights are fitted to sentences made here
(``TRAIN_SENTENCES``, seeded).
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Sentences made for training.
TRAIN_SENTENCES = 9000

# Classes of words, in natural order.
WORDS = {
    "slur": """beaner beaners chink chinks coon coons cripple cripples darkie darkies dyke dykes fag fags faggot faggots gook gooks gyppo homo homos kike kikes midget midgets mongoloid
        negro nigga nigger niggers paki pakis queers raghead ragheads retards shemale spastic spastics spic spics towelhead towelheads tranny trannies wetback wetbacks wop""",
    "you": "you u ya ur your yours yourself yourselves you're you'll ye",
    "he": "he she they him her them his hers their theirs he's she's they're himself herself themselves",
    "i": "i me my myself mine i'm im i've i'd we us our",
    "group": """women girls females men boys immigrants immigrant migrants migrant refugees refugee foreigners foreigner gays gay lesbians lesbian trans transgender muslims muslim jews jew jewish christians
        christian catholics hindus sikhs blacks whites asians africans arabs mexicans latinos latinas hispanics indians chinese gypsies disabled autistic handicapped elderly homeless atheists veterans""",
    "person": """guy man woman person people folks dude bro mod mods moderator moderators tutor tutors proctor proctors mentor mentors teacher teachers instructor instructors professor professors evaluator evaluators
        grader graders student students everyone everybody anyone someone kid kids staff admin admins author classmate classmates roommate partner mate boss advisor""",
    "harm": """kill killed murder murdered hurt beat stab stabbed shoot shot strangle choke punch smash bury gut burn torch rape raped hang drown slap slit bleed suffer die lynch poison behead throttle
        throttled beheaded drowned bash""",
    "body": "face fingers finger bones bone legs leg arms arm neck throat throats skull teeth knees knee jaw head nose ribs mouth eye eyes",
    "weapon": "gun knife bat hammer bullet rifle shotgun pistol crowbar machete axe bomb grave coffin morgue",
    "purge": "deported exterminated eliminated sterilized sterilised gassed hanged lynched caged purged castrated culled euthanized euthanised enslaved whipped stoned",
    "low": "subhuman inferior filth vermin parasites savages plague disease animals trash scum garbage criminals thieves rapists cockroaches rats apes monkeys",
    "sex": """cock cocks dick dicks tits titties boobs pussy clit nipples panties nudes nude horny blowjob blowjobs handjob cumshot cum deepthroat masturbate masturbating masturbation orgasm orgasms gangbang threesome
        milf dildo onlyfans sext sexting naked ass boner hard-on""",
    "do": "lick licks licking suck sucks sucking ride riding strip undress spank bang banged moan moaning grope groped thrust",
    "swear": "fuck fucks fucked fucking shit shitty damn damned hell crap crappy bloody bullshit",
    "thing": """exam exams test tests course courses class classes module modules quiz portal assignment assignments homework lab labs rubric grade grades project system website software app deadline schedule week
        semester term day job laptop printer weather traffic car code bug program question questions workload policy""",
    "topic": "chapter book novel essay article reading unit lecture film movie play character characters poem story history case study lesson section topic scene documentary textbook theory debate article's",
    "said": "said says told called calls calling call wrote writes posted yelled shouted commented replied quote quoted quoting labelled labeled branded named names accused termed",
}
SMALL = frozenset("a an the is are was were be been being am such so all just nothing but of and or to in on at for with if not no do does did should must will would can cannot can't could than then that this these those like what who why how go get off up out it as by from about more most very too".split())
_tokens = re.compile(r"[a-z]+(?:'[a-z]+|-of-[a-z]+)?").finditer
_END = "."


@lru_cache(1)
def classes() -> dict[str, str]:
    from quernstone.llm.abuse import BEASTS, INSULTS, SLURRING

    out = {w: k for k, words in WORDS.items() for w in words.split()}
    forms = lambda words: [w + s for w in words for s in ("", "s", "es")]
    return out | {w: "beast" for w in forms(BEASTS)} | {w: "adj" for w in SLURRING} | {w: "insult" for w in forms(INSULTS)} | {w: "slur" for w in WORDS["slur"].split()}


#: Classes whose words make a sentence worth a look, whether or not a rule may speak.
TELLING = ("insult", "slur", "sex")
_ALSO_TELLING = frozenset("rape raped lynch lynched behead strangle castrated exterminated gassed sterilized sterilised subhuman".split())
#: Log odds before the features are looked at: of a sentence in which a rule speaks, and of others.
PRIOR = (2.2, -2.2)


@lru_cache(1)
def telling_words() -> frozenset[str]:
    return _ALSO_TELLING | {w for w, k in classes().items() if k in TELLING}


def features(sentence: str, spoken: list[tuple[int, bool, int, int]]) -> set[str]:
    """Of a restored sentence; ``spoken``: rules that match, whether only as a report or of oneself, and where."""
    known = classes()
    words = [(m[0], m.start()) for m in _tokens(sentence)]
    seq = [_END, *[k if (k := known.get(w)) else w if w in SMALL else "_" for w, _ in words], _END]
    strong = [i for i, t in enumerate(seq) if t in _STRONG]
    strong += [i for i, (_, at) in enumerate(words, 1) if any(a <= at < b for _, _, a, b in spoken)]
    if strong:  # what stands far from all strong words says nothing of them
        near = sorted({j for i in strong for j in range(max(0, i - REACH), min(len(seq), i + REACH + 1))})
        seq = [seq[j] for j in near]
    kinds = [t for t in seq if t in _KINDS]
    out = {f"1 {t}" for t in kinds}
    for i in range(len(seq) - 1):
        if seq[i] in _KINDS or seq[i + 1] in _KINDS:
            out.add(f"2 {seq[i]} {seq[i + 1]}")
            if i + 2 < len(seq):
                out.add(f"3 {seq[i]} {seq[i + 1]} {seq[i + 2]}")
    near = {(a, b) for i, a in enumerate(seq) if a in _KINDS for b in seq[i + 1 : i + 6] if b in _KINDS}
    out |= {f"n {a} {b}" for a, b in near}
    some = sorted(set(kinds))
    out |= {f"& {a} {b}" for i, a in enumerate(some) for b in some[i + 1 :]}
    out |= {f"rule {i}{' held' if held else ''}" for i, held, _, _ in spoken}
    out.add("spoken" if any(not x[1] for x in spoken) else "held" if spoken else "silent")
    return out


_KINDS = frozenset(WORDS) | {"beast", "adj", "insult"}
_STRONG = frozenset("slur insult beast adj harm weapon purge low sex do".split())
#: Words before and after a strong word that are looked at.
REACH = 7


def kind_of(found: set[str]) -> str:
    """The category that the classes of a sentence speak for where no rule does."""
    for kind, names in (("sexual", ("sex",)), ("hate", ("slur", "purge")), ("threat", ("harm", "weapon"))):
        if any(f"1 {n}" in found for n in names):
            return kind
    return "insult"


class Scorer:
    """Weights of features that correct the prior log odds."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __call__(self, found: set[str]) -> float:
        w = self.weights
        x = PRIOR["spoken" not in found] + sum([w[f] for f in found if f in w])
        return 1 / (1 + np.exp(-min(max(x, -30.0), 30.0)))


def fit(rows: list[set[str]], labels: list[bool], ridge: float = 0.05, steps: int = 150, least: int = 5) -> Scorer:
    """Logistic regression by preconditioned gradient steps over features of at least ``least`` rows."""
    counts = Counter(f for r in rows for f in r)
    names = sorted(f for f, n in counts.items() if n >= least)
    place = {f: i for i, f in enumerate(names)}
    found = [np.array(sorted(place[f] for f in r if f in place), np.int64) for r in rows]
    at, of = np.concatenate(found), np.repeat(np.arange(len(rows)), [len(x) for x in found])
    y, prior = np.array(labels, float), np.array([PRIOR["spoken" not in r] for r in rows])
    w = v = np.zeros(len(names))
    pull = ridge * len(rows) ** 0.5
    scale = 1 / (0.25 * np.bincount(at, minlength=len(names)) * max(len(at) / len(rows), 1) ** 0.5 + pull)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(prior + np.bincount(of, w[at], len(rows)))))
        v = 0.9 * v + scale * (np.bincount(at, (y - p)[of], len(names)) - pull * w)
        w = w + 0.3 * v
    return Scorer(dict(zip(names, w.round(5).tolist())))


# ------------------------------------------------------------------ sentences made for training
def made(rng: random.Random, n: int) -> list[tuple[str, bool]]:
    """(sentence, whether it is a case) from generic phrases with random fillings."""
    from quernstone.llm.abuse import BEASTS, INSULTS, SLURRING

    pick = rng.choice
    word, small = {k: sorted(v.split()) for k, v in WORDS.items()}, sorted(SMALL)
    ins, bst, adj, slur = (lambda: pick(INSULTS)), (lambda: pick(BEASTS)), (lambda: pick(SLURRING)), (lambda: pick(word["slur"]))
    many = lambda w: w + ("es" if w.endswith(("s", "ch", "sh")) else "s")
    who = lambda: pick(["my tutor", "that proctor", "the mod", "this instructor", "my roommate", "the guy at support", "he", "she", "whoever wrote this", "the grader", "the person above", "everyone in here", "our mentor"])
    whom = lambda: pick(["you", "him", "her", "them", "that proctor", "my mentor"])
    whose = lambda: pick(["your", "his", "her", "their"])
    group = lambda: pick([*word["group"][:], "old people", "poor people", "black people", "people from abroad", "people on welfare", "single mothers", "fat people"])
    thing = lambda: pick(word["thing"])
    topic = lambda: pick(["chapter", "book", "novel", "essay", "article", "reading", "unit", "lecture", "film", "play", "poem", "story", "lesson", "case", "documentary"])
    a = lambda w: ("an " if w[0] in "aeiou" else "a ") + w
    adjs = lambda: pick(["", "", adj() + " ", adj() + " ", adj() + ", " + adj() + " "])
    neutral = lambda: pick(["the quiz was long", "i passed it at last", "any advice is welcome", "the deadline moved again", "my laptop died", "we waited two hours", "the rubric makes no sense", "i read the guide twice", "nobody explained it", "thanks in advance"])
    unknown = lambda: "".join(pick(["ba", "cor", "del", "fen", "gar", "hol", "kin", "lor", "mar", "nor"]) for _ in range(rng.randint(2, 3)))
    plain = lambda: pick([unknown] * 4 + [thing, topic, lambda: pick(word["person"]), lambda: pick(word["said"]), lambda: pick(word["body"]), lambda: pick(["i", "you", "he", "they", "my", "we"]), lambda: str(rng.randint(2, 90)), lambda: pick(small), lambda: pick(small)])()
    filler = lambda: " ".join(plain() for _ in range(rng.randint(3, 12)))
    harm = lambda: pick(["kill", "hurt", "beat", "stab", "shoot", "strangle", "choke", "punch", "burn", "bury", "rape", "smash", "gut", "murder"])
    body = lambda: pick(word["body"])
    cases: list[Callable[[], str]] = [
        lambda: f"you are {a(adjs() + ins())}", lambda: f"you {adjs()}{ins()}", lambda: f"{who()} is {a(adjs() + ins())}", lambda: f"{who()} is nothing but {a(adjs() + pick([ins(), bst()]))}", lambda: f"what {a(adjs() + ins())}", lambda: f"you {adjs()}{bst()}",
        lambda: f"you are {a(adj() + ' ' + bst())}", lambda: f"{who()} is such {a(ins())}", lambda: f"shut up you {ins()}", lambda: f"all of you are {many(ins())}", lambda: f"{ins()}", lambda: f"{adj()} {ins()}", lambda: f"go away, {ins()}", lambda: f"these {adjs()}{many(pick([ins(), bst()]))} never answer", lambda: f"you are so {pick(['stupid', 'dumb', 'pathetic', 'worthless', 'useless', 'ugly', 'vile'])}",
        lambda: f"{who()} {pick(['acts', 'talks', 'looks'])} like {a(adjs() + ins())}", lambda: f"only {a(ins())} would ask that", lambda: f"{pick(['hey', 'listen', 'read this', 'ok'])} {ins()}, {neutral()}", lambda: f"you are a waste of {pick(['space', 'air', 'oxygen', 'skin'])}", lambda: f"{pick(['fuck', 'screw'])} you and {whose()} {thing()}", lambda: f"{who()} is a {adj()} {ins()} and should be fired", lambda: f"nobody will miss you, {ins()}", lambda: "nobody would miss you", lambda: "go to hell", lambda: "eat shit", lambda: "drop dead", lambda: f"shut your {pick(['mouth', 'trap', 'face'])}", lambda: f"{ins()} of a {pick(['tutor', 'man', 'teacher', 'human'])}",
        lambda: f"i will {harm()} {whom()}", lambda: f"i am going to {harm()} {whom()}", lambda: f"i'll {harm()} {whose()} {pick(['family', 'dog', 'friends'])}", lambda: f"i want to {harm()} {whom()} in {whose()} sleep", lambda: f"i will break {whose()} {body()}", lambda: f"someone should {harm()} {whom()}", lambda: f"i hope {pick(['you', 'he', 'she', 'they'])} {pick(['die', 'bleed', 'suffer', 'burn', 'get raped'])}", lambda: f"{pick(['you', 'he', 'she', 'they'])} {pick(['deserve', 'deserves'])} to {pick(['die', 'bleed', 'suffer', 'burn', 'be shot', 'be raped'])}", lambda: f"go {pick(['kill', 'hang', 'shoot', 'drown'])} yourself", lambda: f"i know where {pick(['you live', 'she lives', 'you park', 'he lives', 'you work'])}", lambda: f"i have {a(pick(['gun', 'knife', 'bat', 'rifle', 'hammer']))} and {pick(['know your address', 'i am not afraid to use it on you', 'you will see it'])}", lambda: f"watch your back, {pick(['you will bleed', 'i am coming for you', neutral()])}", lambda: f"i will find {whose()} {pick(['house', 'car', 'office'])} and {pick(['burn', 'torch', 'smash'])} it", lambda: f"i will make {whom()} {pick(['pay', 'suffer', 'bleed', 'regret it', 'beg'])}", lambda: f"sleep with one eye open", lambda: f"i am going to put a bullet in {whose()} {body()}", lambda: f"you will {pick(['bleed', 'regret', 'suffer'])} for this",
        lambda: f"{group()} are {pick(['', 'all ', 'nothing but ', 'just '])}{pick(word['low'])}", lambda: f"{group()} should {pick(['all ', ''])}be {pick(word['purge'] + ['shot', 'killed', 'kept out', 'locked up', 'thrown out'])}", lambda: f"i hate {pick(['', 'all ', 'these '])}{group()}", lambda: f"get rid of {pick(['', 'all ', 'the '])}{group()}", lambda: f"{group()} are {pick(['too stupid to study', 'born lazy', 'dirty', 'lazy and dirty', 'less than human', 'inferior', 'not human', 'all criminals'])}", lambda: f"{pick(['you', 'that', 'these', 'all', 'another', 'no', 'dirty'])} {slur()}", lambda: f"{who()} is a {pick(['', adj() + ' '])}{slur()}", lambda: f"{slur()}", lambda: f"we do not want {pick([group(), many(slur())])} here", lambda: f"send {pick(['them', group()])} back {pick(['home', 'to where they came from', 'to the jungle'])}", lambda: f"no {group()} {pick(['allowed', 'in my cohort', 'near me'])}", lambda: f"{group()} {pick(['stink', 'ruin everything', 'spread disease', 'cannot think'])}", lambda: f"{group()} do not deserve {pick(['to vote', 'a degree', 'rights', 'to live'])}", lambda: f"{pick(['kill', 'gas', 'shoot', 'hang', 'deport', 'burn'])} {pick(['all ', 'the ', 'all the ', 'those '])}{group()}", lambda: f"{group()} {pick(['belong in a cage', 'belong in the kitchen', 'go home', 'go back to your country', 'are mentally ill', 'are criminals', 'are animals'])}", lambda: f"i hope {pick(['you', 'she', 'he', 'your family', 'his kids'])} {pick(['die', 'dies', 'get cancer', 'rot', 'suffer', 'bleed'])}", lambda: f"you disgust me, {adj()} {pick(['excuse for a person', 'joke of a tutor', 'thing', 'lot'])}", lambda: f"{who()} is a {adj()} piece of {pick(['shit', 'crap', 'trash'])}", lambda: f"i am gonna {pick(['beat the crap out of', 'beat the shit out of', 'murder', 'hurt', 'stab'])} {whom()}", lambda: f"i will shoot up {pick(['the', 'this', 'your'])} {pick(['school', 'center', 'office', 'campus'])}", lambda: f"{pick(['nice', 'great', 'hot'])} {pick(['tits', 'ass', 'boobs'])}, {pick(['wanna fuck', 'show me', 'want to ride me', 'come here'])}", lambda: f"you are so {adj()}", lambda: f"you {pick(['people', 'guys', 'mods', 'lot'])} are {pick(['animals', 'vermin', 'trash', 'scum', adj()])}", lambda: f"die in a fire{pick(['', ' you all', ', all of you'])}", lambda: f"i {pick(['swear i', 'promise i', 'think i'])} will {harm()} {pick(['my roommate', 'my tutor', 'that professor', 'the proctor', 'this mod'])}", lambda: f"{group()} should not be allowed to {pick(['vote', 'study', 'work here', 'have kids', 'post'])}", lambda: f"typical {slur()} behaviour", lambda: f"{who()} is {a(adj() + ' ' + bst())}", lambda: f"{who()} is {a(adj() + ' ' + bst())} and {pick(['should be told so', 'everyone knows', 'must be fired', 'will hear it'])}", lambda: f"{unknown()} {adj()} {ins()} that you are", lambda: f"i {pick(['will', 'would', 'can only'])} call you {a(adj() + ' ' + ins())}", lambda: f"{whom()} and the other {many(pick([ins(), bst()]))}", lambda: f"{who()} {pick(['has', 'had'])} the {pick(['brain', 'manners', 'wit', 'face'])} of {a(pick([ins(), bst()]))}", lambda: f"{group()} {pick(['with', 'from', 'in', 'of'])} {unknown()} are {pick(word['low'])}", lambda: f"ruined by {group()}, {pick(word['low'])} the lot of them", lambda: f"tell {who()} to {pick(['watch out', 'run', 'hide', 'say goodbye', 'enjoy what is left'])} {unknown()} i {pick(['own', 'have', 'bought'])} {a(pick(['gun', 'knife', 'bat', 'rifle']))}",
        lambda: f"i want to {pick(['lick', 'suck', 'ride', 'fuck', 'spank', 'bang'])} {whose()} {pick(['cock', 'pussy', 'tits', 'ass', 'dick'])}", lambda: f"show me {whose()} {pick(['tits', 'boobs', 'nudes', 'pussy', 'ass', 'panties'])}", lambda: f"send {pick(['me ', ''])}nudes", lambda: f"she made me so {pick(['horny', 'wet', 'hard'])}", lambda: f"{pick(['i', 'he', 'she'])} {pick(['masturbated', 'was masturbating', 'was moaning', 'was naked'])} {pick(['in bed', 'on camera', 'all night'])}", lambda: f"{whose()} {pick(['tight', 'wet', 'big', 'hard', 'perfect'])} {pick(['pussy', 'cock', 'ass', 'tits'])} {pick(['drives me wild', 'all night', 'on my face'])}", lambda: f"bend {pick(['you', 'her', 'him', 'me'])} over the desk", lambda: f"{pick(['best', 'free', 'hot'])} {pick(['blowjob', 'threesome', 'gangbang', 'milf', 'handjob'])} {pick(['ever', 'tonight', 'on my onlyfans'])}", lambda: f"i touch myself when i see {whom()}", lambda: f"want to fuck {pick(['me', 'tonight', 'me all night'])}", lambda: f"i would love to see {whom()} naked",
    ]
    others: list[Callable[[], str]] = [
        neutral, filler, lambda: f"{pick(['no', 'some', 'not'])} {ins()} proof {pick(['guide', 'instructions', 'steps'])}", lambda: f"this is {a(ins())} of {a(thing())}", lambda: f"this {thing()} is a piece of {pick(['shit', 'crap', 'trash'])}", lambda: f"the {ins()} {unknown()} from {unknown()} is a {pick(['funny', 'long', 'good'])} {pick(['read', 'book', 'story', 'film'])}", lambda: f"{pick(['pussy', 'cock', 'dick', 'ass', 'bitch'])} {unknown()} {pick(['case study', 'chapter', 'lecture', 'reading', 'article'])} was {pick(['interesting', 'long'])}", lambda: f"you {pick(['deserve to pass', 'deserve a break', 'can shoot a video', 'will hurt your grade', 'hurt your chances', 'beat the clock', 'can kill the process', 'will die laughing', 'can burn a disc'])}", lambda: f"they {pick(['killed the thread', 'shot a video', 'beat the deadline', 'burn through money', 'bury the link', 'hurt my grade', 'choke on load'])}", lambda: f"{pick(['the', 'a', 'this', 'my'])} {adj()} {pick(['page', 'desk', 'table', 'chair', 'font', 'file', 'cat', 'cell', 'matrix', 'essay', 'menu'])} {pick(['and they', 'but you', 'so he', 'while she'])} {pick(['waited', 'read on', 'left', 'passed'])}", lambda: f"i am {adj()} {pick(['of this', 'and tired', 'today', 'at it'])}", lambda: f"he told me i was {adj()}", lambda: f"{pick(['somebody', 'a guy', 'they', 'my boss'])} told {pick(['my friend', 'her', 'us', 'a student'])} {pick(['she is', 'he is', 'we are'])} {a(ins())}{pick(['', ' and got banned', ' and left'])}", lambda: f"{group()} {pick(['may', 'should', 'can'])} {pick(['take the course', 'apply for aid', 'not be charged twice', 'not be ignored'])}", lambda: f"the {pick(['tutor', 'proctor', 'teacher'])} {pick(['shot a video', 'killed the session', 'beat the deadline', 'died last year'])}", lambda: f"the {pick(['villain', 'king', 'monster', 'hero', 'witch'])} is a {adj()} {pick(['man', 'ghost', ins(), bst()])}", lambda: f"a {adj()} {pick(['bit', 'one', 'kid', 'child', 'part', 'patient'])} {pick(['of', 'with', 'in'])} {unknown()}", lambda: f"i hope {pick(['you', 'she', 'he', 'they'])} {pick(['pass', 'passes', 'get well', 'find it', 'feel better', 'get a pass'])}", lambda: f"the {topic()} covers how {group()} were {pick(word['purge'])}", lambda: f"{filler()} {pick([ins(), bst(), adj()])} {thing()}", lambda: f"the {unknown()} on {pick(['rape survivors', 'murder', 'lynch mobs', 'gun owners', 'sex work', 'nude models', 'naked mole rats'])} {pick(['was long', 'asks for sources', 'is in week two'])}", lambda: f"it {pick(['murdered', 'killed', 'beat', 'choked', 'burned', 'raped'])} my {pick(['average', 'score', 'schedule', 'laptop', 'weekend'])}", lambda: f"my code to {pick(['execute', 'kill', 'hang', 'shoot'])} the {pick(['child', 'daemon', 'parent', 'thread', 'slave'])} fails", lambda: f"{pick(['my mother', 'the patient', 'the old man', 'my dog', 'the plant'])} {pick(['died', 'will die', 'is dead', 'was hurt', 'bled'])} {pick(['last year', 'in the case', 'soon', ''])}", lambda: f"i feel {pick(['burned out', 'dead inside', 'beat', 'like dying'])} after {rng.randint(2, 90)} hours of {unknown()}", lambda: f"the {ins()} in the {topic()} is {a(pick([ins(), 'hero', 'clown']))}", lambda: f"the {topic()} about {a(ins())} was {pick(['dull', 'long', 'great'])}", lambda: f"the {pick(['course', topic()])} on {pick([ins() + ' savants', many(ins()), ins() + 's in history'])} was dull", lambda: f"in {topic()} {rng.randint(1, 12)} the {pick(['king', 'hero', 'man', 'villain'])} is {a(adjs() + pick([ins(), bst()]))}", lambda: f"the character is {a(adjs() + ins())}", lambda: f"we read {a(topic())} called the {ins()}", lambda: f"the play has {a(ins())} and {a(bst())} in it", lambda: f"an essay on why people say {ins()}", lambda: f"the word {pick([ins(), slur()])} {pick(['comes from', 'is in the reading', 'is discussed in the lecture', 'has a long history'])}", lambda: f"the {topic()} on the history of {pick([slur(), many(ins())])} as a word",
        lambda: f"{who()} called me {a(adjs() + pick([ins(), slur()]))}", lambda: f"{who()} said {pick(['we are', 'i am', 'you are'])} {a(ins())}", lambda: f"someone posted {pick(['go kill yourself', 'you ' + ins(), 'i will hurt you'])} and was banned", lambda: f"i was told that {group()} are {pick(word['low'])} and i reported it", lambda: f"a mod wrote you {ins()} to a student", lambda: f"the article on {group()} says they were {pick(word['purge'])}", lambda: f"people call {group()} {pick(['lazy', 'animals', slur()])} and it is wrong", lambda: f"he yelled {pick(['shut up', 'you ' + ins(), slur()])} at us", lambda: f"quoting the post: {pick(['you are ' + a(ins()), 'i hate ' + group()])}",
        lambda: f"i am {a(adjs() + ins())}", lambda: f"i feel like {a(adjs() + pick([ins(), bst()]))}", lambda: f"i was such {a(ins())} to {pick(['wait', 'skip it', 'trust the guide'])}", lambda: f"i'm so {pick(['stupid', 'dumb', 'useless', 'lazy'])}", lambda: f"it made me feel like {a(ins())}", lambda: f"i must be {a(ins())}", lambda: f"call me {a(ins())} but i like it", lambda: f"i could kill myself for missing the {thing()}", lambda: f"i look like {a(ins())} now",
        lambda: f"this {thing()} is {pick(['stupid', 'dumb', 'garbage', 'trash', 'pathetic', 'useless', 'a joke', 'a bitch', 'a bastard of a thing', 'shit'])}", lambda: f"{pick(['fuck', 'damn', 'screw', 'to hell with'])} this {thing()}", lambda: f"what a {pick(['shitty', 'stupid', 'dumb', 'fucking useless', 'garbage'])} {thing()}", lambda: f"the {thing()} {pick(['sucks', 'is killing me', 'broke again', 'beat me', 'will be the death of me', 'is dead'])}", lambda: f"{pick(['that', 'this', 'the'])} {pick(['', '', 'damn ', 'fucking ', 'bloody '])}{thing()} {pick(['kicked', 'whooped', 'is kicking', 'beat'])} my ass{pick(['', ' and ' + filler(), ' and i do not know why'])}", lambda: f"{pick(['i worked my ass off', 'this is a pain in the ass', 'my ass is sore from sitting', 'i dragged my ass to class', 'they can kiss my ass'])} {pick(['', 'for this ' + thing(), filler()])}", lambda: f"my {bst()} ate the {thing()}", lambda: f"the {bst()} in the lab was {pick(['fed', 'sick', 'big', 'dirty'])}", lambda: f"we dissected {a(bst())} in the {topic()}", lambda: f"i will kill for a good grade", lambda: f"the {unknown()} {pick(['note', 'page', 'file', 'form'])} from my {pick(['mentor', 'roommate', 'evaluator', 'tutor'])} {pick(['has a dead link', 'kills the browser', 'is dead weight', 'choked on upload'])} {pick(['', 'in every row'])}", lambda: f"i will {pick(['break', 'smash', 'burn', 'kill', 'beat'])} this {thing()}", lambda: f"the {thing()} was a {pick(['beast', 'monster', 'bitch', 'pig'])}", lambda: f"holy shit the {thing()} is long", lambda: f"shit, {neutral()}", lambda: f"i hate {pick(['this', 'the', 'every'])} {thing()}", lambda: f"i broke my {body()} and missed the {thing()}", lambda: f"my {body()} hurts after the {thing()}",
        lambda: f"{group()} should {pick(['be helped', 'be treated fairly', 'get support', 'be paid more', 'have access', 'be in the study'])}", lambda: f"{group()} are {pick(['students here', 'a third of the class', 'in the study', 'under-represented', 'great mentors', 'protected by the act'])}", lambda: f"the {topic()} on {group()} {pick(['was long', 'is in week two', 'covers law', 'and crime statistics is dense'])}", lambda: f"many {group()} in my cohort {pick(['work hard', 'passed', 'were ignored', 'dropped out'])}", lambda: f"i work with {group()} at my job", lambda: f"i hate how {group()} are treated", lambda: f"the law said {group()} should be {pick(word['purge'])}",
        lambda: f"the {topic()} on {pick(['gun violence', 'rape law', 'murder rates', 'knife crime', 'sexual health', 'breast cancer', 'the death penalty', 'masturbation in freud', 'orgasm disorders', 'nude art', 'animal abuse', 'homicide'])} was {pick(['long', 'hard', 'dull'])}", lambda: f"the {topic()} shows a naked statue", lambda: f"the case is about {a(pick(['man', 'woman', 'student']))} who {pick(['killed', 'shot', 'stabbed', 'raped', 'beat'])} {a(pick(['man', 'woman', 'guard']))}", lambda: f"the patient {pick(['was shot', 'had a broken leg', 'was stabbed', 'is dead', 'bled a lot'])} in the case", lambda: f"the tutor {pick(['was late', 'never answered', 'is new', 'ignored us', 'is a saint'])}", lambda: f"you are {pick(['right', 'not alone', 'a star', 'too kind', 'almost done'])}", lambda: f"{who()} is {pick(['helpful', 'kind', 'late', 'slow', 'new here', 'a good teacher'])}", lambda: f"you will {pick(['pass', 'be fine', 'love it', 'hate the rubric'])}", lambda: f"i will {pick(['find you a link', 'send you the notes', 'help you', 'visit the office'])}", lambda: f"don't be {a(pick(['stranger', 'hero']))}", lambda: f"{pick(['do not', 'please do not', 'never'])} call people {many(ins())}", lambda: f"we should not say {slur()}",
    ]
    out = []
    for _ in range(n):
        good = rng.random() < 0.5
        s = pick(cases)() if good else pick(others)()
        s = pick(["{s}"] * 3 + ["{f} {s}", "{s} {f}", "{f}, {s}", "{s}, {f}"]).format(s=s, f=filler())
        s = pick(["", "", "", "honestly ", "so ", "and ", "but ", "well, ", "today ", "look, "]) + s + pick(["", "", "", "!", ".", ", " + neutral(), " and " + neutral(), " lol"])
        out.append((re.sub(r"\s+", " ", s), good))
    return out


@lru_cache(1)
def scorer(seed: int = 5) -> Scorer:
    """Fitted to TRAIN_SENTENCES sentences; the same for every session."""
    from quernstone.llm.abuse import spoken_rules

    sentences = made(random.Random(seed), TRAIN_SENTENCES)
    return fit([features(s, spoken_rules(s)) for s, _ in sentences], [y for _, y in sentences])

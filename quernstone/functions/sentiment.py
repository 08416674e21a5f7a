"""A lexicon scorer for the compound sentiment of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word weights, negations, words that strengthen or weaken the next one.
WEIGHTS = {
    "abandoned": -2.0, "abysmal": -2.8, "afraid": -1.8, "angry": -2.3, "annoyed": -1.7, "annoying": -1.7, "anxious": -1.5, "appreciate": 2.0, "awesome": 3.1, "awful": -2.5, "bad": -2.0, "beautiful": 2.9,
    "best": 3.2, "better": 1.9, "bitter": -1.8, "bored": -1.1, "boring": -1.3, "brilliant": 2.8, "broken": -1.5, "calm": 1.3, "cheat": -2.0, "clear": 1.3, "comfortable": 1.5, "complain": -1.5,
    "confident": 2.2, "confused": -1.3, "confusing": -1.6, "crash": -1.6, "crazy": -1.4, "cried": -1.6, "cruel": -2.8, "damn": -1.7, "dead": -2.0, "defeated": -1.9, "delay": -1.3, "depressed": -2.3,
    "desperate": -1.6, "difficult": -1.5, "disappointed": -1.9, "disappointing": -2.2, "disaster": -3.1, "dread": -2.0, "dumb": -2.3, "easy": 1.6, "embarrassed": -1.5, "enjoy": 2.2, "error": -1.7, "excellent": 2.8,
    "excited": 1.4, "exhausted": -1.5, "fail": -2.0, "failed": -2.0, "failing": -2.3, "failure": -2.3, "fair": 1.3, "fantastic": 2.6, "fear": -2.2, "fine": 0.9, "flawed": -2.1, "fraud": -2.8,
    "friendly": 2.2, "frustrated": -2.0, "frustrating": -1.9, "fun": 2.3, "garbage": -1.9, "glad": 2.0, "good": 1.9, "grateful": 2.0, "great": 2.6, "happy": 2.4, "hard": -0.4, "hate": -2.7,
    "hated": -3.2, "hell": -3.6, "help": 1.7, "helpful": 1.9, "hope": 1.9, "hopeless": -2.2, "horrible": -2.5, "hurt": -2.4, "ignored": -1.3, "impossible": -1.2, "impressed": 2.1, "insane": -1.7,
    "irritated": -1.8, "joke": 1.2, "kind": 2.4, "lazy": -1.5, "lied": -1.6, "lost": -1.2, "love": 2.7, "loved": 2.9, "lucky": 1.8, "mad": -2.2, "mess": -1.5, "miserable": -2.4,
    "nervous": -1.1, "nice": 1.8, "nightmare": -2.5, "outrageous": -2.0, "overwhelmed": -1.7, "pain": -2.3, "panic": -2.3, "pathetic": -2.7, "perfect": 2.7, "pleased": 1.9, "poor": -2.1, "pretty": 2.2,
    "problem": -1.7, "proud": 2.1, "recommend": 1.5, "regret": -1.8, "reject": -1.7, "relieved": 1.6, "ridiculous": -1.5, "rude": -2.0, "rushed": -0.9, "sad": -2.1, "scam": -2.7, "scared": -1.9,
    "shit": -2.6, "sick": -2.3, "slow": -0.9, "sorry": -0.3, "strange": -0.8, "stress": -1.8, "stressed": -1.4, "struggling": -1.8, "stuck": -1.4, "stupid": -2.4, "success": 2.7, "suck": -1.9,
    "support": 1.7, "terrible": -2.1, "thank": 1.5, "thanks": 1.9, "tired": -1.9, "trouble": -1.7, "ugly": -2.3, "unclear": -1.0, "unfair": -2.1, "unhappy": -1.8, "upset": -1.6, "useful": 1.9,
    "useless": -1.8, "warn": -0.4, "waste": -1.8, "weak": -1.9, "win": 2.8, "wonderful": 2.7, "worried": -1.2, "worse": -2.1, "worst": -3.1, "worthless": -1.9, "wrong": -2.1, "yay": 2.4,
}
NEGATIONS = ("not", "no", "never", "without", "nor", "none", "cannot", "hardly")
STRONGER = ("very", "really", "so", "extremely", "absolutely", "totally", "completely", "incredibly")
WEAKER = ("slightly", "somewhat", "barely", "partly", "kinda")


def compound(text: Column) -> Column:
    """Sum of word weights, turned and damped after a negation, greater or smaller after a word of degree,
    squashed to -1..1; empty is 0."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    # each word beside the one before it; only words of the lexicon are looked up
    pairs = F.zip_with(F.concat(F.array(F.lit("")), words), words, lambda before, w: F.struct(before.alias("before"), w.alias("w")))
    hits = F.filter(pairs, lambda x: x["w"].isin(*WEIGHTS))
    weigh = lambda x: table[x["w"]] * F.when(x["before"].isin(*NEGATIONS), F.lit(-0.74)).when(x["before"].isin(*STRONGER), F.lit(1.29)).when(x["before"].isin(*WEAKER), F.lit(0.71)).otherwise(F.lit(1.0))
    total = F.aggregate(hits, F.lit(0.0), lambda a, x: a + weigh(x))
    return total / F.sqrt(total * total + F.lit(15.0))

"""The fitted scorer on phrases that neither the test tables nor its own training phrases hold."""

import random

import pytest

from quernstone.llm import abuse, abuse_model

CASES = [
    "My landlord is a miserable bastard.", "Honestly your whole family are cretins", "Get lost, you greasy weasel!", "That librarian is a spiteful hag", "I am going to strangle him with his own tie", "Tonight I will stab that man", "I will rape you",
    "You filthy faggot", "another kike in the forum", "Refugees are vermin", "Muslims should be exterminated", "those trannies again", "Show me your tits", "I want to suck your cock", "your wet pussy is all I think of", "You pathetic maggot", "The dean is such a wanker", "kys", "drop dead already", "Immigrants are subhuman filth",
]
HARMLESS = [
    "The coward in chapter 3 is a fool.", "The course on idiot savants was dull.", "She called me a moron and I cried.", "I am such an idiot for skipping lab.", "This exam is a bitch.", "Fuck this portal.", "The lecture on rape law was long.", "In the play the king is a bloody tyrant and a liar.", "My dog ate the essay.",
    "Women in my cohort deserve better pay.", "Immigrants should be helped with forms.", "The patient was stabbed and died.", "I hate this stupid website.", "Our unit covers the history of the word faggot.", "The nurse said the man was shot.", "I could kill for a coffee.", "He said go to hell and was banned.", "The breast cancer module is good.", "You are not alone.", "My tutor was kind.",
]


def score(text):
    return abuse.score_text(abuse.Restorer(abuse.CharModel({})).text(text))[0]


def test_unseen_phrases():
    found = [t for t in CASES if score(t) >= abuse.CASE]
    false = [t for t in HARMLESS if score(t) >= abuse.CASE]
    assert len(found) >= 0.9 * len(CASES), sorted(set(CASES) - set(found))
    assert len(false) <= 0.1 * len(HARMLESS), false


def test_held_out_sentences():
    made = abuse_model.made(random.Random(123), 1500)
    s = abuse_model.scorer()
    right = sum((s(abuse_model.features(t, abuse.spoken_rules(t))) >= abuse.CASE) == y for t, y in made)
    assert right >= 0.95 * len(made)


def test_scores_rank():
    many = {round(score(t), 3) for t in CASES + HARMLESS}
    assert len(many) > 15
    assert score("You are a worthless moron") > score("The moron in the story") > score("The story was long")


@pytest.mark.parametrize("text", ["", "   ", "!!!", "x" * 100_000])
def test_empty_and_long(text):
    assert score(text) == 0.0


#: Phrases that earlier scorers got wrong, kept as they are.
ONCE_MISSED = [
    "You're all a bunch of retards.", "I'm going to rape you", "All Jews should be gassed.", "stupid bitch",
    "My professor is a fat ugly cow", "Women belong in the kitchen", "Black people are criminals", "You deserve to die",
    "I'll find you and kill you", "I hope you get cancer", "go die in a fire", "nice tits, wanna fuck?",
    "I want to cum on your face", "she sucked my dick last night", "f u c k  y o u", "fuck you all",
    "F*ck off you c*nt", "you n1gger", "gas the jews", "faggots everywhere in this sub",
    "kill all muslims", "what a dumb whore", "he is a worthless piece of shit", "hope your whole family dies",
    "i will shoot up the testing center", "you are a joke of a human being", "Your mother is a whore", "shut the fuck up",
    "trannies are mentally ill", "I would smash that ass", "dirty immigrants go home", "the mentors are useless idiots",
    "nobody likes you, kill yourself", "you disgust me, you pathetic excuse for a person", "your brain is the size of a pea", "send me your nudes or else",
    "you people are animals", "go back to your country", "i am gonna beat the crap out of him", "retard alert",
]
ONCE_FALSE = [
    "This course is killing me", "I want to kill this exam", "my computer died", "I feel so stupid right now",
    "Stupid exam software crashed", "The bastard operator from hell is a funny read", "Dick Cheney is discussed in chapter 4", "the cock crowed at dawn in the poem",
    "Pussy Riot case study was interesting", "I was called a retard in school and the counselling module brought it back", "my ass is tired from sitting", "no idiot proof instructions",
    "dummy variables are hard", "beat the clock", "The course covers the genocide of jews in Germany", "jews were gassed in the camps, says the history text",
    "slave and master in the database unit", "I'd kill for an A", "we shot a video for the assignment", "damn this is hard, shit",
    "I hate myself for waiting", "what the hell is wrong with the portal", "hot girls shown in the ad study is a marketing example", "sexual harassment policy must be cited",
    "the nurse must touch the patient's breast", "women are under-represented in tech", "I am sick of this lazy rubric", "dirty data ruined my model",
    "my lazy cat sat on the keyboard", "fat content of milk", "the exam raped my gpa", "this is a bitch of a class",
    "you are awesome", "you guys are the best", "He told me I was worthless", "The villain is a sick twisted monster",
    "mad respect to my mentor", "ugly interface but works", "poor people should be supported", "Muslim students should be given a prayer room",
]


def test_once_wrong():
    missed, false = [t for t in ONCE_MISSED if score(t) < abuse.CASE], [t for t in ONCE_FALSE if score(t) >= abuse.CASE]
    assert len(missed) <= 0.05 * len(ONCE_MISSED) and len(false) <= 0.05 * len(ONCE_FALSE), (missed, false)

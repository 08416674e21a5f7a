import time
from collections import Counter

import pytest

from quernstone.llm import abuse


@pytest.fixture(scope="module")
def restorer():
    counts = Counter()
    for w in "the worst course was the webinar and you are not going to pass another exam without help from someone who can read this text".split():
        for g in abuse.trigrams(w):
            counts[g] += 50
    return abuse.Restorer(abuse.CharModel(counts))


@pytest.mark.parametrize(
    "noisy, clean",
    [("idi" + "o" * 90 + "t", "idiot"), ("1d1" + "0" * 90 + "t", "idiot"), ("mor-on", "moron"), ("id.iot", "idiot"), ("mo_ron", "moron"), ("moroon", "moron"), ("iidiot", "idiot"), ("ki-ll", "kill"), ("you/1d10t", "you/idiot"), ("a/id.iot", "a/idiot"), ("what-a-very-long-token-of-many-words/you-1d10t-there", "what-a-very-long-token-of-many-words/you-idiot-there")],
)
def test_disguises_of_every_length(restorer, noisy, clean):
    assert restorer.token(noisy) == clean


@pytest.mark.parametrize("word", ["pass", "will", "who're", "she'll", "looser", "well-known", "co-op", "e.g", "see", "course-related", "idiot's", "piece-of-shit"])
def test_innocent_words_stay(restorer, word):
    assert restorer.token(word) == word


@pytest.mark.parametrize("text", ["You are a mor-on.", "you iidiot", "You idi" + "o" * 60 + "t", "I will ki-ll you"])
def test_disguised_text_is_a_case(restorer, text):
    low, rules = restorer.read(text)
    assert rules and abuse.score_text(low)[0] >= abuse.CASE


def test_long_tokens_take_linear_time(restorer):
    began = time.process_time()
    restorer.token("a1b2" * 20_000)
    assert time.process_time() - began < 20


def test_letters_of_whole_words_are_counted(spark):
    word = "ab" * 40 + "xyz"
    got = abuse.letter_counts(spark.createDataFrame([(word,)], "text string"), "text")
    want = Counter(abuse.trigrams(word))
    assert got == dict(want) and got["xyz"] == 1


@pytest.mark.parametrize("text", ["y.o.u a.r.e a i.d.i.o.t", "you are a mo ron", "what an id iot!", "You are a ba stards"])
def test_mixed_separators_and_words_cut_once(restorer, text):
    low, rules = restorer.read(text)
    assert rules and abuse.score_text(low)[0] >= abuse.CASE


@pytest.mark.parametrize("text", ["who re did the exam", "we go at it", "my lo gin failed", "a low life insurance fee"])
def test_words_that_are_not_cut(restorer, text):
    assert restorer.text(text) == text

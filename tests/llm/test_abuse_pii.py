import random
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import abuse, pii
from quernstone.llm.boosting import BoostedTrees


@pytest.fixture(scope="module")
def restorer():
    words = Counter("the worst course was the webinar and you are not going to pass another exam without help from someone who can read this text".split())
    counts = Counter()
    for w, n in words.items():
        for g in abuse.trigrams(w):
            counts[g] += n * 50
    return abuse.Restorer(abuse.CharModel(counts))


@pytest.mark.parametrize("noisy, clean", [("1d10t", "idiot"), ("l0$er", "loser"), ("cl0wn", "clown"), ("haaaalfwit", "halfwit"), ("a$$hole", "asshole"), ("m0r0ns", "morons"), ("n254", "n254"), ("course", "course"), ("2024-05-01", "2024-05-01"), ("", "")])
def test_tokens(restorer, noisy, clean):
    assert restorer.token(noisy) == clean


def test_masked_words_become_insults(restorer):
    for masked in ("b*****d", "m*r*n", "a**hole"):
        assert restorer.token(masked) in abuse._FORMS


@pytest.mark.parametrize("noisy, clean", [("You M O R O N, stop", "you moron, stop"), ("what a v i l e rat", "what a vile rat"), ("call 9 7 1 5 5 5 0", "call 9 7 1 5 5 5 0"), ("ｙｏｕ ｉdiоt", "you idiot"), (None, "")])
def test_texts(restorer, noisy, clean):
    assert restorer.text(noisy) == clean


ABUSIVE = ["You are a complete moron.", "Nobody would miss you, you worthless pig.", "I hope you die, scumbag", "I will break your fingers.", "I know where you live and I own a gun.", "Immigrants are vermin.", "Women should be banned from nursing.", "Send nudes, I am so horny", "Show me your tits", "1d10ts like you should shut your mouth", "My tutor is a lying bastard."]
HARMLESS = ["This exam is useless garbage and the rubric is stupid.", "I feel so stupid for missing it.", "Someone called me a moron and told me to quit.", "I had to kill the daemon and its child process.", "The chapter on breast exams and sexual health is short.", "Immigrants and refugees are the topic of unit 3.", "Shit, I forgot the file.", "The pig anatomy lab was fun.", "", None]


@pytest.mark.parametrize("text", ABUSIVE)
def test_abusive(restorer, text):
    assert abuse.score_text(restorer.text(text))[0] >= abuse.CASE


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(restorer, text):
    low, telling = restorer.read(text)
    assert not telling or abuse.score_text(low)[0] < abuse.CASE


def test_abuse_table(spark):
    rows = [("a", "You moron.", "r/X "), ("a", "fine", "x"), ("b", None, "X"), ("c", "", None), ("d", "ok " * 50_000, "y"), ("d", "ok", "y")]
    df = spark.createDataFrame(rows, "post_id string, selftext string, subreddit_name string").selectExpr("*", "1.0D AS score")
    got = {r["post_id"]: (r["score"] >= abuse.CASE, r["category"]) for r in abuse.post_scores(df).collect()}
    assert got == {"a": (True, "insult"), "b": (False, None), "c": (False, None), "d": (False, None)}
    rates = {r["subreddit"]: (r["posts"], r["cases"], r["rate"]) for r in abuse.source_rates(df).collect()}
    assert rates == {"x": (2, 1, 0.5), None: (1, 0, 0.0), "y": (1, 0, 0.0)}
    assert abuse.post_scores(df.where("false")).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.RandomState(0)
    x = rng.randint(0, 2, (800, 6)).astype(np.uint8)
    y = (x[:, 0] & x[:, 1]) | x[:, 2]
    m = BoostedTrees(30).fit(x[:600], y[:600]).calibrate(x[:600], y[:600])
    assert ((m.probability(x[600:]) >= m.threshold) == y[600:]).mean() > 0.98


@pytest.fixture(scope="module")
def trained():
    return pii.models()


def test_held_out_accuracy(trained):
    held = pii._labelled(random.Random(99), 1500)
    for kind, least in (("email", 0.97), ("phone", 0.97), ("id_number", 0.97), ("address", 0.95), ("name", 0.85)):
        x, y = np.array(held[kind][0], np.uint8), np.array(held[kind][1])
        p = trained[kind].probability(x) >= trained[kind].threshold
        f1 = 2 * (p & y).sum() / (p.sum() + y.sum())
        assert f1 >= least, (kind, f1)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to jo.doe+x@mail.example please", "Write to [EMAIL] please"),
        ("You can reach me at jane (at) mail (dot) org if needed", "You can reach me at [EMAIL] if needed"),
        ("My cell is (212) 555-0187 now", "My cell is [PHONE] now"),
        ("WhatsApp 2 1 2 5 5 5 0 1 8 7 for the group", "WhatsApp [PHONE] for the group"),
        ("My SSN 912-55-1234 was shown", "My SSN [ID_NUMBER] was shown"),
        ("Ticket 912-55-1234 is open", "Ticket 912-55-1234 is open"),
        ("Order 912551234 came late", "Order 912551234 came late"),
        ("I live at 12 Old Mill Road, Apt 4B and work", "I live at [ADDRESS] and work"),
        ("My tutor Maria Holt never called", "My tutor [NAME] never called"),
        ("I was told by maria holt that it works", "I was told by [NAME] that it works"),
        ("We met in Mercury Hall on Friday", "We met in Mercury Hall on Friday"),
        ("The Court of Appeals reading has 600 pages.", "The Court of Appeals reading has 600 pages."),
        ("", ""),
        (None, None),
    ],
)
def test_redaction(trained, text, want):
    assert pii.redact(text, pii.find_all([text], trained)[0]) == want


def test_lookalikes_keep_places(trained):
    text = "é ｍａｉｌ: jo​.doe@mаil.example end 🙏"
    assert pii.redact(text, pii.find_all([text], trained)[0]) == "é ｍａｉｌ: [EMAIL] end 🙏"


def test_pii_table(spark):
    rows = [("a", "Mail jo@mail.example"), ("a", "Mail jo@mail.example"), ("b", None), ("c", ""), (None, "jo@mail.example"), ("d", "word " * 40_000 + "jo@mail.example")]
    df = spark.createDataFrame(rows, "post_id string, body string").selectExpr("*", "'x' AS pii_type", "'y' AS text")
    assert sorted(tuple(r) for r in pii.types_found(df, "post_id", "body").collect()) == [("a", "email"), ("d", "email")]
    assert pii.types_found(df.where("false"), "post_id", "body").count() == 0
    out = df.select("post_id", pii.redacted(df, "body")["text"].alias("t")).collect()
    assert len(out) == 6 and {r["t"] for r in out if r["post_id"] == "a"} == {"Mail [EMAIL]"}

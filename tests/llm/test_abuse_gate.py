import random
from re._parser import parse

import pytest

from quernstone.llm import abuse


def sample(items, rng):
    """A random match of a parsed pattern, look-around left out."""
    out = ""
    for op, arg in items:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, what = rng.choice(arg)
            out += chr(what) if str(kind) == "LITERAL" else {"CATEGORY_SPACE": " ", "CATEGORY_WORD": "x"}[str(what)]
        elif op == "ANY":
            out += "x"
        elif op == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[0] + 2, arg[1]))))
    return out


@pytest.mark.parametrize("rule", range(len(abuse.RULES)))
def test_every_match_holds_a_sign(rule):
    rng, pattern = random.Random(rule), abuse.RULES[rule][2]
    parsed, matches = parse(pattern.pattern), 0
    for _ in range(1500):
        text = sample(parsed, rng)
        for t in (text, f"well, {text}, so", f"oh {text} if you want the face"):
            if pattern.search(t):
                matches += 1
                assert any(abuse.rules_of(x) >> rule & 1 for x in t.split()), t
                assert abuse.score_text(t) == abuse.score_text(t, gate=False), t
    assert matches > 500


@pytest.mark.parametrize(
    "text",
    ["I will break you", "I will make you pay.", "I know where you park.", "Sleep with one eye open.", "Someone will torch your car", "Go to hell", "Eat shit", "You should be wiped out", "They will end up in a body bag", "she was jerking off", "He is touching. Bang me all night"],
)
def test_no_gate_hides_a_case(text):
    low, rules = abuse.Restorer(abuse.CharModel({})).read(text)
    assert rules and abuse.score_text(low)[0] >= abuse.CASE

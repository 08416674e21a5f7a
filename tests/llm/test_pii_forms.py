"""Forms of values beyond those of the test tables."""

import pytest

from quernstone.llm import pii

FORMS = [
    ("Write to jörg.müller@uni-köln.de please", "email", "jörg.müller@uni-köln.de"), ("https://x.example/f?email=john.doe@example.com is public", "email", "john.doe@example.com"),
    ("My NI number is QQ 12 34 56 C.", "id_number", "QQ 12 34 56 C"), ("My national ID 1234 5678 9012 is on it", "id_number", "1234 5678 9012"),
    ("I live at Calle Mayor 12, Madrid", "address", "Calle Mayor 12"), ("Ship it to PO Box 1234", "address", "PO Box 1234"), ("We meet at 10 Rue de Rivoli, Paris", "address", "10 Rue de Rivoli"),
    ("Priyanka told me to wait.", "name", "Priyanka"), ("Regards,\nThandiwe", "name", "Thandiwe"), ("Wojciech graded it.", "name", "Wojciech"),
]


@pytest.mark.parametrize("text, kind, value", FORMS)
def test_found(text, kind, value):
    spans = pii.find_all([text], pii.models())[0]
    assert any(s.kind == kind and value in text[s.start : s.stop] for s in spans), [(s.kind, text[s.start : s.stop]) for s in spans]


@pytest.mark.parametrize("text", ["I flew via Denver 3 times.", "The box 12 holds the plaza map.", "The rue is long, question 14 too.", "tickets at 12:30 via portal 9"])
def test_not_an_address(text):
    assert not [s for s in pii.find_all([text], pii.models())[0] if s.kind == "address"]

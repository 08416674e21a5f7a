import random

import pytest

from quernstone.llm import pii


@pytest.fixture(scope="module")
def trained():
    return pii.models()


def test_recall_of_true_names(trained):
    """Against the names that stand in the sentences, not among those proposed."""
    made = list(pii._sentences(random.Random(77), 2500))
    true = hit = 0
    for (text, found), spans in zip(made, pii.find_all([t for t, _ in made], trained)):
        for kind, value in found:
            if kind == "name":
                a = text.find(value)
                true += 1
                hit += any(s.kind == "name" and min(s.stop, a + len(value)) - max(s.start, a) >= len(value) / 2 for s in spans)
    assert true > 700 and hit / true >= 0.9, (hit, true)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Okafor never answered.", "[NAME] never answered."),
        ("It failed. Okafor told us to wait.", "It failed. [NAME] told us to wait."),
        ("Tutor: Okafor", "Tutor: [NAME]"),
        ("Thank you for your help.\nOkafor", "Thank you for your help.\n[NAME]"),
        ("MY TUTOR OKAFOR NEVER ANSWERED AND THE EXAM IS LATE", "MY TUTOR [NAME] NEVER ANSWERED AND THE EXAM IS LATE"),
        ("my tutor okafor never answered", "my tutor [NAME] never answered"),
        ("Canvas never loads.", "Canvas never loads."),
        ("Reading the guide takes hours.", "Reading the guide takes hours."),
        ("THE PDF FILE IS LONG AND LATE", "THE PDF FILE IS LONG AND LATE"),
    ],
)
def test_names_at_any_place(trained, text, want):
    assert pii.redact(text, pii.find_all([text], trained)[0]) == want

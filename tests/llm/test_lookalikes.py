import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import lookalikes as L

CASES = {
    "plain text": "plain text",
    "ｆｕｌｌ　ｗｉｄｔｈ": "full width",
    "café": "café",
    "zero​wi⁠dth﻿ so­ft": "zerowidth soft",
    "no break space ": "no break space ",
    "Сору оf Аррlе": "Copy of Apple",
    "ﬁne ﬂow… non‑break": "fine flow... non-break",
    "q̣̇": "q̣̇",
    "q̣̇": "q̣̇",
    "naïve Ω ツ x² ½ ß": "naïve Ω ツ x² ½ ß",
    "a\r\n b\t c": "a\r\n b\t c",
    "👩‍🔬": "👩‍🔬",
    "각 가": "각 가",
    "": "",
}


def test_fold():
    for text, want in CASES.items():
        assert L.fold_text(text) == want, text
    assert L.fold_text(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aе́ﬁ​̣ｑ ")), max_size=40))
def test_fold_is_stable(text):
    once = L.fold_text(text)
    assert L.fold_text(once) == once
    assert unicodedata.normalize("NFC", once) == once or "‍" in once


def test_operator_equals_fold(spark):
    texts = [*CASES, None, "x" * 50_000 + "ｅ" * 3000 + "́", "ｅ", "ｅ", "́start", "​"]
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "id int, text string, k string")
    got = {r["id"]: r["text_seen"] for r in L.with_seen(df, ["text"]).collect()}
    assert got == {i: L.fold_text(t) for i, t in enumerate(texts)}
    assert L.with_seen(df.where("false"), ["text"]).count() == 0


def test_same_look(spark):
    body = " ".join(f"word{i}" for i in range(25))
    rows = [("a", "T", body), ("b", "T", body.replace("w", "ｗ")), ("c", "T", body), ("d", "t", body), ("e", None, body), ("f", "", body.replace(" ", " ")), ("g", "T", "ｓhort"), ("h", "T", "short"), ("a", "T", body), ("z", "T", None), (None, "T", body)]
    df = spark.createDataFrame(rows, "id string, title string, body string").selectExpr("*", "'x' AS stored", "1 AS words")
    got = {tuple(r) for r in L.same_look(df, "id", ["title", "body"], "body", 20).collect()}
    assert got == {("a", "b"), ("b", "c"), ("e", "f")}
    assert L.same_look(df.where("false"), "id", ["title", "body"], "body", 20).count() == 0


@pytest.mark.parametrize("ch", ["̀", "é", "Å", "ｱ", "𝐀"])
def test_mapping_never_maps_to_itself(ch):
    assert L.mapping().get(ch) != ch

"""Problem 8: evaluation items that stand, fully or partly, inside a corpus.

The n-grams of the items' normalised words are a broadcast hash set; every window of words
of every document is looked up in one scan, and hits are joined to the items' grams and
verified word by word.  The set has a fixed greatest size: beyond it a table of bits takes
its place, which lets a few windows too many reach the join and loses none.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.rolling import Windows
from quernstone.session import stored

WORDS = 12
#: So many hashes of grams (8 bytes each) are broadcast as they are; more become a table of 2 ** BITS bits.
SET_GRAMS = 1_000_000
BITS = 27
_word, _word_at = re.compile(r"[^\W_]+").findall, re.compile(r"[^\W_]+").finditer


#: For ASCII texts, cutting at these is the same and faster.
_gaps = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, lower-cased."""
    if not text:
        return []
    low = text.lower()
    return low.translate(_gaps).split() if low.isascii() else _word(low)


class _Known(dict):
    def __missing__(self, w: str) -> int:
        x = self[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return x


class WordIds:
    """Words -> 64-bit ids; a worker remembers a bounded number of words."""

    def __init__(self) -> None:
        self.known = _Known()

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 1 << 18:
            self.known.clear()
        known = self.known
        return np.array([known[w] for w in words], np.uint64)


class GramFilter:
    """Which hashes may be those of a gram: exactly, or with false alarms but without misses."""

    def __init__(self, exact: np.ndarray | None = None, bits: np.ndarray | None = None) -> None:
        self.exact, self.bits = exact, bits

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            at = h >> np.uint64(64 - BITS)
            return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        if not len(self.exact):
            return np.zeros(len(h), bool)
        return self.exact[np.minimum(np.searchsorted(self.exact, h), len(self.exact) - 1)] == h


def _grams_of(n: int):
    """(item, k, h, gram) of each distinct gram of an item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, win = WordIds(), Windows()
        for b in batches:
            rows = []
            for item, text in zip(b["item"], b["text"]):
                words = words_of(text)
                k = min(n, len(words))
                if k:
                    seen = {" ".join(words[i : i + k]): h for i, h in enumerate(win.of(win.prefix(ids(words)), k).view(np.int64).tolist())}
                    rows += [(item, k, h, gram) for gram, h in seen.items()]
            yield pd.DataFrame(rows, columns=["item", "k", "h", "gram"])

    return run


def _filters(grams: DataFrame) -> dict[int, GramFilter]:
    """For each length of grams what its hashes are looked up in; of bounded size."""
    counts = {r["k"]: r["n"] for r in grams.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most WORDS rows
    out = {}
    exact = sum(counts.values()) <= SET_GRAMS
    for k in counts:
        own = grams.where(F.col("k") == k)
        if exact:
            out[k] = GramFilter(np.unique(np.array([r["h"] for r in own.select("h").distinct().collect()], np.int64).view(np.uint64)))
        else:
            bits = np.zeros(1 << (BITS - 6), np.uint64)
            at = F.shiftrightunsigned("h", 64 - BITS)
            for r in own.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int)))").alias("bits")).toLocalIterator():
                bits[r["word"]] = np.int64(r["bits"]).view(np.uint64)
            out[k] = GramFilter(bits=bits)
    return out


def leaked_spans(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_key bigint, item_key bigint, start int, stop int): verified hits, in words of the document.

    A hit is n consecutive words of an item, or all of an item of fewer words, in a document's
    words. Null, empty and word-less texts match nothing. Repeated rows of a document or an item
    count once. A document's whole text is scanned; other columns are ignored. A shorter item
    whose words are part of longer wording matches as well.
    """
    spark = docs.sparkSession
    named = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    grams = stored(named.mapInPandas(_grams_of(n), "item bigint, k int, h bigint, gram string").distinct(), "grams")
    shared = spark.sparkContext.broadcast(_filters(grams))
    source = docs.select(F.col(doc_key).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, win = WordIds(), Windows()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc"], b["text"]):
                words = words_of(text)
                if not words:
                    continue
                prefix = win.prefix(ids(words))
                for k, known in shared.value.items():
                    h = win.of(prefix, k)
                    for i in np.flatnonzero(known(h)).tolist():
                        rows.append((doc, k, int(h[i].view(np.int64)), " ".join(words[i : i + k]), i, i + k))
            yield pd.DataFrame(rows, columns=["doc", "k", "h", "gram", "start", "stop"])

    hits = source.mapInPandas(scan, "doc bigint, k int, h bigint, gram string, start int, stop int")
    return hits.join(grams, ["k", "h", "gram"]).select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "start", "stop").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_key bigint, item_key bigint, hits int): items that stand in a document, with their number of hits, as leaked_spans gives them."""
    return leaked_spans(docs, items, doc_key, item_key, text, n).groupBy(doc_key, item_key).agg(F.count(F.lit(1)).cast("int").alias("hits"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words and what stands between their words."""
    low, at = text.lower(), None
    if len(low) != len(text):  # few letters become several when lower-cased
        at = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
        low = "".join(c.lower() for c in text)
    words = [m.span() for m in _word_at(low)]
    out, done = [], 0
    for a, b in sorted(spans):
        a, b = words[a][0], words[b - 1][1]
        if at is not None:
            a, b = at[a], at[b - 1] + 1
        out.append(text[done : max(a, done)])
        done = max(done, b)
    return "".join(out) + text[done:]


def without_leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_key, text): every document without the words of verified hits; all else stays as stored.

    Repeated rows stay repeated, null stays null.
    """
    spans = leaked_spans(docs, items, doc_key, item_key, text, n)
    # overlapping hits become one span before they are listed
    order = Window.partitionBy("__doc").orderBy("start", "stop")
    fresh = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = (
        spans.select(F.col(doc_key).alias("__doc"), "start", "stop").distinct()
        .withColumn("__island", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("__doc", "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .groupBy("__doc").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else without_spans(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(texts, spans)])

    joined = docs.select(doc_key, text).join(merged, F.col(doc_key).cast("bigint") == F.col("__doc"), "left")
    touched = joined.where("__spans IS NOT NULL").select(doc_key, cut(F.col(text), F.col("__spans")).alias(text))
    return joined.where("__spans IS NULL").select(doc_key, text).unionByName(touched)


def cleaned(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str) -> DataFrame:
    """(doc_key, keep): documents without any leaked item."""
    hit = leaked_spans(docs, items, doc_key, item_key).select(doc_key).distinct().withColumn("__hit", F.lit(True))
    return docs.select(doc_key).join(hit, doc_key, "left").select(doc_key, F.col("__hit").isNull().alias("keep"))

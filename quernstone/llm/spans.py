"""Problem 9: long exact passages shared between records.

Runs of whole sentences cannot give the required result: a shared passage may start and
end inside sentences.  So the spans slide over characters.  Each text is winnowed: of
any `length` characters at least one fingerprint is kept, the same one wherever they
stand.  Fingerprints are joined globally; only around repeated ones every window of
`length` characters is hashed (128 bits) and joined again.  The windows found in more
than one record are exactly the shared passages; their union is what is shared.  No pairs
of records are formed, so a passage in a third of all records costs what any other does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.rolling import Windows, code_points, sliding_min
from quernstone.session import stored

LENGTH = 150
#: So many hashed ids are broadcast to pick texts; with more, the join alone picks them.
BROADCAST_IDS = 1_000_000


def _prints(text: str, length: int, win: Windows) -> np.ndarray:
    k = length // 2
    h = win.of(win.prefix(code_points(text)), k)
    return np.unique(sliding_min(h, length - k + 1))


def shared_windows(docs: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """(id, start): every start of a window of ``length`` code points found in another record too.

    Null and shorter texts have none. ``key`` must be unique; repeated windows within one
    record do not count as shared.
    """
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where((F.length(text) >= length) & F.col(key).isNotNull())
    kind = source.schema["id"].dataType.simpleString()

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        win = Windows()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fps": [_prints(t, length, win).view(np.int64) for t in b["text"]]})

    listed = stored(source.mapInPandas(prints, f"id {kind}, fps array<bigint>"), "prints")
    marks = listed.select("id", F.explode("fps").alias("fp"))
    several = stored(marks.groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("fp"), "repeated")
    near = stored(marks.join(several, "fp", "left_semi").groupBy("id").agg(F.collect_list("fp").alias("fps")), "near")
    # few texts hold repeated fingerprints; their hashed ids, 8 bytes each, pick them before texts travel
    picked = near.select(F.xxhash64("id").alias("__h"))
    if picked.count() <= BROADCAST_IDS:
        source = source.withColumn("__h", F.xxhash64("id")).join(F.broadcast(picked), "__h", "left_semi").drop("__h")

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Windows(0), Windows(1)
        k = length // 2
        for b in batches:
            ids, starts, lows, highs = [], [], [], []
            for i, t, fps in zip(b["id"], b["text"], b["fps"]):
                points = code_points(t)
                p1, p2 = one.prefix(points), two.prefix(points)
                at = np.flatnonzero(np.isin(one.of(p1, k), np.asarray(fps, np.int64).view(np.uint64)))
                n = len(points) - length + 1
                edge = np.zeros(len(points) + 2, np.int64)
                np.add.at(edge, np.maximum(at - (length - k), 0), 1)
                np.add.at(edge, at + 1, -1)
                s = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                ids.append(np.repeat(np.asarray([i]), len(s)))
                starts.append(s)
                lows.append(one.of(p1, length)[s])
                highs.append(two.of(p2, length)[s])
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids), "start": np.concatenate(starts).astype(np.int32), "h1": np.concatenate(lows).view(np.int64), "h2": np.concatenate(highs).view(np.int64)})

    # one shuffle serves the count of each window and the choice of its rows
    windows = source.join(near, "id").mapInPandas(around, f"id {kind}, start int, h1 bigint, h2 bigint").repartition("h1", "h2")
    shared = windows.groupBy("h1", "h2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h1", "h2")
    return windows.join(shared.hint("shuffle_hash"), ["h1", "h2"], "left_semi").select("id", "start")


def shared_spans(docs: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """(key, n_chars, shared_chars, share, passages): for every record of ``docs``.

    passages: array<struct<start, stop>> in code points, maximal and in order, each covered
    by windows that stand in another record as well. Records with null text have null
    n_chars and share 0.0; empty text has share 0.0.
    """
    windows = shared_windows(docs, key, text, length)
    # consecutive starts form an island, so a passage is one row before anything is listed
    islands = (
        windows.distinct()
        .selectExpr("id", "start", "start - row_number() OVER (PARTITION BY id ORDER BY start) AS island")
        .groupBy("id", "island")
        .agg(F.min("start").alias("start"), (F.max("start") + F.lit(length)).alias("stop"))
    )
    listed = islands.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("x"))
    step = F.aggregate(
        "x",
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, p: F.when((F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= p["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), p["stop"].alias("stop"))))).otherwise(F.concat(done, F.array(p))),
    )
    merged = listed.select(F.col("id").alias(key), step.alias("passages"))
    n = F.length(text)
    sum_of = F.aggregate("passages", F.lit(0), lambda a, p: a + p["stop"] - p["start"])
    return (
        docs.select(key, n.alias("n_chars"))
        .join(merged, key, "left")
        .select(key, "n_chars", F.coalesce(sum_of, F.lit(0)).alias("shared_chars"), F.coalesce(F.when(F.col("n_chars") > 0, sum_of / F.col("n_chars")), F.lit(0.0)).alias("share"), F.coalesce("passages", F.array().cast("array<struct<start:int,stop:int>>")).alias("passages"))
    )


# ------------------------------------------------------------------ runs of whole sentences
_sentence_end = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the sentences of a text, in code points; line breaks part them too."""
    out, at = [], 0
    for m in _sentence_end.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    return out + [(at, len(text))] * (at < len(text))


def _runs(text: str, length: int) -> list[tuple[int, int, int, bytes]]:
    """(sentence, start, stop, digest) of the shortest run of sentences of ``length`` characters from each sentence on."""
    parts, out, j = sentences(text), [], 0
    for i, (a, _) in enumerate(parts):
        j = max(j, i)
        while j < len(parts) and parts[j][1] - a < length:
            j += 1
        if j == len(parts):
            break
        out.append((i, a, parts[j][1], blake2b(text[a : parts[j][1]].encode("utf-8", "surrogatepass"), digest_size=16).digest()))
    return out


def repeated_runs(docs: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """(id, sentence, start, stop, first): runs of whole sentences that stand in several places, verbatim.

    A run is the shortest of at least ``length`` characters from a sentence on; ``first`` is true where
    no smaller id, or earlier place of the same id, has it. Null and shorter texts have none. ``key`` must be unique.
    """
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where((F.length(text) >= length) & F.col(key).isNotNull())
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, t in zip(b["id"], b["text"]) for r in _runs(t, length)], columns=["id", "sentence", "start", "stop", "h"])

    found = source.mapInPandas(run, f"id {kind}, sentence int, start int, stop int, h binary").repartition("h")
    place = F.struct("id", "sentence")
    several = found.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h", "lo")
    return found.join(several.hint("shuffle_hash"), "h").select("id", "sentence", "start", "stop", (place == F.col("lo")).alias("first"))


def without_repeats(docs: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """(key, text): every record without the sentences that a non-first repeated run covers.

    What stands between two removed sentences goes too; null stays null, all else stays as stored.
    """
    cover = repeated_runs(docs, key, text, length).where("NOT first")
    order = Window.partitionBy("id").orderBy("start", "stop")
    fresh = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = (
        cover.select(F.col("id").alias("__id"), "id", "start", "stop")
        .withColumn("__island", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("__id", "__island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__cut"))
    )
    kept = F.aggregate("__cut", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda s, c: F.struct(F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, c["start"] - s["at"])).alias("out"), c["stop"].alias("at")), lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))))
    return docs.select(key, text).join(merged, F.col(key) == F.col("__id"), "left").select(key, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(kept).alias(text))

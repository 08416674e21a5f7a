"""Problem 6: one consistent form for text that looks the same.

The Spark operator explodes the stretches of a text that hold anything but plain ASCII
into positioned code points, joins them with the broadcast mapping table (decomposition,
look-alikes, invisible characters), orders combining marks by class, recomposes, and
rebuilds the strings.  Plain ASCII maps to itself, so it is carried along unexploded.
``fold_text`` is the same mapping for use inside Arrow batches of other operators.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.session import cut_lineage

# Letters of other scripts that look like a plain letter, in natural order.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "h", "Ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o",
    "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ѵ": "v", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ӏ": "l", "Ӏ": "I", "ү": "y", "ѡ": "w",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "Տ": "S", "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "զ": "q",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin beyond ASCII
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ꜱ": "s", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z",
    # Punctuation
    "‐": "-", "‑": "-", "﹣": "-", "ʼ": "’", "․": ".", "ꓸ": ".", "։": ":", "׃": ":", "∶": ":", "꞉": ":", "ǃ": "!",
}
#: Kinds of compatibility decomposition that keep the look.
_KEEPS_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>")
_LOOKS_DIFFERENT = "ſ"
_FILLERS = "͏ᅟᅠ឴឵᠎ㅤﾠ"
#: Stands for a joiner inside an emoji sequence, where removing it would change the look.
_JOINER = "﷐"
_EMOJI_JOIN = "(?<=[\\p{So}\U0001F3FB-\U0001F3FF\uFE0F])\u200D(?=\\p{So})"
_PLAIN = r"\t-\r\x20-\x7e"
STRETCH = f"[{_PLAIN}]?[^{_PLAIN}]+"


def _invisible(ch: str) -> bool:
    cat = U.category(ch)
    return cat == "Cf" or ch in _FILLERS or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or (cat == "Cc" and ch not in "\t\n\v\f\r\x85")


def _expand(ch: str) -> str:
    """What a code point stands for, decomposed."""
    if _invisible(ch):
        return ""
    if U.category(ch) == "Zs" and ch != " ":
        return " "
    kind, _, rest = U.decomposition(ch).partition(" ")
    if kind.startswith("<") and (kind not in _KEEPS_LOOK or ch in _LOOKS_DIFFERENT or rest.startswith("0020")):
        parts = ch
    else:
        parts = U.normalize("NFKD" if kind.startswith("<") else "NFD", ch)
    return "".join(LOOKALIKES.get(p, p) for p in parts)


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Every code point that does not stand for itself; its size is bounded by Unicode."""
    out = {}
    # ideographs and Hangul syllables stand for themselves
    for cp in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x1FC00), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        if (to := _expand(ch)) != ch:
            out[ch] = to
    for cp in (*range(0x09), *range(0x0E, 0x20), 0x7F):
        out[chr(cp)] = ""
    out[_JOINER] = "‍"
    return out


_table = lru_cache(1)(lambda: str.maketrans(mapping()))
_stretch = re.compile(STRETCH)
_emoji_join = lru_cache(1)(lambda: regex.compile(_EMOJI_JOIN))


@lru_cache(1 << 16)
def _fold_stretch(s: str) -> str:
    return U.normalize("NFC", U.normalize("NFD", s.translate(_table())))


def fold_text(text: str | None) -> str | None:
    """The text as seen; null stays null."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    if "‍" in text:
        text = _emoji_join().sub(_JOINER, text)
    return _stretch.sub(lambda m: _fold_stretch(m[0]), text)


def mapping_table(spark: SparkSession) -> DataFrame:
    """(ch, parts array<struct<ch, ccc>>): about twenty thousand rows, fixed by Unicode."""
    rows = [(ch, [(p, U.combining(p)) for p in to]) for ch, to in mapping().items()]
    rows += [(m, [(m, U.combining(m))]) for cp in range(0x300, 0x1F000) if U.combining(m := chr(cp)) and m not in mapping()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ch", "parts"]), "ch string, parts array<struct<ch:string,ccc:int>>")


@F.pandas_udf(T.StringType())
def _recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: U.normalize("NFC", x))


def is_plain(text: Column) -> Column:
    """Nothing but printable ASCII and line breaks: the text is its own form."""
    return ~text.rlike(f"[^{_PLAIN}]")


def seen_forms(texts: DataFrame) -> DataFrame:
    """(k, seen) of (k, text): every non-plain text as seen.

    k must be a function of the text (as its md5): repeated keys give one row. Texts that
    are null or plain are skipped, since they are their own form.
    """
    texts = texts.where(F.col("text").isNotNull() & ~is_plain(F.col("text"))).select("k", F.regexp_replace("text", _EMOJI_JOIN, _JOINER).alias("text"))
    stretches = texts.select("k", F.posexplode(F.regexp_extract_all("text", F.lit(STRETCH), F.lit(0))).alias("piece", "s")).dropDuplicates(["k", "piece"])
    points = stretches.select("k", "piece", F.posexplode(F.regexp_extract_all("s", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    mapped = points.join(F.broadcast(mapping_table(texts.sparkSession)), "ch", "left").select(
        "k", "piece", "pos", F.posexplode_outer(F.coalesce("parts", F.array(F.struct(F.col("ch"), F.lit(0).alias("ccc"))))).alias("sub", "part")
    )
    order = Window.partitionBy("k", "piece").orderBy("pos", "sub")
    at = F.struct("pos", "sub")
    starter = F.max(F.when(F.coalesce(F.col("part.ccc"), F.lit(0)) == 0, at)).over(order)
    ordered = mapped.withColumn("base", starter).select("k", "piece", F.struct("base", F.coalesce(F.col("part.ccc"), F.lit(0)).alias("ccc"), "pos", "sub", F.coalesce(F.col("part.ch"), F.lit("")).alias("ch")).alias("x"))
    rebuilt = ordered.groupBy("k", "piece").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list("x")), lambda x: x["ch"])).alias("s"))
    pieces = rebuilt.select("k", "piece", _recompose("s").alias("s")).groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("piece", "s"))), lambda x: x["s"]).alias("pieces"))
    once = texts.dropDuplicates(["k"])
    gaps = F.split("text", STRETCH, -1)
    return once.join(pieces, "k").select("k", F.concat_ws("", F.zip_with(gaps, "pieces", lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))).alias("seen"))


def with_seen(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``<column>_seen`` for each text column.

    Every row is kept as it is, repeated rows too. Null stays null, empty stays empty. Line
    breaks, the number of visible spaces, case and visible accents stay. Existing columns
    of the new names are replaced.
    """
    df = df.drop(*[f"{c}_seen" for c in columns])
    n = range(len(columns))
    plain = F.lit(True)
    for c in columns:
        plain = plain & F.coalesce(is_plain(F.col(c)), F.lit(True))
    untouched = df.where(plain).select("*", *[F.col(c).alias(f"{c}_seen") for c in columns])
    # only rows with something to fold are keyed and shuffled
    other = df.where(~plain).withColumn("__k", F.md5(F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in columns])))
    texts = other.select(F.explode(F.array(*[F.struct(F.concat("__k", F.lit(f":{i}")).alias("k"), F.col(c).alias("text")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    forms = seen_forms(texts).select(F.substring_index("k", ":", 1).alias("__k"), F.substring_index("k", ":", -1).cast("int").alias("i"), "seen")
    folded = forms.groupBy("__k").agg(*[F.max(F.when(F.col("i") == i, F.col("seen"))).alias(f"__s{i}") for i in n])
    joined = other.join(folded, "__k", "left").select(*df.columns, *[F.coalesce(f"__s{i}", c).alias(f"{c}_seen") for i, c in enumerate(columns)])
    return untouched.unionByName(joined)


def same_look(df: DataFrame, key: str, columns: list[str], long_column: str, least_words: int) -> DataFrame:
    """(key_a, key_b; a < b): different keys whose columns all look the same but are stored differently.

    Only rows whose ``long_column`` as seen has at least ``least_words`` words take part.
    Null and empty text look the same and count as stored the same. Forms are paired before
    rows are, so a large group of exact copies costs no comparison.
    """
    base = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *[F.coalesce(F.col(c), F.lit("")).alias(f"t{i}") for i, c in enumerate(columns)])
    n = range(len(columns))
    long = columns.index(long_column)
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    base = base.withColumn("stored", F.md5(F.concat_ws("\x00", *[f"t{i}" for i in n])))
    look = lambda hashes: F.md5(F.concat_ws(",", *hashes))
    dirty = [~is_plain(F.col(f"t{i}")) for i in n]
    plain = ~F.greatest(*dirty)
    narrow = base.select("id", "stored", plain.alias("plain"), *[F.md5(f"t{i}").alias(f"h{i}") for i in n], words(F.col(f"t{long}")).alias("words"))
    # a text's key is that of its row and its column, so what is folded needs no look-up
    texts = base.where(~plain).select(F.explode(F.array(*[F.struct(F.concat("stored", F.lit(f":{i}")).alias("k"), F.col(f"t{i}").alias("text")) for i in n])).alias("x")).select("x.*")
    forms = seen_forms(texts).select(F.substring_index("k", ":", 1).alias("stored"), F.substring_index("k", ":", -1).cast("int").alias("i"), F.md5("seen").alias("h"), words(F.col("seen")).alias("w"))
    folded = forms.groupBy("stored").agg(*[F.max(F.when(F.col("i") == i, F.col("h"))).alias(f"f{i}") for i in n], F.max(F.when(F.col("i") == long, F.col("w"))).alias("w"))
    same = narrow.where("plain").select("id", "stored", "words", look([f"h{i}" for i in n]).alias("look"))
    other = narrow.where("NOT plain").join(folded, "stored", "left").select("id", "stored", F.coalesce("w", "words").alias("words"), look([F.coalesce(f"f{i}", f"h{i}") for i in n]).alias("look"))
    rows = cut_lineage(same.unionByName(other).where(F.col("words") >= least_words).select("id", "look", "stored").distinct())
    shapes = rows.select("look", "stored").distinct()
    several = shapes.alias("x").join(shapes.alias("y"), (F.col("x.look") == F.col("y.look")) & (F.col("x.stored") < F.col("y.stored"))).select(F.col("x.stored").alias("sa"), F.col("y.stored").alias("sb"))
    a = rows.select(F.col("id").alias("ia"), F.col("stored").alias("sa"))
    b = rows.select(F.col("id").alias("ib"), F.col("stored").alias("sb"))
    return several.join(a, "sa").join(b, "sb").where(F.col("ia") != F.col("ib")).select(F.least("ia", "ib").alias(f"{key}_a"), F.greatest("ia", "ib").alias(f"{key}_b")).distinct()

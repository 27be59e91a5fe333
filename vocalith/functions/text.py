"""Column expressions over transcripts and paths (T1-T17) and the table jobs that apply them.

All of them are built-in expressions; only NFKC, for rows outside ASCII and the German letters, is an Arrow UDF. Null
text behaves like a missing key: it normalises to ''.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: English number words.
ONES = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SPACE = r"(?U)\s+"
ERROR = "__ERROR__:"


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm_raw(c: Column) -> Column:
    """Strip."""
    return _strip(_given(c))


def _markers(c: Column) -> Column:
    """Lower case without markers; a text without their signs, as most are, is not searched for them."""
    t = F.lower(_given(c))
    t = F.when(F.contains(c, F.lit("<")), F.regexp_replace(t, r"<[^>]+>", " ")).otherwise(t)
    return F.when(F.contains(c, F.lit("+")), F.regexp_replace(t, r"\+[^+]*\+", " ")).otherwise(t)


def norm_basic(c: Column) -> Column:
    """Lower case, without <..> and +..+ markers, letters a-z, digits, apostrophes and single spaces only."""
    return _squeeze(F.regexp_replace(_markers(c), r"(?U)[^a-z0-9'\s]", " "))


def int_to_english_words(n: Column) -> Column:
    """T4: 0 to 9999 in words, larger numbers as digits; null stays null."""
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))

    def under_100(x: Column) -> Column:
        unit = F.when(x % 10 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.get(ones, (x % 10).cast("int"))))
        return F.when(x < 20, F.get(ones, x.cast("int"))).otherwise(F.concat(F.get(tens, F.floor(x / 10).cast("int") - 2), unit))

    def above(x: Column, base: int, name: str, rest: Callable[[Column], Column]) -> Column:
        head = F.concat(F.get(ones, F.floor(x / base).cast("int")), F.lit(f" {name}"))
        return F.when(x % base == 0, head).otherwise(F.concat(head, F.lit(" "), rest(x % base)))

    hundreds = lambda x: F.when(x < 100, under_100(x)).otherwise(above(x, 100, "hundred", under_100))
    return F.when(n < 1000, hundreds(n)).when(n < 10000, above(n, 1000, "thousand", hundreds)).otherwise(n.cast("string"))


def norm_basic_num(c: Column) -> Column:
    """T2 with standing numbers in words first; numbers from 10000 on lose leading zeros only."""
    mark = "\x01"
    parts = F.split(F.regexp_replace(F.translate(_markers(c), mark, " "), r"(?U)\b(\d+)\b", f"{mark}$1{mark}"), mark, -1)

    def word(x: Column) -> Column:
        n = x.try_cast("bigint")
        digits = F.regexp_replace(x, r"^0+(?=.)", "")
        return F.when(n < 10000, int_to_english_words(n)).otherwise(digits)

    spoken = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, word(x)).otherwise(x)), "")
    return _squeeze(F.regexp_replace(spoken, r"(?U)[^a-z0-9'\s]", " "))


def norm_light(c: Column) -> Column:
    """T5: lower case and single spaces; punctuation and diacritics stay."""
    return _strip(F.regexp_replace(F.lower(_given(c)), SPACE, " "))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def norm_german(c: Column, compose: bool = True) -> Column:
    """Lower case, NFKC, ss for ß, ae/oe/ue for umlauts, letters a-z, digits and single spaces only.

    Texts of ASCII and German letters, which NFKC leaves as they are, stay in the JVM; Python is given the others only.
    compose=False leaves NFKC out, for text known to be composed.
    """
    t = F.lower(_given(c))
    if compose:
        plain = t.rlike(r"\A[\x00-\x7fßäöü]*\z")
        t = F.when(plain, t).otherwise(_nfkc(F.when(~plain, t)))
    for a, b in (("ß", "ss"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return _squeeze(F.regexp_replace(t, r"(?U)[^a-z0-9\s]", " "))


def norm_polish(c: Column) -> Column:
    """Lower case, without <..> markers, Unicode word characters, apostrophes and single spaces; hyphens part words."""
    t = F.regexp_replace(F.lower(_given(c)), r"<[^>]+>", " ")
    return _squeeze(F.translate(F.regexp_replace(t, r"(?U)[^\w'\s-]", " "), "-", " "))


MODES: dict[str, Callable[[Column], Column]] = {
    "raw": norm_raw, "basic": norm_basic, "basic_num": norm_basic_num, "light": norm_light, "german": norm_german, "polish": norm_polish,
}


def words(c: Column) -> Column:
    """White-space tokens; none for an empty text."""
    return F.array_remove(F.split(_given(c), SPACE), "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def first_word(c: Column) -> Column:
    """The first token or ''."""
    return F.coalesce(F.get(words(c), 0), F.lit(""))


def canonical_word(df: DataFrame, word: str, dictionary: DataFrame, to: str) -> DataFrame:
    """Df with the dictionary's (token, canonical) form of a column, itself where the dictionary has none."""
    d = dictionary.select(F.col("token").alias("_token"), F.col("canonical").alias("_canonical"))
    return df.join(d, F.col(word) == F.col("_token"), "left").withColumn(to, F.coalesce("_canonical", word)).drop("_token", "_canonical")


def inverse_dictionary(dictionary: DataFrame) -> DataFrame:
    """Canonical -> the sorted set of its tokens and itself."""
    return dictionary.groupBy("canonical").agg(F.collect_set("token").alias("t")).select("canonical", F.array_sort(F.array_union("t", F.array("canonical"))).alias("tokens"))


def basename(path: Column) -> Column:
    """T14."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1)


#: Manifest fields that name a speaker, in order.
SPEAKER_FIELDS = ["speaker", "speaker_id", "spk_id", "client_id", "speaker_id_original"]


def speaker_of(df: DataFrame, dataset: Column, unknown_is_missing: bool = True, path: str = "audio_filepath") -> Column:
    """The first explicit speaker field, else the rule of the dataset on the path.

    First field between '-' (librispeech), second between '_' (myst), first between '_' (jasmin, kidstalc), grandparent
    folder (pavsig), else the stem. With unknown_is_missing "unknown" counts as absent.
    """
    gone = ["", "unknown"] if unknown_is_missing else [""]
    fields = [F.when(~F.col(f).cast("string").isin(gone), F.col(f).cast("string")) for f in SPEAKER_FIELDS if f in df.columns]
    s, parts = stem(F.col(path)), F.filter(F.split(path, "/"), lambda x: x != "")
    depth = F.size(parts) + F.when(F.startswith(F.col(path), F.lit("/")), 1).otherwise(0)
    rule = (
        F.when(dataset == "librispeech", F.get(F.split(s, "-"), 0))
        .when(dataset == "myst", F.coalesce(F.get(F.split(s, "_"), 1), s))
        .when(dataset.isin("jasmin", "kidstalc"), F.get(F.split(s, "_"), 0))
        .when(dataset == "pavsig", F.when(depth >= 3, F.coalesce(F.get(parts, F.size(parts) - 3), F.lit(""))).otherwise(s))
        .otherwise(s)
    )
    return F.coalesce(*fields, rule)


def speaker_from_dir(path: Column, levels: int) -> Column:
    """The folder so many levels above the file, or 'unknown'."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.coalesce(F.get(parts, F.size(parts) - 1 - levels), F.lit("unknown"))


def path_candidates(path: Column) -> Column:
    """Ordered distinct spellings of an audio path under which an archive may hold it."""
    raw = F.translate(norm_raw(path), "\\", "/")
    bare = lambda x: F.regexp_replace(x, "^/+", "")

    def after(mark: str) -> list[Column]:
        rest = F.when(F.contains(raw, F.lit(mark)), F.substring(raw, F.locate(mark, raw) + len(mark), F.length(raw)))
        return [rest, bare(rest), basename(rest)]

    found = F.array(raw, bare(raw), basename(raw), *after(".tar/"), *after("::"), *after(".tar:"))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "")))


def hyp_to_text(hyp: Column, error: Column) -> Column:
    """The hypothesis, or the marked error that stands for it."""
    return F.coalesce(hyp, F.concat(F.lit(ERROR), error))


def normalize_transcripts(df: DataFrame, columns: list[str], mode: str | Callable[[Column], Column] = "basic_num") -> DataFrame:
    """replace the columns by their normal form, under a named mode or any Column -> Column function."""
    fn = MODES[mode] if isinstance(mode, str) else mode
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def attach_speaker(df: DataFrame, dataset: str = "dataset", unknown_is_missing: bool = True) -> DataFrame:
    return df.withColumn("speaker", speaker_of(df, F.col(dataset), unknown_is_missing))

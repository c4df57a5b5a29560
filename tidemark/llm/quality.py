"""Quality rules: one table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, no_null

#: Symbols counted as such.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was as with be by on not he his but at are this have from or had an they you we "
    "der die das und ist nicht ein eine zu mit den von für auf im dem sich des als auch "
    "le la les de et est un une que qui dans pour pas sur au avec du "
    "el los las y en por con para se del su al lo como más"
).split()
WINDOW = 8


class Rule(NamedTuple):
    """A text fails where ``low * per > amount`` or ``amount > high * per`` (amounts scaled by 1000)."""

    name: str
    amount: str
    per: str
    low: int | None
    high: int | None


#: Thresholds in thousandths of the divisor.
RULES = [
    Rule("word_length", "word_chars", "n_words", 2000, 15000),
    Rule("symbols", "n_symbols", "n_words", None, 200),
    Rule("shouting", "n_shouts", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 50, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
]


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text; windows meet by a hash of word hashes."""
    def covered(windows: Column) -> Column:
        def count(ordered: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            starts = F.sort_array(F.transform(F.filter(
                F.transform(ordered, lambda x, i: F.struct(
                    x["i"].alias("i"), (same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1))).alias("twice"))),
                lambda x: x["twice"]), lambda x: x["i"]))
            return let(starts, lambda s: F.aggregate(
                F.transform(s, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - v, F.lit(WINDOW)))),
                F.lit(0).cast("long"), lambda a, b: a + b))

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(ordered, count))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(
        F.slice(h, F.lit(1), F.size(h) - (WINDOW - 1)),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def measures(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns named in ``keep`` and the counts of every whole text that the rules divide."""
    body = no_null(text)
    words = F.filter(F.split(body, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.filter("words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(STOP_WORDS))
    out = documents.select(*[F.col(f"`{c}`") for c in keep or []], body.alias("body"), words.alias("words"),
                           lines.alias("lines"))
    count = lambda c: F.size(c).cast("long")
    return out.select(
        *[F.col(f"`{c}`") for c in keep or []],
        count("words").alias("n_words"),
        F.length(F.regexp_replace("body", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (count("lines") - count(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        count("lines").alias("n_lines"),
        count(F.filter("words", lambda w: w.endswith("!!"))).alias("n_shouts"),
        count(stop).alias("n_stop_words"),
    )


def passes(rules: list[Rule] = RULES) -> Column:
    """The table of thresholds as one condition; whole numbers only, so every engine decides alike."""
    out = F.lit(True)
    for rule in rules:
        amount, per = F.col(rule.amount) * 1000, F.col(rule.per)
        if rule.low is not None:
            out = out & (amount >= rule.low * per)
        if rule.high is not None:
            out = out & (amount <= rule.high * per)
    return out


def quality_flags(documents: DataFrame, text: str = "text", keep: list[str] | None = None,
                  rules: list[Rule] = RULES) -> DataFrame:
    """``keep`` columns, the counts, ``base_failed`` and ``kept`` of every row; no row is dropped here.

    A null text counts as an empty one: no words, so it fails the base rule. A text of 20 words or more is kept if no
    rule of the table fails. Equal texts get equal verdicts; columns not named in ``keep`` are not looked at, and an
    empty table gives no rows. A name in ``keep`` that is also a count's name is not allowed.
    """
    keep = ["doc_id"] if keep is None else keep
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return (measures(documents, text, keep).withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & passes(rules)))


def accepted(documents: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """The rows that are kept, with all their columns, whatever those are called."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("record"), F.col(f"`{text}`").alias("text"))
    return quality_flags(packed, "text", ["record"], rules).filter("kept").select("record.*")

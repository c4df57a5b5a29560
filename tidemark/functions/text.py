"""Text helpers: title keys, tokens, disclosure classes, secrets, headline scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First match wins.
DISCLOSURE_CLASSES = [
    ("provisional", r"(?i)provisional|잠정"),
    ("buyback", r"(?i)treasury|자기주식"),
    ("dividend", r"(?i)dividend|배당"),
    ("periodic", r"(?i)quarterly|annual|분기보고서|사업보고서"),
]


def title_key(t: Column) -> Column:
    """Lower case, digits, Latin letters and Hangul only."""
    return F.regexp_replace(F.lower(t), r"[^0-9a-z\x{AC00}-\x{D7A3}]+", "")


def first_class(t: Column, classes) -> Column:
    """Label of the first matching pattern, empty when none matches."""
    out = F
    for label, pattern in classes:
        out = out.when(t.rlike(pattern), label)
    return out.otherwise("")


def term_score(t: Column, name: str, relevant, noise) -> Column:
    """3 for the name, +2 per relevant word (any case), -2 per noise word."""
    score = F.when(t.contains(name), 3).otherwise(0)
    for w in relevant:
        score = score + F.when(F.lower(t).contains(w.lower()), 2).otherwise(0)
    for w in noise:
        score = score - F.when(t.contains(w), 2).otherwise(0)
    return score


SECRET_WORDS = r"(?i)(api[_-]?key|secret|token|passwd|password|authorization)"


def mask_secrets(t: Column) -> Column:
    """URLs and key parameters masked; a text that still names a secret is dropped whole."""
    masked = F.regexp_replace(t, r"https?://\S+", "<url>")
    masked = F.regexp_replace(masked, r"(?i)\b(key|crtfc_key|api_key|token|secret|serviceKey)=[^&\s]+", "<masked>")
    return F.when(masked.rlike(SECRET_WORDS), "<withheld>").otherwise(masked)


def fingerprint(t: Column, n: int = 8) -> Column:
    return F.left(F.sha2(t, 256), F.lit(n))

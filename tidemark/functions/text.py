"""Text columns: tokens, folding, escaping, transcript lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .times import col, ms_to_hms

# Token characters (letters, numbers, private use; marks continue a token).
TOKEN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*"
# Characters stripped from the front of a text before the blocklist test.
LEADING = "\"'«»„“”-–— "
# Openings that mark a row as recogniser boilerplate.
BLOCKLIST = ("Teksting av", "Takk for at du så på", "Thank you for watching")
# Fixed value: a word that ends a sentence.
SENTENCE_END = r"""[.!?…]["'»”)]?\s*$"""
_WS = " \t\n\r\f\x0b"


def strip(text: Column | str) -> Column:
    return F.btrim(col(text), F.lit(_WS))


def fold(text: Column | str) -> Column:
    """Case folding: lower case, and sharp s as `ss`."""
    return F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))


def fold_term(term: str) -> str:
    return term.lower().replace("ß", "ss")


def contains_folded(text: Column | str, term: str) -> Column:
    return F.contains(fold(text), F.lit(fold_term(term)))


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens in order; diacritics are significant."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def phrase_tokens(term: str) -> list[str]:
    """The tokens of one whitespace-separated query term; several make a phrase."""
    import unicodedata

    out: list[str] = []
    inside = False
    for ch in term.lower():
        cat = unicodedata.category(ch)
        if cat[0] in "LN" or cat == "Co":
            if inside:
                out[-1] += ch
            else:
                out.append(ch)
            inside = True
        elif cat[0] == "M" and inside:
            out[-1] += ch
        else:
            inside = False
    return out


def phrase_count(token_array: Column, phrase: list[str]) -> Column:
    """How often consecutive tokens equal the phrase.

    Tokens are laid out with a space of their own on either side, so hits cannot share one, and the
    count is the length a plain replace takes away; only a phrase that can overlap itself needs a
    pattern.
    """
    laid = F.concat(F.lit(" "), F.array_join(token_array, "  "), F.lit(" "))
    needle = " " + "  ".join(phrase) + " "
    if any(phrase[:k] == phrase[-k:] for k in range(1, len(phrase))):
        return overlapping_count(laid, needle)
    gone = F.octet_length(laid) - F.octet_length(F.replace(laid, F.lit(needle), F.lit("")))
    return F.when(F.array_contains(token_array, phrase[0]),
                  F.call_function("div", gone, F.lit(len(needle.encode())))).otherwise(0)


def overlapping_count(text: Column, term: str) -> Column:
    """Occurrences of a literal, overlaps included, in one pass."""
    quoted = "".join("\\" + c if re.match(r"[^\w\s]", c, re.ASCII) and ord(c) < 128 else c for c in term)
    # The substring test is far cheaper than the pattern and settles most rows.
    return F.when(F.contains(text, F.lit(term)), F.regexp_count(text, F.lit(f"(?={quoted})"))).otherwise(0)


def normalise_opening(text: Column | str) -> Column:
    return F.lower(F.ltrim(strip(text), F.lit(LEADING)))


def is_boilerplate(text: Column | str, blocklist=BLOCKLIST) -> Column:
    head = normalise_opening(text)
    out = F.lit(False)
    for b in blocklist:
        if b.strip():
            out = out | F.startswith(head, F.lit(b.strip().lstrip(LEADING).lower()))
    return out


def join_tokens(token_array: Column) -> Column:
    """Tokens joined so that exactly the missing spaces are added, then trimmed."""
    def step(acc: Column, tok: Column) -> Column:
        glue = (acc != "") & ~F.startswith(tok, F.lit(" ")) & ~F.endswith(acc, F.lit(" "))
        return F.concat(acc, F.when(glue, " ").otherwise(""), tok)

    return strip(F.aggregate(token_array, F.lit(""), step))


def transcript_line(start_ms: Column | str, channel: Column | str, lang: Column | str, text: Column | str) -> Column:
    """`[HH:MM:SS] text`, with `(channel lang) ` before the text off the ambient channel."""
    mark = F.when(col(channel) == "ambient", "").otherwise(
        F.concat(F.lit("("), col(channel), F.lit(" "), F.coalesce(col(lang), F.lit("None")), F.lit(") ")))
    return F.concat(F.lit("["), ms_to_hms(start_ms), F.lit("] "), mark, col(text))


def yaml_string(text: Column | str) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(col(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                      F.lit('"'))
    return F.coalesce(quoted, F.lit("null"))


def label_value(text: Column | str) -> Column:
    c = F.replace(F.replace(col(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def ends_sentence(text: Column | str) -> Column:
    return col(text).rlike(SENTENCE_END)

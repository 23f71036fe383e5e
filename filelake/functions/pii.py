"""Personal-data types by rule, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class PiiRule(NamedTuple):
    """``languages`` empty means any language. A validator narrows what the pattern finds.

    A text without any of the lower-case words that the pattern ``needs`` is not searched, nor
    one without ``sign``, a short pattern that lies in whatever the pattern finds.
    """

    entity_type: str
    pattern: str
    languages: tuple[str, ...] = ()
    validator: str | None = None
    needs: tuple[str, ...] = ()
    sign: str = ""


# What texts are looked through for before any rule is tried.
_DIGIT, _DIGITS, _AT, _COLON, _SCHEME = "[0-9]", "[0-9]{3}", "@", ":", "://"

# Fixed values. No look-around and no back-references, so that any engine can run them.
PII_RULES = [
    PiiRule("CREDIT_CARD", r"\b[0-9]{4}[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}[ -]?[0-9]{3,5}\b", validator="luhn", sign=_DIGITS),
    PiiRule("CREDIT_CARD", r"\b3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4}\b", validator="luhn", sign=_DIGITS),
    PiiRule("CRYPTO", r"\b(?:bc1[ac-hj-np-z02-9]{25,71}|0x[0-9A-Fa-f]{40})\b", sign=_DIGIT),
    PiiRule("CRYPTO", r"\b[13][1-9A-HJ-NP-Za-km-z]{25,34}\b", validator="base58", sign=_DIGIT),
    PiiRule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", sign=_AT),
    PiiRule(
        "IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", validator="mod97", sign=_DIGIT
    ),
    PiiRule(
        "IP_ADDRESS",
        r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
        sign=_DIGIT,
    ),
    PiiRule("IP_ADDRESS", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", sign=_COLON),
    PiiRule("IP_ADDRESS", r"\b(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b", sign=_COLON),
    PiiRule("PHONE_NUMBER", r"(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b", sign=_DIGITS),
    PiiRule("URL", r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}", sign=_SCHEME),
    PiiRule("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", ("en",), sign=_DIGITS),
    PiiRule("US_ITIN", r"\b9[0-9]{2}[ -](?:5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])[ -][0-9]{4}\b", ("en",), sign=_DIGITS),
    PiiRule("UK_NHS", r"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}\b", ("en",), validator="mod11", sign=_DIGITS),
    # Numbers without a form of their own count after the word that says what they are.
    PiiRule("US_PASSPORT", r"(?i:passport)[^\n]{0,30}?\b(?:[A-Z][0-9]{8}|[0-9]{9})\b", ("en",), needs=("passport",), sign=_DIGITS),
    PiiRule("US_BANK_NUMBER", r"(?i:bank|account|acct)[^\n]{0,30}?\b[0-9]{8,17}\b", ("en",), needs=("bank", "account", "acct"), sign=_DIGITS),
    PiiRule("US_DRIVER_LICENSE", r"(?i:driver.{0,3} licen[cs]e)[^\n]{0,30}?\b[A-Z][0-9]{4,14}\b", ("en",), needs=("driver",), sign=_DIGITS),
    PiiRule("ES_NIF", r"\b[0-9]{8}[A-HJ-NP-TV-Z]\b", ("es",), sign=_DIGITS),
    PiiRule("FR_NIR", r"\b[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}\b", ("fr",), sign=_DIGITS),
]


def _luhn(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[ -]", ""))


def _mod97(value: Column) -> Column:
    """ISO 7064 check: the first four signs go to the end, letters count from 10."""
    plain = F.regexp_replace(value, " ", "")
    signs = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    step = lambda rest, c: F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0), step) == 1


def _mod11(value: Column) -> Column:
    """Ten digits weighed from ten down to one."""
    digits = F.regexp_replace(value, "[ -]", "")
    weighed = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (F.lit(11) - i))
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 11 == 0


_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _base58(value: Column) -> Column:
    """A Bitcoin address: 25 bytes in base 58, of which the last four begin the double SHA-256 of the others."""
    empty = F.array_repeat(F.lit(0), 25)

    def times58(carry_and_bytes: Column, byte: Column) -> Column:
        total = byte * 58 + carry_and_bytes["carry"]
        return F.struct((total / 256).cast("int").alias("carry"), F.array_append(carry_and_bytes["bytes"], total % 256).alias("bytes"))

    def step(low_first: Column, sign: Column) -> Column:
        start = F.struct((F.call_function("locate", sign, F.lit(_BASE58)) - 1).alias("carry"), F.array().cast("array<int>").alias("bytes"))
        return F.aggregate(low_first, start, times58)["bytes"]

    signs = F.filter(F.split(value, ""), lambda c: c != "")
    # The lowest byte first; what does not fit into 25 bytes fails the check anyway.
    data = F.reverse(F.aggregate(signs, empty, step))
    text = F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b), 2, "0")), "")
    body = F.unhex(F.substring(text, 1, 42))
    check = F.sha2(F.unhex(F.sha2(body, 256)), 256)
    return F.lower(F.substring(text, 43, 8)) == F.substring(check, 1, 8)


_VALIDATORS = {"mod11": _mod11, "base58": _base58, "luhn": _luhn, "mod97": _mod97}


def _hit(text: Column, rule: PiiRule) -> Column:
    if rule.needs:
        words = reduce(or_, [F.lower(text).contains(w) for w in rule.needs])
        return words & _hit(text, rule._replace(needs=()))
    if rule.validator is None:
        return text.rlike(rule.pattern)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    valid = F.exists(found, _VALIDATORS[rule.validator])
    # The cheap test first: most texts have no candidate at all.
    return text.rlike(rule.pattern) & valid


def pii_types(
    text: Column, languages: Iterable[str] = ("en",), rules: Iterable[PiiRule] | None = None
) -> Column:
    """Sorted types found in the whole text, NULL if there are none."""
    wanted = set(languages)
    chosen = [r for r in (PII_RULES if rules is None else rules) if not r.languages or wanted & set(r.languages)]
    found = []
    for sign in dict.fromkeys(r.sign for r in chosen):
        hits = F.array(*[F.when(_hit(text, r), F.lit(r.entity_type)) for r in chosen if r.sign == sign])
        # Rules are tried on the few texts with their sign, which is sought once for all of them.
        found.append(F.when(text.rlike(sign), hits).otherwise(F.array().cast("array<string>")) if sign else hits)
    names = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*found)))))
    return F.when(F.size(names) > 0, names)


def is_scannable(mime: Column, content: Column) -> Column:
    """Media files are never scanned; others when text was extracted or the type is text."""
    media = mime.startswith("image") | mime.startswith("video") | mime.startswith("audio")
    return ~F.coalesce(media, F.lit(False)) & (content.isNotNull() | F.coalesce(mime.startswith("text/"), F.lit(False)))

"""Predicates and masks as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types in the order that settles ties, patterns, words in a column's name that raise a type by ten points,
# and the words of an address.
PII_TYPES = ("EMAIL", "PHONE", "POSSIBLE_ID", "POSSIBLE_PAN", "IP", "POSSIBLE_NAME", "POSSIBLE_ADDRESS")
EMAIL = r"\A[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\z"
ID12 = r"\A\d{4}\s?\d{4}\s?\d{4}\z"
PAN = r"\A[A-Z]{5}[0-9]{4}[A-Z]\z"
NAME_HINTS = {
    "EMAIL": ("email", "mail", "e-mail"),
    "PHONE": ("phone", "mobile", "contact", "cell", "tel"),
    "POSSIBLE_ID": ("aadhaar", "aadhar", "uid", "uidai"),
    "POSSIBLE_PAN": ("pan",),
    "IP": ("ip_address", "ipaddr", "ip"),
    "POSSIBLE_NAME": ("name",),
    "POSSIBLE_ADDRESS": ("address", "addr", "street", "location"),
}
ADDRESS_WORDS = (
    "street", "st.", "road", "rd.", "lane", "ln.", "avenue", "ave",
    "nagar", "colony", "sector", "block", "apartment", "apt", "floor",
    "marg", "chowk", "circle", "layout", "society", "phase",
)

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"\A{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_WORD = r"[A-Za-z][A-Za-z'.\-]*"
NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyyMMdd", "yyyy")


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def has_outer_space(c: Column) -> Column:
    return c.rlike(r"(?U)\A\s|\s\z")


def has_special(c: Column) -> Column:
    return c.rlike(r"(?U)[^a-zA-Z0-9\s]")


def is_numeric_like(c: Column) -> Column:
    s = strip(c)
    return c.rlike(r"[0-9]|[iI][nN][fF]") & (s.rlike(NUMBER) | F.lower(s).rlike(r"\A[+-]?inf(inity)?\z"))


def _digits_of_phone(c: Column) -> Column:
    d = F.regexp_replace(c, r"[\s\-()]", "")
    return F.when(d.startswith("+91"), F.substring(d, 4, 10**6)).when(d.startswith("91") & (F.length(d) == 12), F.substring(d, 3, 10**6)).when(d.startswith("+"), F.substring(d, 2, 10**6)).otherwise(d)


def is_phone(c: Column) -> Column:
    return _digits_of_phone(c).rlike(r"\A([6-9]\d{9}|\d{10,13})\z")


def matches(c: Column) -> dict[str, Column]:
    """One predicate per PII type over stripped text. What a match can't lack is looked for before the pattern runs."""
    words = "|".join(w.replace(".", r"\.") for w in ADDRESS_WORDS)
    return {
        "EMAIL": c.contains("@") & c.rlike(EMAIL),
        "PHONE": (F.length(c) >= 10) & is_phone(c),
        "POSSIBLE_ID": F.length(c).between(12, 14) & c.rlike(ID12),
        "POSSIBLE_PAN": (F.length(c) == 10) & c.rlike(PAN),
        "IP": F.length(c).between(7, 15) & c.rlike(IP),
        "POSSIBLE_NAME": (F.length(c) <= 40) & c.rlike(rf"\A{_WORD}(\s+{_WORD}){{1,3}}\z"),
        "POSSIBLE_ADDRESS": (F.length(c) >= 8) & c.rlike(r"\d") & (F.lower(c).rlike(words) | c.contains(",")),
    }


def matches_integer(x: Column) -> dict[str, Column]:
    """The same for the decimal digits of an integer: 10 to 13 of them make a phone number, 12 without a sign an id."""
    no = F.lit(False)
    return {k: no for k in PII_TYPES} | {"PHONE": x.between(10**9, 10**13 - 1) | x.between(1 - 10**13, -(10**9)), "POSSIBLE_ID": x.between(10**11, 10**12 - 1)}


def mask(c: Column, kind: str, char: str = "*") -> Column:
    """Masks non-null values of a PII type; null stays null."""
    s = strip(c.cast("string"))
    star = lambda n: F.repeat(F.lit(char), F.greatest(n, F.lit(0)).cast("int"))
    every = star(F.length(s))
    if kind == "EMAIL":
        at = F.instr(s, "@")
        out = F.when(at > 1, F.concat(F.substring(s, 1, 1), star(F.greatest(at - 2, F.lit(1))), F.substring(s, at, F.length(s)))).when(at == 1, F.concat(F.lit(char), s)).otherwise(every)
    elif kind == "PHONE":
        d = F.regexp_replace(s, r"\D", "")
        out = F.when(F.length(d) >= 4, F.concat(F.substring(d, 1, 2), star(F.length(d) - 4), F.right(d, F.lit(2)))).otherwise(every)
    elif kind == "POSSIBLE_ID":
        d = F.regexp_replace(s, r"\D", "")
        out = F.when(F.length(d) >= 4, F.concat(star(F.length(d) - 4), F.right(d, F.lit(4)))).otherwise(every)
    elif kind == "POSSIBLE_PAN":
        out = F.when(F.length(s) >= 3, F.concat(F.substring(s, 1, 2), star(F.length(s) - 3), F.right(s, F.lit(1)))).otherwise(every)
    elif kind == "IP":
        out = F.when(s.contains("."), F.concat(F.regexp_replace(s, r"\.[^.]*\z", "."), F.lit(char * 3))).otherwise(every)
    elif kind == "POSSIBLE_NAME":
        out = F.array_join(F.transform(F.split(s, r"\s+"), lambda w: F.concat(F.substring(w, 1, 1), star(F.length(w) - 1))), " ")
    elif kind == "POSSIBLE_ADDRESS":
        out = F.lit("[REDACTED ADDRESS]")
    else:
        out = every
    return F.when(c.isNotNull(), out)


def parses_as_date(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS)).isNotNull()

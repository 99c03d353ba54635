"""Identifiers and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tickers that other sources write differently.
TICKER_ALIASES = {"BRK.B": "BRK-B", "BRK.A": "BRK-A", "BRK/B": "BRK-B", "BRK/A": "BRK-A", "LLIVE": "LLYVK", "YY": "JOYY"}

# Legal forms that names are compared without.
LEGAL_FORMS = r"(?i)\b(INC|CORP|CORPORATION|CO|COMPANY|HOLDINGS|HLDGS|GROUP|PLC|LTD|LLC|CL A|CL B|COM|SER [A-Z])\b\.?"

# Abbreviations in issuers' names.
ABBREVIATIONS = {"AIRLS": "AIRLINES", "CONTL": "CONTINENTAL", "COMM": "COMMUNICATIONS", "INTL": "INTERNATIONAL", "ENTMT": "ENTERTAINMENT", "BK": "BANK", "MTRS": "MOTORS", "WHSL": "WHOLESALE", "COS": "COMPANIES", "SYS": "SYSTEMS", "HLDG": "HOLDING", "HLDGS": "HOLDINGS"}


def _mapped(c: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), c)


def ticker(c: Column) -> Column:
    """Trimmed, in upper case and by its usual name; null if nothing is left."""
    raw = F.upper(F.trim(c))
    return _mapped(F.when(raw != "", raw), TICKER_ALIASES)


def cik(c: Column) -> Column:
    """The digits without leading zeros; null if they are none or zero."""
    digits = F.ltrim(F.regexp_replace(c.cast("string"), r"\D", ""), F.lit("0"))
    return F.when(digits != "", digits)


def cik10(c: Column) -> Column:
    """The digits in ten places; longer ones stay whole."""
    d = cik(c)
    return F.when(F.length(d) < 10, F.lpad(d, 10, "0")).otherwise(d)


def cusip(c: Column) -> Column:
    """Letters and digits in upper case; digits alone fill nine places."""
    x = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(x.rlike(r"^\d+$") & (F.length(x) < 9), F.lpad(x, 9, "0")).otherwise(x)


def english_name(c: Column) -> Column:
    """A name without legal forms."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, LEGAL_FORMS, ""), r"\s+", " "))


def issuer_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(english_name(c)), "[^A-Z0-9 ]", "")


def issuer_match_key(c: Column) -> Column:
    """A key under which spellings of an issuer's name meet: without states and NEW, abbreviations spelled out."""
    base = F.trim(F.regexp_replace(F.regexp_replace(english_name(c), r"(?i)\b(DEL|DE|NEW)\b", ""), r"\s+", " "))
    words = F.transform(F.split(F.upper(base), r"\s+"), lambda w: _mapped(w, ABBREVIATIONS))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(words, " "), "[^A-Z0-9 ]", ""), r"\s+", " "))


# Sectors by words of an industry's description, in this order, then by ranges of its code.
SECTOR_WORDS = (
    ("oil|gas|petroleum|pipeline|drilling|exploration|energy", "Energy"),
    ("bank|bancorp|credit|financial|insurance|capital|asset|broker|mortgage|reit|trust", "Financials"),
    ("software|computer|internet|semiconductor|telecom|communications|electronic|data processing", "Technology"),
    ("pharma|pharmaceutical|biotech|medical|health|hospital|diagnostic|therapeutic", "Health Care"),
    ("restaurant|food|beverage|apparel|footwear|retail|consumer|household|cosmetic|automotive retail", "Consumer"),
    ("media|broadcast|entertainment|publishing|streaming|advertising", "Communication Services"),
    ("railroad|air freight|air transport|airline|aerospace|defense|machinery|industrial|manufactur|logistics|transport", "Industrials"),
    ("electric|utility|water supply|natural gas distribution", "Utilities"),
    ("mining|chemical|steel|metal|forest|paper|lumber|glass|cement", "Materials"),
)
SECTOR_CODES = ((1000, 1299, "Materials"), (1300, 1399, "Energy"), (4900, 4999, "Utilities"), (6000, 6799, "Financials"), (7370, 7379, "Technology"), (8000, 8099, "Health Care"))


def sector(code: Column, description: Column) -> Column:
    """The first sector whose words the description has, else the code's; null without either."""
    words = [F.when(description.rlike(rf"(?i)\b({w})\b"), s) for w, s in SECTOR_WORDS]
    number = code.try_cast("int")
    return F.coalesce(*words, *(F.when(number.between(a, b), s) for a, b, s in SECTOR_CODES))


def share_class(title: Column) -> Column:
    """A title's class letter, such as A of 'CL A' and of 'CLASS A'."""
    found = F.regexp_extract(F.upper(title), r"\bCL(?:ASS)?\s+([A-Z])\b", 1)
    return F.when(found != "", found)

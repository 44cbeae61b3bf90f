"""Address and identifier text as Column expressions.

Everything here stays in the JVM. Unicode normalisation and visual-order repair have no built-in; they are Arrow
functions in :mod:`permitflow.functions.arrow` and belong at ingestion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped in front of a street name, and characters that sources use inconsistently.
STREET_PREFIXES = ["רחוב", "רח", "שדרות", "שדרה", "שד", "דרך", "סמטת", "סמטה", "משעול", "נתיב", "מעלה", "מורד", "כיכר", "ככר", "טיילת", "מדרגות"]
PUNCTUATION = "\"'׳״‘’“”,.־–—"
# Texts that stand for no value.
NO_BLOCK = ["", "none", "0"]
PLACEHOLDER_STREETS = ["?", "??", "---", "לא ידוע", "לא צוין", "0"]

WIDEST_RANGE = 200

_SPACE = r"(?U)[\s\x1c-\x1f]+"
_CLEAN = r"^(?:[!-~א-ת]++(?: [!-~א-ת]++)*+)?\z"
_HOUSE = r"\d+[א-ת]?(?:[-/,]\d+[א-ת]?)*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Null becomes empty; every run of Unicode white space one blank; ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), _SPACE, " "))


def clean_column(c: Column | str) -> Column:
    """The same for a column, named several times here: common text that is clean but for its ends is tested once, not
    written anew."""
    s = F.trim(_col(c))
    return F.when(s.rlike(_CLEAN), s).otherwise(clean_text(c))


def is_blank(c: Column | str) -> Column:
    """Whether nothing is left of a text when it is cleaned. Composition (NFKC) makes no text blank and fills none."""
    return ~F.coalesce(_col(c), F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def split_street_house(c: Column | str) -> Column:
    """struct(street, house): trailing house tokens, all of them, come off the street."""
    s = clean_text(c)
    tail = house_tail(s)
    return F.struct(without_tail(s, tail).alias("street"), F.trim(tail).alias("house"))


def house_tail(s: Column) -> Column:
    """The house tokens at the end of clean text, with the blank before them; empty where there is none."""
    return F.regexp_extract(s, rf"(?U)(?:(?:^| ){_HOUSE})+$", 0)


def without_tail(s: Column, tail: Column) -> Column:
    return F.trim(F.substring(s, F.lit(1), F.length(s) - F.length(tail)))


def house_number(c: Column | str) -> Column:
    """First integer of a house text, or null."""
    return F.regexp_extract(clean_text(c), r"(?U)(\d+)", 1).try_cast("int")


def address_number(street: Column | str, house: Column | str) -> Column:
    """The house column's number, else one embedded in the street text."""
    return F.coalesce(house_number(house), house_number(split_street_house(street)["house"]))


def normalize_street(c: Column | str) -> Column:
    """Street key: no parentheses or punctuation, no leading type word, no trailing house numbers."""
    s = clean_text(c)
    outside = F.regexp_replace(s, r"\([^)]*\)", " ")
    s = F.when(F.trim(outside) != "", outside).otherwise(s)
    s = clean_text(F.translate(s, "()" + PUNCTUATION, "  "))
    first, rest = F.substring_index(s, " ", 1), F.regexp_extract(s, r"^\S+ (.*)$", 1)
    s = F.when((rest != "") & first.isin(STREET_PREFIXES), rest).otherwise(s)
    return F.regexp_replace(s, rf"(?U)(?<=\S)(?: {_HOUSE})+$", "")


def street_keys(c: Column | str) -> Column:
    """Distinct keys of a street name, most specific first: whole, outside parentheses, inside each, then without ה."""
    s = clean_text(c)
    inner = F.regexp_extract_all(s, F.lit(r"\(([^)]*)\)"), F.lit(1))
    outside = F.regexp_replace(s, r"\([^)]*\)", " ")
    names = F.when(F.size(inner) > 0, F.concat(F.array(s, outside), inner)).otherwise(F.array(s))
    keys = F.array_distinct(F.filter(F.transform(names, normalize_street), lambda k: k != ""))
    bare = F.transform(F.filter(keys, lambda k: (F.length(k) > 3) & k.startswith("ה")), lambda k: normalize_street(F.substring(k, 2, 1 << 20)))
    return F.array_distinct(F.concat(keys, F.filter(bare, lambda k: k != "")))


def id_list(c: Column | str, widest: int = WIDEST_RANGE) -> Column:
    """Numbers of a free-text list in order: commas or semicolons part, a hyphen is an inclusive range either way round.
    A range of more than ``widest`` numbers is refused and its low end kept as written."""
    parts = F.filter(F.transform(F.split(F.replace(clean_text(c), F.lit(";"), F.lit(",")), ","), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        low, high = F.trim(F.regexp_extract(p, r"^([^-]*)-(.*)$", 1)), F.trim(F.regexp_extract(p, r"^([^-]*)-(.*)$", 2))
        is_range = low.rlike(r"^[0-9]+$") & high.rlike(r"^[0-9]+$")
        a, b = low.try_cast("bigint"), high.try_cast("bigint")
        narrow = F.coalesce(F.abs(a - b) < widest, F.lit(False))
        spread = F.transform(F.sequence(F.least(a, b), F.greatest(a, b)), lambda n: n.cast("string"))
        plain = F.when(p.rlike(r"^[0-9]+$"), F.regexp_replace(p, r"^0+(?=.)", "")).otherwise(p)
        return F.when(is_range & narrow, spread).when(is_range, F.array(low)).otherwise(F.array(plain))

    return F.array_distinct(F.flatten(F.transform(parts, one)))


def digits(c: Column | str) -> Column:
    """Digits only, without leading zeros; all zeros give 0; none give empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"[^0-9]", ""), r"^0+(?=.)", "")


def clean_block(c: Column | str) -> Column:
    """A block or parcel as printed; empty where it stands for none."""
    s = clean_text(c)
    return F.when(F.lower(s).isin(NO_BLOCK), "").otherwise(s)


def address(street: Column | str, house: Column | str) -> Column:
    """Street and house, unless the house is blank, "none" or already part of the street."""
    s, h = clean_text(street), F.trim(F.coalesce(_col(house).cast("string"), F.lit("")))
    return F.when((h == "") | (F.lower(h) == "none") | s.contains(h), s).otherwise(F.trim(F.concat_ws(" ", s, h)))


def block_text(block: Column | str, parcel: Column | str) -> Column:
    """The block and parcel in words, as much as there is."""
    b, p = clean_block(block), clean_block(parcel)
    return F.when(b == "", "").otherwise(F.concat(F.lit("גוש "), b, F.when(p != "", F.concat(F.lit(" חלקה "), p)).otherwise("")))


def location_text(street: Column | str, house: Column | str, block: Column | str, parcel: Column | str) -> Column:
    """The address, or the block where there is none."""
    return F.coalesce(F.nullif(address(street, house), F.lit("")), block_text(block, parcel))


def pdf_date(c: Column | str) -> Column:
    """dd/mm/yyyy, with or without leading zeros; else null."""
    return F.try_to_date(F.trim(_col(c)), "d/M/yyyy")


def api_date(c: Column | str) -> Column:
    """The date before a T; else null."""
    return F.try_to_date(F.split_part(_col(c), F.lit("T"), F.lit(1)), "yyyy-M-d")


def pdf_count(c: Column | str) -> Column:
    """An integer, or 1 where the cell holds none."""
    return F.coalesce(F.when(F.trim(_col(c)).rlike(r"^[0-9]+$"), F.trim(_col(c)).try_cast("int")), F.lit(1))


def api_count(c: Column | str) -> Column:
    """An integer, or 0."""
    return F.coalesce(_col(c).try_cast("int"), F.lit(0))


def species_text(species: Column | str) -> Column:
    """Ordered array<struct(name, n)> as "name xN, ..."; N is left out for 1 and blank names are skipped."""
    named = F.filter(_col(species), lambda s: clean_text(s["name"]) != "")
    return F.array_join(F.transform(named, lambda s: F.concat(clean_text(s["name"]), F.when(s["n"] > 1, F.concat(F.lit(" x"), s["n"].cast("string"))).otherwise(""))), ", ")


def html_escape(c: Column | str) -> Column:
    """Text for HTML bodies and attribute values."""
    out = _col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def state_key(source: Column | str, source_id: Column | str) -> Column:
    """source:id; ids of the two sources overlap."""
    return F.concat_ws(":", _col(source), _col(source_id).cast("string"))


def legacy_key(source: Column | str, legacy_id: Column | str) -> Column:
    """Key of a record known by its old id only."""
    return F.concat_ws(":", _col(source), F.lit("legacy"), _col(legacy_id).cast("string"))


def is_street_level(house_from: Column | str, house_to: Column | str) -> Column:
    """Whether a range covers the whole street; both bounds count."""
    return (_col(house_from) <= 0) & (_col(house_to) >= 99999)


def usable_street(c: Column | str) -> Column:
    """Whether a name is neither a placeholder nor digits alone."""
    s = clean_text(c)
    return ~s.isin(PLACEHOLDER_STREETS) & (s != "") & ~s.rlike(r"^[0-9]+$")


#: Confidence of an index row by priority, and of any other priority.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.6, 5: 0.85, 6: 0.7, 7: 0.55}


def confidence(priority: Column | str) -> Column:
    out = F.lit(0.5)
    for p, v in CONFIDENCE.items():
        out = F.when(_col(priority) == p, v).otherwise(out)
    return out

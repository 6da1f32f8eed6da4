"""Name and text columns: normalisers, stems, slugs, addresses. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinthwork.functions.numbers import as_col

# Legal forms, noise words, abbreviations and alias tails that names are normalised by.
LEGAL = "inc incorporated corp corporation corporations co company llc ltd limited lp llp pllc pc plc pa na sa gmbh ag pty pvt nv bv gp np trust fund foundation cooperative coop limitedliabilitycompany limitedliability corportation coporation coropration incoporated incorperated".split()
NOISE = "the of and services service group holdings holding management international national global usa enterprises enterprise associates partners industries industry consulting consultants solutions solution".split()
ABBREVIATIONS = {
    "hosp": "hospital", "med": "medical", "ctr": "center", "cntr": "center", "mgmt": "management", "mfg": "manufacturing", "intl": "international", "natl": "national", "assn": "association",
    "assoc": "association", "dept": "department", "govt": "government", "univ": "university", "tech": "technology", "sys": "systems", "svc": "services", "svcs": "services", "dist": "distribution",
    "mktg": "marketing", "comm": "communications", "engr": "engineering", "fin": "financial", "ins": "insurance", "transp": "transportation", "rehab": "rehabilitation", "pharm": "pharmaceutical",
    "mem": "memorial", "reg": "regional", "genl": "general", "gen": "general", "elem": "elementary", "sch": "school", "schl": "school", "bldg": "building", "prop": "property", "apt": "apartment",
    "hwy": "highway", "pkwy": "parkway", "st": "saint", "mt": "mount", "ft": "fort",
}
ALIAS_TAILS = (r"\bd\s*b\s*a\b.*$", r"\bdoing business as\b.*$", r"\ba\s*k\s*a\b.*$")


def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters of one ASCII letter each, those letters, and characters that decompose into several (ligatures, fractions)."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000]
    one = [p for p in pairs if len(p[1]) == 1]
    return "".join(p[0] for p in one), "".join(p[1] for p in one), {a: b for a, b in pairs if len(b) > 1}


_ACCENTED, _PLAIN, _SEVERAL = _folds()


def ascii_fold(x) -> Column:
    """Compatibility decomposition without what is not ASCII, as in NFKD; only texts with characters of several letters are taken apart."""
    several = F.create_map(*[F.lit(v) for kv in _SEVERAL.items() for v in kv])
    single = F.translate(as_col(x), _ACCENTED, _PLAIN)
    apart = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    folded = F.regexp_replace(F.when(F.rlike(single, F.lit(f"[{''.join(_SEVERAL)}]")), apart).otherwise(single), r"[^\x00-\x7F]", "")
    return F.when(F.rlike(as_col(x), F.lit(r"[^\x00-\x7F]")), folded).otherwise(as_col(x))  # most names are ASCII


def squeeze(x) -> Column:
    return F.trim(F.regexp_replace(as_col(x), r"\s+", " "))


def standard_name(x) -> Column:
    """Lower case, punctuation to spaces, alias tail cut off; null: empty."""
    s = squeeze(F.regexp_replace(F.lower(ascii_fold(F.coalesce(as_col(x), F.lit("")))), r"[^\w\s]", " "))
    for tail in ALIAS_TAILS:
        s = F.trim(F.regexp_replace(s, tail, ""))
    return s


def tokens(x) -> Column:
    """Words of a squeezed text; none for an empty one."""
    return F.filter(F.split(as_col(x), " "), lambda t: t != "")


def expand(words: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(table, t), t))


def aggressive_name(x) -> Column:
    """Standard form with abbreviations written out, then legal forms and noise words dropped."""
    drop = [*LEGAL, *NOISE]
    return F.array_join(F.filter(expand(tokens(standard_name(x)), ABBREVIATIONS), lambda t: ~t.isin(drop)), " ")


def fuzzy_name(x) -> Column:
    """Distinct words of two or more characters of the aggressive form, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens(aggressive_name(x)), lambda t: F.length(t) > 1))), " ")


def collapsed(x) -> Column:
    return F.regexp_replace(as_col(x), r"\s+", "")


# Endings and what replaces them, in the order in which they are tried.
STEM_RULES = (
    ("ations", "at"),
    ("ation", "at"),
    ("tions", "t"),
    ("tion", "t"),
    ("ments", ""),
    ("ment", ""),
    ("ings", ""),
    ("ing", ""),
    ("ies", "y"),
    ("ers", ""),
    ("ors", ""),
    ("es", ""),
    ("s", ""),
)


def stemmed(x) -> Column:
    """Words over three characters with the first ending that leaves three or more replaced."""

    def stem(t):
        fits = [(F.endswith(t, F.lit(end)) & (F.length(t) >= 3 + len(end) - len(put)), F.concat(F.substring(t, F.lit(1), F.length(t) - len(end)), F.lit(put))) for end, put in STEM_RULES]
        out = F.when(F.length(t) <= 3, t)
        for fit, put in fits:
            out = out.when(fit, put)
        return out.otherwise(t)

    return F.array_join(F.transform(tokens(x), stem), " ")


def name_slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(F.coalesce(as_col(x), F.lit("")))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


# Words that give an acronym no letter.
ACRONYM_STOP = "the of and a an in for at by to or on with as llc inc corp ltd lp llp co pc pa pllc".split()


def acronym(x) -> Column:
    """First letters of the words that are no stop words."""
    words = F.filter(tokens(squeeze(F.regexp_replace(F.lower(as_col(x)), r"[^\w\s]", " "))), lambda t: ~t.isin(ACRONYM_STOP) & t.rlike("^[a-z]"))
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def street_number(x) -> Column:
    return F.nullif(F.regexp_extract(as_col(x), r"^\s*(\d+)", 1), F.lit(""))


STREETS = {"street": "st", "avenue": "ave", "boulevard": "blvd", "road": "rd", "drive": "dr", "lane": "ln", "suite": "ste", "north": "n", "south": "s", "east": "e", "west": "w", "highway": "hwy", "parkway": "pkwy"}


def address(x) -> Column:
    return F.array_join(expand(tokens(squeeze(F.regexp_replace(F.lower(as_col(x)), r"[^\w\s]", " "))), STREETS), " ")


def blank_to_null(x) -> Column:
    return F.nullif(F.trim(as_col(x)), F.lit(""))

"""Score factors, signals and name filters as column expressions; null where the evidence is absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinthwork.functions.numbers import as_col, clamp, decay, ladder, rounded, weighted_mean_present

# Size sources in order of trust.
SIZE_SOURCES = ("mergent_company", "sec_10k", "ppp_2020", "rpe_estimate", "f7_group_consolidated", "f7_unit_size")
# Two-digit industry to density sector.
SECTORS = {
    "11": "AGR_MIN", "21": "AGR_MIN", "22": "TRANS_UTIL", "23": "CONST", "31": "MFG", "32": "MFG", "33": "MFG", "42": "WHOLESALE", "44": "RETAIL", "45": "RETAIL", "48": "TRANS_UTIL", "49": "TRANS_UTIL",
    "51": "INFO", "52": "FINANCE", "53": "FINANCE", "54": "PROF_BUS", "55": "PROF_BUS", "56": "PROF_BUS", "61": "EDU_HEALTH", "62": "EDU_HEALTH", "71": "LEISURE", "72": "LEISURE", "81": "OTHER", "92": "PUBLIC_ADMIN",
}
# Patterns of persons and law firms among parties.
PERSON = (r"^[A-Z][a-zA-Z]+,\s+[A-Z][a-zA-Z]+\.?$", r"^[A-Z]+,\s+[A-Z][A-Za-z]+(?:\s+[A-Z]\.?)?$")
LAW_FIRM = r"(?i)\bll\.?p\.?\b|\bp\.?\s*c\.?\s*$|\bpllc\b|\b(?:law\s+)?(?:office|firm)s?\s+of\b|\battorney|\bcounsel\b|\besq\.?\b"
# First words and phrases that no person's name has.
BAD_FIRST = (
    "chief", "president", "executive", "chairman", "director", "directors", "officer", "vice", "senior", "audit", "continuing", "independent", "outside", "new", "other", "principal", "lead", "committee", "committees", "def", "planner",
    "treasurer", "corporate", "class", "professional", "qualifications", "experience", "background", "managing", "founder", "co-founder", "all", "ceo", "an", "a", "the", "our", "back", "general", "deputy", "assistant", "as", "with", "to",
    "for", "from", "on", "in", "by",
)
BAD_PARTS = (
    "def 14a", "continuing directors", "independent directors", "outside directors", "class i directors", "class ii directors", "class iii directors", "audit committee", "directors are", "venture", "ltd. (", "llc (", "inc. (", "lp (",
    "and his ", "and her ", "proxy statement", "page ", "table of contents",
)
# Methods that count whatever their score.
IDENTITY_METHODS = ("EIN_EXACT", "CROSSWALK", "CIK_BRIDGE")


# Violations of an establishment where its industry's average is not known, and steps of charges and of wins nearby.
TYPICAL_VIOLATIONS = 2.23
CHARGE_POINTS, CHARGE_ANGER = ((10, 8), (4, 6), (2, 4), (1, 2)), ((10, 10), (4, 8), (2, 6), (1, 4))
INDUSTRY_WINS, STATE_WINS = ((50, 2.0), (20, 1.5), (5, 1.0), (1, 0.5)), ((100, 2.0), (40, 1.5), (10, 1.0), (1, 0.5))


def _or0(x) -> Column:
    return F.coalesce(as_col(x), F.lit(0))


def violations(willful, repeat, serious, total, latest, norm, as_of) -> Column:
    """Violations by severity against the industry's average, halved every five years, and one more for willful or repeated ones; null without a record."""
    w, r, s, n = (_or0(x) for x in (willful, repeat, serious, total))
    weight = w * 3 + r * 2 + s + (n - w - r - s) * 0.5
    average = F.greatest(F.coalesce(as_col(norm), F.lit(TYPICAL_VIOLATIONS)), F.lit(0.1))
    base = F.greatest(F.lit(0.0), rounded(weight / average * decay(as_of, latest, 5.0), 2))
    return F.when(as_col(total).isNotNull(), F.least(F.lit(10.0), base + F.when(w + r > 0, 1.0).otherwise(0.0)))


def organizing(wins, elections, losses, latest, charges, latest_charge, industry_wins, state_wins, as_of, own: tuple[int, int, int] = (2, 1, -1)) -> Column:
    """Elections and charges, halved every seven years, and wins of the last years in the industry and state; null without either.

    ``own`` weighs wins, elections and losses.
    """
    history = (_or0(wins) * own[0] + _or0(elections) * own[1] + _or0(losses) * own[2]) * decay(as_of, latest, 7.0)
    points = F.coalesce(ladder(_or0(charges), CHARGE_POINTS, 0.0), F.lit(0.0)) * decay(as_of, latest_charge, 7.0)
    nearby = ladder(_or0(industry_wins), INDUSTRY_WINS, 0.0) + ladder(_or0(state_wins), STATE_WINS, 0.0)
    return F.when(as_col(elections).isNotNull() | as_col(charges).isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(0.0), rounded(history + points + nearby, 2))))


def anger(osha, whd, nlrb, charges, sentiment=None, researched=None) -> Column:
    """Mean of the enforcement factors and charges that there are, at most 10; a researched value comes first, found sentiment adds."""
    n = as_col(charges)
    steps = F.when(n > 0, ladder(n, CHARGE_ANGER, 0.0))
    extra = _or0(sentiment) * 10 if sentiment is not None else F.lit(0.0)
    parts = [(as_col(osha), 3), (as_col(whd), 3), (as_col(nlrb), 3), (steps, 4)]
    top = reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) * float(w) for c, w in parts]) + extra
    low = reduce(Column.__add__, [F.when(c.isNotNull(), float(w)).otherwise(0.0) for c, w in parts])
    own = F.when(low > 0, F.least(F.lit(10.0), top / low))
    return own if researched is None else F.coalesce(as_col(researched), own)


def leverage(proximity, similarity_, contracts_, financial_, growth_, revenue_each=None) -> Column:
    """Weighted mean of the factors that there are, at most 10; revenue of over 500,000 a worker adds."""
    parts = [(as_col(proximity), 10), (as_col(similarity_), 15), (as_col(contracts_), 25), (as_col(financial_), 25), (as_col(growth_), 10)]
    extra = F.when(_or0(revenue_each) > 500_000, 10.0).otherwise(0.0) if revenue_each is not None else F.lit(0.0)
    top = reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) * float(w) for c, w in parts]) + extra
    low = reduce(Column.__add__, [F.when(c.isNotNull(), float(w)).otherwise(0.0) for c, w in parts])
    return F.when(low > 0, F.least(F.lit(10.0), top / low))


def tier(percentile, factors, direct) -> Column:
    p, solid = as_col(percentile), (as_col(factors) >= 3) & (as_col(direct) >= 1)
    return F.when((p >= 0.97) & solid, "Priority").when((p >= 0.85) & solid, "Strong").when((p >= 0.60) & (as_col(direct) >= 1), "Promising").when(p >= 0.85, "Speculative").when(p >= 0.25, "Moderate").otherwise("Low")


def wage_cases(cases, latest, as_of) -> Column:
    """0, 5, 7 or 10 by cases, halved every five years; null without a record."""
    return rounded(ladder(cases, [(4, 10), (2, 7), (1, 5)], 0.0) * decay(as_of, latest, 5.0), 2)


def contracts(federal, obligations, local, sources) -> Column:
    """The better of the federal ladder by money and the state and local one by sources; null for no contractor."""
    federal, local = F.coalesce(as_col(federal), F.lit(False)), F.coalesce(as_col(local), F.lit(False))
    money, n = F.coalesce(as_col(obligations), F.lit(0.0)), F.coalesce(as_col(sources), F.lit(0))
    one = F.when(federal & (money > 0), ladder(money, [(100_000_000, 10), (10_000_000, 8), (1_000_000, 6), (100_000, 4)], 2.0)).when(federal, 1.0).otherwise(0.0)
    other = F.when(local, F.when(n >= 4, 8.0).when(n == 3, 6.0).when(n == 2, 5.0).otherwise(3.0)).otherwise(0.0)
    return F.when(federal | local, F.greatest(one, other))


def proximity(members, family) -> Column:
    """10 with two or more others in the group, 5 with one or a family, else 0; null with neither known."""
    others = F.greatest(F.coalesce(as_col(members), F.lit(1)) - 1, F.lit(0))
    return F.when(as_col(members).isNull() & as_col(family).isNull(), None).when(others >= 2, 10.0).when((others == 1) | as_col(family).isNotNull(), 5.0).otherwise(0.0)


def growth(industry, change) -> Column:
    return F.when(as_col(industry).isNotNull(), clamp(rounded((F.coalesce(as_col(change), F.lit(0.0)) + 10.0) / 20.0 * 10.0, 2), 0.0, 10.0))


def size_source(sizes: list) -> Column:
    """Which of the sizes, in order of trust, is the first known."""
    return F.coalesce(*[F.when(as_col(s).isNotNull(), F.lit(name)) for s, name in zip(sizes, SIZE_SOURCES)])


def size(workers) -> Column:
    """0 below 15, rising to 10 at 500, falling from 25,000 to 5 at 100,000."""
    n = as_col(workers)
    return F.when(n.isNull(), None).when(n < 15, 0.0).when(n.between(500, 25_000), 10.0).when(n > 25_000, F.greatest(F.lit(5.0), 10.0 - rounded((n - 25_000) / 75_000.0 * 5.0, 2))).otherwise(rounded((n - 15) / 485.0 * 10.0, 2))


def similarity(distance) -> Column:
    return clamp(rounded((1.0 - as_col(distance) / 0.40) * 10.0, 1), 0.0, 10.0)


def financial(revenue, assets, expenses, workers, public, participants, plans, pension, welfare) -> Column:
    """The better of the filing's health (or a listed company's 7) and the benefit plans' richness; null with neither."""
    r, a, e = as_col(revenue), F.coalesce(as_col(assets), F.lit(0.0)), F.coalesce(as_col(expenses), F.lit(1.0))
    each = r / F.greatest(F.coalesce(as_col(workers), F.lit(1)), F.lit(1))
    filed = ladder(r, [(10_000_000, 6), (1_000_000, 4), (100_000, 2)], 0.0) + F.when(a > e * 2, 2.0).when(a > e, 1.0).otherwise(0.0) + ladder(each, [(50_000, 2), (20_000, 1)], 0.0)
    rich = ladder(participants, [(1000, 3), (500, 2), (100, 1)], 0.0) + F.coalesce(ladder(plans, [(5, 4), (3, 3), (2, 2)], 1.0), F.lit(1.0)) + F.when(as_col(pension), 2.0).otherwise(0.0) + F.when(as_col(welfare), 1.0).otherwise(0.0)
    return F.greatest(F.when(r.isNotNull(), clamp(filed, 0.0, 10.0)).when(as_col(public), 7.0), F.when(as_col(participants).isNotNull(), clamp(rich, 0.0, 10.0)))


def legacy(parts: dict[str, str]) -> Column:
    """Weighted mean of the factors present; ``parts`` names the column of each factor."""
    weights = {"proximity": 3, "nlrb": 3, "contracts": 2, "growth": 2, "financial": 2, "osha": 1, "whd": 1, "similarity": 1}
    return rounded(weighted_mean_present([(parts[k], w) for k, w in weights.items()]), 2)


def density_signal(state, sector) -> Column:
    """A quarter of the mean of state and sector density, an unknown one counting 0; null with neither."""
    s, i = as_col(state), as_col(sector)
    return F.when(s.isNotNull() | i.isNotNull(), clamp(rounded((F.coalesce(s, F.lit(0.0)) * 0.5 + F.coalesce(i, F.lit(0.0)) * 0.5) / 4.0, 2), 0.0, 10.0))


def sector(industry) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv]), F.substring(as_col(industry), 1, 2))


def recommended_action(tier, enforced, factors) -> Column:
    t, e, n = as_col(tier), F.coalesce(as_col(enforced), F.lit(False)), F.coalesce(as_col(factors), F.lit(0))
    out = F.when((t == "Priority") & e, "PURSUE NOW").when(t.isin("Priority", "Strong") & (n >= 3), "RESEARCH FIRST")
    return out.when(t.isin("Promising", "Moderate") & e, "RESEARCH FIRST").when(n < 3, "INSUFFICIENT DATA").otherwise("MONITOR")


def is_person(name) -> Column:
    return reduce(Column.__or__, [F.rlike(F.trim(as_col(name)), F.lit(p)) for p in PERSON])


def is_law_firm(name) -> Column:
    return F.rlike(as_col(name), F.lit(LAW_FIRM))


def employer_of(party) -> Column:
    """The employer in a party's text: its second line, or its only one; null for persons, law firms and scraps."""
    lines = F.filter(F.transform(F.split(F.trim(as_col(party)), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    second, only = F.get(lines, F.lit(1)), F.get(lines, F.lit(0))
    return F.when(F.size(lines) >= 2, F.when(~is_law_firm(second) & ~is_person(second), second)).when(~is_person(only) & ~is_law_firm(only) & (F.length(only) >= 3), only)


def likely_name(name) -> Column:
    """Whether a text can be a person's name rather than what a parser took for one; null: no."""
    s = F.trim(as_col(name))
    first = F.regexp_replace(F.lower(F.regexp_extract(s, r"^(\S+)", 1)), r"[.,;:]+$", "")
    bad = reduce(Column.__or__, [F.contains(F.lower(s), F.lit(p)) for p in BAD_PARTS])
    good = F.length(s).between(4, 80) & F.rlike(s, F.lit(r"^\S+\s+\S")) & ~first.isin(*BAD_FIRST) & ~F.rlike(first, F.lit("^[0-9]+$")) & ~F.rlike(s, F.lit(r"\b(19|20)\d{2}\b")) & ~bad
    return F.coalesce(good, F.lit(False))


def score_eligible(method, score) -> Column:
    return as_col(method).isin(*IDENTITY_METHODS) | (as_col(score) >= 0.85)


def hellinger(p: list, q: list) -> Column:
    """Hellinger distance of two shares given as lists of columns."""
    return F.sqrt(reduce(Column.__add__, [(F.sqrt(as_col(a)) - F.sqrt(as_col(b))) ** 2 for a, b in zip(p, q)])) / F.sqrt(F.lit(2.0))


# Employed people of the country, how far a total may go beyond, and shares beside 100.
EMPLOYED, CEILING, SHARE_TOLERANCE = 144_540_000, 1.30, 3.0


def implausible(workers, employed, shares: dict[str, str]) -> Column:
    """What cannot be in a group's total and shares, as an array of texts; the country's ceiling holds where a state's is unknown.

    ``employed`` is the state's number; ``shares`` maps a dimension to a column of its percentages, an empty or null one is not judged.
    """
    n = as_col(workers)
    ceiling = F.floor(F.coalesce(as_col(employed), F.lit(EMPLOYED)) * CEILING)
    told = [F.when(n <= 0, F.lit("total_workers must be > 0")), F.when((n > 0) & (n > ceiling), F.lit("total_workers exceeds ceiling"))]
    for name, column in shares.items():
        known = F.filter(F.coalesce(as_col(column), F.array().cast("array<double>")), lambda p: p.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda a, p: a + p)
        told.append(F.when((F.size(known) > 0) & (F.abs(total - 100.0) > SHARE_TOLERANCE), F.lit(f"{name} pct sum outside")))
    return F.array_compact(F.array(*told))

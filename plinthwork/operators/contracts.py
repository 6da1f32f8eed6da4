"""Contract texts: parties, dates and locals, sub-fields of articles, contents pages, wage tables. Column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinthwork.functions.numbers import as_col, once

# What tells a union's name, how parties, dates, locals and units are worded, the holidays counted, rates of pay,
# the marks of contents and index pages, money in wage tables.
UNION = (
    "local", "union", "brotherhood", "federation", "afscme", "seiu", "teamsters", "ufcw", "uaw", "ibew", "iam", "iamaw", "iatse", "afge", "nffe", "apwu", "nalc", "nteu", "afl-cio", "aflcio", "workers", "employees", "laborers", "carpenters",
    "plumbers", "electricians", "nurses", "teachers", "firefighters", "police", "council", "district council", "joint board", "lodge",
)
BETWEEN = r"(?is)(?:between|by and between)\s+(.+?)\s+(?:and|&)\s+(.+?)(?:\.|,|\n|hereinafter)"
ENTERED = r"(?is)entered\s+into\s+by\s+(.+?)\s+(?:and|&)\s+(.+?)(?:\.|,|\n)"
LOCAL = (r"(?i)Local\s+(?:No\.?\s*)?(\d+[A-Z]?(?:-\d+[A-Z]?)?)", r"(?i)Local\s+Union\s+(?:No\.?\s*)?(\d+[A-Z]?)", r"(?i)Lodge\s+(?:No\.?\s*)?(\d+)")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE = rf"(?:(?:{'|'.join(MONTHS)})\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})"
EFFECTIVE = rf"(?i)effective\s+(?:as\s+of\s+|from\s+|on\s+)?({DATE})"
EXPIRES = tuple(rf"(?i){p}({DATE})" for p in (r"(?:shall\s+)?expir(?:e|ation)\s+(?:on\s+|date\s+(?:of\s+)?)?", r"through\s+", r"ending\s+(?:on\s+)?", r"until\s+"))
PERIOD = rf"(?i)for\s+the\s+period\s+({DATE})\s+(?:through|to|until)\s+({DATE})"
YEARS = r"(20\d{2})\s*[-\u2013]\s*(20\d{2})"
UNIT = (
    r"(?is)bargaining\s+unit\s+(?:consisting\s+of|comprised\s+of|includes?|shall\s+(?:consist|include|be))\s+(.{20,300}?)(?:\.|$)",
    r"(?is)employees?\s+covered\s+(?:by\s+this\s+agreement\s+)?(?:include|are|shall\s+be)\s+(.{20,300}?)(?:\.|$)",
    r"(?is)all\s+(?:full[- ]?time\s+(?:and\s+(?:regular\s+)?part[- ]?time\s+)?)?employees?\s+(?:employed|working)\s+(.{10,200}?)(?:\.|$)",
)
STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
    "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming", "district of columbia",
)
HOLIDAYS = (
    r"new\s+year", r"martin\s+luther\s+king|mlk\b|king\s+jr", r"president", r"memorial\s+day", r"independence\s+day|fourth\s+of\s+july|july\s+4", r"labor\s+day", r"columbus\s+day|indigenous\s+people", r"veteran", r"thanksgiving", r"christmas",
    r"good\s+friday", r"easter", r"juneteenth", r"election\s+day",
)
LEAST_HOLIDAYS, NEAR = 3, 300
HOLIDAY_RATES = (
    (r"double\s+time\s+and\s+(?:a\s+|one\s+)?half|2\.5\s*x|250\s*%", "2.5"), (r"double\s+time|2\s*x|200\s*%", "2.0"), (r"triple\s+time|3\s*x|300\s*%", "3.0"),
    (r"time\s+and\s+(?:a\s+|one\s+)?half|1\.5\s*x?|150\s*%|one\s+and\s+one[\s-]half", "1.5"), (r"straight[\s-]?time", "1.0"),
)
OVERTIME_RATES = ((r"double\s+time\s+and\s+(?:a\s+|one\s+)?half|2\.5\s*x", "2.5"), (r"double\s+time|2\s*x", "2.0"), (r"time\s+and\s+(?:a\s+|one\s+)?half|1\.5\s*x?|one\s+and\s+one[\s-]half", "1.5"))
STARTS, STOPS = ("effective", "commenc", "begin", "start", "from"), ("expir", "terminat", "end", "through", "until", "conclud")
CONTENTS = r"\.{4,}|·{4,}|\.\s*\.\s*\.\s*\.|\bSubject\s+Page\b"
PAGES = r"\d{1,3}(?:,\s*\d{1,3}){2,}"
INDEX = rf"\w[\w\s]{{2,30}}\s+{PAGES}"
WAGE = r"\$\s*\d+[.,]\d{2}"


def _first(x: Column, pattern: str, group: int = 1) -> Column:
    return once(F.regexp_extract(x, pattern, group), lambda v: F.when(v != "", v))


def party_name(x) -> Column:
    """A party's name without outer punctuation, quotes and a leading article; blank: null."""
    s = F.regexp_replace(F.trim(F.regexp_replace(as_col(x), r"\s+", " ")), r"""^["'.,;:()\[\]]+|["'.,;:()\[\]]+$""", "")
    return once(F.trim(F.regexp_replace(s, r"(?i)^the\s+", "")), lambda v: F.when(v != "", v))


def is_union(name) -> Column:
    low = F.lower(as_col(name))
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in UNION]), lambda w: F.contains(low, w)), F.lit(False))


def parties(text) -> Column:
    """``employer`` and ``union`` of "between X and Y", else of "entered into by X and Y": the first side named as a union, else the second, is the union."""
    x = as_col(text)
    both = F.array(*[F.coalesce(*[party_name(_first(x, p, i)) for p in (BETWEEN, ENTERED)]) for i in (1, 2)])
    return once(both, lambda b: F.when(is_union(b[0]), F.struct(b[1].alias("employer"), b[0].alias("union"))).otherwise(F.struct(b[0].alias("employer"), b[1].alias("union"))))


def local_number(text) -> Column:
    return F.coalesce(*[_first(as_col(text), p) for p in LOCAL])


def contract_dates(text) -> Column:
    """``effective`` and ``expires`` as they are written; a range of years stands for its first and last day."""
    x = as_col(text)
    years = [_first(x, YEARS, i) for i in (1, 2)]
    effective = F.coalesce(_first(x, EFFECTIVE), _first(x, PERIOD, 1))
    expires = F.coalesce(*[_first(x, p) for p in EXPIRES], _first(x, PERIOD, 2))
    last = F.when(effective.isNull(), F.concat(F.lit("December 31, "), years[1]))
    return F.struct(F.coalesce(effective, F.concat(F.lit("January 1, "), years[0])).alias("effective"), F.coalesce(expires, last).alias("expires"))


def place_state(text) -> Column:
    """The state named after "state of", "in", "covering", "located in" or a comma; of several the longest name, then the first by spelling."""
    names = F.array(*[F.lit(s) for s in sorted(STATES, key=lambda s: (-len(s), s))])

    def told(low):
        seen = F.filter(names, lambda s: F.contains(low, s))
        return F.filter(seen, lambda s: F.rlike(low, F.concat(F.lit(r"(?:state\s+of|in|covering|located\s+in)\s+"), s)) | F.rlike(low, F.concat(F.lit(r",\s*"), s, F.lit(r"(?:\s|,|\.|$)"))))

    return F.initcap(F.get(once(F.lower(as_col(text)), told), F.lit(0)))


def bargaining_unit(text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(*[_first(as_col(text), p) for p in UNIT]), r"\s+", " "))


def _behind(words: tuple[str, ...]) -> str:
    """One of the words within a hundred characters before."""
    return "(?:" + "|".join(f"(?<={w}.{{0,{100 - len(w)}}})" for w in words) + ")"


def term_years(text) -> Column:
    """Years of "N-year agreement", from 1 to 10; else of the months between the first date that begins and the first that ends the term,
    or between the earliest and the latest date of the text."""
    x = as_col(text)
    n = F.try_to_number(_first(x, r"(?i)(\d{1,4})\s*-?\s*year\s+(?:agreement|contract|term|period|duration)"), F.lit("9999")).cast("int")
    day = rf"({'|'.join(MONTHS)})\s+(\d{{1,2}}),?\s+(20[0-2]\d|203[0-5])"
    months = F.array(*[F.lit(m) for m in MONTHS])

    def stamp(v: Column) -> Column:
        month = F.array_position(months, F.lower(F.regexp_extract(v, r"^(\w+)", 1)))
        return ((F.right(v, F.lit(4)).cast("int") * 12 + month) * 32 + F.regexp_extract(v, r"(\d+)", 1).cast("int")).cast("int")

    begun, done = (once(F.regexp_extract(x, rf"(?is)(?={day}){p}{day}", 0), lambda v: F.when(v != "", stamp(v))) for p in (_behind(STARTS), rf"(?!{_behind(STARTS)}){_behind(STOPS)}"))
    every = F.transform(F.regexp_extract_all(x, F.lit(rf"(?is){day}"), F.lit(0)), stamp)
    ends = once(every, lambda e: F.when(F.size(e) >= 2, F.array(F.array_min(e), F.array_max(e))))
    term = once(F.array(begun, done), lambda p: F.when(p[0].isNotNull() & p[1].isNotNull(), p).otherwise(ends))
    dated = once(term, lambda p: F.bround((F.floor(p[1] / 32) - F.floor(p[0] / 32)) / 12).cast("int"))
    return F.coalesce(F.when(n.between(1, 10), n), once(F.when(F.rlike(x, F.lit(rf"(?i){day}")), dated), lambda y: F.when(y.between(1, 10), y)))


def holidays(text) -> Column:
    """Named holidays, each once, and the floating ones counted in the text; null below three named ones."""
    named = sum((F.rlike(as_col(text), F.lit(f"(?i){p}")).cast("int") for p in HOLIDAYS), F.lit(0))
    floating = _first(as_col(text), r"(?i)(\d{1,3})\s+(?:personal|floating)\s+holiday")
    return once(named, lambda n: F.when(n >= LEAST_HOLIDAYS, n + F.coalesce(floating.cast("int"), F.lit(0))))


def holiday_rate(text) -> Column:
    """The first rate of pay in the list that the text names."""
    return F.coalesce(*[F.when(F.rlike(as_col(text), F.lit(f"(?i){p}")), v) for p, v in HOLIDAY_RATES])


def _near(word: str, pattern: str) -> str:
    """The pattern with its start less than ``NEAR`` characters from the start of the word, on either side."""
    return rf"(?is)(?=(?:{pattern}))(?:(?<={word}.{{0,{NEAR - 1 - len(word)}}})|(?=.{{0,{NEAR - 1}}}{word}))(?:{pattern})"  # the pattern first: it is rare


def overtime_rate(text) -> Column:
    """The first rate in the list that stands near the word overtime."""
    x = as_col(text)
    return F.when(F.contains(F.lower(x), F.lit("overtime")), F.coalesce(*[F.when(F.rlike(x, F.lit(_near("overtime", p))), v) for p, v in OVERTIME_RATES]))


def grievance_steps(text) -> Column:
    """Steps of an "N-step procedure", else the highest numbered of two or more steps; from 2 to 8."""
    x = as_col(text)
    told = _first(x, r"(?i)(\d{1,4})[\s-]step\s+(?:grievance|procedure|process)").cast("int")
    steps = F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(?i)Step\s+(\d{1,4})"), F.lit(1)), lambda s: s.cast("int")))
    most = F.when(F.size(steps) >= 2, F.array_max(steps))
    return F.coalesce(F.when(told.between(2, 8), told), F.when(most.between(2, 8), most))


def no_strike(text) -> Column:
    return F.rlike(as_col(text), F.lit(r"(?i)strike|work\s+stoppage|lockout"))


def probation_days(text) -> Column:
    """The first number of days from 10 to 730 near the word probation, else of months from 1 to 24, of thirty days each."""
    x = as_col(text)
    near = F.when(F.contains(F.lower(x), F.lit("probation")), x)
    found = lambda p: F.transform(F.regexp_extract_all(near, F.lit(_near("probation", p)), F.lit(1)), lambda s: s.cast("int"))
    days = F.get(F.filter(found(r"(?<!\d)(\d{1,6})\)?\s*(?:(?:calendar|working|business)\s+)?days?"), lambda n: n.between(10, 730)), F.lit(0))
    months = F.get(F.filter(found(r"(?<!\d)(\d{1,6})\)?\s*months?"), lambda n: n.between(1, 24)), F.lit(0))
    return F.coalesce(days, months * 30)


def is_contents(text) -> Column:
    x = as_col(text)
    return F.rlike(x, F.lit(CONTENTS)) | (F.rlike(x, F.lit(PAGES)) & F.rlike(x, F.lit(INDEX)))  # lists of pages are rare, and soon found


def kept_chunk(text, page, pages) -> Column:
    """Whether a chunk stays: not on the last two pages, and without the marks of contents or index pages."""
    last = F.coalesce(as_col(page) >= as_col(pages) - 1, F.lit(False))
    return ~last & ~F.coalesce(is_contents(text), F.lit(False))


def section_facts(text) -> Column:
    """Words and whether at least three amounts make a wage table."""
    x = F.coalesce(as_col(text), F.lit(""))
    return F.struct(F.regexp_count(x, F.lit(r"\S+")).cast("long").alias("words"), (F.regexp_count(x, F.lit(WAGE)) >= 3).alias("wage_table"))

"""Word lists, patterns and constants the results depend on."""

# Keyword flags over enforcement text (flag name -> terms). Fixed values.
ORDER_TERMS = [
    "consent order", "unilateral order", "demand", "demand notice", "agreement",
    "notice of noncompliance", "boil water order", "settlement agreement", "amendment",
    "penalty assessment notice", "civil administrative penalty", "labels", "water supply",
    "attorney general", "water", "hazardous waste", "sewer",
    "civil penalty", " supplemental environmental project", "gasoline", "asbestos", "wetlands",
    "stormwater",
]
LAW_TERMS = {
    "npdes": ["npdes", "National Pollution Discharge Elimination System"],
    "chapter 91": ["chapter 91", "ch 91"],
}

# Job classes: (class, terms looked for in the title), first match wins. Fixed values.
JOB_CLASSES = [
    ("Environmental Analyst", ["Environmental Analyst"]),
    ("Environmental Engineer", ["Environmental Engineer"]),
    ("Program Coordinator", ["Program Coordinator"]),
    ("Regional Planner", ["Regional Planner", "Planners"]),
    ("Director", ["Director", "Dir "]),
    ("Counsel", ["Counsel"]),
    ("Accountant", ["Accountant"]),
    ("Scientist", ["Scientist"]),
    ("Administrative Assistant", ["Administrative Assistant"]),
    ("Commissioner", ["Commissioner"]),
    ("IT Pro", ["IT Pro"]),
    ("Laboratory Supervisor", ["Laboratory Supervisor"]),
    ("Chemist", ["Chemist"]),
    ("Auditor", ["Auditor"]),
    ("Clerk", ["Clerk"]),
]
OTHER_CLASS = "OTHER"
# Job classes shown in the wage and seniority reports, and in the head-count report. Fixed values.
WAGE_CLASSES = [
    "Environmental Analyst", "Environmental Engineer", "Program Coordinator",
    "Regional Planner", "Counsel",
]
HEADCOUNT_CLASSES = [
    "Environmental Analyst", "Environmental Engineer", "Program Coordinator",
    "Regional Planner", "Accountant", "Counsel",
]

# Text patterns. Fixed values.
PROPER_NOUNS = r"(?:\s*\b[A-Z][a-z\-]+\b)+"
DATED_LINE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}:"
MONEY = r"\$[0-9]{1,3}(?:,?[0-9]{3})*(?:\.[0-9]{2})?\b"
MONEY_MILLIONS = r"\$[0-9]{1,3}(?:,?[0-9]{3})*(?:\.{0,2}[0-9]{0,2} million)\b"
JOB_LEVEL = r" (i{1,3}|iv|vi?)$"

# Budget report layout and row names. Fixed values.
BLOCK_NOT_TITLES = ["Environmental Agency Budget", "Amount of", "Capital spend"]
BLOCK_DETAIL_MARKS = [
    "% from", "of Budget", "Env. Agency Budget", "Amount from", "Status of",
    "Environmental Agency",
]
BUDGET = "Environmental Agency Budget"
BUDGET_WITH_FUND = "Environmental Agency Budget (SRF Added)"
BUDGET_NO_FUND = "Environmental Agency Budget (No SRF)"
FUND_AMOUNT = "Amount of Budget from SRF"
FUND_REPORTED = "Amount of Reported SRF"
FUND_QUESTION = "Budget includes SRF/ARRA funds (Yes/No)?"
PERCENT_FROM = "Percent from "
AMOUNT_FROM = "Amount from "
FEDERAL_ALIAS = ("Percent from Federal Government (e.g., EPA)", "Percent from Federal Government")

# Numbers. Fixed values.
METERS_PER_MILE = 1609.34
MIN_POPULATION = 50
BAND_SD = 1.65
UNKNOWN_PLACE = "[UNKNOWN]"
UNKNOWN_INCOME = -666666666.0
# Ellipsoid (semi-major axis, flattening) and cone (origin lat/lon, parallels, offsets). Fixed values.
ELLIPSOID = {"a": 6378137.0, "f": 1 / 298.257222101}
ALBERS = {
    "lat0": 0.0, "lon0": -120.0, "lat1": 34.0, "lat2": 40.5,
    "false_east": 0.0, "false_north": -4000000.0,
}

# Plain spellings of characters outside ASCII that have no accented base letter.
ASCII_SPELLINGS = {
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u202f": " ", "\u200b": "", "\ufeff": "",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "--", "\u2015": "--", "\u2212": "-",
    "\u2018": "'", "\u2019": "'", "\u201a": ",", "\u201c": '"', "\u201d": '"', "\u201e": ",,", "\u2032": "'", "\u2033": "''",
    "\u00ab": "<<", "\u00bb": ">>", "\u2026": "...", "\u2022": "*", "\u00b7": "*",
    "\u00bc": " 1/4", "\u00bd": " 1/2", "\u00be": " 3/4", "\u00b0": "deg", "\u00d7": "x", "\u00f7": "/", "\u00b1": "+-",
    "\u00a9": "(c)", "\u00ae": "(r)", "\u2122": "(tm)", "\u00a7": "SS", "\u00a3": "GBP", "\u20ac": "EUR", "\u00b5": "u",
    "\u00df": "ss", "\u00e6": "ae", "\u00c6": "AE", "\u0153": "oe", "\u0152": "OE", "\u00f8": "o", "\u00d8": "O",
    "\u0142": "l", "\u0141": "L", "\u0111": "d", "\u0110": "D", "\u00f0": "d", "\u00d0": "D", "\u00fe": "th", "\u00de": "Th", "\u0131": "i",
}

# Latin spellings of small Greek and Cyrillic letters; capitals follow by rule.
GREEK_SPELLINGS = dict(zip("αβγδεζηθικλμνξοπρςστυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
CYRILLIC_SPELLINGS = dict(zip(
    "абвгдежзийклмнопрстуфхцчшщъыьэюяєіїґўђјљњћџ",
    "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia ie i i g u d j lj nj c dz".split(),
))

# Named character references of HTML that occur in agency pages. Numbered ones follow by rule.
HTML_REFERENCES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018",
    "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "hellip": "\u2026", "bull": "\u2022", "middot": "\u00b7",
    "deg": "\u00b0", "frac12": "\u00bd", "copy": "\u00a9", "reg": "\u00ae", "amp": "&",
}

"""Fixed values of the complaint domain. All are defaults of parameters."""

# Keyword phrases injected as tags.
KEYWORDS = [
    "traffick", "fraud", "identity theft", "credit report error", "unauthorized charges",
    "FCRA violation", "FDCPA violation", "child abuse", "scam", "sexual abuse", "data breach",
    "harassment", "discrimination", "unauthorized access", "debt collection", "overcharged",
    "unlawful practices", "forgery", "abduction", "missing child", "molestation", "foreclosure",
]

# Keyword stems shown under their full noun.
STEM_LABELS = {"traffick": "trafficking"}

# Legal references, matched without regard to case.
STATUTE_PATTERNS = [
    r"\bFair Credit Reporting Act\b",
    r"\bFair Debt Collection Practices Act\b",
    r"\bFDCPA\b",
    r"\bFCRA\b",
    r"\b15\s*U\.?S\.?C\.?\s*§?\s*\d+[a-zA-Z\-]*\b",
    r"\bSection\s+\d+[a-zA-Z\-]*\s+of\s+the\s+FCRA\b",
    r"\bFlorida state law\b",
    r"\bstatute of limitations\b",
]

# Openings that mark a theme as boilerplate.
BOILERPLATE_STARTS = [
    "you are an expert", "complaint", "note", "please", "let me know",
    "theme label", "respond",
]

# Themes too generic to keep.
GENERIC_THEMES = ["", "complaint", "dispute", "issue", "problem", "concern"]

# Theme lengths in words.
THEME_MAX_WORDS, THEME_KEPT_WORDS = 10, 7
THEME_WORD_RANGE = (2, 10)

# Words allowed on a strictly parsed tag line.
TAG_LINE_WORD_RANGE = (1, 6)

# Labels of unnamed clusters and of noise.
UNKNOWN_LABEL, NOISE_LABEL = "Unknown", "Noise/Outlier"

# One summary sentence per month and state: month, name, code, cases, topic.
SUMMARY_TEMPLATE = "%s: %s (%s) has %d cases about %s."
SUMMARY_SOURCE = "complaint_summary"

# United States postal codes and names.
STATE_NAMES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}

# Texts read as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Personal data, replaced in this order: (type, pattern, placeholder, sign).
# The sign is a short pattern that every hit contains; texts without it are
# spared the full pattern.
PII_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]", "@"),
    ("secret", r"(?i)(?:api_?key|token|secret|password)[ ]*[:=][ ]*[\"']?[A-Za-z0-9_-]{8,}[\"']?", "[SECRET]", "[:=]"),
    ("long_number", r"[0-9]{12,}", "[NUMBER]", "[0-9]{12}"),
    ("phone", r"(?:\+?[0-9]{1,2}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", "[PHONE]",
     "[0-9]{3}[ .-][0-9]{4}"),
]

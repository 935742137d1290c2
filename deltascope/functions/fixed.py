"""Fixed values the results depend on, stated plainly in one place."""

# Text that means "no value", compared after trimming and lower-casing.
NULL_TOKENS = ("", "na", "n/a", "null", "none", "nan", "-", "--", "?", "unknown", "#n/a")

# Strings a CSV reader turns into true nulls (pandas' documented defaults).
CSV_NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Everything Unicode counts as white space, for trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Patterns.
AMOUNT_PATTERN = r"^\s*[-+(]?\s*[$€£¥]?\s*[\d,]+(\.\d+)?\s*%?\s*\)?\s*$"
CODE_NAME_PATTERN = r"(?i)(^|_)(id|key|code|no|num|number|uuid|guid|sku|ref)($|_)"
YEAR_NAME_PATTERN = r"(?i)(^|_)(year|yr|fy|fiscal_?year|period)($|_)"
ROLLUP_PATTERN = r"(?i)^\s*(level\s*\d+|total|all\b.*|subtotal|aggregate)\s*$"
NOT_A_SUM_PATTERN = (
    r"(?i)\b(average|avg|mean|median|typical|correlation|distribution|"
    r"variance|std|standard deviation|percentile|quantile|per capita)\b"
)
NUMBER_PATTERN = r"-?\d[\d,]*\.?\d*"
CAUSAL_PATTERN = (
    r"(?i)\b(fell|dropped|declined|rose|increased|decreased|change[d]?)\b[^.]{0,40}?"
    r"\b(due to|because of|driven by|caused by|resulted from)\b"
)
SUMMED_PATTERNS = (
    r"\beach contribut",
    r"\btogether (they )?(account|contribut|explain)",
    r"\bcombined,? (they )?(account|contribut|explain)",
    r"\bsum(med)? to\b",
)

# Words a text column may hold and still be a yes/no column.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "0", "1", "t", "f")
YES_WORDS = ("yes", "y", "true", "t", "1")

# Limits and thresholds.
MISSING = "(missing)"
YEAR_MIN, YEAR_MAX = 1900, 2100
YEAR_MAX_DISTINCT = 200
SAMPLE_VALUES = 4
TOP_VALUES = 6
CATEGORY_MAX_DISTINCT = 25
CATEGORY_MAX_RATIO = 0.5
KEY_MIN_RATIO = 0.95
KEY_MIN_DISTINCT = 100
FREE_TEXT_MIN_LENGTH = 40
TYPE_SHARE = 0.9
GRANULAR_MIN_DISTINCT = 1_000
GRANULAR_MIN_RATIO = 0.05
AUTO_DIMENSION_MAX_DISTINCT = 50
RECONCILE_TOLERANCE = 0.01
CONCENTRATED_MIN_SHARE = 0.35
DECOY_MIN_OWN_PCT = 25.0
DECOY_MAX_SHARE = 0.10
OFFSETTING_MAX_RATIO = 0.50
FIGURE_TOLERANCE = 0.051
GATE_MIN_SCORE = 0.8

"""Values every engine must share for equal results."""

# --- Fixed values: must equal the rules being matched -------------------------------------------
# Characters that count as white space, one by one and as the inside of a regex class.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD = r"\p{L}\p{N}_"
URL = rf"(?:http|www)[^{WS}]+"
MENTION = rf"@[{WORD}]+"
PUNCT = rf"[^{WORD}{WS}]"
NOT_LETTERS = "[^a-zA-Z]+"
TOKEN = rf"[^{WS}]+"

# Contractions, applied in this order.
CONTRACTIONS = (("can't", "cannot"), ("won't", "will not"), ("n't", " not"))

POSITIVE_WORDS = (
    "good", "great", "excellent", "amazing", "wonderful", "fantastic",
    "best", "love", "perfect", "awesome", "brilliant", "thank", "thanks",
)
NEGATIVE_WORDS = (
    "bad", "terrible", "awful", "horrible", "worst", "hate", "poor",
    "sucks", "disappointed", "delay", "cancel", "late", "lost", "never",
)
MIN_HITS = 2

CLASSES = ("negative", "neutral", "positive")
BLANK_MESSAGE = "Please enter a tweet!"
UNKNOWN_LABEL = "Unknown"

# Field values read as missing from a CSV.
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

MAX_WORDS = 25000
MAX_LENGTH = 120
MASKED_LENGTH = 128
VECTOR_SIZE = 200
OOV_ID = 1
SEED = 42
TEST_SHARE = 0.15
VAL_SHARE = 0.10
RESAMPLE_RATIOS = {1: 0.7, 2: 0.6}
LENGTH_BINS = 50
WORD_BINS = 30
PREVIOUS_BEST = 0.8928
TARGET = 0.90
# ------------------------------------------------------------------------------------------------

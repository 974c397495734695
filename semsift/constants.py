"""Fixed values that must equal the original engine's for identical results.

Everything here is a plain constant; the logic that uses it lives in
``semsift.functions`` / ``semsift.operators``.
"""

# --- fixed values (must match the original engine) -------------------------

# Stop words dropped from keyword tokens (applied after the plural strip).
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were",
    "of", "to", "in", "on", "for", "with",
    "what", "who", "when", "where", "why", "how",
    "define", "definition", "explain",
)

# Question prefixes stripped (first match only, at offset 0) before embedding a query.
ENTITY_PREFIXES = ("what is", "what are", "define", "definition of", "explain")

# Articles dropped from the entity string.
ENTITY_ARTICLES = ("a", "an", "the")

# Hybrid score weights: knn, keyword, title.
W_KNN = 0.55
W_KEYWORD = 0.30
W_TITLE = 0.15

# Title score constants.
TITLE_EXACT = 2.5
TITLE_CONTAINS = 1.5

# Candidate over-fetch factor for the re-ranking stage.
OVERFETCH = 1.5

# Default result size of an interactive search.
DEFAULT_K = 10

# Token frequency is stored as SMALLINT.
FREQ_CAP = 32767

# Model input length and the words that fit in it (CLS + words + SEP).
MAX_SEQ_LEN = 128

# Stored vectors and query vectors are quantised to this many decimals.
VECTOR_DECIMALS = 6

# Link of an ingested article = prefix + raw title (no URL encoding).
LINK_PREFIX = "https://en.wikipedia.org/wiki/"

# Records per JSON-lines output file at prepare time.
RECORDS_PER_FILE = 10000

# Ingest batch size (rows per model call).
INGEST_BATCH = 250

# Redirect markers: prepare drops text starting with this (case-insensitive),
# ingest drops text containing the upper-case form anywhere.
REDIRECT_PREFIX = "#redirect"
REDIRECT_MARKER = "#REDIRECT"

# Special vocabulary tokens.
PAD, CLS, SEP, UNK = "[PAD]", "[CLS]", "[SEP]", "[UNK]"

# The 32 ASCII punctuation characters (C-locale ispunct), in code-point order.
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# ASCII whitespace (C-locale isspace).
ASCII_SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]+"

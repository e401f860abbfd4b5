"""Fixed values.

These values must equal the behaviour being reproduced for the results to
match (tokenizer alphabet, filter thresholds, stopword list, URL rules).
They are stated plainly and in their natural order; change none of them
without changing the documented semantics.
"""

# --- Fixed values: tokenizers -------------------------------------------------
# The 21 punctuation characters that both tokenizers turn into a space.
PUNCTUATION = ".?!,:;—()[]{}\\'\"/*&~+"
PUNCTUATION_SPACES = " " * len(PUNCTUATION)
# A term is a maximal run of these characters.
TERM_PATTERN = r"[A-Za-z0-9_\-#@]+"
# Vowels counted by the long-token filter.
VOWELS = "aeiouy"

# --- Fixed values: index filters ----------------------------------------------
MIN_TERM_LEN = 2          # keep length >= 2
MAX_TERM_LEN = 29         # keep length <= 29
LONG_TERM_LEN = 20        # vowel rule applies above this length
LONG_TERM_MAX_VOWELS = 7  # drop when vowels > 7 and vowels + 1 < length // 2
RARE_MIN_LEN = 3          # rare-term rule keeps 3 < length < 15 ...
RARE_MAX_LEN = 15
RARE_MIN_OCCURRENCES = 20  # ... or more than 20 occurrences

# --- Fixed values: ranking ------------------------------------------------------
LINK_BOOST_PER_TERM = 0.15
SIMILARITY_EXPONENT = 1.2
TOP_K = 20

# --- Fixed values: stopwords (one per line in the source list, in that order;
# 135 lines, 132 distinct because i, s and t repeat) -------------------------
STOPWORD_LINES = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "into",
    "through", "during", "before", "after", "above", "below", "to", "up", "down", "in",
    "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "where", "all", "both", "each", "few", "more", "most", "other", "some",
    "such", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "a", "b", "c", "d", "e", "f", "g",
    "h", "i", "j", "k", "l", "m", "n", "o", "p", "q", "r", "s", "t", "u", "v", "w",
    "x", "y", "z",
)

# --- Fixed values: outlinks ----------------------------------------------------
MAX_LINK_LEN = 750  # links of this length or longer are dropped
SKIPPED_LINK_SUFFIXES = (".jpg", ".png", ".pdf", ".css", ".js", ".zip", ".exe")
SKIPPED_LINK_MARKERS = ("mailto@", "mailto:", "tel:")

# --- Fixed values: URL canonicalisation (query keys removed, compared lower-case)
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "e",
    "ref", "source", "ref_source", "_hsfp", "_hssc", "_hstc", "gclid", "fbclid",
)

# --- Fixed values: responses ------------------------------------------------------
MAX_RESPONSE_BYTES = 3 * 1024 * 1024  # Content-Length above this is rejected

# --- Fixed values: politeness --------------------------------------------------
RETRY_STATUSES = (403, 429, 503)
RETRY_FALLBACK_SECONDS = 15.0
ROBOTS_MIN_WAIT_SECONDS = 0.2
DEFAULT_WAIT_SECONDS = 1.0
MIN_SLEEP_SECONDS = 0.05
MAX_BATCH_WAIT_PRODUCT = 3.0  # sleep x URLs of a domain must stay below this
ROBOTS_ACCESS_AGENT = "*"

# --- Fixed values: batching ------------------------------------------------------
SEED_BATCH_SIZE = 3
FRONTIER_BATCH_SIZE = 50
FRONTIER_EXIT_DOMAINS = 0
CRAWL_BUDGET = 10000

# --- Default public suffixes (a small offline list; pass a full list as a table)
DEFAULT_PUBLIC_SUFFIXES = (
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "io", "co",
    "ai", "app", "dev", "me", "tv", "us", "uk", "co.uk", "org.uk", "ac.uk",
    "gov.uk", "de", "fr", "es", "it", "nl", "be", "ch", "at", "se", "no", "dk",
    "fi", "pl", "pt", "ie", "eu", "ru", "cn", "com.cn", "jp", "co.jp", "ne.jp",
    "kr", "co.kr", "in", "co.in", "au", "com.au", "net.au", "org.au", "nz",
    "co.nz", "ca", "br", "com.br", "mx", "com.mx", "ar", "com.ar", "za", "co.za",
)

"""Fixed values that results depend on: thresholds, word lists, patterns and statuses."""

# Overlap scoring.
HIGH_OVERLAP = 0.6
LOW_OVERLAP = 0.3
TOP_K = 5
ENTITY_WEIGHT = 2.0
CONTENT_WEIGHT = 1.0
MIN_PAGE_CHARS = 80
PASSAGE_MAX_CHARS = 400
PASSAGE_MIN_CHARS = 20
SNIPPET_MAX_CHARS = 300
CONTEXT_MAX_CHARS = 512
DROP_CONTEXT_CHARS = 160

# Entailment and contradiction.
ENTAIL_SUPPORTED = 0.7
ENTAIL_AMBIGUOUS = 0.3
CONTRADICTION = 0.5
POOL_MIN_OVERLAP = 0.5
POOL_MIN_CHARS = 25
SLOT_MIN_SHARED = 0.35
VERBATIM_MIN_TOKENS = 10

# Fetching, caching and page use.
CACHE_HOURS = 24
RETRY_AFTER_CAP = 30.0
REQUEST_SECONDS = 5.0
BACKOFF_SECONDS = (0.5, 1.5)
RETRIED_STATUSES = (429, 503)
IN_FLIGHT = 10

# Models and the environment.
DEFAULT_MODEL = "cross-encoder/nli-deberta-v3-base"
MODEL_TOKENS = 512
ENV_MODEL, ENV_CACHE, ENV_ROOTS, ENV_ANY_LOCAL = "ATTESTA_NLI_MODEL", "ATTESTA_CACHE_DIR", "ATTESTA_LOCAL_ROOTS", "ATTESTA_ALLOW_ANY_LOCAL"
USABLE_PAGE_CHARS = 800

# Word lists.
STOPWORDS = tuple(
    """
    a an and are as at be been being but by can could did do does doing down
    during each few for from further had has have having he her here hers
    him his how i if in into is it its itself just me more most my myself
    of off on once one only or other our ours out over own same she
    should so some such than that the their theirs them then there these
    they this those through to too under until up very was we were what when
    where which while who whom why will with would you your yours
    """.split()
)
NEGATIONS = ("not", "no", "never", "nor")
ANAPHORS = ("it", "he", "she", "they", "this", "that", "these", "those", "our", "their", "his", "her", "its")
GENERIC_TERMS = tuple(
    """
    used use uses using run runs running coroutine coroutines concurrently concurrent scheduled schedule object
    objects function functions value values type types task tasks event events loop loops way ways one two new set
    get make made provide provides support supports call calls code data time times first other same given using able
    """.split()
)
NOT_NAMES = tuple(
    """
    the a an in on at it this that these those as by for we he she they our its if but and or so to from with when
    while after before during each some most many all one two three both however there here then thus also because
    since although though whether see note return set not new use used using supports support provides
    """.split()
)
CONJUNCTIONS = (" and also ", " and ", " while ", " but ")  # the longest wins where two start together
SWAP_NAMES = ("Marlowe", "Zenith", "Northwind", "Calder", "Halcyon", "Tessellate")
AUXILIARIES = (" is ", " are ", " was ", " were ", " can ", " will ", " must ", " may ", " has ", " have ")
SENTENCE_WORDS = (12, 34)

# Patterns, in the syntax of java.util.regex.
WORD = r"[A-Za-z][A-Za-z0-9'\-]*|\d+(?:\.\d+)?"
LONG_WORD = r"[A-Za-z][A-Za-z0-9'\-]+|\d+(?:\.\d+)?"
QUOTED = r"\"[^\"\n]{2,}\"|'[^'\n]{2,}'"
NUMBER = r"\d+(?:\.\d+)?"
NAME = r"\b[A-Z][a-zA-Z0-9]{2,}(?:\s+[A-Z][a-zA-Z0-9]+)*\b"
VERBATIM_TOKEN = r"[0-9A-Za-z]+(?:[._'-][0-9A-Za-z]+)*"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
NUMERIC_MARKER = r"\[(\d+)\](?!\()"
INLINE_LINK = r"\[([^\[\]\n]+)\]\(\s*([^()\s]+)\s*\)"
SOURCES_HEADING = r"(?im)^\s{0,3}(#{1,6})\s*(?:sources|references)\b.*$"
REF_DEFINITION = r"(?m)^\s*\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s+.*)?$"
NUMBERED_ITEM = r"(?m)^\s*(\d+)[.)]\s+(\S.*)$"
URL_TOKEN = r"(?:https?://|file://)[^\s\)\]>\"']+"
PAYWALL = (
    r"paywall",
    r"subscribe\s+to\s+(?:continue|read|unlock|access)",
    r"sign\s+in\s+to\s+continue",
    r"log\s?in\s+to\s+(?:continue|read|access|view)",
    r"metered\s+access",
    r"this\s+article\s+requires\s+a\s+subscription",
    r"you've\s+reached\s+your\s+(?:monthly\s+)?limit",
    r"<form[^>]*\baction=[\"'][^\"']*(?:^|/|[\"'])(?:login|signin|sign-in|logout|auth)(?:[/\"'?#]|$)[^\"']*[\"'][^>]*>",
    r"\bclass=[\"'][^\"']*(?:paywall|login-form|subscription-wall)[^\"']*[\"']",
)
RETRACTION = (r"retraction\s+notice", r"\bretracted\b", r"\bretraction:\s", r"expressed\s+concerns\s+about\s+the\s+validity")

# Statuses, and the one each category of evaluation cases calls for.
SUPPORTED, UNSUPPORTED, UNREACHABLE, PAYWALLED, AMBIGUOUS, ERROR = "supported", "unsupported", "unreachable", "paywalled", "ambiguous", "error"
VERDICTS = (SUPPORTED, UNSUPPORTED, UNREACHABLE, PAYWALLED, AMBIGUOUS)
STATUSES = (*VERDICTS, ERROR)
CANONICAL = {
    "verbatim-supported": SUPPORTED,
    "paraphrase-supported": SUPPORTED,
    "numeric-detail-supported": SUPPORTED,
    "false-claim": UNSUPPORTED,
    "negation-flip": UNSUPPORTED,
    "entity-swap": UNSUPPORTED,
    "partially-true-ambiguous": AMBIGUOUS,
    "dead-link": UNREACHABLE,
    "paywalled": PAYWALLED,
    "partially-true-mixed": AMBIGUOUS,
    "fully-supported-compound": SUPPORTED,
}
CONFIDENCES = ("high", "medium", "low")
#: The 97.5 % quantile of the standard normal distribution.
Z95 = 1.959963984540054

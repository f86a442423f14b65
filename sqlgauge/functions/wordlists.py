"""Word lists and operator groups that define the results.

They have to equal the published definition for the scores to be comparable.
"""

# English stop words ignored by value matching.
STOP_WORDS = frozenset(
    """
    a about above after again against ain all am an and any are aren aren't as at
    be because been before being below between both but by
    can couldn couldn't
    d did didn didn't do does doesn doesn't doing don don't down during
    each few for from further
    had hadn hadn't has hasn hasn't have haven haven't having he her here hers
    herself him himself his how
    i if in into is isn isn't it it's its itself
    just ll
    m ma me mightn mightn't more most mustn mustn't my myself
    needn needn't nor not now
    o of off on once only or other our ours ourselves out over own
    re
    s same shan shan't she she's should should've shouldn shouldn't so some such
    t than that that'll the their theirs them themselves then there these they
    this those through to too
    under until up
    ve very
    was wasn wasn't we were weren weren't what when where which while who whom why
    will with won won't wouldn wouldn't
    y you you'd you'll you're you've your yours yourself yourselves
    """.split()
)

# Words that only count when they match perfectly.
COMMON_WORDS = frozenset({"no", "yes", "many"})

# Ubiquitous database terms that never count as a match.
COMMON_DB_TERMS = frozenset({"id"})

# Characters that separate token spans.
SPAN_SEPARATORS = "'\"()`,.?! "

# Operator groups counted by the difficulty metric.
WHERE_OPS = ("not", "between", "=", ">", "<", ">=", "<=", "!=", "in", "like", "is", "exists")
UNIT_OPS = ("-", "+", "*", "/")
AGG_OPS = ("max", "min", "count", "sum", "avg")
COND_OPS = ("and", "or")
SET_OPS = ("intersect", "union", "except")
ORDER_OPS = ("desc", "asc")
COUNTED_OPS = WHERE_OPS + UNIT_OPS + AGG_OPS + COND_OPS + SET_OPS + ORDER_OPS
DIFFICULTY_LEVELS = ("simple", "moderate", "challenging")

# BM25 (Okapi) constants and retrieval limits.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
VALUES_KEPT = 2
MATCH_THRESHOLD = 0.85

# Delimiter of the prediction file and its stand-in entry.
PREDICTION_DELIMITER = "\t----- bird -----\t"
MISSING_PREDICTION = (" ", "financial")

# Prompts at or above this many tokens go to the long-context model.
LONG_PROMPT_TOKENS = 3800

# Sample values of this many characters or more are not rendered.
MAX_RENDERED_VALUE = 100

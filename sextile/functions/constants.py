"""Fixed values shared by the whole package."""

# The default categories, in report order.
CATEGORIES = (
    "Political",
    "Economic",
    "Social",
    "Technological",
    "Legal",
    "Environmental",
)

# Columns of a labelled-article file, and of a file of texts to score.
HEADLINE, DESCRIPTION, TAGS, LABEL = "Headline", "Description", "Topic_Tags", "PESTLE_Category"
ARTICLE_COLUMNS = (HEADLINE, DESCRIPTION, TAGS, LABEL)
TEXT_COLUMN = "text"

# The log keeps this many characters of a text.
LOG_TEXT_CHARS = 500

# Defaults of training.
SEED = 42
MAX_FEATURES = 5000
MIN_DF = 2
MAX_DF = 0.95
NUM_TREES = 200
MAX_DEPTH = 20
MIN_LEAF = 2

# A token is a run of two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Strings a CSV reader takes for a missing value.
NA_STRINGS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# The words of Spark's own English stop-word list that can be a token. The rest of
# that list is single letters and words with an apostrophe, which the token pattern never yields.
ENGLISH_STOP_WORDS = tuple(
    """
    me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
    hers herself it its itself they them their theirs themselves what which who whom this that these
    those am is are was were be been being have has had having do does did doing an the and but if or
    because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where
    why how all any both each few more most other some such no nor not only own same so than too very
    can will just don should now cannot could ought would
    """.split()
)

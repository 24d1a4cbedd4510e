"""Fixed values the results depend on.

FIXED VALUES — these must stay equal to the behaviour being reproduced
(label domains, lexicons, defaults, message texts). Keep them in natural
order and together here; everything else derives from them.
"""

from __future__ import annotations

# ---- FIXED VALUES: label domains -------------------------------------------
MULTICLASS_ID2LABEL = {0: "negative", 1: "neutral", 2: "positive"}
BINARY_ID2LABEL = {0: "negative", 1: "positive"}
LABEL_MODES = ("multiclass", "binary_polarity")
FEATURE_MODES = ("word", "word_char")

# ---- FIXED VALUES: baseline defaults ---------------------------------------
DEFAULT_MAX_FEATURES = 100000
DEFAULT_NGRAM_MAX = 2
DEFAULT_MIN_DF = 2
DEFAULT_CHAR_MAX_FEATURES = 50000
DEFAULT_CHAR_NGRAM_MIN = 3
DEFAULT_CHAR_NGRAM_MAX = 5
DEFAULT_C = 0.7
DEFAULT_MAX_ITER = 1000
DEFAULT_SEED = 42

# ---- FIXED VALUES: retrieval / answer defaults -----------------------------
DEFAULT_TOP_K = 5
MAX_TOP_K = 20
DEFAULT_GENERATION_MODE = "auto"
DEFAULT_GENERATOR_TIMEOUT = 45.0
GENERATION_MODES = ("auto", "extractive", "llm")
KEYPHRASE_MAX_FEATURES = 1000
KEYPHRASE_TOP_N = 5
SNIPPET_LIMIT = 120
TRUNCATE_LIMIT = 220
PUBLIC_API_HOST = "api.openai.com"
# answer sentences (extractive mode)
FOUND_TEMPLATE = "Found {n} relevant reviews for: {question}"
MOST_TEMPLATE = "Most retrieved reviews are {label} ({n}/{k})."
FOCUS_TEMPLATE = "Sentiment focus applied: {focus}."
THEMES_PREFIX = "Recurring themes: "
EVIDENCE_PREFIX = "Example evidence: "
NO_HITS_MESSAGE = (
    "No relevant reviews were found for this question. Try a broader query "
    "or rebuild the index with more data."
)

# ---- FIXED VALUES: request validation --------------------------------------
MIN_TEXT_CHARS = 1
MIN_QUESTION_CHARS = 3

# ---- FIXED VALUES: sentiment-focus markers (priority: negative, positive,
# neutral). Matching is by substring of the lower-cased question.
NEGATIVE_MARKERS = ("негатив", "жалоб", "жалуют", "плохо", "проблем", "ошиб",
                    "медлен", "не работает", "слом", "минус")
POSITIVE_MARKERS = ("позитив", "плюс", "нрав", "хорош", "удоб", "быстро",
                    "лучше", "довол")
NEUTRAL_MARKERS = ("нейтрал", "без эмоций", "обычн", "средне")

# ---- FIXED VALUES: stop words removed before key-phrase n-grams -------------
STOP_WORDS = (
    "это", "как", "для", "что", "при", "если", "она", "они", "или", "уже",
    "просто", "после", "через", "когда", "который", "которая", "которые",
    "очень", "свои", "своих", "того", "только", "всего", "снова", "потому",
    "между", "будет", "чтобы", "можно", "нужно", "теперь", "раньше", "стало",
    "приложение", "приложении", "приложения", "программа", "программой",
    "сервис", "сервиса", "которое", "которых", "весь", "всем", "всех", "есть",
    "было", "были", "быть", "также", "пока", "потом", "либо", "лишь", "вроде",
    "тут", "там", "где", "куда", "отзыв", "отзывы", "отзыве", "мной", "меня",
    "тебя", "себя", "вами", "нами", "тоже", "себе", "этого", "этой", "этот",
    "этом", "много", "мало",
)

# ---- FIXED VALUES: plot colours per task ------------------------------------
TASK_COLOURS = {"binary_polarity": "#1b7f5f", "multiclass": "#2f6f8f"}
DEFAULT_TASK_COLOUR = "#5f6b7a"


def marker_lexicon(negative=NEGATIVE_MARKERS, positive=POSITIVE_MARKERS,
                   neutral=NEUTRAL_MARKERS) -> list[tuple[str, str, int]]:
    """(marker, focus, priority) rows; lower priority wins."""
    rows = []
    for priority, (focus, markers) in enumerate(
        (("negative", negative), ("positive", positive), ("neutral", neutral))
    ):
        rows.extend((m, focus, priority) for m in markers)
    return rows

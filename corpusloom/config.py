"""Fixed values and job parameters."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: results depend on these exact patterns, words and formats. ---

ARTICLE_PREFIX = "URL: "
DATE_IN_URL = "[0-9]+/[0-9]+/[0-9]+"
TOKEN_PATTERN = r"[A-Za-z0-9\-]{3,50}"
SIGN_UP_SENTENCE = "Want to get this briefing by email? Here’s the sign-up."
CJK_CLASS = r"[\uac00-\ud7a3\u3040-\u30ff\u4e00-\u9fff]"  # Hangul, kana, Han

WORD_CLASSES: dict[str, list[str]] = {
    "person_titles": ["mr", "mrs", "ms", "dr", "mr.", "mrs.", "ms.", "dr.", "e"],
    "broken_words": ["don", "isn", "mustn", "shouldn", "couldn", "doesn", "didn"],
    "numbers": ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "000"],
    "url_terms": ["http", "https", "ref", "href", "com", "src"],
    "days": ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"],
    "months": ["january", "february", "march", "april", "may", "june", "july", "august",
               "september", "october", "november", "december"],
    "periods": ["minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
                "month", "months", "year", "years"],
    "times": ["yesterday", "today", "tomorrow", "day", "night", "morning", "afternoon",
              "evening", "edt", "est", "time", "times"],
    "nouns": ["new", "york", "nytimes", "press", "news", "report", "page", "user", "file",
              "video", "pic", "photo", "online", "social", "media", "group", "inbox", "item",
              "advertisement", "world", "store", "story", "life", "family", "people", "man",
              "woman", "friend", "friends"],
    "social_media": ["twitter", "facebook", "google", "gmail", "video", "photo", "image",
                     "user", "social", "media", "page", "online", "stream", "post", "app"],
}

LIGHT_VERB_ROOTS = [
    "ask", "come", "go", "know", "look", "see", "talk", "try", "use", "want", "call", "click",
    "continue", "comment", "do", "feel", "find", "give", "get", "have", "include", "like", "live",
    "love", "make", "post", "read", "say", "speak", "send", "share", "show", "sign", "tag",
    "take", "tell", "think", "update", "work", "write",
]

# Marks and words taken out of the lemmas before the alphabetical vectorizer.
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
EXTRA_WORDS = ["-pron-", "mr", "mrs", "ms", "dr", "man", "woman"]

# --- End of fixed values. ---

# Characters that count as white space at the ends of a text and between words.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regular-expression character class.
WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)


@dataclass(frozen=True)
class TopicParams:
    """Everything a topic job can be told.

    ``steps_per_pass`` is the number of training steps a pass has, whatever the size of the corpus:
    each step draws one in so many documents. ``None`` leaves Spark's default sampling rate. Spark
    draws with replacement, so that a pass meets about 63 % of the documents, not every one. Of
    ``restarts`` fits, with seeds from ``seed`` on, the one of the highest likelihood is kept.
    """

    topics: int = 20
    max_iter: int = 200
    passes: int | None = None
    vocab_size: int | None = 10_000
    vocab_order: str = "cf"
    min_df_frac: float | None = 0.02
    max_df_frac: float | None = 0.8
    min_df_count: float | None = None
    learning_offset: float = 100.0
    learning_decay: float = 0.51
    steps_per_pass: int | None = None
    symmetric_priors: bool = False
    seed: int = 1
    restarts: int = 1
    top_words: int = 20
    features_col: str = "features"

    @property
    def iterations(self) -> int:
        return self.max_iter if self.passes is None else self.passes * (self.steps_per_pass or 1)

    @property
    def sampling_rate(self) -> float | None:
        return None if self.steps_per_pass is None else 1.0 / self.steps_per_pass


def spark_profile(**changes) -> TopicParams:
    """The distributed job: online LDA over at most 10,000 terms."""
    return TopicParams(**changes)


def spark_trial_profile(**changes) -> TopicParams:
    """The quick trial of the distributed job: fewer topics, terms and iterations."""
    return TopicParams(**{"topics": 15, "max_iter": 10, "vocab_size": 5_000, "top_words": 15, **changes})


def multicore_profile(**changes) -> TopicParams:
    """Chunked multi-pass training over a dictionary cut by document frequency."""
    base = dict(
        passes=10, vocab_size=100_000, vocab_order="df", min_df_frac=None, min_df_count=0.02,
        learning_offset=1.0, learning_decay=0.5, steps_per_pass=5, symmetric_priors=True,
    )
    return TopicParams(**{**base, **changes})


def multicore_trial_profile(**changes) -> TopicParams:
    """The quick trial of the chunked training."""
    return multicore_profile(**{"topics": 15, "passes": 20, "top_words": 15, **changes})


def batch_profile(**changes) -> TopicParams:
    """Mini-batch training over an alphabetical vocabulary."""
    base = dict(
        topics=10, passes=200, vocab_size=None, vocab_order="alphabetical", max_df_frac=0.5,
        steps_per_pass=5, symmetric_priors=True, top_words=15,
    )
    return TopicParams(**{**base, **changes})

"""Rows the operators must stand, and a few texts to work on."""

import itertools
import random

SYLLABLES = ["the", "an", "er", "in", "on", "th", "re", "st", "ou", "ea", "ti", "nd", "ly", "ble", "tion"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words, syllables=SYLLABLES):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents(spark, texts, langs=None):
    """Rows numbered from 1; a text may be None."""
    langs = langs or itertools.repeat("en")
    return spark.createDataFrame([(k, t, lang, "src0", len(t or "")) for k, (t, lang) in enumerate(zip(texts, langs), 1)], DOCUMENTS)


def awkward(spark):
    """Null and empty texts, null ids, a very long text, repeated rows, columns with clashing names."""
    long = prose(1, 30_000)
    rows = [(1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (None, "hello there", None), (None, None, None),
            (4, long, "en"), (5, "same text here for all of us", "de"), (5, "same text here for all of us", "de"),
            (6, "same text here for all of us", "de"), (7, "x", "fr"), (8, "▁ \\ </s>", "fr"), (9, "1234 5678", "en")]
    return spark.createDataFrame([(i, t, lang, "s", 0, "mine", 1.5, True) for i, t, lang in rows],
                                 DOCUMENTS + ", score string, fp double, held_out boolean")


def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)

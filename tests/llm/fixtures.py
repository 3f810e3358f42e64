"""Small frames with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
UPPER = {k: k + 32 for k in range(65, 91)}

# doc_id, text, lang, source, n_chars
AWKWARD = [
    (1, "the cat sat on the mat and went to sleep in the sun", "en", "a", 51),
    (2, "the cat sat on the mat and went to sleep in the sun", "en", "b", 51),
    (2, "the cat sat on the mat and went to sleep in the sun", "en", "b", 51),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "  \t\n ", "de", None, 5),
    (6, "İstanbul Straße ſecret K x", "de", "é", 24),
    (None, "a row without an id", "en", "a", 19),
    (None, None, None, "a", None),
    (7, LONG, "en", "a", len(LONG)),
    (8, "one", "en", "Z", 3),
    (9, "password = hunter22 licensed under cc by 4.0, all rights reserved", "en", "a", 60),
    (10, "All rights reserved. ALL RIGHTS RESERVED all rights", "en", "c", 50),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = {
    "size": "1", "key": "2", "target": "3", "taken": "4", "fingerprint": "5", "component_id": "6", "component": "7", "node": "8", "toxic": "9",
    "toxicity": "10", "secrets": "11", "count": "12", "label": "13", "hash": "14", "words": "15", "n_tokens": "16", "rank": "17", "copies": "18",
    "item": "19", "start": "20", "text_hash": "21", "score": "22", "lists": "23", "payload": "24", "digest": "25", "weight": "26", "pick": "27",
}


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def clashing(df):
    """The frame with extra columns named like what operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items() if k not in df.columns})


def none_of(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"t{r.randrange(vocabulary)}" for _ in range(words))


def smallest_reachable(ids: list, links: list[tuple]) -> dict:
    above = {i: i for i in ids}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def ascii_lower(text: str | None) -> str:
    return (text or "").translate(UPPER)


def split_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")

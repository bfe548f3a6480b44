"""Small tables with the awkward rows every operator must bear."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORDS = "the of and river stone light cloud ember field harbour signal copper window garden letter mirror".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ly"]) for _ in range(n))


def awkward_documents(seed: int = 3) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, blanks, short and very long texts, odd characters."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(20, 80)) for _ in range(12)]
    passage = sentence(rng, 60)
    rows = [(k, base[k]) for k in range(12)]
    for k in range(12, 24):  # near copies: one word changed
        words = base[k % 5].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(k, base[1]) for k in range(24, 34)]  # a group of copies
    rows += [(k, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 10)) for k in range(34, 40)]
    rows += [(40, None), (41, ""), (42, "   \t\n "), (43, "one"), (44, "ONE"), (45, "a b c d"), (46, "A b  c D"), (47, "été 日本語 " * 30), (48, "\x00nul\x00 " * 20)]
    rows += [(49, "x" * 3000), (50, sentence(rng, 30_000)), (51, "y" + "x" * 3000)]
    rows += [(52, base[2]), (52, base[2])]  # repeated rows
    rng.shuffle(rows)
    return rows


SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("block", T.StringType()), ("score", T.StringType()), ("shard", T.StringType()), ("bands", T.StringType()))]
)


def frame(spark, rows, parts: int = 3):
    """The rows with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "b", "s", "h", "k") for i, t in rows], SCHEMA).repartition(parts)


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")

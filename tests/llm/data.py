"""Small tables for the operators: invented text with copies, and awkward rows."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["ka", "lo", "mi", "ne", "pu", "ra", "so", "ti", "va", "zu", "be", "do", "fe", "gi", "hu", "ja"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def copies(seed: int, n: int = 60, length: int = 60) -> list[tuple]:
    """Documents of which about half are near or exact copies of another."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = sentence(rng, rng.randint(3, length)).split()
        if out and rng.random() < 0.6:
            words = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + 1] = [] if rng.random() < 0.3 and len(words) > 4 else [rng.choice(WORDS)]
            if rng.random() < 0.3:
                words += sentence(rng, rng.randint(1, 30)).split()
        text = rng.choice([" ", "  ", "\n", "\t"]).join(words)
        out.append((i * 3 + 1, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c"]), len(text)))
    rng.shuffle(out)
    return out


def awkward(seed: int = 0) -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, one long text."""
    rng = random.Random(seed)
    long = "\n".join(sentence(rng, 12) for _ in range(4000))
    base = [(1, None, "en", "a", 5), (2, "", "en", None, None), (3, " \n\t ", None, "b", 3), (None, sentence(rng, 30), "en", "a", 9), (4, sentence(rng, 30), None, None, None), (5, "één ünï — 你好 🙂", "xx", "c", 1), (6, long, "en", "a", len(long)), (8, long + "\nmore words here", "en", "a", 7), (7, "!!! 123 ###", "en", "b", 2)]
    return base + [base[4], base[4], (4, "another text under the same id", "en", "a", 4), base[0], base[3]]


def frame(spark, rows, clash: bool = False):
    """clash: with columns named like those the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        names = ["whole", "node", "token", "row_key", "bucket", "ranges", "n", "size", "kept_text", "gone", "doc", "block", "weight", "rl_items", "mix_slot", "held_out", "lot", "t0", "h", "bound", "host", "y", "label"]
        df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(names)])
    return df


def split(text: str | None) -> list[str]:
    """The words of a text: parted by the six ASCII blanks only."""
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]

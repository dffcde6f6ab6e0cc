import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n long, bucket long, label string"


def documents(spark, texts, langs=None):
    """A table with nulls and columns whose names clash with the operators' own."""
    rows = [(i, t, (langs or {}).get(i, "en" if i % 2 else None), None, len(t or ""), -1, "x", None, 3, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts(seed=1):
    rng = random.Random(seed)
    words = "alpha beta gamma delta épsilon zeta ΗΤΑ theta iota kappa 日本 mu".split()
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 160))) for _ in range(12)]
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    near = prose[0].split()
    near[50] = "changed"
    return [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two three four", *prose, prose[0], prose[0].replace(" ", "\n"), " ".join(near), prose[1] + " ", long,
        "same line\n" * 80, "q" * 500, "a <|endoftext|> b  c \n\n d\x1c\x85e's 12 ²½", "MIT License\nSPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-only WITH X) AND BSD-3-Clause",
        prose[2] + " tail", "lead " + prose[2], "123 456", "😀 astral 𝔸b",
    ]

"""Small corpora with copies, shared passages and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, words string, key long, row string"


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    texts = []
    for i in range(n):
        kind = i % 6
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 19, 20, 60, 300]))]
        if kind == 1 and texts:
            texts.append(texts[rng.randrange(len(texts))])
        elif kind == 2 and texts:
            old = (texts[rng.randrange(len(texts))] or "").split(" ")
            old[rng.randrange(len(old))] = "changed"
            texts.append(" ".join(old))
        elif kind == 3:
            texts.append(" ".join(w[:40]) + "\n" + passage + "\n" + " ".join(w[40:]))
        elif kind == 4:
            texts.append("\n".join(" ".join(rng.choice(["one", "two", "Deux"]) for _ in range(3)) for _ in range(12)))
        else:
            texts.append(" ".join(w))
    texts[5], texts[11] = None, ""
    texts[17] = "\t\n \x0b"
    texts[23] = "é" * 70 + " " + "ü" * 70
    return list(enumerate(texts))


def frame(spark, rows):
    """The rows as documents, with columns whose names clash with names that operators use."""
    full = [(k, t, "en", "s", len(t or ""), 1, "w", 2, "r") for k, t in rows]
    return spark.createDataFrame(full, SCHEMA)

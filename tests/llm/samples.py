"""Documents that the tests of this folder share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, sources=None):
    """Documents numbered from 0, spread over partitions."""
    rows = [(i, t, "en", (sources or ["a"])[i % len(sources or ["a"])], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=1, n=160, vocabulary=400):
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    line = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [line(rng.randint(14, 40)) for _ in range(5)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            text = rng.choice(out)
        elif out and kind < 0.45:
            text = list(rng.choice(out).split())
            for _ in range(rng.randint(1, 4)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
            text = " ".join(text)
        else:
            body = line(rng.randint(0, 90))
            if rng.random() < 0.4:
                at = rng.randint(0, len(body))
                body[at:at] = rng.choice(passages)
            if rng.random() < 0.15:
                body += body[-20:] * 3
            text = " ".join(body)
        out.append(text)
    return out

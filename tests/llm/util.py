import random

SYLLABLES = "an er on th re ti en in at or st ou la el ne so mi ka".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(n=80, seed=1):
    """Documents with copies, near copies, shared passages, repeats, junk, and every odd case: (doc_id, text, lang, source, n_chars)."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    texts = []
    for i in range(n):
        w = words(rng, rng.choice([1, 3, 4, 5, 6, 20, 60, 150, 400]))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        if i % 7 == 0:
            w += w[:10]
        texts.append("".join(x + rng.choice([" ", " ", " ", "\n", ", ", "  ", "\t"]) for x in w))
        if i % 6 == 0 and i > 6:
            texts.append(texts[rng.randrange(len(texts))])
        if i % 4 == 0 and i > 4:
            v = texts[rng.randrange(len(texts))].split()
            for _ in range(max(1, len(v) // 40)):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v).upper() if i % 8 == 0 else " ".join(v))
    texts += [None, "", " \n\t", "!!! ??? 123", "x" * 3000, "word " * 2500, "日本語 テキスト é ñ ß", "a\x0bb\x0cc\x1cd\xa0e f", "one two three four five"]
    return [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)

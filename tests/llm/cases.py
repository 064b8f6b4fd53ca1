"""Small tables with the awkward cases every operator has to take."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, fp string, _row string, h int, key string"


def rows(seed=5, n=60):
    """Documents with nulls everywhere, empty and very long texts, ties, near and exact copies, and clashing names."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]

    def prose(k):
        return " ".join(r.choice(words) for _ in range(k))

    texts = [prose(r.randint(1, 120)) for _ in range(n)]
    texts += [None, "", "   \n\t ", "one", "Two words", prose(30_000), "ÄÖ É ÑANDÚ 中文 😀 end", "A" * 5000, "tie tie tie tie"]
    texts += [texts[0]] * 6 + [texts[1] + " tail", texts[1].upper(), texts[2].replace(" ", "  ")]
    out = [(i * 3, t, "en", f"src{i % 4}", len(t or ""), 1, "x", "row", 2, "k") for i, t in enumerate(texts)]
    out += [(0, texts[0], "en", "src0", 1, None, None, None, None, None), (None, texts[3], None, None, None, None, None, None, None, None),
            (None, None, None, None, None, None, None, None, None, None), (None, texts[3], None, None, None, 9, "", "", 9, "")]
    return out


def docs(spark, seed=5, parts=3):
    return spark.createDataFrame(rows(seed), DOCS).repartition(parts)


def none(spark):
    return spark.createDataFrame([], DOCS)

"""Tables for the tests of the pipeline."""

import random

RNG = 11


def _rows():
    rng = random.Random(RNG)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(3, 8))) for _ in range(600)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randrange(60, 150))]
        if i % 8 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vileword", "nastyterm"])
        elif i % 10 == 3 and i > 20:
            w = list(rows[i - 20][1])
            w[5] = "changed"
        elif i % 10 == 7:
            w[30:30] = passage
        elif i % 10 == 9:
            w[3:3] = ["mail", f"user{i}@example.org", "or", "+1 212 555 01" + f"{i:03d}"]
        rows.append((i, w))
    return rows


def mixed_documents(spark):
    return spark.createDataFrame([(i, t := " ".join(w), "en", f"s{i % 3}", len(t)) for i, w in _rows()], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def labels_table(spark):
    return spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int")

"""Documents with everything that can be odd about a row."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for k in range(n):
        out.append(r.choice(WORDS) + str(r.randrange(400)))
        if k % 12 == 11:
            out[-1] += ".\n" if k % 36 == 35 else "."
    text = " ".join(out).replace("\n ", "\n")
    return text + "."


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, score double, line string, chunk int, fp string, place int"


def rows() -> list[tuple]:
    a, b = prose(1, 120), prose(2, 90)
    passage = prose(9, 40)
    texts = [
        (1, a), (2, a), (3, b), (4, None), (5, ""), (6, " \t\n\x0b "), (7, "one"), (8, "one two"), (9, "one  two\tthree"),
        (10, b + "\n" + passage), (11, prose(3, 60) + "\n" + passage + "\n" + prose(4, 30)), (None, prose(5, 80)), (None, None),
        (12, prose(6, 20000)), (13, "Größe ÉTÉ été ß " * 30), (14, prose(7, 50)), (14, prose(8, 50)), (15, prose(7, 50)), (15, prose(7, 50)),
        (16, "spam ham eggs bacon toast jam tea milk " * 12), (17, b.replace("alpha", "omega", 1)), (18, "THE END!! OF!! IT!! " * 20), (-5, prose(10, 45)),
    ]
    src = ["s1", "s1", "s2", None, "s3", "s1", "é", "s2", "s1", "s1"]
    return [(i, t, "en" if k % 3 else None, src[k % len(src)], None if t is None else len(t), 1, 2, 0.5, "x", 3, "y", 4) for k, (i, t) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, docs=None):
    r = [(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(-5, 30)] + [(None, 1, 0), (3, None, None), (1, 0, 1)]
    return spark.createDataFrame(r, "doc_id long, quality int, toxic int")

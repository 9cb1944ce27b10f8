"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators make.
MORE = "doc_id long, text string, lang string, source string, n_chars long, size int, k string, part string, n long, digest string, rep long, component string, h long"


def words(rng, n, alphabet="abcdefgh"):
    return [("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7)))) for _ in range(n)]


def documents(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, " ".join(words(rng, rng.randint(1, 120))), rng.choice(["en", "fr"]), "s", 1))
    base = words(rng, 150)
    for j in range(25):  # a group of near copies, some linked only through others
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(5))
        rows.append((n + j, " ".join(w), "en", "s", 1))
    k = n + 25
    rows += [(k, None, None, None, None), (k + 1, "", "en", "s", 0), (k + 2, " \t\n", "en", "s", 3), (k + 3, "One two", "en", "s", 1), (k + 4, "one  TWO", None, "s", 1), (k + 5, rows[0][1], "en", "s", 1), (k + 6, " ".join(words(rng, 30_000)), "fr", "s", 1), (k + 7, "x" * 50_000, "fr", "s", 1), (k + 7, "x" * 50_000, "fr", "s", 1)]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return spark.createDataFrame([r + (7, "k", "p", 1, "d", 2, "c", 3) for r in rows], MORE)

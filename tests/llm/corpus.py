"""A small corpus with copies, near copies, shared passages and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light over under green house walks slowly past old mill where three birds sing each morning while rain falls on quiet roads".split()


def prose(rnd, n):
    out = []
    for i in range(n):
        w = rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "ed", str(rnd.randint(0, 99))])
        out.append(w.capitalize() if i % 9 == 0 else w + ("," if i % 7 == 3 else "." if i % 9 == 8 else ""))
    return " ".join(out)


def rows(seed=1, n=40):
    rnd = random.Random(seed)
    passage = prose(rnd, 60)
    out = []
    for i in range(n):
        text = prose(rnd, rnd.randint(5, 160))
        if i % 5 == 4:
            text = out[rnd.randrange(len(out))][1] or text  # an exact copy
        elif i % 5 == 3:
            words = (out[rnd.randrange(len(out))][1] or text).split(" ")
            words[rnd.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 5 == 2:
            text = f"{text}\n{passage}"
        out.append((i, text, ("en", "de", None)[i % 3], f"s{i % 4}" if i % 11 else None, len(text)))
    odd = ["", None, " \t\n", "x", "é ß Ö ñ  two\n\nthree", "a b c", "A b C", "For " * 60, "y" * 130 + "y" * 130, "́ #$% 😀"]
    out += [(100 + i, t, None, "odd", None) for i, t in enumerate(odd)]
    out += [out[3], out[3]]  # repeated rows
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

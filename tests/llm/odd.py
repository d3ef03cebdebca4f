"""A small table with every awkward case, and extra columns whose names clash with the operators' own."""

import random

LONG = "alpha " * 30_000 + "omega"
ONE_WORD = "x" * 50_000


def rows(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["The", "the", "ÉTÉ", "été", "über-"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120))) for _ in range(12)]
    out = []
    for i in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append((i, "\n".join(" ".join(w[k:k + 9]) for k in range(0, len(w), 9)), rng.choice(["en", None]), f"src{i % 3}"))
    out += [(1000, None, None, None), (1001, "", "en", "src0"), (1002, " \n\t ", "en", None), (1003, "one", None, "src1"),
            (1004, "ONE", "en", "src1"), (1005, LONG, "en", "src0"), (1006, LONG, "en", "src2"), (1007, ONE_WORD, "en", "src2"),
            (1008, "a b c d", "en", None), (None, "no id here at all", "en", "src0"), out[3], out[3]]
    return out


CLASHES = ("n", "h1", "sig", "salt", "node", "component", "key", "doc", "x", "y", "row", "value", "before", "host", "length",
           "task", "rank", "base", "score", "_id", "_row", "kept", "n_words", "dropped_id", "lo", "hi", "window", "rejected")


def frame(spark, data=None, clashes=True):
    data = rows() if data is None else data
    full = [(*r, len(r[1]) if r[1] is not None else None, *(("?",) * len(CLASHES) if clashes else ())) for r in data]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(
        f", `{c}` string" for c in (CLASHES if clashes else ()))
    return spark.createDataFrame(full, schema).repartition(4)


def empty(spark):
    return frame(spark, [])


def path(name="word_bpe_49k.json"):
    import public_tokenizers
    return public_tokenizers.path(name)


def key(t):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in t)


def ordered(rows_):
    return sorted(map(tuple, rows_), key=key)

"""Small made-up corpora."""

import random

SYLLABLES = {"aa": ["th", "er", "ing", "on", "ea", "nd", "the", "ou"], "bb": ["sch", "ung", "ein", "ich", "ge", "ver", "zu", "äu"], "cc": ["ción", "os", "que", "rr", "ado", "ez", "mi", "ñ"]}


def prose(rng, lang, n):
    pool = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(150)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in rng.choices(pool, k=n))


#: Rows that every operator has to bear: null, empty, blank, odd white space, one word, non-characters, repeated rows.
ODD = [(901, None), (902, ""), (903, " \n\t\x0b\x0c\r "), (904, "word"), (905, "a b c d"), (906, "▁ é 漢字 😀 \u0000 x"), (906, "▁ é 漢字 😀 \u0000 x"), (None, "no id at all here"), (907, "!!! 123 ###"), (908, "\\ < > </turn> \\b \\l")]


def frame(spark, rows, name="doc_id"):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, f"{name} long, text string")
    for c in ("id", "node", "chunk", "cell", "u", "v", "passage", "seed", "kept", "score", "text_key", "_text_key", "gone", "_gone", "fp", "sig", "keys", "least", "near", "page", "n"):
        df = df.withColumn(c, df[name].cast("string"))
    return df


def documents(seed=1):
    """(rows of documents, labels, benchmark): good prose, junk, copies, near copies and contaminated texts."""
    rng = random.Random(seed)
    docs, labels, bench = [], [], [(i, prose(rng, "aa", 30)) for i in range(5)]
    for i in range(150):
        lang = ("aa", "bb", "cc")[i % 3]
        text = prose(rng, lang, rng.randint(60, 120))
        if i % 5 == 4:
            text = " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split())
        docs.append((i, text, lang))
        labels.append((i, int(i % 5 != 4), 0))
    good = [d for d in docs if d[0] % 5 != 4]
    for k in range(5):
        docs.append((200 + k, good[k][1], good[k][2]))
        w = good[10 + k][1].split()
        w.insert(len(w) // 2, "extra")
        docs.append((210 + k, " ".join(w), good[10 + k][2]))
        words = bench[k][1].split()
        words[7], words[19] = "changed", "edited"
        docs.append((220 + k, prose(rng, "aa", 40) + " " + " ".join(words) + " " + prose(rng, "aa", 40), "aa"))
    return docs, labels, bench

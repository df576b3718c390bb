"""A table of odd documents and brute-force versions of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece string, kept string, d string, o string, n string, node string, rank string, tokens string, n_words string, fingerprint string, text2 string"


def texts() -> list[str | None]:
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["Straße", "ﬁne", "été", "the", "The", "of"]
    long_ = " ".join(rnd.choices(words, k=6000))
    passage = " ".join(rnd.choices(words, k=70))
    base = rnd.choices(words, k=200)
    near = base[:100] + ["changed"] + base[101:]
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "a b c", long_, " ".join(base), " ".join(base), " ".join(near), "  ".join(base[:90])]
    out += [" ".join(rnd.choices(words, k=60)) + " " + passage + "\n" + " ".join(rnd.choices(words, k=40)) for _ in range(4)]
    out += ["same line here with words\n" * 12, "x " * 60, "word" * 5000, "<|endoftext|> special  <|endoftext|>", "été   KK", "été kk", "#### $$$ %%%% <<>> | &"]
    out += [" ".join(rnd.choices(words, k=rnd.randint(5, 120))) for _ in range(12)]
    return out


def rows(doubled: bool = True) -> list[tuple]:
    ts = texts()
    own = [(i * 3, t, ("en", "fr", None)[i % 3], "s", None if t is None else len(t), *["clash"] * 11) for i, t in enumerate(ts)]
    if doubled:
        own += [own[7], own[7], (9, "another text under an id that is there already", "en", "s", 1, *["clash"] * 11), (None, "no id at all " + ts[11][:50], "en", None, None, *[None] * 11)]
    return own


def frame(spark, doubled: bool = True, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(doubled), SCHEMA)

"""Words in ranges against a scan of the text."""

import random
import re

from strandline.sources import word_positions as W


def test_words_in_ranges_equal_a_scan(spark):
    rnd = random.Random(8)
    words = ["a", "ab", "abc", "é", "x_1", "日本", "if"]
    texts = {f"f{i}": "".join(rnd.choices([*words, " ", "\n", ".", "-"], k=rnd.choice([0, 3, 40, 300]))) for i in range(12)} | {"none": None}
    asked = []
    for path, t in texts.items():
        for _ in range(25):
            n = len(t or "")
            s = rnd.randint(0, n)
            asked.append((path, rnd.choice([*words, "nowhere"]), s, rnd.randint(s - 1, n + 2)))
    asked += [("f1", "a", None, 5), ("f1", None, 0, 5), ("missing", "a", 0, 5)]
    got = W.in_ranges(W.index(spark.createDataFrame(list(texts.items()), "path string, content string")), spark.createDataFrame(asked, "path string, word string, start int, end int")).collect()
    want = []
    for path, word, s, e in asked:
        found = [m.start() for m in re.finditer(r"\w+", texts.get(path) or "") if s is not None and m[0] == word and m.start() >= s and m.end() <= e]
        want.append((path, word, s, e, len(found), found[0] if found else None))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(w[4] for w in want) > 20


def test_no_files(spark):
    assert W.index(spark.createDataFrame([], "path string, content string")).count() == 0

"""Coverage levels against sets, on mixed states."""

import itertools

from strandline.operators import coverage as C


def merge(states):
    s = set(states)
    if "partial" in s or "complete" in s and len(s) > 1:
        return "partial"
    return "failed" if "failed" in s else "complete" if "complete" in s else "skipped"


def test_levels_of_all_mixtures(spark):
    mixes = [m for n in (1, 2, 3) for m in itertools.combinations_with_replacement(C.STATUSES, n)]
    results, want = [], {}
    for i, m in enumerate(mixes):
        for k, s in enumerate(m):
            results.append((f"f{i}", f"p{k % 2}", s, [f"r{s}", "x"] if s != "complete" else None))
        want[("file", f"f{i}", None)] = merge(m)
        for k in range(min(2, len(m))):
            want[("result", f"f{i}", f"p{k}")] = merge(m[k::2])
        # merging what is merged gives the same
        assert merge(merge(m[k::2]) for k in range(min(2, len(m)))) == merge(m)
    for p in ("p0", "p1"):
        want[("producer", None, p)] = merge(r[2] for r in results if r[1] == p)
    want |= {("file", "out", None): "excluded", ("file", "alone", None): "not_targeted"}
    inventory = [(f"f{i}", None) for i in range(len(mixes))] + [("out", "too_large"), ("alone", None), ("alone", None)]
    extra = [("out", "p0", "failed", None), ("nowhere", "p0", "failed", None)]
    got = C.coverage(spark.createDataFrame(inventory, "path string, excluded string"), spark.createDataFrame(results + extra, "path string, producer string, status string, reasons array<string>")).cache()
    rows = {(r.level, r.path, r.producer): r for r in got.collect()}
    assert {k: r.status for k, r in rows.items()} == want
    assert rows[("file", "out", None)].reasons == ["too_large"] and rows[("file", "f0", None)].reasons == [] and rows[("file", f"f{len(mixes) - 1}", None)].reasons == ["rskipped", "x"]
    assert rows[("file", f"f{len(mixes) - 1}", None)].n_results == 3 and rows[("producer", None, "p0")].n_results == sum(r[1] == "p0" for r in results)
    counted = {r.producer: r.asDict() for r in C.summary(got).collect()}
    for s in (*C.STATUSES, "excluded", "not_targeted"):
        assert counted[None][s] == sum(v == s for k, v in want.items() if k[0] == "file")
    assert counted[None]["inventory"] == len(mixes) + 2 and counted[None]["targeted"] == len(mixes) and counted["p1"]["targeted"] == sum(len(m) > 1 for m in mixes)


def test_no_results(spark):
    got = C.coverage(spark.createDataFrame([("a", None)], "path string, excluded string"), spark.createDataFrame([], "path string, producer string, status string, reasons array<string>")).collect()
    assert [(r.level, r.path, r.status) for r in got] == [("file", "a", "not_targeted")]

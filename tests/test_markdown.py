"""References in Markdown: fences, spans, links and what they lead to."""

from strandline.sources import markdown as M

TEXT = """# T [a](x.md#part) and ![img](<../pic one.png> "t")
```py
[no](fence.md) `no`
~~~
``` more
```
~~~~
`no`
~~~
~~~~
`src/a.py` ``two `x` [n](n.md)`` `C.run()` `:app:core` `open [m](y%20z.md?q) left`
[ref]: /guide
[^note]: skip.md
```js `not a fence`
[h](http://x/y) [f](#here) [u](../../out.md) [d](docs/) [g](/none) [r](sub)
`src/gone.py` `nowhere/x` `twice` `missing` `a b/c.py` `pkg.C.run` `:no`\r
""".replace("\n`src/gone", "\n`src/gone")


def test_lines_outside_of_fences_and_spans():
    got = list(M.references_of(TEXT))
    assert [(n, k, t) for n, _, k, t in got] == [
        (1, "link", "x.md#part"), (1, "link", "<../pic one.png>"),
        (11, "span", "src/a.py"), (11, "span", "C.run()"), (11, "span", ":app:core"), (11, "span", "open [m](y%20z.md?q) left"),
        (12, "link", "/guide"),
        (14, "span", "not a fence"),
        (15, "link", "http://x/y"), (15, "link", "#here"), (15, "link", "../../out.md"), (15, "link", "docs/"), (15, "link", "/none"), (15, "link", "sub"),
        (16, "span", "src/gone.py"), (16, "span", "nowhere/x"), (16, "span", "twice"), (16, "span", "missing"), (16, "span", "a b/c.py"), (16, "span", "pkg.C.run"), (16, "span", ":no"),
    ]


def test_references_are_resolved(spark):
    files = spark.createDataFrame([("docs/t.md", TEXT), ("docs/x.md", "[y](y%20z.md) [p](a+b.md) [c](100%.md)"), ("pic one.png", None), ("guide/index.md", ""), ("docs/docs/q.md", ""), ("docs/sub/README.md", None), ("docs/y z.md", "``"), ("docs/a+b.md", ""), ("src/a.py", "[no](no.md)")], "path string, content string")
    refs, inventory = M.extract(files), M.with_directories(files.select("path"))
    got = {(r.doc, r.text): (r.status, r.target) for r in M.resolve_links(refs, inventory).collect()}
    assert got == {
        ("docs/t.md", "x.md#part"): ("resolved", "docs/x.md"), ("docs/t.md", "../pic one.png"): ("resolved", "pic one.png"), ("docs/t.md", "/guide"): ("resolved", "guide"), ("docs/t.md", "../../out.md"): ("dangling", None),
        ("docs/t.md", "docs/"): ("resolved", "docs/docs"), ("docs/t.md", "/none"): ("site_route", None), ("docs/t.md", "sub"): ("resolved", "docs/sub"),
        ("docs/x.md", "y%20z.md"): ("resolved", "docs/y z.md"), ("docs/x.md", "a+b.md"): ("resolved", "docs/a+b.md"), ("docs/x.md", "100%.md"): ("dangling", None),
    }
    symbols = spark.createDataFrame([("s1", "run", "pkg.C.run"), ("s2", "run", "other.C.run"), ("s3", "twice", "twice"), ("s4", "twice", "x.twice")], "id string, label string, symbol_path string")
    modules = spark.createDataFrame([(":app:core", "m1")], "module_path string, id string")
    spans = {r.text: (r.notation, r.status, r.target, r.candidates, r.candidate_total) for r in M.resolve_spans(refs, inventory, symbols, modules, most=1).collect()}
    assert spans == {
        "src/a.py": ("code_path", "resolved", "src/a.py", None, None), "src/gone.py": ("code_path", "dangling", None, None, None), "C.run()": ("identifier", "ambiguous", None, ["s1"], 2),
        "pkg.C.run": ("identifier", "resolved", "s1", None, None), "twice": ("identifier", "ambiguous", None, ["s3"], 2), ":app:core": ("gradle_module", "resolved", "m1", None, None), ":no": ("gradle_module", "dangling", None, None, None),
    }


def test_plain_paths(spark):
    from pyspark.sql import functions as F

    rows = [("a/b", "../c", "a/c"), ("", "./x//y/.", "x/y"), ("a", "../..", None), ("a", "..", ""), ("", "../a", None), ("a", "b/../../..", None)]
    got = spark.createDataFrame(rows, "b string, r string, w string").select(M.plain_path(F.col("b"), F.col("r")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]

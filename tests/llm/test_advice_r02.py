"""Cases that the operators left out before the second round's review."""

import random
import textwrap

from platewise.llm import html_text, licenses, registry
from platewise.llm.registry import QUERIES


def test_op8_ids_before_slashes(spark):
    urls = {
        "https://h.org/en/1837/": 1837, "https://h.org/en/1837//?a=/5#/6": 1837,
        "http://h.org/a/12.html": 12, "http://h.org/a/12.html/": 12, "http://h.org/7": 7,
        "http://h.org/7/a": None, "http://h.org/?q=/9": None, "http://h.org/": None,
        "no scheme /5": None, "http://h.org/99999999999999999999/": None, None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select("url", registry.page_document(df.url).alias("doc")).collect()
    assert {r.url: r.doc for r in got} == urls


def test_op8_counts_pages_with_a_slash_at_the_end(spark, tmp_path):
    pages = [(i, f"http://h.org/x/{i}/") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(i, 0, 1) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    got = QUERIES["op8_url_filter"](spark, str(tmp_path)).collect()
    assert [r.verdict for r in got] == ["block"] * 20


def _wrapped(text, width, sign=""):
    lines = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
    return "\n".join(sign + line for line in lines)


def test_op1_wrapped_notices(spark):
    rng = random.Random(3)
    prose = lambda n: "\n".join(" ".join(rng.choices("a of and in the for or to".split(), k=8)) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        for k, (width, sign) in enumerate([(60, ""), (72, " * "), (28, "# "), (1, "// "), (5000, "")]):
            for before in (0, 3, licenses.LONGEST - 1, 150):
                body = _wrapped(text, width, sign)
                start = prose(before) + "\n\n" if before else ""
                key = len(rows)
                rows.append((key, start + body + "\n" + prose(90)))
                want.add((key, start.count("\n"), name, i, True))
    rows.append((len(rows), None))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert {(r.id, r.line, r.license, r.template, r.exact) for r in got} == want
    assert len(got) == len(want)


def test_op1_every_notice(spark):
    bsd = dict(licenses.TEMPLATES[::-1])["BSD"].replace("source and binary", "source and the binary")
    text = (
        "All rights reserved. Licensed under CC BY 4.0. All rights\n# reserved.\n\n"
        "some text\n" + _wrapped(bsd, 30, "# ") + "\nReleased under the MIT License."
    )
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.line, r.license, r.added, r.block) for r in licenses.scan(df).collect()]
    lines = text.split("\n")
    end = len(lines) - 1
    assert got == [
        (0, "Proprietary", [], lines[0]), (0, "CC-BY-4.0", [], lines[0]),
        (0, "Proprietary", [], "\n".join(lines[:2])),
        (4, "BSD", ["the"], "\n".join(lines[4:end])), (end, "MIT", [], lines[end]),
    ]


def test_op1_looks_at_the_wording_where_nothing_is_saved(monkeypatch):
    scan = licenses.Scanner()
    monkeypatch.setattr(scan, "plain", scan.primed[-1])  # then the last template saves nothing
    name, _, saving, missing, added, exact = scan.judge("All rights reserved.")
    assert (name, saving, missing, added, exact) == ("Proprietary", 0.0, [], [], True)


def test_op9_open_head():
    text = html_text.page_text
    assert text("<head><title>T</title><p>one<p>two") == "T\n\none\n\ntwo"
    assert text("<html><head><meta charset=x><title>T</title>plain<b> bold</b>") == "T\nplain bold"
    assert text("<head>\n<style>no</style><script>no</script>\n<div>yes</div></html>") == "yes"
    assert text("<head><head><title>T</title></head><body>b") == "T\nb"
    assert text("<head><template><p>no</p></template><noscript><p>no</p></noscript></head>b") == "b"


def test_op9_hides_what_a_browser_hides():
    page = (
        "<p>a<svg><title>no</title><defs><text>no</text></defs><text>x</text><text>y</text></svg>"
        "<p><math><semantics><mi>m</mi><annotation>no</annotation></semantics></math>"
        "<p><object data=u>o</object><audio>no</audio><video>no</video><canvas>no</canvas>"
    )
    assert html_text.page_text(page) == "a x y\n\nm\n\no"

"""Every query on the odd tables against brute force, and on empty ones."""

import os
import random
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from llm import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from platewise.llm import (  # noqa: E402
    bpe, components, decontaminate, html_text, licenses, quality, repeats, sentencepiece_codec,
    simhash, suffixes, token_counts, urls,
)
from platewise.llm.registry import PIECES, QUERIES, WORD_BPE, tokenizer_file  # noqa: E402


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(spark, folder):
    return rows(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_preference_format", "op9_html_text"])
def test_odd_tables_run(spark, odd, name):
    assert QUERIES[name](spark, odd).count() > 0


def test_op1(spark, odd):
    got = QUERIES["op1_license_scan"](spark, odd).collect()
    assert [(r.license, r.exact, r.missing, r.added) for r in got] == [("MIT", True, [], [])]


def test_op1_wording():
    scan = licenses.Scanner()
    name, _, saving, missing, added, exact = scan.judge("Released under the MIT License.")
    assert (name, missing, added, exact) == ("MIT", [], [], True) and saving > 0.3
    assert scan.judge("The license of this house is old and worn.") is None
    assert scan.judge("Licensed under CC BY-SA 4.0.")[0] == "CC-BY-SA-4.0"
    assert scan.judge("Licensed under CC BY 4.0.")[0] == "CC-BY-4.0"
    text = dict(licenses.TEMPLATES[::-1])["BSD"].replace("binary", "binary object")
    assert scan.judge(text)[4] == ["object"] and not scan.judge(text)[5]


def test_op2(spark, odd):
    docs = documents(spark, odd)
    prints = [brute.fingerprint(t) for _, t in docs]
    root = brute.components(prints)
    smallest = {}
    for (i, _), f in zip(docs, prints):
        if i is not None:
            smallest[root[f]] = min(smallest.get(root[f], i), i)
    want = [(i, f"{f:016x}", smallest.get(root[f])) for (i, _), f in zip(docs, prints)]
    assert Counter(rows(QUERIES["op2_simhash_near_dedup"](spark, odd))) == Counter(want)


def test_op2_links(spark, monkeypatch):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    want = brute.components(values)
    for cell in (64, 2):  # pairs in cells, and common neighbours
        monkeypatch.setattr(simhash, "CELL", cell)
        links = simhash.links(spark.createDataFrame(signed, "fp long"))
        got = {}
        for node, root in rows(components.connected_components(links)):
            got.setdefault(root, set()).add(node % (1 << 64))
        groups = {}
        for v, r in want.items():
            groups.setdefault(r, set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(
            sorted(g) for g in groups.values() if len(g) > 1
        )


def test_op3(spark, odd):
    want = Counter()
    for i, t in documents(spark, odd):
        s = brute.signals(t)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        extra = 2 * s[2] > s[0] or s[1] < 2 * s[0] or s[1] > 25 * s[0] or (s[3] > 5 and 10 * s[3] > s[0])
        want[(i, *s, failed, not (failed or extra))] += 1
    df = QUERIES["op3_quality_rules"](spark, odd).select(
        "doc_id", *quality.SIGNALS, "base_failed", "kept"
    )
    assert Counter(rows(df)) == want


def test_op3_filter_keeps_rows_and_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    want = [i for i, _, k in rows(quality.quality_report(docs).select("doc_id", "n_words", "kept")) if k]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)


def test_op4(spark, odd):
    got = {(r.chosen_id, r.rejected_id): r for r in QUERIES["op4_preference_format"](spark, odd).collect()}
    start, end = "<|im_start|>", "<|im_end|>\n"
    r = got[0, 1]
    assert r.n_common == 3
    assert r.prompt == f"{start}user\nhi{end}{start}assistant\nanswer 0{end}{start}user\n{end}"
    assert r.chosen == f"{start}assistant\nlast 0{end}" and r.rejected == f"{start}assistant\nlast 1{end}"
    a, b = map(int, r.chosen_spans.split("-"))
    assert r.chosen[a:b] == f"last 0{end}"
    assert got[0, 7].n_common == 1 and got[0, 11].rejected == ""
    assert got[2, 2].rejected.endswith(f"last 3{end}") and (9, 9) not in got


def test_op5_against_library(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    want = Counter()
    for i, t in documents(spark, odd):
        want[(i, tuple(model.encode(t or "")))] += 1
    got = QUERIES["op5_sentencepiece"](spark, odd).collect()
    assert Counter((r.doc_id, tuple(r.piece_ids)) for r in got) == want
    assert all(r.restored and r.n_pieces == len(r.piece_ids) for r in got)


def test_op5_random_texts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    codec = sentencepiece_codec.Codec(tokenizer_file(PIECES))
    rng = random.Random(1)
    parts = "a e the ing \n \t é 漢 😀 0 12 # </ ▁ А s er ion un -- ==== ß".split(" ") + [" ", "   ", " " * 9]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(800)]
    texts += [" " * k + "ab" for k in range(60)]
    for text, ids in zip(texts, codec.encode_all(texts)):
        want = model.encode(text)
        assert list(memoryview(ids).cast("i")) == want
        assert codec.decode(ids) == text.replace("▁", " ") == model.decode(want)


def test_op5_decode_table(spark):
    docs = spark.createDataFrame([(1, "some text  here\n"), (2, None)], "doc_id long, text string")
    encoded = sentencepiece_codec.encode(docs, tokenizer_file(PIECES))
    got = dict(rows(sentencepiece_codec.decode(encoded, tokenizer_file(PIECES))))
    assert got == {1: "some text  here\n", 2: ""}


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(500):
        k = rng.choice([1, 2, 3, 5])
        values = [rng.randint(1, k) for _ in range(rng.randint(1, 60))] + [0]
        assert suffixes.suffix_array(values) == sorted(range(len(values)), key=lambda i: values[i:])


def test_op6(spark, odd):
    docs = documents(spark, odd)
    want = Counter()
    for (i, _), (n, spans, sha) in zip(docs, brute.repeats(docs)):
        want[(i, n, sum(b - a for a, b in spans), len(spans), sha)] += 1
    got = QUERIES["op6_suffix_array_dedup"](spark, odd)
    assert Counter(rows(got)) == want


def test_op6_hot_classes(spark, odd):
    docs = documents(spark, odd)
    want = Counter((i, tuple(spans)) for (i, _), (_, spans, _) in zip(docs, brute.repeats(docs)))
    got = repeats.removals(spark.read.parquet(f"{odd}/documents.parquet"), hot_class=1)
    assert Counter((r.id, tuple(map(tuple, r.spans))) for r in got.collect()) == want


def test_op6_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 97)
    rng = random.Random(4)
    parts = ["".join(rng.choices("ab ", k=60)) for _ in range(6)]
    docs = [(i, "".join(rng.choices(parts, k=12))) for i in range(6)]
    texts = [(i, m, 0, t.encode()) for m, (i, t) in enumerate(docs)]
    assert texts  # the block size reaches only code that runs in this process
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in docs]), pa.array([0] * 6), pa.array([t.encode() for _, t in docs])],
        names=["id", "mark", "raw"],
    )
    dealt = list(repeats.deal([batch], 4))
    windows = sum(
        int(np.frombuffer(b["rows"].as_py()[-2 * n : -n], "u1").sum()) + n
        for part in dealt
        for b in [dict(zip(part.schema.names, row)) for row in zip(*part.columns)]
        for n in [int(np.frombuffer(b["counts"].as_py(), np.uint32).sum())]
    )
    assert windows == sum(len(t) - repeats.LENGTH + 1 for _, t in docs)


def test_op6_edited_texts(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    plain = documents(spark, odd)
    edited = repeats.without_repeats(docs)
    assert edited.columns == docs.columns
    want = Counter()
    for (i, t), (_, spans, _) in zip(plain, brute.repeats(plain)):
        raw = (t or "").encode()
        for a, b in reversed(spans):
            raw = raw[:a] + raw[b:]
        want[(i, raw.decode("utf-8", "ignore") if spans else t)] += 1
    assert Counter((r.doc_id, r.text) for r in edited.collect()) == want


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_op7(spark, odd, monkeypatch, limit):
    items = rows(spark.read.parquet(f"{odd}/benchmark.parquet").select("item_id", "text"))
    docs = documents(spark, odd)
    want = Counter((i, *brute.contamination(t, items)) for i, t in docs)
    if limit:
        got = rows(QUERIES["op7_decontaminate"](spark, odd))
        assert Counter(got) == want
    else:  # the shuffled join
        table = spark.read.parquet
        found = decontaminate.contamination(
            table(f"{odd}/documents.parquet"), table(f"{odd}/benchmark.parquet"), broadcast_bytes=-1
        )
        assert Counter((r.id, r.n_words, r.n_hit, len(r.items)) for r in found.collect()) == Counter(
            w[:4] for w in want.elements()
        )


def test_op8(spark, odd):
    pages = rows(spark.read.parquet(f"{odd}/pages.parquet").select("page_id", "url"))
    got = QUERIES["op8_url_filter"](spark, odd).collect()
    assert Counter((r.page_id, r.host, r.path) for r in got) == Counter(
        (i, *brute.url_parts(u)) for i, u in pages
    )
    for r in got:
        rule, verdict = brute.url_rule(r.host, r.path, urls.RULES)
        assert r.rule == rule
        if rule:
            assert r.verdict == verdict
        elif r.path.startswith("/spam"):
            assert r.verdict == "block"
        else:
            assert r.verdict == "allow"


def test_op8_templates(spark, odd):
    pages = spark.read.parquet(f"{odd}/pages.parquet")
    none = spark.createDataFrame([], "id long, bad boolean")
    got = {(r.host, r.template) for r in urls.url_verdicts(pages, none).collect()}
    assert ("wide.org", "/u/*/p") in got and ("bad.org", "/spam/*.html") in got


def test_op9():
    page = (
        "<title>T</title><table><tr><th>a<td>bbb<tr><td>cccc<td>d</table>z<ol><li>one<li>two<ul>"
        "<li>n</ul></ol><pre>x\n  y</pre><p>p<br>q<p hidden>no<div style='display: none'>no</div>"
        "<script>no</script><!-- no -->tail &lt;b&gt;"
    )
    assert html_text.page_text(page) == (
        "T\n\na     bbb\ncccc  d\n\nz\n\n1. one\n2. two\n   - n\n\nx\n  y\n\np\nq\n\ntail <b>"
    )
    assert html_text.page_text(None) == html_text.page_text("") == ""
    assert html_text.page_text("a  b\n c") == "a b c"
    assert "deep" in html_text.page_text("<div><b>" * 5000 + "deep")


def test_op9_visible_words(spark):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.found = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.found.append(data)

    for page_id, html in rows(
        spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    ):
        words = Words()
        words.feed(html)
        want = "".join("".join(words.found).split())
        got = "\n".join(x.removeprefix("- ") for x in html_text.page_text(html).split("\n"))
        assert "".join(got.split()) == want, page_id


def test_op10(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    want = Counter()
    for i, t in documents(spark, odd):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert Counter(rows(QUERIES["op10_token_counts"](spark, odd))) == want


def test_op10_chunks(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    counter = token_counts.Counter(tokenizer_file(WORD_BPE))
    rng = random.Random(6)
    parts = ["a", "the", "ing", " ", "\u3000", "\x1c", "\n", "é", "e\u0301", "漢", "😀", "12", "'s", "Σ", "İ"]
    parts += ["<|endoftext|>", "</w>", "--", "ﬁ", "\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(600)]
    for size in (1 << 16, 7, 1):
        monkeypatch.setattr(token_counts, "CHUNK_CHARS", size)
        for t in texts:
            assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_merges_agree():
    merges = {("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2, ("c", "c"): 3, ("cc", "a"): 4}
    table = bpe.MergeTable(lambda x, y: merges.get((x, y)))
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choices("abc", k=rng.randint(0, 30)))
        assert table.merge(text) == table.merge_long(text)


def test_pipeline(spark, odd, tmp_path):
    """Each stage on its own input against brute force."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = rows(docs.select("doc_id", "text"))
        out = stage(spark, docs, odd)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            prints = [(i, brute.fingerprint(t)) for i, t in given]
            root = brute.components([f for _, f in prints])
            first = {}
            for i, f in prints:
                if i is not None:
                    first[root[f]] = min(first.get(root[f], i), i)
            want = [i for i, f in prints if i is None or first[root[f]] == i]
            assert Counter(r.doc_id for r in docs.collect()) == Counter(want)
        if name == "benchmark_decontamination":
            items = rows(spark.read.parquet(f"{odd}/benchmark.parquet").select("item_id", "text"))
            want = [i for i, t in given if not brute.contamination(t, items)[4]]
            assert Counter(r.doc_id for r in docs.collect()) == Counter(want)
    assert before is None and docs.where("NOT restored").count() == 0
    whole = corpus_pipeline.run(spark, odd)
    assert Counter((r.doc_id, tuple(r.piece_ids)) for r in whole.collect()) == Counter(
        (r.doc_id, tuple(r.piece_ids)) for r in docs.collect()
    )


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0

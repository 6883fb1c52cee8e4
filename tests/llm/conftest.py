"""Small tables with nulls, empty and long texts, ties, repeated rows and
extra columns whose names clash with those that the operators use inside."""

import random

import pytest
from pyspark.sql import functions as F

CLASHING = (
    "id h w p k key fp e n mark raw spans words word bucket text2 q_text q_words n_words "
    "gone_key repeat_key repeat_spans decon_h q_row component_id said host shape verdict "
    "score rank weight bucket x good most label features place part"
).split()


def _texts():
    rng = random.Random(5)
    syllables = "an the ing er on re ti in es or nd st en at ou ea ha th é ß ñ".split()

    def prose(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
        words[0] = words[0].capitalize()
        return " ".join(words)

    passage = prose(30)
    base = prose(120)
    edited = base.split()
    edited[60] = "changed"
    item = prose(14)
    texts = [None, "", "   \n\t ", "one", "two words", base, base, " ".join(edited)]
    texts += [prose(90) + "\n" + passage + "\n" + prose(40) for _ in range(6)]
    texts += [prose(70) + " " + item.upper() + " " + prose(70), prose(60) + " " + item + "."]
    texts += ["la la la " * 40, "a b c\n" * 30, prose(60) + " ###" * 70, "x" * 400, "x" * 700]
    texts += [prose(4000), base + "\nReleased under the MIT License.\n" + prose(60)]
    texts += ["don't STOP <|endoftext|> İΣ 漢字 😀\u2581 a\u0301  b" + " z" * 20, "\x00\x1c\u3000"]
    texts += [prose(rng.randint(1, 150)) for _ in range(30)]
    return texts, item


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Folder of odd tables."""
    folder = tmp_path_factory.mktemp("odd")
    texts, item = _texts()
    rows = [(i * 3 + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[9], (None, texts[5], None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(7))
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "two words"), (6, "one"), (None, "zzz")]
    items.append((7, " ".join(texts[5].split()[10:31])))
    spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1)).write.parquet(
        f"{folder}/benchmark.parquet"
    )
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?y#z", "http://net/es/"]
    urls += ["https://www.example.com/en/1", "https://example.com/de/1", "x://b.net/fr/a?c", "a://b://c/d"]
    urls += ["http://bücher.ÄB.org/é/1", "http://h.org?q=/x", "http://h.org#a"]
    urls += [f"http://bad.org/spam/{i}.html" for i in range(20)]
    # other documents than the spam pages, labelled good
    urls += [f"http://bad.org/good/{i}" for i in range(500, 560)]
    urls += [f"http://wide.org/u/{a}{b}/p" for a in "abcdefgh" for b in "abcdefgh"]
    pages = [(i, u, None if i == 3 else f"<p>page {i}") for i, u in enumerate(urls)]
    pages += [pages[4], (None, "http://net/fr/", "<b>x")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn(
        "host", F.lit(1)
    ).write.parquet(f"{folder}/pages.parquet")
    labels = [(i, 1, 1) for i in range(20)] + [(i, 1, 0) for i in range(500, 560)]
    labels += [(None, 0, 0), (0, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    rng = random.Random(6)
    near = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    vectors = [[x + rng.gauss(0, 0.1) for x in rng.choice(near)] for _ in range(80)]
    vectors += [vectors[3]] * 40 + [[0.5] * 64, [0.5] * 63 + [-0.5], [0.0] * 64, [-0.0] * 64]
    vectors += [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [None] * 64]
    vectors += [[1.0] * 63 + [float(x)] for x in ("nan", "inf", "-inf")]
    vectors = [(i * 7 % 1000, v) for i, v in enumerate(vectors)]
    vectors += [vectors[0], (vectors[1][0], vectors[2][1]), (None, vectors[4][1]), (None, None)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    for c in ("id", "v", "c", "cluster", "distance", "label"):
        frame = frame.withColumn(c, F.lit(7))
    frame.write.parquet(f"{folder}/embeddings.parquet")
    chats = []
    for c in range(8):
        chats += [(c, 0, "user", "hi"), (c, 1, "assistant", f"answer {c // 3}"), (c, 2, "user", None)]
        chats += [(c, 4, "assistant", f"last {c}")] * (c % 2 + 1)
    chats += [(9, 0, None, None), (None, 0, "user", "x"), (10, None, "user", "x"), (11, 0, "user", "hi")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").withColumn(
        "said", F.lit(1)
    ).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "embeddings", "benchmark", "pages", "labels", "conversations"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)

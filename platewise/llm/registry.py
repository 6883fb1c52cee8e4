"""Queries of the training-data operators and, where SQL can express them,
the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.llm import (
    centroids,
    decontaminate,
    html_text,
    licenses,
    preferences,
    quality,
    ranking,
    repeats,
    resampling,
    sentencepiece_codec,
    simhash,
    token_counts,
    urls,
)
from platewise.llm.common import checkpointed, table

# Where the vocabulary files of the public tokenizers are; never copied here.
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"

QUERIES = {}
ORACLES = {}


def tokenizer_file(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op2_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=2)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


@query
def op3_quality_rules(spark, sf_dir):
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    return report.drop("failed_rule")


ORACLES["op3_quality_rules"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), spot AS (
    SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d
), tri AS (
    SELECT doc_id, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3
    FROM spot WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
    SELECT doc_id, i FROM tri WHERE w3 IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1
), rep AS (
    SELECT doc_id, count(DISTINCT i + k) AS n
    FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
    SELECT doc_id, len(words)::BIGINT AS n_words,
           len(array_to_string(words, ''))::BIGINT AS word_chars,
           len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
           coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
            OR 2 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 25 * n_words
            OR (n_dup_lines > 5 AND 10 * n_dup_lines > n_words)) AS kept
FROM s
"""


@query
def op5_sentencepiece(spark, sf_dir):
    found = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_file(PIECES))
    return found.withColumnRenamed("id", "doc_id")


@query
def op10_token_counts(spark, sf_dir):
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(WORD_BPE))
    return found.withColumnRenamed("id", "doc_id").withColumn(
        "over_limit", F.col("n_tokens") > 2048
    )


@query
def op6_suffix_array_dedup(spark, sf_dir):
    found = repeats.removals(table(spark, sf_dir, "documents"))
    removed = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"])
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        "kept_sha256",
    )


@query
def op7_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op7_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n,
           array_to_string(list_slice(w, s, s + 9), ' ') AS win
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win
), spot AS (
    SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
    FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s) WHERE len(w) >= n
), hit AS (SELECT doc_id, s, spot.n, item_id FROM spot JOIN win USING (n, win)
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
    FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _listed(spans):
    """Spans as text, like ``12-40,60-80``."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))
        ),
        ",",
    )


@query
def op4_preference_format(spark, sf_dir):
    chats = preferences.numbered(preferences.turns(table(spark, sf_dir, "conversations")))
    chats = checkpointed(chats)  # four branches read it
    pairs = preferences.pairs_by_opening(chats).unionByName(preferences.pairs_by_answer(chats))
    found = preferences.format_pairs(pairs)
    return found.withColumns(
        {c: _listed(F.col(c)) for c in ("chosen_spans", "rejected_spans")}
    )


_SEGMENTS = """
    list_transform({said}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text
                                     || '<|im_end|>' || chr(10))"""
_SPANS = """
    array_to_string(list_transform(
        list_filter(range(1, len({said}) + 1), lambda i: {said}[i].role = 'assistant'),
        lambda i: (coalesce(list_sum(list_transform({said}[1:i - 1],
                     lambda t: len(t.role) + len(t.text) + 24)), 0)
                   + len({said}[i].role) + 13)::BIGINT::VARCHAR || '-' ||
                  list_sum(list_transform({said}[1:i],
                     lambda t: len(t.role) + len(t.text) + 24))::BIGINT::VARCHAR), ',')"""

ORACLES["op4_preference_format"] = f"""
WITH turns AS (
    SELECT conv_id, turn, min({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}) AS t
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
), chats AS (
    SELECT conv_id, list(t ORDER BY turn) AS said FROM turns GROUP BY conv_id
), answered AS (
    SELECT *, list_max(list_filter(range(1, len(said) + 1),
                                   lambda i: said[i].role = 'assistant')) AS k
    FROM chats WHERE k IS NOT NULL
), groups AS (
    SELECT said[1] AS opening, min(conv_id) AS chosen_id FROM chats GROUP BY said[1]
), pairs AS (
    SELECT chosen_id, r.conv_id AS rejected_id, c.said AS a, r.said AS b
    FROM groups JOIN chats r ON r.said[1] = opening AND r.conv_id > chosen_id
    JOIN chats c ON c.conv_id = chosen_id
    UNION ALL
    SELECT r.conv_id, r.conv_id, r.said[1:r.k], r.said[1:r.k - 1] || [o.said[o.k]]
    FROM answered r JOIN answered o ON o.conv_id = xor(r.conv_id, 1)
), cut AS (
    SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1),
                                            lambda i: a[i] <> b[i])) - 1,
                       least(len(a), len(b)))::BIGINT AS n_common
    FROM pairs
), parts AS (
    SELECT chosen_id, rejected_id, n_common, a[1:n_common] AS p,
           a[n_common + 1:] AS x, b[n_common + 1:] AS y FROM cut
)
SELECT chosen_id, rejected_id, n_common,
       array_to_string({_SEGMENTS.format(said="p")}, '') AS prompt,
       array_to_string({_SEGMENTS.format(said="x")}, '') AS chosen,
       array_to_string({_SEGMENTS.format(said="y")}, '') AS rejected,
       {_SPANS.format(said="x")} AS chosen_spans,
       {_SPANS.format(said="y")} AS rejected_spans
FROM parts
"""


@query
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # a page renders the document whose id its path ends in
    page_doc = pages.select("page_id", page_document(F.col("url")).alias("doc_id"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    known = page_doc.join(labels, "doc_id").groupBy(F.col("page_id").alias("id")).agg(
        F.max("bad").alias("bad")
    )
    found = urls.url_verdicts(pages, known)
    return found.withColumnRenamed("id", "page_id").drop("template", "branch")


def page_document(url):
    """The id that ends the path of ``url``, slashes behind it aside."""
    _, path = urls.host_and_path(url)
    return F.regexp_extract(path, r"/([0-9]+)[^0-9/]*/*$", 1).try_cast("bigint")


@query
def op9_html_text(spark, sf_dir):
    found = html_text.visible_text(table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("id", "page_id")


ORACLES["op8_url_filter"] = r"""
WITH p AS (
    SELECT page_id, url,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), s AS (SELECT *, regexp_replace(path, '[^/]*[0-9][^/.]*', '*', 'g') AS shape FROM p
), shapes AS (SELECT host, shape, count(*) AS pages FROM s GROUP BY host, shape
), nodes AS (
    SELECT host, shape, pages, i, segs[i + 1] AS segment, array_to_string(segs[1:i], '/') AS above
    FROM (SELECT *, string_split(shape, '/') AS segs FROM shapes), unnest(range(len(segs))) AS u(i)
), wild AS (
    SELECT host, above, i FROM (
        SELECT host, above, i, segment, sum(pages) AS pages FROM nodes GROUP BY ALL)
    GROUP BY ALL HAVING count(*) > 32 AND 2 * count(*) > sum(pages)
), tree AS (
    SELECT host, shape, array_to_string(parts, '/') AS template,
           array_to_string(parts[1:len(parts) - 1], '/') AS parent
    FROM (SELECT n.host, n.shape,
                 list(CASE WHEN w.i IS NULL THEN n.segment ELSE '*' END ORDER BY n.i) AS parts
          FROM nodes n LEFT JOIN wild w ON w.host = n.host AND w.above = n.above AND w.i = n.i
          GROUP BY n.host, n.shape)
), doc_labels AS (
    SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id
), known AS (
    SELECT page_id, bool_or(bad) AS bad
    FROM p JOIN doc_labels ON doc_id =
        try_cast(regexp_extract(path, '/([0-9]+)[^0-9/]*/*$', 1) AS BIGINT)
    GROUP BY page_id
), counts AS (
    SELECT t.host, t.template, t.parent, coalesce(sum(k.n), 0) AS n, coalesce(sum(k.bad), 0) AS bad
    FROM tree t LEFT JOIN (
        SELECT host, shape, count(*) AS n, count(*) FILTER (known.bad) AS bad
        FROM s JOIN known USING (page_id) GROUP BY host, shape) k
      ON k.host = t.host AND k.shape = t.shape
    GROUP BY t.host, t.template, t.parent
), parents AS (
    SELECT host, parent, sum(n) AS pn, sum(bad) AS pbad FROM counts GROUP BY host, parent
), branch AS (
    SELECT c.host, c.template, n, bad,
           CASE WHEN coalesce(n = 0 OR abs(bad / nullif(n, 0) - (pbad - bad) / nullif(pn - n, 0))
                              <= 1.96 * sqrt(pbad / nullif(pn, 0) * (1 - pbad / nullif(pn, 0))
                                             * (1.0 / nullif(n, 0) + 1.0 / nullif(pn - n, 0))), FALSE)
                THEN c.parent || '/~' ELSE c.template END AS branch
    FROM counts c JOIN parents q ON q.host = c.host AND q.parent = c.parent
), total AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS share FROM counts
), judged AS (
    SELECT host, branch, (sum(bad) + 4.0 * any_value(share)) / (sum(n) + 4.0) > 0.5 AS rejected
    FROM branch, total GROUP BY host, branch
)
SELECT page_id, s.host, path,
       CASE WHEN (s.host = 'www.example.com' OR s.host LIKE '%.www.example.com')
                 AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN (s.host = 'example.com' OR s.host LIKE '%.example.com')
                 AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN (s.host = 'net' OR s.host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN (s.host = 'net' OR s.host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN (s.host = 'com' OR s.host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
       END AS rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
            WHEN rule IS NOT NULL OR rejected THEN 'block' ELSE 'allow' END AS verdict
FROM s JOIN tree USING (host, shape) JOIN branch USING (host, template) JOIN judged USING (host, branch)
"""


@query
def op11_centroid_clustering(spark, sf_dir):
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, size=64)
    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2("centroid", 256).alias("centroid_sha256"),
    )


def _kmeans_sql(clusters, rounds, size, seed):
    """Plain k-means: every vector against every centroid, round by round."""
    near = """a{r} AS (
    SELECT k.i, min({{'d': list_sum(list_transform(list_zip(k.v, c.v),
                                   lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS n
    FROM kept k, c{r} c GROUP BY k.i
)"""
    mean = """, c{n} AS (
    SELECT c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM (
            SELECT a.n.c AS c, j, sum(x)::HUGEINT AS s, count(*) AS n
            FROM a{r} a JOIN component USING (i) GROUP BY ALL) GROUP BY c) m USING (c)
), """
    steps = "".join(near.format(r=r) + mean.format(r=r, n=r + 1) for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = {size}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), component AS (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept
), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c,
           v FROM kept QUALIFY c < {clusters}
), {steps}{near.format(r=rounds)}, digest AS (
    SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c{rounds}
)
SELECT vec_id, n.c::INT AS cluster, n.d::BIGINT AS distance,
       sum(n.d) OVER (PARTITION BY n.c)::BIGINT AS cluster_inertia,
       sum(n.d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (i) JOIN digest ON c = n.c
"""


ORACLES["op11_centroid_clustering"] = _kmeans_sql(clusters=40, rounds=5, size=64, seed="2")


@query
def op12_importance_resampling(spark, sf_dir):
    found = resampling.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10
    )
    return found.select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank"
    )


ORACLES["op12_importance_resampling"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
    FROM benchmark
), said AS (
    SELECT row_number() OVER () AS i, doc_id, w FROM d
), spot AS (SELECT i, unnest(w) AS w FROM said
), step AS (
    SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:
               CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY b) AS t
    FROM range(256) AS r(b)
), bytes AS (
    SELECT w, [4294967295] || list_transform(range(0, strlen(w)), lambda k:
               ('0x' || substr(hex(encode(w)), (2 * k + 1)::INT, 2))::BIGINT) AS l
    FROM (SELECT w FROM spot UNION SELECT w FROM b)
), bucket AS MATERIALIZED (
    SELECT w, xor(list_reduce(l, lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295)
              % 10000 AS bucket
    FROM bytes, step
), s AS (SELECT bucket, count(*) AS s FROM spot JOIN bucket USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM b JOIN bucket USING (w) GROUP BY bucket
), total AS (SELECT (SELECT count(*) FROM spot) AS ss, (SELECT count(*) FROM b) AS tt
), gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0)::DOUBLE * (ss + 10000)
                                   / ((s + 1.0)::DOUBLE * (tt + 10000))))::BIGINT AS gain
    FROM total, s LEFT JOIN t USING (bucket)
), weighed AS (
    SELECT i, sum(gain) AS weight FROM spot JOIN bucket USING (w) JOIN gain USING (bucket) GROUP BY i
), scored AS (
    SELECT i, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM said LEFT JOIN weighed USING (i)
), final AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
    FROM scored
), drawn AS (
    SELECT i, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place,
           10 * count(*) OVER () // 100 AS wanted
    FROM final WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank
FROM final LEFT JOIN drawn USING (i)
"""


@query
def op13_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = ranking.measured(docs)
    model = ranking.fit(docs, table(spark, sf_dir, "labels"), found=found)
    return ranking.score_documents(docs, model, at=0.7, found=found).withColumnRenamed("id", "doc_id")

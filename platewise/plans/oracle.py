"""Independent DuckDB SQL for every query with a deterministic result.

Written from the operator specifications, not generated from the Spark
doubles are rounded to 6 places, integer casts truncate (``trunc``), modes
and rankings break ties by the smallest value / name.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

# Venue view of FIXTURES.md §2, with 'city' blanked for ids divisible by 23.
# ``nat`` is scanned once (materialised): DuckDB 2.0 fails with an internal
# error when the dictionary-encoded ``n_name`` is scanned twice in one query.
VENUES_CTE = """
nat AS MATERIALIZED (SELECT n_nationkey, n_name FROM nation),
v_lines AS (
    SELECT l.l_orderkey,
           count(*) AS n_lines,
           sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS cents,
           sum(CAST(round(l.l_discount * 100) AS BIGINT)) AS discount_pct,
           sum(CAST(l.l_quantity AS BIGINT)) AS qty,
           max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_returned,
           string_agg(DISTINCT p.p_brand, ', ' ORDER BY p.p_brand) AS brands
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
    GROUP BY l.l_orderkey
),
v AS (
    SELECT o.o_orderkey AS venue_id,
           c.c_name AS venue_name,
           CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE n.n_name END AS city,
           c.c_mktsegment || '#' || CAST(c.c_custkey % 7 AS VARCHAR) AS locality,
           c.c_mktsegment AS rest_type,
           vl.brands AS cuisines,
           CAST(floor(vl.cents / (vl.n_lines * 100.0)) AS BIGINT) AS avg_cost,
           CAST(CASE substr(o.o_orderpriority, 1, 1)
                WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '5' THEN 1 END AS INTEGER)
               AS price_range,
           5.0 - 0.5 * CAST(vl.discount_pct AS DOUBLE) / vl.n_lines AS rating,
           CAST(coalesce(vl.qty, 0) AS BIGINT) AS votes,
           CASE o.o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS has_table_booking,
           CASE WHEN vl.any_returned = 1 THEN 'Yes' ELSE 'No' END AS has_online_delivery,
           CASE WHEN o.o_orderkey % 17 <> 0
                THEN c.c_nationkey * 6 - 75 + CAST(o.o_custkey % 64 AS DOUBLE) / 64 END AS latitude,
           CASE WHEN o.o_orderkey % 19 <> 0
                THEN c.c_nationkey * 14 - 175 + CAST(o.o_orderkey % 64 AS DOUBLE) / 64 END AS longitude
    FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nat n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN v_lines vl ON vl.l_orderkey = o.o_orderkey
),
loc AS (
    SELECT venue_id, venue_name,
           coalesce(city, 'Unknown') AS city,
           coalesce(locality, 'Unknown') AS locality,
           cuisines, price_range,
           coalesce(TRY_CAST(rating AS DOUBLE), 0.0) AS rating,
           coalesce(TRY_CAST(avg_cost AS DOUBLE), 0.0) AS avg_cost,
           has_table_booking, has_online_delivery,
           TRY_CAST(latitude AS DOUBLE) AS latitude,
           TRY_CAST(longitude AS DOUBLE) AS longitude
    FROM v
)
"""


def with_venues(body: str) -> str:
    """Prefix ``body`` with the venue CTEs; ``body`` is either a SELECT or
    more CTEs followed by a SELECT."""
    body = body.strip()
    sep = "\n" if body.upper().startswith("SELECT") else ",\n"
    return inline_ctes("WITH " + VENUES_CTE.strip() + sep + body)


def inline_ctes(sql: str) -> str:
    """Mark every CTE (a line ``name AS (``) NOT MATERIALIZED: DuckDB 2.0
    fails with an internal error on some materialised CTEs of
    dictionary-encoded strings."""
    return re.sub(r"^(\s*(?:WITH\s+)?\w+) AS \(", r"\1 AS NOT MATERIALIZED (", sql, flags=re.M)


ORACLES: dict[str, str] = {}

ORACLES["city_stats"] = with_venues("""
SELECT city,
       CAST(count(*) AS BIGINT) AS restaurant_count,
       round(avg(rating), 6) AS average_rating,
       round(avg(CASE WHEN lower(has_online_delivery) = 'yes' THEN 1 ELSE 0 END) * 100, 6)
           AS online_order_percentage,
       round(avg(CASE WHEN lower(has_table_booking) = 'yes' THEN 1 ELSE 0 END) * 100, 6)
           AS table_booking_percentage
FROM loc WHERE city <> 'Unknown'
GROUP BY city
""")

CITY_TABLE = """
ct AS (
    SELECT city, count(*) AS n, avg(rating) AS r, avg(avg_cost) AS c
    FROM loc WHERE city <> 'Unknown' GROUP BY city
),
tc AS (
    SELECT city, cuisines,
           row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, cuisines) AS rn
    FROM loc WHERE city <> 'Unknown' AND cuisines IS NOT NULL
    GROUP BY city, cuisines
),
cities AS (
    SELECT ct.city, ct.n AS "count", round(ct.r, 6) AS avg_rating, round(ct.c, 6) AS avg_cost,
           coalesce(trim(split_part(tc.cuisines, ',', 1)), 'Unknown') AS top_cuisine
    FROM ct LEFT JOIN tc ON tc.city = ct.city AND tc.rn = 1
)
"""

ORACLES["city_overview"] = with_venues(CITY_TABLE + """
SELECT * FROM cities ORDER BY "count" DESC, city LIMIT 15
""")

ORACLES["cities_by_cost"] = with_venues(CITY_TABLE + """
SELECT * FROM cities ORDER BY avg_cost DESC, city
""")

ORACLES["insights"] = with_venues("""
cs AS (
    SELECT city, count(*) AS n, avg(rating) AS r, avg(avg_cost) AS c
    FROM loc WHERE city <> 'Unknown' GROUP BY city
),
k AS (SELECT count(*) AS n_known FROM cs)
SELECT
    (SELECT CAST(count(*) AS BIGINT) FROM loc) AS total_restaurants,
    CAST(CASE WHEN k.n_known > 0 THEN (SELECT count(DISTINCT city) FROM loc) ELSE 0 END AS BIGINT)
        AS total_cities,
    CAST(CASE WHEN k.n_known > 0 THEN (SELECT count(DISTINCT locality) FROM loc) ELSE 0 END
        AS BIGINT) AS total_localities,
    coalesce((SELECT city FROM cs ORDER BY r DESC, city LIMIT 1), 'N/A') AS highest_rated_city,
    coalesce((SELECT city FROM cs ORDER BY n DESC, city LIMIT 1), 'N/A')
        AS highest_restaurant_density_city,
    CASE WHEN k.n_known > 0 THEN round((SELECT avg(rating) FROM loc), 6) ELSE 0.0 END
        AS avg_rating_overall,
    coalesce((SELECT city FROM cs ORDER BY c DESC, city LIMIT 1), 'N/A') AS most_expensive_city
FROM k
""")

ORACLES["locality_stats"] = with_venues("""
cs AS (SELECT city, count(*) AS n FROM loc WHERE city <> 'Unknown' GROUP BY city),
top AS (SELECT city FROM cs ORDER BY n DESC, city LIMIT 1),
r AS (
    SELECT top.city AS requested_city, loc.locality, loc.city, loc.price_range, loc.rating
    FROM loc JOIN top ON lower(loc.city) = lower(top.city)
),
agg AS (
    SELECT requested_city, locality, count(*) AS cnt, avg(rating) AS avg_rating,
           row_number() OVER (PARTITION BY requested_city ORDER BY count(*) DESC, locality) AS rk
    FROM r GROUP BY requested_city, locality
),
cm AS (
    SELECT requested_city, locality, city,
           row_number() OVER (PARTITION BY requested_city, locality
                              ORDER BY count(*) DESC, city) AS rn
    FROM r GROUP BY requested_city, locality, city
),
pm AS (
    SELECT requested_city, locality, price_range,
           row_number() OVER (PARTITION BY requested_city, locality
                              ORDER BY count(*) DESC, price_range) AS rn
    FROM r WHERE price_range IS NOT NULL
    GROUP BY requested_city, locality, price_range
)
SELECT a.requested_city, a.locality, cm.city, a.cnt AS "count",
       round(a.avg_rating, 6) AS avg_rating,
       CAST(coalesce(pm.price_range, 2) AS INTEGER) AS price_range_mode
FROM agg a
JOIN cm ON cm.requested_city = a.requested_city AND cm.locality = a.locality AND cm.rn = 1
LEFT JOIN pm ON pm.requested_city = a.requested_city AND pm.locality = a.locality AND pm.rn = 1
WHERE a.rk <= 15
""")

ORACLES["argmax_city"] = with_venues("""
ct AS (
    SELECT city, count(*) AS n, avg(rating) AS r, avg(avg_cost) AS c
    FROM loc WHERE city <> 'Unknown' GROUP BY city
)
SELECT * FROM (SELECT 'highest_rated' AS metric, city, round(r, 6) AS value
               FROM ct ORDER BY r DESC, city LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'most_venues', city, CAST(n AS DOUBLE) FROM ct ORDER BY n DESC, city LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'most_expensive', city, round(c, 6) FROM ct ORDER BY c DESC, city LIMIT 1)
""")

ORACLES["grid_clusters"] = with_venues("""
SELECT CAST(floor(latitude / 1.0) AS BIGINT) AS cell_lat,
       CAST(floor(longitude / 1.0) AS BIGINT) AS cell_lng,
       count(*) AS "count",
       round(avg(rating), 6) AS avg_rating,
       round(avg(latitude), 6) AS center_lat,
       round(avg(longitude), 6) AS center_lng
FROM loc WHERE latitude IS NOT NULL AND longitude IS NOT NULL
GROUP BY 1, 2
""")

_CELLS = "\nUNION ALL ".join(
    f"""SELECT {level} AS level,
       CAST(floor(latitude / {16.0 / 2**level}) AS BIGINT) AS cell_lat,
       CAST(floor(longitude / {16.0 / 2**level}) AS BIGINT) AS cell_lng,
       count(*) AS "count",
       round(round(avg(rating), 9), 6) AS avg_rating,
       round(round(avg(latitude), 9), 6) AS center_lat,
       round(round(avg(longitude), 9), 6) AS center_lng,
       min(latitude) AS south, max(latitude) AS north,
       min(longitude) AS west, max(longitude) AS east
FROM loc WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 2, 3"""
    for level in range(7)
)
ORACLES["map_pyramid"] = with_venues(_CELLS)

_COUNTED = ("venue_name", "locality", "rest_type", "cuisine")
_DISTINCT = "\nUNION ALL ".join(
    f"""SELECT '{name}' AS grouping, {value} AS value, '{c}' AS counted,
       count(DISTINCT {c}) AS n_distinct, true AS within
FROM items GROUP BY 2"""
    for name, value in (("city", "city"), ("price_range", "CAST(price_range AS VARCHAR)"), ("all", "'all'"))
    for c in _COUNTED
)
ORACLES["distinct_sketches"] = with_venues("""
items AS (
    SELECT coalesce(city, 'Unknown') AS city, price_range, venue_name, locality, rest_type,
           trim(unnest(string_split(coalesce(cuisines, 'Unknown'), ','))) AS cuisine
    FROM v
)
""" + _DISTINCT)

ORACLES["city_share"] = with_venues("""
bc AS (SELECT city, count(*) AS n FROM loc GROUP BY city)
SELECT city, n AS "count",
       round(CAST(n AS DOUBLE) * 100 / (SELECT sum(n) FROM bc), 6) AS share_pct,
       round(CAST(n AS DOUBLE) * 100 / (SELECT max(n) FROM bc WHERE city <> 'Unknown'), 6)
           AS pct_of_largest
FROM bc WHERE city <> 'Unknown'
""")

ORACLES["city_rank"] = with_venues("""
ct AS (SELECT city, count(*) AS n FROM loc WHERE city <> 'Unknown' GROUP BY city)
SELECT city, n AS "count", CAST(row_number() OVER (ORDER BY n DESC, city) AS INTEGER) AS rank
FROM ct ORDER BY n DESC, city LIMIT 3
""")

MAP_COLUMNS = "venue_id, latitude AS lat, longitude AS lng, venue_name AS name, city, rating"

ORACLES["map_points_500"] = with_venues(f"""
SELECT {MAP_COLUMNS} FROM loc
WHERE latitude IS NOT NULL AND longitude IS NOT NULL
ORDER BY venue_id LIMIT 500
""")

ORACLES["location_distribution_500"] = with_venues(f"""
SELECT {MAP_COLUMNS} FROM (SELECT * FROM loc ORDER BY venue_id LIMIT 500)
WHERE latitude IS NOT NULL AND longitude IS NOT NULL
""")

MAP_DATA = f"""
md AS (
    SELECT {MAP_COLUMNS},
           trim(split_part(coalesce(cuisines, 'Unknown'), ',', 1)) AS cuisine,
           avg_cost AS cost
    FROM loc WHERE latitude IS NOT NULL AND longitude IS NOT NULL
)
"""

ORACLES["map_data_full"] = with_venues(MAP_DATA + "SELECT * FROM md")

ORACLES["search_venues"] = with_venues(MAP_DATA + """
SELECT * FROM md
WHERE (contains(lower(name), 'nation_1') OR contains(lower(city), 'nation_1'))
  AND rating >= 3.5
""")

ORACLES["class_distribution"] = with_venues("""
mc AS (SELECT trim(split_part(coalesce(cuisines, 'Unknown'), ',', 1)) AS main_cuisine FROM v)
SELECT main_cuisine, count(*) AS "count",
       round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM v), 6) AS share
FROM mc GROUP BY main_cuisine
""")

ORACLES["numeric_ranges"] = with_venues("""
SELECT 'votes' AS feature, CAST(min(votes) AS BIGINT) AS min_value,
       CAST(max(votes) AS BIGINT) AS max_value, CAST(trunc(avg(votes)) AS BIGINT) AS avg_value
FROM v
UNION ALL
SELECT 'avg_cost', CAST(min(avg_cost) AS BIGINT), CAST(max(avg_cost) AS BIGINT),
       CAST(trunc(avg(avg_cost)) AS BIGINT)
FROM v
""")

ORACLES["mode_price_by_city"] = with_venues("""
m AS (
    SELECT coalesce(city, 'Unknown') AS city, price_range,
           row_number() OVER (PARTITION BY coalesce(city, 'Unknown')
                              ORDER BY count(*) DESC, price_range) AS rn
    FROM v WHERE price_range IS NOT NULL
    GROUP BY 1, 2
)
SELECT city, price_range AS price_range_mode FROM m WHERE rn = 1
""")

ORACLES["distinct_counts"] = with_venues("""
SELECT count(*) AS n_venues,
       count(DISTINCT coalesce(city, 'Unknown')) AS n_cities,
       count(DISTINCT locality) AS n_localities,
       count(DISTINCT rest_type) AS n_rest_types,
       (SELECT count(DISTINCT trim(item)) FROM
           (SELECT unnest(string_split(coalesce(cuisines, 'Unknown'), ',')) AS item FROM v))
           AS n_cuisines
FROM v
""")

ORACLES["distinct_cities"] = with_venues("""
SELECT DISTINCT city FROM v WHERE city IS NOT NULL
""")

ORACLES["distinct_cuisines"] = with_venues("""
SELECT DISTINCT trim(item) AS item
FROM (SELECT unnest(string_split(cuisines, ',')) AS item FROM v WHERE cuisines IS NOT NULL)
""")

ORACLES["sample_row"] = with_venues("""
SELECT CAST(coalesce(votes, 100) AS BIGINT) AS votes,
       CASE WHEN lower(has_online_delivery) = 'yes' THEN 1 ELSE 0 END AS online_order,
       CASE WHEN lower(has_table_booking) = 'yes' THEN 1 ELSE 0 END AS book_table,
       coalesce(city, 'Unknown') AS location,
       coalesce(rest_type, 'Unknown') AS rest_type,
       coalesce(cuisines, 'Unknown') AS cuisines,
       CAST(coalesce(trunc(avg_cost), 500) AS BIGINT) AS cost
FROM v ORDER BY md5('42' || CAST(venue_id AS VARCHAR)) LIMIT 1
""")

ORACLES["sample_class_row"] = with_venues("""
SELECT coalesce(city, 'Unknown') AS city,
       CASE WHEN has_table_booking IS NULL OR lower(has_table_booking) = 'yes' THEN 1 ELSE 0 END
           AS has_table_booking,
       CASE WHEN has_online_delivery IS NULL OR lower(has_online_delivery) = 'yes' THEN 1 ELSE 0 END
           AS has_online_delivery,
       CAST(coalesce(price_range, 2) AS INTEGER) AS price_range,
       CAST(coalesce(votes, 150) AS BIGINT) AS votes
FROM v ORDER BY md5('42' || CAST(venue_id AS VARCHAR)) LIMIT 1
""")

ORACLES["form_options"] = with_venues("""
SELECT DISTINCT rest_type AS option FROM v WHERE rest_type IS NOT NULL
UNION ALL SELECT 'Unknown'
""")

ORACLES["cleaning_steps"] = with_venues("""
SELECT venue_id, venue_name AS name, city, CAST(coalesce(avg_cost, 0) AS DOUBLE) AS cost,
       CAST(coalesce(votes, 0) AS DOUBLE) AS votes, price_range,
       CASE WHEN lower(has_table_booking) = 'yes' THEN 1 ELSE 0 END AS book_table,
       trim(split_part(coalesce(cuisines, 'Unknown'), ',', 1)) AS main_cuisine,
       'none' AS dish_liked, round(coalesce(latitude, 0), 6) AS latitude
FROM v WHERE price_range IS NOT NULL AND city IS NOT NULL
""")

ORACLES["filter_venues"] = with_venues("""
rec AS (
    SELECT venue_id, venue_name,
           coalesce(city, 'Unknown') AS city,
           coalesce(cuisines, 'Unknown') AS cuisines,
           coalesce(price_range, 0) AS price_range,
           coalesce(has_table_booking, 'No') AS has_table_booking,
           coalesce(has_online_delivery, 'No') AS has_online_delivery
    FROM v
)
SELECT * FROM rec
WHERE lower(city) = 'nation_3'
  AND regexp_matches(cuisines, 'brand#1$|brand#2', 'i')
  AND lower(has_table_booking) = 'yes'
""")

ORACLES["clean_venues"] = with_venues("""
SELECT venue_id,
       coalesce(city, 'Unknown') AS city,
       coalesce(locality, 'Unknown') AS locality,
       coalesce(cuisines, 'Unknown') AS cuisines,
       trim(split_part(coalesce(cuisines, 'Unknown'), ',', 1)) AS main_cuisine,
       TRY_CAST(rating AS DOUBLE) AS rating,
       coalesce(TRY_CAST(avg_cost AS DOUBLE), 0.0) AS avg_cost,
       CAST(coalesce(TRY_CAST(price_range AS DOUBLE), 0) AS INTEGER) AS price_range,
       CAST(coalesce(TRY_CAST(votes AS DOUBLE), 0) AS BIGINT) AS votes,
       CASE WHEN lower(has_table_booking) = 'yes' THEN 1 ELSE 0 END AS has_table_booking,
       CASE WHEN lower(has_online_delivery) = 'yes' THEN 1 ELSE 0 END AS has_online_delivery
FROM v
""")

ORACLES["combined_text"] = with_venues("""
SELECT venue_id,
       concat_ws(' ', coalesce(cuisines, 'Unknown'), coalesce(city, 'Unknown'),
                 'price_' || CAST(coalesce(price_range, 0) AS VARCHAR),
                 'table_' || lower(coalesce(has_table_booking, 'No')),
                 'delivery_' || lower(coalesce(has_online_delivery, 'No'))) AS combined_text
FROM v
""")

ORACLES["label_bands"] = with_venues("""
lc AS (SELECT city, locality, count(*) AS locality_count FROM loc GROUP BY city, locality)
SELECT venue_id, rating, price_range, lc.locality_count, round(rating * 20, 6) AS score,
       CASE WHEN rating >= 4.5 THEN 'Excellent' WHEN rating >= 4.0 THEN 'Good'
            WHEN rating >= 3.5 THEN 'Average' ELSE 'Below Average' END AS rating_band,
       CASE price_range WHEN 1 THEN 'Budget (₹)' WHEN 2 THEN 'Moderate (₹₹)'
            WHEN 3 THEN 'Expensive (₹₹₹)' WHEN 4 THEN 'Very Expensive (₹₹₹₹)'
            ELSE 'Unknown' END AS price_label,
       repeat('₹', CAST(coalesce(price_range, 0) AS BIGINT)) AS price_symbols,
       CASE WHEN lc.locality_count > 50 THEN 'High' WHEN lc.locality_count > 20 THEN 'Medium'
            ELSE 'Low' END AS density_band,
       CASE WHEN rating * 20 >= 80 THEN 'green' WHEN rating * 20 >= 60 THEN 'blue'
            WHEN rating * 20 >= 40 THEN 'amber' ELSE 'red' END AS score_band
FROM loc JOIN lc USING (city, locality)
""")

# ---- text similarity and recommendation ------------------------------------


# The English stop words of Spark ML, written out here so that
# the oracle does not take them from the code that it checks.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his
himself she her hers herself it its itself they them their theirs themselves what which
who whom this that these those am is are was were be been being have has had having do
does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't
wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()

TOKEN_RE = r"'[\p{L}\p{N}_]{2,}'"
STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"

ORACLES["token_counts_documents"] = inline_ctes(f"""
SELECT doc_id,
       CAST(len(list_filter(regexp_extract_all(lower(text), {TOKEN_RE}),
                            lambda x: NOT list_contains({STOP}, x))) AS INTEGER) AS n_tokens,
       CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), {TOKEN_RE}),
                            lambda x: NOT list_contains({STOP}, x)))) AS INTEGER) AS n_distinct
FROM documents
""")


def tfidf_ctes(corpus: str, id_col: str, text: str, prefix: str) -> str:
    """CTEs <prefix>idf(token, idf) and <prefix>w(id, token, w) of unit rows
    for the texts of ``corpus``."""
    return f"""
{prefix}tok AS (
    SELECT {id_col}, unnest(regexp_extract_all(lower({text}), {TOKEN_RE})) AS token
    FROM {corpus}
),
{prefix}tf AS (
    SELECT {id_col}, token, count(*) AS tf FROM {prefix}tok
    WHERE NOT list_contains({STOP}, token) GROUP BY {id_col}, token
),
{prefix}idf AS (
    SELECT token, ln((1 + (SELECT count(*) FROM {corpus})) / (1 + count(*))) + 1 AS idf
    FROM {prefix}tf GROUP BY token
),
{prefix}w0 AS (
    SELECT {id_col}, token, tf * idf AS w FROM {prefix}tf JOIN {prefix}idf USING (token)
),
{prefix}w AS (
    SELECT {id_col}, token, w / sqrt(sum(w * w) OVER (PARTITION BY {id_col})) AS w
    FROM {prefix}w0
)
"""


def query_weight_ctes(queries: str, id_col: str, text: str, idf: str, prefix: str) -> str:
    return f"""
{prefix}tok AS (
    SELECT {id_col}, unnest(regexp_extract_all(lower({text}), {TOKEN_RE})) AS token
    FROM {queries}
),
{prefix}tf AS (
    SELECT {id_col}, token, count(*) AS tf FROM {prefix}tok
    WHERE NOT list_contains({STOP}, token) GROUP BY {id_col}, token
),
{prefix}w0 AS (
    SELECT {id_col}, token, tf * idf AS w FROM {prefix}tf JOIN {idf} USING (token)
),
{prefix}w AS (
    SELECT {id_col}, token, w / sqrt(sum(w * w) OVER (PARTITION BY {id_col})) AS w
    FROM {prefix}w0
)
"""


ORACLES["tfidf_documents"] = inline_ctes(
    "WITH " + tfidf_ctes("documents", "doc_id", "text", "d").strip() + """
SELECT doc_id, token, round(w, 6) AS weight FROM dw
""")

# Brute force: every (query, document) pair, zero when no token is shared.
ORACLES["similar_documents"] = inline_ctes(
    "WITH "
    + tfidf_ctes("documents", "doc_id", "text", "d").strip()
    + ",\n"
    + query_weight_ctes("benchmark", "item_id", "text", "didf", "q").strip()
    + """,
pos AS (
    SELECT qw.item_id, dw.doc_id, sum(qw.w * dw.w) AS score
    FROM qw JOIN dw USING (token) GROUP BY qw.item_id, dw.doc_id
),
allp AS (
    SELECT b.item_id, d.doc_id, round(coalesce(pos.score, 0.0), 6) AS score
    FROM benchmark b CROSS JOIN documents d
    LEFT JOIN pos ON pos.item_id = b.item_id AND pos.doc_id = d.doc_id
),
ranked AS (
    SELECT item_id, doc_id, score,
           row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM allp
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")


def recommend_oracle(requests_sql: str, top_n: int = 10) -> str:
    """Brute-force recommendation: every (request, venue) pair that passes
    the filters is scored; zero scores are ranked too."""
    return with_venues(f"""
req0 AS (
{requests_sql}
),
req AS (
    SELECT CAST(request_id AS BIGINT) AS request_id,
           CASE WHEN length(city) > 0 THEN city END AS q_city,
           CASE WHEN length(cuisine) > 0 THEN cuisine END AS q_cuisine,
           CAST(price_range AS INTEGER) AS q_price,
           CAST(table_booking AS BOOLEAN) AS q_table,
           CAST(online_delivery AS BOOLEAN) AS q_delivery
    FROM req0
),
preq AS (
    SELECT *, concat_ws(' ', q_cuisine, q_city, 'price_' || CAST(q_price AS VARCHAR),
                        'table_' || CASE WHEN q_table THEN 'yes' WHEN NOT q_table THEN 'no' END,
                        'delivery_' || CASE WHEN q_delivery THEN 'yes'
                                            WHEN NOT q_delivery THEN 'no' END) AS qtext
    FROM req
    WHERE q_city IS NOT NULL OR q_cuisine IS NOT NULL OR q_price IS NOT NULL
       OR q_table IS NOT NULL OR q_delivery IS NOT NULL
),
rec AS (
    SELECT venue_id, venue_name,
           coalesce(cuisines, 'Unknown') AS cuisines,
           coalesce(city, 'Unknown') AS city,
           coalesce(price_range, 0) AS price_range,
           coalesce(has_table_booking, 'No') AS has_table_booking,
           coalesce(has_online_delivery, 'No') AS has_online_delivery,
           rating, avg_cost, votes
    FROM v
),
vdoc AS (
    SELECT venue_id,
           concat_ws(' ', cuisines, city, 'price_' || CAST(price_range AS VARCHAR),
                     'table_' || lower(has_table_booking),
                     'delivery_' || lower(has_online_delivery)) AS t
    FROM rec
),
""" + tfidf_ctes("vdoc", "venue_id", "t", "v").strip() + ",\n"
        + query_weight_ctes("preq", "request_id", "qtext", "vidf", "q").strip() + f""",
pairs AS (
    SELECT r.request_id, rec.venue_id
    FROM preq r JOIN rec ON
        (r.q_city IS NULL OR lower(rec.city) = lower(r.q_city))
        AND (r.q_cuisine IS NULL OR regexp_matches(rec.cuisines, r.q_cuisine, 'i'))
        AND (r.q_price IS NULL OR rec.price_range = r.q_price)
        AND (r.q_table IS NULL OR lower(rec.has_table_booking)
             = CASE WHEN r.q_table THEN 'yes' ELSE 'no' END)
        AND (r.q_delivery IS NULL OR lower(rec.has_online_delivery)
             = CASE WHEN r.q_delivery THEN 'yes' ELSE 'no' END)
),
sc AS (
    SELECT p.request_id, p.venue_id, round(coalesce(sum(qw.w * vw.w), 0.0), 6) AS score
    FROM pairs p JOIN vw ON vw.venue_id = p.venue_id
    LEFT JOIN qw ON qw.request_id = p.request_id AND qw.token = vw.token
    GROUP BY p.request_id, p.venue_id
),
ranked AS (
    SELECT request_id, venue_id, score,
           row_number() OVER (PARTITION BY request_id ORDER BY score DESC, venue_id) AS rank
    FROM sc
),
firstn AS (
    SELECT venue_id, row_number() OVER (ORDER BY venue_id) AS rank
    FROM rec ORDER BY venue_id LIMIT {top_n}
),
top AS (
    SELECT request_id, venue_id, score, rank FROM ranked WHERE rank <= {top_n}
    UNION ALL
    SELECT r.request_id, f.venue_id, 1.0, f.rank
    FROM req r CROSS JOIN firstn f
    WHERE r.request_id NOT IN (SELECT request_id FROM preq)
)
SELECT t.request_id, CAST(t.rank AS INTEGER) AS rank, t.venue_id,
       rec.venue_name AS name, rec.cuisines AS cuisine, rec.city,
       round(CAST(rec.rating AS DOUBLE), 6) AS rating,
       CAST(rec.price_range AS INTEGER) AS price_range,
       CAST(trunc(rec.avg_cost) AS INTEGER) AS cost,
       CAST(trunc(rec.votes) AS INTEGER) AS votes,
       rec.has_online_delivery AS online_delivery,
       rec.has_table_booking AS table_booking,
       round(t.score, 6) AS similarity_score
FROM top t JOIN rec USING (venue_id)
""")


_REQ_TYPES = (
    "SELECT CAST(1 AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS city, "
    "CAST(NULL AS VARCHAR) AS cuisine, CAST(NULL AS INTEGER) AS price_range, "
    "CAST(NULL AS BOOLEAN) AS table_booking, CAST(NULL AS BOOLEAN) AS online_delivery "
    "WHERE false"
)


def _sql_value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def requests_sql(rows) -> str:
    parts = [_REQ_TYPES]
    for row in rows:
        cols = ", ".join(_sql_value(x) for x in row)
        parts.append(f"SELECT * FROM (VALUES ({cols}))")
    return "\nUNION ALL ".join(parts)


def _batch_requests_sql() -> str:
    from platewise.plans.registry import BATCH_REQUESTS

    return requests_sql(BATCH_REQUESTS) + """
UNION ALL
SELECT 100 + n_nationkey, lower(n_name), NULL, n_nationkey % 4 + 1, n_nationkey % 2 = 0, NULL
FROM nat"""


ORACLES["recommend_one"] = recommend_oracle(
    requests_sql([(1, "nation_7", "brand#12", None, None, None)])
)
ORACLES["recommend_empty"] = recommend_oracle(requests_sql([(1, None, None, None, None, None)]))
ORACLES["recommend_batch"] = recommend_oracle(_batch_requests_sql())

# ---- keyword classification of pages ----------------------------------------

_NAMED = ", ".join(
    f"'{name}': chr({code})" for name, code in [*name2codepoint.items(), ("apos", 39)]
)
_NAME = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);', 1)"
_CODE = f"""(CASE WHEN {_NAME}[2:2] IN ('x', 'X') THEN try_cast('0x' || {_NAME}[3:] AS BIGINT)
              ELSE try_cast({_NAME}[2:] AS BIGINT) END)"""
PAGE_TEXT = r"""
pt AS (
    SELECT page_id,
           trim(regexp_replace(
               array_to_string(list_transform(string_split(
                   regexp_replace(
                       regexp_replace(
                           regexp_replace(
                               regexp_replace(html,
                                   '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>',
                                   ' ', 'g'),
                               '(?s)<!--.*?-->', ' ', 'g'),
                           '(?i)<!doctype[^>]*>', ' ', 'g'),
                       '</?[A-Za-z!?][^>]*>', ' ', 'g'), '&'),
                   lambda p, i: CASE WHEN i = 1 THEN p ELSE coalesce(
                       (CASE WHEN @NAME = '' THEN NULL
                             WHEN @NAME[1:1] <> '#' THEN MAP {@NAMED}[@NAME]
                             WHEN @CODE BETWEEN 1 AND 55295 OR @CODE BETWEEN 57344 AND 1114111
                             THEN chr(@CODE::INTEGER) END) || p[len(@NAME) + 2:], '&' || p) END), ''),
               '[ \t\n\r\f\x0B\x{A0}]+', ' ', 'g')) AS text
    FROM pages
)
""".replace("@NAMED", _NAMED).replace("@NAME", _NAME).replace("@CODE", _CODE)

ORACLES["page_text"] = inline_ctes("WITH " + PAGE_TEXT.strip() + "\nSELECT page_id, text FROM pt")


def keyword_oracle(dictionary) -> str:
    rows = ",\n        ".join(
        f"({_sql_value(cat)}, {order}, {_sql_value(word)})"
        for order, (cat, words) in enumerate(dictionary)
        for word in words
    )
    return inline_ctes("WITH " + PAGE_TEXT.strip() + f""",
kw AS (
    SELECT * FROM (VALUES
        {rows}
    ) t(category, ord, keyword)
),
ncat AS (SELECT category, count(*) AS n_kw FROM kw GROUP BY category),
hits AS (
    SELECT pt.page_id, kw.category, kw.ord, count(*) AS hits
    FROM pt JOIN kw ON contains(lower(pt.text), kw.keyword)
    GROUP BY pt.page_id, kw.category, kw.ord
),
best AS (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY hits DESC, ord) AS rn FROM hits
)
SELECT pt.page_id,
       coalesce(b.category, 'Unknown') AS cuisine,
       CASE WHEN b.category IS NULL THEN 0.0
            ELSE round(least(CAST(b.hits AS DOUBLE) / n.n_kw * 100, 95.0), 6) END AS confidence,
       CAST(coalesce(b.hits, 0) AS INTEGER) AS hits
FROM pt
LEFT JOIN best b ON b.page_id = pt.page_id AND b.rn = 1
LEFT JOIN ncat n ON n.category = b.category
""")


def dictionary_oracle(rows: str) -> str:
    """``keyword_oracle`` over a dictionary query ``rows``."""
    sql = keyword_oracle([("", ["x"])])
    start, end = sql.index("SELECT * FROM (VALUES"), sql.index("ncat AS")
    return sql[:start] + rows + "\n),\n" + sql[end:]


ORACLES["page_keywords_words"] = dictionary_oracle("""
    SELECT 'group_' || (ascii(keyword) % 10) AS category, ascii(keyword) % 10 AS ord, keyword
    FROM (
        SELECT *, count(*) OVER (ORDER BY n DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM (
            SELECT keyword, count(*) AS n
            FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS keyword FROM documents)
            GROUP BY keyword
        )
    ) WHERE upto <= 50000""")


def _keyword_oracles():
    from platewise.plans.registry import WORD_PIECES
    from platewise.schema import CUISINE_KEYWORDS

    ORACLES["page_keywords"] = keyword_oracle(CUISINE_KEYWORDS)
    ORACLES["page_keywords_pieces"] = keyword_oracle(WORD_PIECES)


_keyword_oracles()

# ---- features, splits and metrics --------------------------------------------

RATING_ROWS = """
rr AS (
    SELECT venue_id, rating,
           coalesce(city, 'Unknown') AS city,
           coalesce(cuisines, 'Unknown') AS cuisines,
           coalesce(rest_type, 'Unknown') AS rest_type,
           CASE WHEN substr(md5(CAST(venue_id AS VARCHAR) || '42'), 1, 8) < '33333333'
                THEN 'test' ELSE 'train' END AS split
    FROM v WHERE rating IS NOT NULL
)
"""

ORACLES["label_encode"] = with_venues(RATING_ROWS + """
SELECT 'city' AS feature, value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS code
FROM (SELECT DISTINCT city AS value FROM rr)
UNION ALL
SELECT 'cuisines', value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT)
FROM (SELECT DISTINCT cuisines AS value FROM rr)
UNION ALL
SELECT 'rest_type', value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT)
FROM (SELECT DISTINCT rest_type AS value FROM rr)
""")

ORACLES["encode_unseen"] = with_venues(RATING_ROWS + """,
codes AS (
    SELECT 'city' AS feature, value, row_number() OVER (ORDER BY value) - 1 AS code
    FROM (SELECT DISTINCT city AS value FROM rr)
    UNION ALL
    SELECT 'cuisines', value, row_number() OVER (ORDER BY value) - 1
    FROM (SELECT DISTINCT cuisines AS value FROM rr)
    UNION ALL
    SELECT 'rest_type', value, row_number() OVER (ORDER BY value) - 1
    FROM (SELECT DISTINCT rest_type AS value FROM rr)
),
fb AS (
    SELECT feature,
           coalesce(max(CASE WHEN value = 'Unknown' THEN code END), count(*)) AS fallback
    FROM codes GROUP BY feature
),
q AS (
    SELECT n_nationkey AS request_id,
           coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END, 'Unknown')
               AS city,
           coalesce('Brand#' || CAST(n_nationkey AS VARCHAR), 'Unknown') AS cuisines,
           coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'BUILDING'
                         WHEN n_nationkey % 3 = 1 THEN 'building' END, 'Unknown') AS rest_type
    FROM nat
)
SELECT CAST(q.request_id AS BIGINT) AS request_id,
       CAST(coalesce(c1.code, (SELECT fallback FROM fb WHERE feature = 'city')) AS BIGINT)
           AS city_code,
       CAST(coalesce(c2.code, (SELECT fallback FROM fb WHERE feature = 'cuisines')) AS BIGINT)
           AS cuisines_code,
       CAST(coalesce(c3.code, (SELECT fallback FROM fb WHERE feature = 'rest_type')) AS BIGINT)
           AS rest_type_code
FROM q
LEFT JOIN codes c1 ON c1.feature = 'city' AND c1.value = q.city
LEFT JOIN codes c2 ON c2.feature = 'cuisines' AND c2.value = q.cuisines
LEFT JOIN codes c3 ON c3.feature = 'rest_type' AND c3.value = q.rest_type
""")

ORACLES["split_plain"] = with_venues("""
SELECT venue_id,
       CASE WHEN substr(md5(CAST(venue_id AS VARCHAR) || '42'), 1, 8) < '33333333'
            THEN 'test' ELSE 'train' END AS split
FROM v
""")

CUISINE_ROWS = """
cls AS (
    SELECT venue_id, coalesce(locality, 'Unknown') AS locality,
           trim(split_part(coalesce(cuisines, 'Unknown'), ',', 1)) AS label
    FROM v
),
tc AS (SELECT label FROM cls GROUP BY label ORDER BY count(*) DESC, label LIMIT 10),
crow AS (SELECT * FROM cls WHERE label IN (SELECT label FROM tc)),
strat AS (
    SELECT venue_id, locality, label,
           CASE WHEN row_number() OVER (PARTITION BY label
                                        ORDER BY md5(CAST(venue_id AS VARCHAR) || '42'), venue_id)
                     <= round(count(*) OVER (PARTITION BY label) * 0.2)
                THEN 'test' ELSE 'train' END AS split
    FROM crow
)
"""

ORACLES["top_classes"] = with_venues(CUISINE_ROWS + """
SELECT venue_id, label AS main_cuisine FROM crow
""")

ORACLES["split_stratified"] = with_venues(CUISINE_ROWS + """
SELECT venue_id, label, split FROM strat
""")

ORACLES["regression_metrics"] = with_venues(RATING_ROWS + """,
tm AS (SELECT city, avg(rating) AS m FROM rr WHERE split = 'train' GROUP BY city),
gm AS (SELECT avg(rating) AS g FROM rr WHERE split = 'train'),
p AS (
    SELECT rr.split, rr.rating AS label, coalesce(tm.m, gm.g) AS prediction
    FROM rr LEFT JOIN tm USING (city) CROSS JOIN gm
),
mm AS (SELECT split, avg(label) AS mean FROM p GROUP BY split),
s AS (
    SELECT p.split, count(*) AS n,
           avg((label - prediction) * (label - prediction)) AS mse,
           avg(abs(label - prediction)) AS mae,
           sum((label - prediction) * (label - prediction)) AS sse,
           sum((label - mean) * (label - mean)) AS sst
    FROM p JOIN mm USING (split) GROUP BY p.split
)
SELECT split, n, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae,
       round(CASE WHEN sst <> 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2
FROM s
""")

CUISINE_PRED = CUISINE_ROWS + """,
tr AS (SELECT * FROM strat WHERE split = 'train'),
lm AS (
    SELECT locality, label AS prediction FROM (
        SELECT locality, label,
               row_number() OVER (PARTITION BY locality ORDER BY count(*) DESC, label) AS rn
        FROM tr GROUP BY locality, label)
    WHERE rn = 1
),
gmode AS (SELECT label AS g FROM tr GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
p AS (
    SELECT s.venue_id, s.split, s.label, coalesce(lm.prediction, gmode.g) AS prediction
    FROM strat s LEFT JOIN lm USING (locality) CROSS JOIN gmode
),
sup AS (
    SELECT split, label AS class, count(*) AS support,
           sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS tp
    FROM p GROUP BY split, label
),
prd AS (SELECT split, prediction AS class, count(*) AS predicted FROM p GROUP BY split, prediction),
pc AS (
    SELECT coalesce(sup.split, prd.split) AS split, coalesce(sup.class, prd.class) AS class,
           CAST(coalesce(support, 0) AS BIGINT) AS support,
           CAST(coalesce(predicted, 0) AS BIGINT) AS predicted,
           CAST(coalesce(tp, 0) AS BIGINT) AS tp
    FROM sup FULL OUTER JOIN prd ON sup.split = prd.split AND sup.class = prd.class
),
pcm AS (
    SELECT split, class, support, tp,
           CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
           CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
    FROM pc
),
pcf AS (
    SELECT *, CASE WHEN precision + recall > 0
                   THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
    FROM pcm
)
"""

ORACLES["class_metrics"] = with_venues(CUISINE_PRED + """,
acc AS (
    SELECT split, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM p GROUP BY split
)
SELECT pcf.split, round(any_value(acc.accuracy), 6) AS accuracy,
       round(avg(precision), 6) AS precision_macro,
       round(sum(precision * support) / sum(support), 6) AS precision_weighted,
       round(avg(recall), 6) AS recall_macro,
       round(sum(recall * support) / sum(support), 6) AS recall_weighted,
       round(avg(f1), 6) AS f1_macro,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted
FROM pcf JOIN acc USING (split) GROUP BY pcf.split
""")

ORACLES["per_class_metrics"] = with_venues(CUISINE_PRED + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support, tp
FROM pcf WHERE split = 'test'
""")

ORACLES["confusion_matrix"] = with_venues(CUISINE_PRED + """,
pt AS (SELECT * FROM p WHERE split = 'test'),
cl AS (SELECT label AS c FROM pt UNION SELECT prediction FROM pt),
cnt AS (SELECT label, prediction, count(*) AS n FROM pt GROUP BY label, prediction)
SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(cnt.n, 0) AS BIGINT) AS "count"
FROM cl a CROSS JOIN cl b
LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c
""")

ORACLES["weak_classes"] = with_venues(CUISINE_PRED + """
SELECT class, round(f1, 6) AS f1, support, round(precision, 6) AS precision,
       round(recall, 6) AS recall,
       concat_ws(', ',
                 CASE WHEN support < 50 THEN 'low sample size' END,
                 CASE WHEN precision < 0.6 THEN 'high false positive rate' END,
                 CASE WHEN recall < 0.6 THEN 'many samples misclassified' END) AS reasons
FROM pcf WHERE split = 'test' AND f1 < 0.7
""")

ORACLES["class_imbalance"] = with_venues(CUISINE_PRED + """,
t AS (SELECT * FROM pcf WHERE split = 'test'),
a AS (
    SELECT max(support) AS max_support, min(support) AS min_support,
           bool_or(f1 < 0.7) AS weak
    FROM t
),
r AS (
    SELECT *, CASE WHEN min_support > 0 THEN CAST(max_support AS DOUBLE) / min_support
                   ELSE CAST('inf' AS DOUBLE) END AS ratio
    FROM a
)
SELECT max_support, min_support, round(ratio, 6) AS imbalance_ratio,
       ratio > 5 AS imbalanced, (weak OR ratio > 5) AS biases_identified
FROM r
""")

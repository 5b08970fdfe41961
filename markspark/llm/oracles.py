"""The queries of this folder in SQL for DuckDB, where SQL can express them."""

OP4 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM t
"""

OP7 = """
WITH t AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM t
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP9 = """
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain,
         string_split(host, '.')[-1] AS suffix,
         count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM p LEFT JOIN outcomes USING (page_id) GROUP BY host
), top AS (
  SELECT (sum(bad) + 1) / (sum(n) + 2) AS rate FROM hosts
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(top.rate) AS m
  FROM hosts, top GROUP BY suffix
), s1 AS (
  SELECT least(greatest(coalesce(
           sum(CASE WHEN n > 0 THEN pow(bad / n - m, 2) * n - m * (1 - m) END)
             / sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END), 0), 0.001), 0.999) AS rho
  FROM s0
), s2 AS (
  SELECT suffix, (m * ((1 - rho) / rho) + bad) / ((1 - rho) / rho + n) AS rate FROM s0, s1
), d0 AS (
  SELECT domain, any_value(s2.rate) AS m, sum(n) AS n, sum(bad) AS bad
  FROM hosts JOIN s2 USING (suffix) GROUP BY domain
), d1 AS (
  SELECT least(greatest(coalesce(
           sum(CASE WHEN n > 0 THEN pow(bad / n - m, 2) * n - m * (1 - m) END)
             / sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END), 0), 0.001), 0.999) AS rho
  FROM d0
), d2 AS (
  SELECT domain, (m * ((1 - rho) / rho) + bad) / ((1 - rho) / rho + n) AS rate FROM d0, d1
), h0 AS (
  SELECT host, d2.rate AS m, n, bad FROM hosts JOIN d2 USING (domain)
), h1 AS (
  SELECT least(greatest(coalesce(
           sum(CASE WHEN n > 0 THEN pow(bad / n - m, 2) * n - m * (1 - m) END)
             / sum(CASE WHEN n > 0 THEN m * (1 - m) * (n - 1) END), 0), 0.001), 0.999) AS rho
  FROM h0
), h2 AS (
  SELECT host, m * ((1 - rho) / rho) + bad AS a, (1 - m) * ((1 - rho) / rho) + n - bad AS b
  FROM h0, h1
), h3 AS (
  SELECT host, a / (a + b) AS rate,
         greatest(0, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS low
  FROM h2
), j AS (
  SELECT p.page_id, p.host, p.path, rate, low,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com')
              AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com')
              AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM p JOIN h3 USING (host)
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN low > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(rate, 6) AS bad_rate, round(low, 6) AS bad_low
FROM j
"""

_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         {_TERMS.format("coalesce(text, '')")} AS terms
  FROM documents
), held AS (
  SELECT row_id, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0
), facts AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM held
), items AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM benchmark)
  GROUP BY item_id, term
), tf AS (
  SELECT row_id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM items) GROUP BY row_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, facts GROUP BY term
), scored AS (
  SELECT item_id, doc_id,
         sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))
           ::BIGINT AS score
  FROM tf JOIN w USING (term) JOIN items USING (term), facts
  GROUP BY item_id, row_id, doc_id
), best AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 20
"""

# CRC-32 byte by byte, over a table that SQL works out from the polynomial
OP13 = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([b], range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
         ORDER BY b) AS t
  FROM range(256) AS r(b)
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row_id, doc_id,
         {_TERMS.format("coalesce(text, '')")} AS w
  FROM documents
  UNION ALL
  SELECT 'b', 0, NULL, {_TERMS.format("coalesce(text, '')")} FROM benchmark
), grams AS (
  SELECT side, row_id, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g
  FROM texts
), counted AS (
  SELECT side, row_id, g, count(*) AS n FROM grams GROUP BY side, row_id, g
), buckets AS (
  SELECT g, xor(4294967295, list_reduce(
              list_concat([4294967295], list_transform(range(0, strlen(g)),
                lambda i: ('0x' || substr(hex(encode(g)), (2 * i + 1)::BIGINT, 2))::BIGINT)),
              lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM counted), crc
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s,
         coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t
  FROM counted JOIN buckets USING (g) GROUP BY bucket
), totals AS (
  SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM sums
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
                                 / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums, totals
), weights AS (
  SELECT row_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM counted JOIN buckets USING (g) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
         coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT
           AS score
  FROM texts LEFT JOIN weights USING (row_id) WHERE side = 'd'
), able AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN able USING (doc_id)
"""



def similar_sets(n: int, least: int) -> str:
    """Tables for documents' sets of word n-grams and the classes of linked ones: `sets` (doc_id, s,
    n_shingles) and `classes` (doc_id, component_id)."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, s, len(s) AS n_shingles
  FROM (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(
           range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' ')))) END AS s
        FROM words)
), grams AS (
  SELECT doc_id, n_shingles, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= {least} * (any_value(a.n_shingles) + any_value(b.n_shingles) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT doc_id, b FROM reach JOIN links ON a = other
), classes AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)"""


OP12 = f"""{similar_sets(5, 85)}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept,
       CASE WHEN n_shingles = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s) END AS set_copies
FROM sets JOIN classes USING (doc_id)
"""

LLM_ORACLES: dict[str, str] = {
    "op4_exact_dedup": OP4,
    "op7_warc": OP7,
    "op9_url_filter": OP9,
    "op11_ranked_search": OP11,
    "op12_chosen_path": OP12,
    "op13_resampling": OP13,
}

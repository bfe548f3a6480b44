"""The corpus queries: each operator on its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwise.llm import ann, decontam, licenses, lines, neardup, negatives, packing, phrases, quality, sharding, suffixes, urls, warc
from cellwise.session import freeze, scratch_path, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


_FETCHED = "1704067200 + (page_id * 7919) % 31536000"


def captures(spark, folder):
    """The pages with a fetch time that follows from the page_id."""
    return table(spark, folder, "pages").withColumn("fetched_at", F.timestamp_seconds(F.expr(_FETCHED)))


@query("op1_optimal_length_buckets")
def op1(spark, folder):
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_karmarkar_karp_shards")
def op2(spark, folder):
    return sharding.balanced_shards(table(spark, folder, "documents").select("doc_id", "text"))


_KEYED = f"""SELECT page_id, encode(coalesce(html, '')) AS payload, {_FETCHED} AS moment,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1) AS host,
    regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^#]*)', 1) AS rest FROM pages"""


@query(
    "op3_warc_index_merge",
    f"""WITH p AS (SELECT *, sha256(payload) AS digest, octet_length(payload) AS n,
               coalesce(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END, '') AS url_key FROM ({_KEYED})),
         f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= {warc.LEAST_REVISIT} GROUP BY digest)
         SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
                CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
                CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
                row_number() OVER (ORDER BY url_key, moment, page_id) - 1 AS position, url_key
         FROM p LEFT JOIN f USING (digest)""",
)
def op3(spark, folder):
    return warc.round_trip(captures(spark, folder).select("page_id", "url", "html", "fetched_at"))


@query("op4_random_indexing_quality")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op5_multi_index_hashing")
def op5(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


@query("op6_licence_paragraph_classifier")
def op6(spark, folder):
    return licenses.documents_with(table(spark, folder, "documents").select("doc_id", "text"))


@query("op7_longest_previous_factor_dedup")
def op7(spark, folder):
    return suffixes.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))


_DAY = 86_400
_START = 1_704_067_200


def list_events(spark, folder):
    """A dated list made from the hosts of the pages: additions, removals and returns."""
    pages = table(spark, folder, "pages").select(urls.host("url").alias("pattern")).filter("pattern IS NOT NULL")
    hosts = freeze(pages.distinct())
    above = hosts.select(F.regexp_extract("pattern", r"([^.]+\.[^.]+)$", 1).alias("pattern")).filter("pattern <> ''").distinct()

    def drawn(names):
        return names.withColumn("c", F.conv(F.substring(F.sha2("pattern", 256), 1, 8), 16, 10).cast("long"))

    def events(rows, category, action, day):
        return rows.select("pattern", category.alias("category"), F.lit(action).alias("action"), F.timestamp_seconds(F.lit(_START) + day * _DAY).alias("effective_at"))

    c = F.col("c")
    some = drawn(hosts).filter(c % 3 == 0)
    kind, first = F.concat(F.lit("c"), (c % 4).cast("string")), c % 200
    whole = drawn(above)
    return (
        events(some, kind, "add", first)
        .unionByName(events(some.filter(c % 2 == 0), kind, "remove", first + 20 + c % 60))
        .unionByName(events(some.filter(c % 5 == 0), kind, "add", first + 150))
        .unionByName(events(whole, F.lit("domain"), "add", 60 + c % 30))
        .unionByName(events(whole, F.lit("domain"), "remove", 74 + c % 30))
    )


@query(
    "op8_temporal_url_lists",
    f"""WITH p AS (SELECT page_id, url, {_FETCHED} AS t, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '[.]+$', ''), '') AS host FROM pages),
         hosts AS (SELECT DISTINCT host AS pattern FROM p WHERE host IS NOT NULL),
         above AS (SELECT DISTINCT regexp_extract(pattern, '([^.]+[.][^.]+)$', 1) AS pattern FROM hosts),
         h AS (SELECT pattern, ('0x' || substr(sha256(pattern), 1, 8))::BIGINT AS c FROM hosts), a AS (SELECT pattern, ('0x' || substr(sha256(pattern), 1, 8))::BIGINT AS c FROM above WHERE pattern <> ''),
         e AS (SELECT pattern, 'c' || (c % 4) AS category, 'add' AS action, c % 200 AS day FROM h WHERE c % 3 = 0
               UNION SELECT pattern, 'c' || (c % 4), 'remove', c % 200 + 20 + c % 60 FROM h WHERE c % 3 = 0 AND c % 2 = 0
               UNION SELECT pattern, 'c' || (c % 4), 'add', c % 200 + 150 FROM h WHERE c % 3 = 0 AND c % 5 = 0
               UNION SELECT pattern, 'domain', 'add', 60 + c % 30 FROM a UNION SELECT pattern, 'domain', 'remove', 74 + c % 30 FROM a),
         v AS (SELECT pattern, category, action, {_START} + day * {_DAY} AS valid_from, lead({_START} + day * {_DAY}) OVER (PARTITION BY pattern, category ORDER BY day, action) AS valid_to FROM e),
         hit AS (SELECT p.page_id, v.pattern, v.category, v.valid_from,
                        row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.pattern) DESC, v.pattern, v.category, v.valid_from) AS k
                 FROM p JOIN v ON (p.host = v.pattern OR ends_with(p.host, '.' || v.pattern)) AND v.action = 'add' AND v.valid_from <= p.t AND (v.valid_to IS NULL OR p.t < v.valid_to))
         SELECT p.page_id, host, t AS fetched, hit.page_id IS NOT NULL AS blocked, hit.pattern, hit.category, CAST(hit.valid_from AS BIGINT) AS valid_from FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND k = 1""",
)
def op8(spark, folder):
    seen = urls.listed(captures(spark, folder).select("page_id", "url", "fetched_at"), list_events(spark, folder))
    return seen.select("page_id", "host", F.unix_timestamp("fetched_at").alias("fetched"), "blocked", "pattern", "category", F.unix_timestamp("valid_from").alias("valid_from"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op9_winnowing_decontamination",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
  q AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
  v AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM q WHERE len(w) > 0)),
  s AS (SELECT DISTINCT n FROM v),
  h AS (SELECT doc_id, i, v.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)) t JOIN v ON v.n = t.n AND v.g = t.g),
  p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
  c AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id)""",
)
def op9(spark, folder):
    found = decontam.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return decontam.digest(found)


@query(
    "op10_superminhash_near_duplicates",
    f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n r ON r.doc_id = b WHERE 100 * shared >= 85 * (p.n + r.n - shared)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
  c AS (SELECT a, least(a, min(b)) AS least FROM r GROUP BY a)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id""",
)
def op10(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query(
    "op11_toivonen_collocations",
    f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
  g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, w[i:i + m - 1] AS words FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 4) t(m) WHERE len(w) >= m)),
  f AS (SELECT lang, m, phrase, any_value(words) AS words, count(*) AS f FROM g GROUP BY lang, m, phrase),
  n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
  c AS (SELECT lang, m, phrase, words, f AS a FROM f WHERE m >= 2 AND f >= 10),
  u AS (SELECT lang || chr(10) || phrase AS part, f FROM f WHERE m <= 2 AND f >= 10),
  y AS (SELECT lang, phrase, a, k, lang || chr(10) || array_to_string(words[1:k], ' ') AS one, lang || chr(10) || array_to_string(words[k + 1:m], ' ') AS two FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
  x AS (SELECT lang, phrase, a, l.f AS l, r.f AS r, k, CAST(1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM y JOIN u l ON l.part = one JOIN u r ON r.part = two),
  s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  o AS (SELECT DISTINCT s.lang, s.phrase FROM s JOIN (SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase FROM c WHERE m = 3) t ON t.lang = s.lang AND t.phrase = s.phrase AND 100 * t.a >= 50 * s.a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM s ANTI JOIN o USING (lang, phrase) JOIN n USING (lang) QUALIFY rank <= 2000""",
)
def op11(spark, folder):
    return phrases.collocations(table(spark, folder, "documents").select("text", "lang"))


_LINE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op12_cuckoo_line_dedup",
    f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  x AS (SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
  k AS (SELECT *, {_LINE_KEY} AS key FROM x),
  f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
  m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
  SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY row""",
)
def op12(spark, folder):
    kept = lines.drop_frequent_lines(table(spark, folder, "documents").select("doc_id", "text"), scratch_path(spark, "line-index"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op13_gnat_hard_negatives",
    """WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS anchor_id, q.label AS own, r.vec_id AS other_id, r.label AS other, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score FROM u q JOIN u r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
  p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE own = other QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE own <> other AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
)
def op13(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return negatives.hard_negatives(vectors, vectors.filter("vec_id % 50 = 0"))

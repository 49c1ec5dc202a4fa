"""The contract queries: each applies one operator to its whole table.

``QUERIES`` maps names to (spark, sf_dir) functions, ``ORACLES`` to DuckDB SQL
where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embed_join, exact_dedup, html_extract, langid, license_rules, licenses, mixing, near_dedup, packing, prefix_trie, secrets, warc, whitening
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(added)))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("payload", "url")


def _joined(items: str) -> F.Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE_KINDS))
    count = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.withColumn("base", base).select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        "n_live",
        "n_example",
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), rebuild=prefix_trie.regraft)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    base = F.transform("base", lambda b: b["label"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        "score",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_html_extraction, op3_minhash_near_dedup, op4_exact_dedup, op5_best_fit_packing,
        op6_embedding_near_dedup, op7_chat_formatting, op8_source_mixing, op9_warc, op10_secret_scan,
        op11_conversation_trie, op12_embedding_whitening, op13_license_scan,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op4_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS b FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY b) AS keep_id, count(*) OVER (PARTITION BY b) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY b) AS kept, h AS text_sha256
FROM t
"""

ORACLES["op7_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, '<s>' || replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\<') || chr(10)
            || regexp_replace(text, '(\\*)(</?s>)', '\1\1\\\2', 'g') || chr(10) || '</s>' AS f FROM c),
p AS (
  SELECT *, sum(length(f)) OVER w AS upto, max(CASE WHEN role = 'assistant' THEN 0 ELSE 1 END) OVER e AS dummy,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM f
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY conv_id))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR back = 1), 0) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

# Quotients are handed out one by one; blocks and shards as in mixing.BLOCK and mixing.SHARD.
ORACLES["op8_source_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][rank % 3 + 1] AS DOUBLE) AS weight, 3.0 * source_size / [5, 2, 1][rank % 3 + 1] AS fills FROM s),
-- sources are full in the order of what their limit is to their weight, until the share of the next is below its limit
l AS (SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS full_before, sum(weight) OVER rest AS weight_left, sum(source_size) OVER () AS total FROM w
      WINDOW before AS (ORDER BY fills, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY fills, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT arg_min(full_before, (fills, rank)) AS full_before, arg_min(weight_left, (fills, rank)) AS weight_left, min((fills, rank)) AS first
      FROM l WHERE (CAST(total AS DOUBLE) - full_before) / weight_left <= fills),
t AS (SELECT source, l.rank, source_size, CASE WHEN first IS NULL OR (fills, l.rank) < first THEN 3.0 * source_size ELSE (CAST(total AS DOUBLE) - f.full_before) * weight / f.weight_left END AS target FROM l, f),
q AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank) AS place FROM (SELECT rank, target, unnest(generate_series(0, 3 * source_size - 1)) AS k FROM t WHERE target > 0)),
z AS (SELECT rank, count(*) AS seats FROM q WHERE place <= (SELECT round_even(sum(target), 0) FROM t) GROUP BY rank),
e AS (SELECT d.*, rank, source_size, target, coalesce(seats, 0) AS seats, CAST('0x' || substr(mark, 1, 15) AS BIGINT) % greatest(1, CAST(ceil(source_size / 33554432) AS BIGINT)) AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN z USING (rank)),
c AS (SELECT rank, shard, any_value(seats) AS seats, CAST(sum(size) AS BIGINT) AS shard_size FROM e GROUP BY rank, shard),
u AS (SELECT rank, shard, seats, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * k + 1) DESC, shard) AS place
      FROM (SELECT *, unnest(generate_series(0, 3 * shard_size - 1)) AS k FROM c WHERE shard_size > 0)),
v AS (SELECT c.rank, c.shard, shard_size, (count(place) FILTER (place <= u.seats)) // greatest(shard_size, 1) AS passes, (count(place) FILTER (place <= u.seats)) % greatest(shard_size, 1) AS rest
      FROM c LEFT JOIN u ON u.rank = c.rank AND u.shard = c.shard GROUP BY c.rank, c.shard, shard_size),
b AS (SELECT rank, shard, rest, block, least(2048, shard_size - block * 2048) AS own, md5('7:' || rank || ':' || shard || ':' || block) AS drawn
      FROM (SELECT *, unnest(generate_series(0, (shard_size - 1) // 2048)) AS block FROM v WHERE rest > 0)),
g AS (SELECT rank, shard, block * 2048 AS start, greatest(0, least(own, rest - (sum(own) OVER (PARTITION BY rank, shard ORDER BY drawn, block) - own))) AS got FROM b),
p AS (SELECT e.*, passes, sum(size) OVER (PARTITION BY e.rank, e.shard ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM e JOIN v ON v.rank = e.rank AND v.shard = e.shard),
x AS (SELECT p.doc_id, sum(greatest(0, least(upto, start + got) - greatest(upto - size, start))) AS drawn
      FROM p JOIN g ON g.rank = p.rank AND g.shard = p.shard AND start < upto AND start + got > upto - size GROUP BY 1)
SELECT p.doc_id, size, source_size, target, CAST(passes * size + coalesce(drawn, 0) AS BIGINT) AS taken FROM p LEFT JOIN x ON x.doc_id = p.doc_id
"""

ORACLES["op9_warc"] = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM g
"""

_COMPONENTS = """
walk AS (SELECT a AS id, b AS c FROM both_ways UNION SELECT w.id, l.b FROM walk w JOIN both_ways l ON l.a = w.c),
component AS (SELECT id, least(id, min(c)) AS component_id FROM walk GROUP BY id)
"""

ORACLES["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                            ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * common >= 85 * (m.n + o.n - common)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
""" + _COMPONENTS + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN component c ON c.id = d.doc_id
"""

ORACLES["op6_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
              WHERE list_inner_product(x.e, y.e) >= 0.98 * sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))),
""" + _COMPONENTS + """
, d AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN d ON d.a = e.vec_id LEFT JOIN component c ON c.id = e.vec_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _scan(kind: secrets.Kind, rank: int) -> str:
    p = _quoted(kind.pattern)
    return (
        f"SELECT doc_id, source, {rank} AS rank, '{kind.name}' AS kind, {kind.least} AS least, {_quoted(kind.secret)} AS secret_at, "
        f"string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}) AS matches FROM t"
    )


ORACLES["op10_secret_scan"] = (
    "WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), k AS ("
    + " UNION ALL ".join(f"SELECT *, regexp_extract(m, {_quoted(k.secret)}, 1) AS secret FROM (SELECT doc_id, source, rank, kind, least, i, pieces, matches, matches[i] AS m FROM (SELECT *, unnest(generate_series(1, len(matches))) AS i FROM ({_scan(k, r)})))" for r, k in enumerate(secrets.BASE_KINDS + secrets.EXTRA_KINDS))
    + r"""),
f AS (SELECT doc_id, source, rank, kind, secret,
             CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m) AS n
      FROM k WHERE length(secret) >= least),
o AS (SELECT secret, count(DISTINCT source) + max(CAST(source IS NULL AS INTEGER)) >= 3 AS example FROM f GROUP BY 1),
s AS (SELECT f.*, example, kind || ':' || a || ':' || (a + n) AS span FROM f JOIN o ON o.secret = f.secret WHERE rank < 3 OR NOT example),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3), '') AS base, string_agg(span, ',' ORDER BY a, rank) AS spans,
             count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
)

_PADDED = "regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')"
_PHRASES = ", ".join(f"('{label}', ' {phrase.replace(' ', '  ')} ', {len(phrase.split())})" for phrase, label in licenses.PHRASES)
_RULES = ", ".join(f"({k}, {r.priority}, '{r.label}', '{r.keyword}', '{r.pattern}')" for k, r in enumerate(license_rules.rules()))

# Words of a stretch of padded words: half its blanks. Containment is tested pair by pair.
ORACLES["op13_license_scan"] = f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, {_PADDED} AS s FROM documents),
n AS (SELECT k, doc_id, s, (length(s) - length(replace(s, ' ', ''))) // 2 - 1 AS n_words FROM t),
p AS (SELECT k, n_words, label, words, string_split(s, phrase) AS pieces FROM n JOIN (VALUES {_PHRASES}) AS q(label, phrase, words) ON contains(s, phrase)),
b AS (SELECT k, CAST(sum(len(pieces) - 1) AS BIGINT) AS n_base, min((length(pieces[1]) - length(replace(pieces[1], ' ', ''))) // 2) AS first_word,
             max(n_words - words - (length(pieces[-1]) - length(replace(pieces[-1], ' ', ''))) // 2) AS last_word, list(label) AS labels FROM p GROUP BY k),
m AS (SELECT k, rank, priority, label, string_split_regex(s, pattern) AS pieces, regexp_extract_all(s, pattern) AS matches
      FROM n JOIN (VALUES {_RULES}) AS r(rank, priority, label, keyword, pattern) ON contains(s, keyword)),
w AS (SELECT k, rank, priority, label, list_transform(pieces, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS gaps,
             list_transform(matches, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS sizes FROM m),
d AS (SELECT k, rank, priority, label, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS a, list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS e
      FROM (SELECT *, unnest(generate_series(1, len(sizes))) AS i FROM w)),
f AS (SELECT k, list(label) AS labels, max([{', '.join(map(str, license_rules.TRUST))}][priority + 1]) AS trust FROM d
      WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.k = d.k AND o.a <= d.a AND o.e >= d.e AND (o.priority < d.priority OR o.priority = d.priority AND (o.e - o.a > d.e - d.a OR o.e - o.a = d.e - d.a AND o.rank < d.rank)))
      GROUP BY k)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, f.labels))), ','), '') AS labels,
       CAST(greatest(coalesce(trust, 0), CASE WHEN n_base > 0 THEN {license_rules.TRUST[-1]} ELSE 0 END) AS DOUBLE) AS score
FROM n LEFT JOIN b ON b.k = n.k LEFT JOIN f ON f.k = n.k
"""

# A step of the CRC for each bit; -1 stands for a shift.
ORACLES["op11_conversation_trie"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS l, CAST(conv_id AS VARCHAR) AS c FROM t GROUP BY conv_id),
k AS (SELECT conv_id, l, xor(list_reduce(list_concat([4294967295], flatten(list_transform(generate_series(1, length(c)), lambda i: [CAST(ascii(substr(c, CAST(i AS INTEGER), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM s),
b AS (SELECT k.conv_id, list_concat(coalesce(o.l[1:h], []), k.l[h + 1:]) AS l FROM k LEFT JOIN s o ON o.conv_id = k.conv_id - k.conv_id % 20),
p AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS path FROM (SELECT *, unnest(generate_series(0, len(l))) AS d FROM b)),
g AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
c AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
e AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(g.path[d].text, '[^\x20\x09-\x0D]+')) END AS words FROM g LEFT JOIN c ON c.path = g.path),
u AS (SELECT path[1:a] AS path, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
      FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM e) GROUP BY 1)
SELECT e.conv_id, e.d AS depth, o.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens, e.ends_sha256
FROM e JOIN u ON u.path = e.path LEFT JOIN g o ON e.d > 0 AND o.d = e.d - 1 AND o.path = e.path[1:e.d - 1]
"""

"""One query per operator, over whole tables with the operators' own parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, decontaminate, forest, language, licenses, neighbours, packing, preferences, repair, similarity, trie, urls, warc

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.learn_and_identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = rf"""
WITH RECURSIVE doc_words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS k FROM doc_words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * i >= 80 * (a.n + b.n - i)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.digest(F.col("items")).alias("items_sha256"), "contaminated")


OP5_SQL = rf"""
WITH item_words AS (SELECT DISTINCT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k + 1 : k + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM item_words WHERE len(w) > 0)),
doc_words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (SELECT doc_id, size, k, array_to_string(w[k + 1 : k + size], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS k FROM doc_words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, size, k FROM doc_windows JOIN item_windows USING (size, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS sha
  FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("fetched", urls.fetched(F.col("page_id")))
    return warc.round_trip(pages, date_col="fetched").drop("date")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS o FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN o < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN o < page_id THEN o END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return preferences.format_preferences(turns, preferences.shortened_answers(turns)).withColumns({"chosen_spans": spans("chosen_spans"), "rejected_spans": spans("rejected_spans")})


OP8_SQL = r"""
WITH a AS (SELECT conv_id, list(turn ORDER BY turn) AS l FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
cut AS (SELECT conv_id, l[CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % len(l) + 1] AS cut FROM a),
c AS (SELECT t.conv_id, turn, role, text FROM conversations t SEMI JOIN cut USING (conv_id)),
r AS (SELECT t.conv_id, turn, role, CASE WHEN turn = cut THEN left(text, CAST(floor(length(text) / 2) AS BIGINT)) ELSE text END AS text
  FROM conversations t JOIN cut USING (conv_id) WHERE turn <= cut),
both_ AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn,
  coalesce(c.role = r.role AND c.text = r.text, false) AS same FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn),
n AS (SELECT conv_id, coalesce(min(CASE WHEN NOT same THEN turn END), max(turn) + 1) AS n FROM both_ GROUP BY conv_id),
rows_ AS (SELECT side, conv_id, turn, regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') AS role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text
  FROM (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r' AS side, * FROM r)),
shown AS (SELECT side, conv_id, turn, role, n, turn < n AS shared, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM rows_ JOIN n USING (conv_id)),
placed AS (SELECT *, sum(length(s)) OVER (PARTITION BY side, conv_id, shared ORDER BY turn) AS stop FROM shown),
parts AS (SELECT side, conv_id, shared, string_agg(s, '' ORDER BY turn) AS s,
  string_agg(CASE WHEN role = 'assistant' THEN CAST(stop - length(s) + length(role) + 5 AS VARCHAR) || '-' || CAST(stop - 1 AS VARCHAR) END, ',' ORDER BY turn) AS spans
  FROM placed GROUP BY ALL)
SELECT n.conv_id, CAST(n.n AS INTEGER) AS prompt_turns, coalesce(p.s, '') AS prompt, coalesce(x.s, '') AS chosen, coalesce(y.s, '') AS rejected,
  coalesce(x.spans, '') AS chosen_spans, coalesce(y.spans, '') AS rejected_spans
FROM n LEFT JOIN parts p ON p.conv_id = n.conv_id AND p.side = 'c' AND p.shared
LEFT JOIN parts x ON x.conv_id = n.conv_id AND x.side = 'c' AND NOT x.shared
LEFT JOIN parts y ON y.conv_id = n.conv_id AND y.side = 'r' AND NOT y.shared
"""


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", urls.fetched(F.col("page_id")))
    return urls.filter_captures(captures, urls.derived_list(pages)).select("page_id", F.col("fetched").cast("string").alias("fetched"), "host", "blocked", "matched_entry", F.col("active_since").cast("string").alias("active_since"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched,
  nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)', 1), '^[\s.]+|[\s.]+$', '', 'g'), '') AS host FROM pages),
s AS (SELECT page_id, fetched, array_to_string(string_split(host, '.')[k:], '.') AS entry FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM p)
  WHERE k = 1 OR NOT regexp_matches(host, '^(\[.*|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$')),
e AS (SELECT entry, count(*) * 31 + length(entry) * 17 AS k FROM s WHERE contains(entry, '.') GROUP BY entry),
events_ AS (SELECT entry, DATE '2024-01-01' + CAST(k % 200 AS INTEGER) AS day, true AS active FROM e WHERE k % 3 <> 0
  UNION ALL SELECT entry, DATE '2024-01-01' + CAST(k % 200 + 20 + k % 60 AS INTEGER), false FROM e WHERE k % 3 <> 0 AND k % 4 <> 0
  UNION ALL SELECT entry, DATE '2024-01-01' + CAST(k % 200 + 100 AS INTEGER), true FROM e WHERE k % 3 <> 0 AND k % 5 = 0),
days AS (SELECT entry, day, bool_or(active) AS active FROM events_ GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY entry ORDER BY day), false) AS was FROM days) WHERE active <> was),
v AS (SELECT * FROM (SELECT entry, active, day AS since, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until FROM changes) WHERE active),
m AS (SELECT page_id, arg_max(entry, length(entry)) AS matched_entry, arg_max(since, length(entry)) AS active_since
  FROM s JOIN v USING (entry) WHERE fetched >= since AND (until IS NULL OR fetched < until) GROUP BY page_id)
SELECT page_id, CAST(fetched AS VARCHAR) AS fetched, host, matched_entry IS NOT NULL AS blocked, matched_entry, CAST(active_since AS VARCHAR) AS active_since FROM p LEFT JOIN m USING (page_id)
"""


#: A table of crc32 by byte, and a form of crc32 over ASCII strings; for SQL, which has none.
_CRC_TABLE = """crc(tbl) AS MATERIALIZED (SELECT list(t ORDER BY b) FROM (SELECT b,
  list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS t FROM range(256) r(b)))"""
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])))"


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.repair(repair.damaged(turns), keys=turns)


def _op11_sql() -> str:
    """The lattice backwards, row by row: the best (cost, audit, lines) from each state on; a conversation's last state is that after no row."""
    blank = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda cost, initial, role, text, tail: f"{{'c': {tail}.c + {cost}, 'a': '{initial}' || {tail}.a, 'l': {role} || ':' || {text} || chr(10) || {tail}.l}}"
    insert = lambda role, tail: add(5, "I", f"'{role}'", "''", tail)
    never = "{'c': 1000000000, 'a': '', 'l': ''}"

    def base(state: str, nexts: str, role: str) -> str:
        drop = f"{{'c': {state}.c + 2, 'a': 'D' || {state}.a, 'l': {state}.l}}"
        keep = f"CASE WHEN NOT must AND ini = '{role[0]}' THEN {add('extra', 'K', 'role', 'text', nexts)} ELSE {never} END"
        rerole = f"CASE WHEN NOT must THEN {add('1 + extra', 'R', f"'{role}'", 'text', nexts)} ELSE {never} END"
        system = f", CASE WHEN NOT must AND ini = 's' THEN {add('extra', 'K', 'role', 'text', 's1')} ELSE {never} END" if state == "s0" else ""
        return f"list_min([{drop}, {keep}, {rerole}{system}])"

    closed = f"""k, list_min([b2, {insert('assistant', 'b3')}]) AS s2, list_min([b3, {insert('user', 'b2')}]) AS s3, b0, b1"""
    last = "SELECT least(b0, {0}) AS s0, least(b1, {0}) AS s1, s2, s3".format(insert("user", "s2"))
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS draw FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
  CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM drawn)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k, rtrim(text, {blank}) AS bare, left(role, 1) AS ini FROM hurt),
marked AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
  lag(ini) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
faults AS (SELECT *, blank OR again AS must, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
  CASE WHEN NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM marked),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again) AS duplicate,
  count_if(cut) AS truncated, count_if(before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS k, {{'c': 0, 'a': '', 'l': ''}} AS s0, {insert('user', insert('assistant', "{'c': 0, 'a': '', 'l': ''}").join(['(', ')']))} AS s1,
    {insert('assistant', "{'c': 0, 'a': '', 'l': ''}")} AS s2, {{'c': 0, 'a': '', 'l': ''}} AS s3 FROM stats
  UNION ALL
  SELECT conv_id, k - 1, list_min([b0, {insert('user', 's2')}]), list_min([b1, {insert('user', 's2')}]), s2, s3 FROM (
    SELECT conv_id, k, b0, b1, list_min([b2, {insert('assistant', 'b3')}]) AS s2, list_min([b3, {insert('user', 'b2')}]) AS s3 FROM (
      SELECT w.conv_id, w.k, {base('s0', 's2', 'user')} AS b0, {base('s1', 's2', 'user')} AS b1, {base('s2', 's3', 'assistant')} AS b2, {base('s3', 's2', 'user')} AS b3
      FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(CASE WHEN s0.l IS NULL OR s0.l = '' THEN '' ELSE left(s0.l, length(s0.l) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM walk WHERE k = 0) w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP11_SQL = _op11_sql()


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = rf"""
WITH {_CRC_TABLE},
c AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, l, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM c, crc),
r AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1 : h], h.l[h + 1 :]) AS l FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, d, md5(CAST(l[1 : d] AS VARCHAR)) AS node, l[d].t AS text, d = len(l) AS ends, CASE WHEN d > 0 THEN md5(CAST(l[1 : d - 1] AS VARCHAR)) END AS parent, l
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM r)),
n AS (SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent,
  coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends)), sha256('')) AS ends_sha256,
  (count(*) - 1) * any_value(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS saved FROM m GROUP BY d, node),
k AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.parent = n.node) AS n_children FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.node = n.parent),
above AS (SELECT DISTINCT a.d AS ad, a.node AS anode, b.d, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT ad, anode, sum(saved) AS saved, count_if(n_children = 0) AS leaves FROM above JOIN k USING (d, node) GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, ends_sha256
FROM k JOIN sums ON ad = d AND anode = node
"""


def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, which the forest finds with a probability near one.
OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, component_id IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) l ON l.x = e.vec_id
LEFT JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = e.vec_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_decontamination": op5_decontamination,
    "op6_token_attribution": op6_token_attribution,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_preference_format": op8_preference_format,
    "op9_learned_partitions": op9_learned_partitions,
    "op10_url_filter": op10_url_filter,
    "op11_structure_repair": op11_structure_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_projection_forest": op13_projection_forest,
}

#: The others have no SQL form; tests/llm holds them against brute force or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": OP3_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_warc_revisits": OP7_SQL,
    "op8_preference_format": OP8_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_structure_repair": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_projection_forest": OP13_SQL,
}

"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passerelle.llm import decontaminate, extraction, langid, packing, quotes, secrets, simhash, substrings, syncmers, toxicity, trie, variants, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1,
        "op2_warc": warc.op2,
        "op3_toxicity": toxicity.op3,
        "op4_substrings": substrings.op4,
        "op5_syncmers": syncmers.op5,
        "op6_secrets": secrets.op6,
        "op7_decontaminate": decontaminate.op7,
        "op8_quotes": quotes.op8,
        "quoted_conversations": quotes.quoted_conversations,
        "op9_packing": packing.op9,
        "op10_simhash": simhash.op10,
        "op11_trie": trie.op11,
        "op12_variants": variants.op12,
        "op13_extraction": extraction.op13,
    }


OP2 = """SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM (SELECT page_id, h, CASE WHEN octet_length(encode(h)) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS f FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""

OP4 = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT h FROM wins GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM wins WHERE h IN (SELECT h FROM again))),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN left_ ON left_.doc_id = d.doc_id"""

OP7_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7 = f"""WITH d AS (SELECT doc_id, {OP7_WORDS} AS w FROM documents), b AS (SELECT item_id, {OP7_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
found AS (SELECT DISTINCT doc_id, i, f.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)) f JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id"""

def crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8: eight shifts for each byte."""
    shift = "list_reduce(range(8), lambda a, i: xor(a >> 1, (a & 1) * 3988292384), {})"
    byte = "CAST(concat('0x', substr(hex(encode({})), 2 * {} - 1, 2)) AS BIGINT)"
    return f"xor(4294967295, list_reduce(range(1, octet_length(encode({text})) + 1), lambda c, j: {shift.format(f'xor(c, {byte.format(text, "j")})')}, 4294967295))"


OP11 = f"""WITH raw AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM raw)),
turns AS (SELECT c.conv_id, pos, role, text FROM c JOIN raw ON raw.conv_id = base AND pos <= h UNION ALL SELECT c.conv_id, pos + 1000000000, role, text FROM c JOIN raw ON raw.conv_id = c.conv_id AND pos > h),
deep AS (SELECT *, row_number() OVER w AS depth, md5(string_agg(concat(length(role), ':', length(text), ':', role, text), '|') OVER w) AS node, length(text) AS size FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
path AS (SELECT conv_id, depth, node, size FROM deep UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
n AS (SELECT conv_id, max(depth) AS last FROM path GROUP BY conv_id),
node AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM path GROUP BY node, depth),
parent AS (SELECT DISTINCT a.node, b.node AS parent FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM parent GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
total AS (SELECT top AS node, count(*) FILTER (kids.node IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM below JOIN node ON node.node = below.node LEFT JOIN kids ON kids.node = below.node GROUP BY top),
ends AS (SELECT node, string_agg(CAST(path.conv_id AS VARCHAR), ',' ORDER BY path.conv_id) AS ids FROM path JOIN n ON n.conv_id = path.conv_id AND depth = last GROUP BY node)
SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN parent ON parent.node = node.node LEFT JOIN node p ON p.node = parent.parent LEFT JOIN kids ON kids.node = node.node JOIN total ON total.node = node.node LEFT JOIN ends ON ends.node = node.node"""

OP12 = f"""WITH RECURSIVE runs AS (SELECT key, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32("concat(key, ':', run)")} AS h FROM runs),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
short AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other FROM short a JOIN short b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT short.word, words.word FROM short JOIN words ON words.word = short.rest UNION SELECT words.word, short.word FROM short JOIN words ON words.word = short.rest),
best AS (SELECT near.word, count(*) AS n_near, min((-words.n, near.other)) AS b FROM near JOIN words ON words.word = near.other GROUP BY near.word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * words.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * words.n THEN -b[1] END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
steps AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT steps.word, forms.word, forms.form FROM steps JOIN forms ON forms.word = steps.next)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN steps ON steps.word = forms.word AND next IS NULL"""

#: The driver's pages have one article each, in which only headings and paragraphs are blocks.
OP13 = r"""WITH b AS (SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS parts FROM pages),
t AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM t)"""



def oracle_sql() -> dict[str, str]:
    """Only what DuckDB has functions for; tests/llm holds the rest against brute force."""
    return {"op2_warc": OP2, "op4_substrings": OP4, "op7_decontaminate": OP7, "op11_trie": OP11, "op12_variants": OP12, "op13_extraction": OP13}

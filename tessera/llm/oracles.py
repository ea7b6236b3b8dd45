"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from .sharding import SHARDS, SLOTS, lookup_table
from .urls import RULES

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), {_A_TO_Z})")} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: The table of slots stands in the SQL; a test holds it against one made another way.
_OWNERS = ",".join(map(str, lookup_table([f"shard-{i:03d}" for i in range(SHARDS)], SLOTS)))
OP3 = f"""
WITH t AS (SELECT unnest([{_OWNERS}]) AS owner, unnest(range({SLOTS})) AS slot), d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot::INTEGER AS slot, 'shard-' || lpad(owner::VARCHAR, 3, '0') AS shard FROM d JOIN t USING (slot)
"""

OP8 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {_WORDS.format('text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS g, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
y AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x) WHERE n > 1),
z AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM y, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(z.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_shouts,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_alpha, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters FROM w LEFT JOIN z USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_shouts > 30 * n_words OR 100 * n_upper > 40 * n_alpha OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_stutters > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""


def _rules(column: str) -> str:
    out = ""
    for verdict, host, path in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow")):
        value = host + path if column == "rule" else verdict
        out += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value}'"
    return f"CASE{out} END"


def _parts(source: str, keep: str) -> str:
    """url, host, path and key of the URLs of a table, with its rule."""
    host = f"translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_A_TO_Z})"
    return (
        f"(SELECT *, {_rules('rule')} AS rule, {_rules('ruled')} AS ruled FROM (SELECT {keep}, url, {host} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, "
        f"{host} || ' ' || regexp_extract(coalesce(url, ''), '://[^/?#]*([^#]*)', 1) AS key FROM {source}))"
    )


#: Links are taken where they are whole URLs with quoted values, rel before href and http-equiv before content.
OP9 = f"""
WITH RECURSIVE own AS {_parts('pages', 'page_id, html')},
l AS (SELECT key AS a, unnest([regexp_extract(coalesce(html, ''), '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]+)"', 1), regexp_extract(coalesce(html, ''), '(?is)<meta[^>]*http-equiv="refresh"[^>]*content="[^"]*url=([^"]+)"', 1)]) AS url FROM own WHERE host <> ''),
t AS {_parts("(SELECT * FROM l WHERE contains(url, '://'))", 'a')},
e AS (SELECT a, key AS b FROM t UNION SELECT key, a FROM t),
r AS (SELECT a AS key, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.key),
c AS (SELECT key, min(root) AS component FROM r GROUP BY key),
said AS (SELECT key, ruled FROM own WHERE ruled IS NOT NULL UNION SELECT key, ruled FROM t WHERE ruled IS NOT NULL),
fate AS (SELECT component, min(ruled) AS fate FROM said JOIN c USING (key) GROUP BY component)
SELECT page_id, host, path, rule, coalesce(ruled, fate, 'allow') AS verdict FROM own LEFT JOIN c USING (key) LEFT JOIN fate USING (component)
"""

ORACLE_SQL = {"op1_minhash_near_dedup": OP1, "op3_sharding": OP3, "op8_quality_rules": OP8, "op9_url_filters": OP9}

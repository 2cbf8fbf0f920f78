"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The derived history as SQL: every oracle may use these names (see annals.plans.history for the same rules).
HISTORY = """WITH RECURSIVE
commits AS (SELECT event_id AS oid, ts AS commit_time, user_id AS author, event_type AS message, value FROM events),
first_parents AS (SELECT oid AS child, lag(oid) OVER (PARTITION BY author ORDER BY commit_time, oid) AS parent FROM commits),
edges AS (
  SELECT child, parent, 0 AS nth FROM first_parents WHERE parent IS NOT NULL
  UNION ALL
  SELECT child, child - 1, 1 FROM first_parents WHERE child % 17 = 0 AND child > 0 AND parent IS DISTINCT FROM child - 1),
tip AS (SELECT max(oid) AS a, (max(oid) + 1) * 9 // 10 AS b FROM commits),
refs AS (
  SELECT 'refs/heads/u' || author AS name, max(oid) AS oid FROM commits GROUP BY author
  UNION ALL
  SELECT 'refs/remotes/' || lower(r_name) || '/' || lower(replace(n_name, ' ', '-')), n_nationkey * 31 FROM nation JOIN region ON n_regionkey = r_regionkey),
tags AS (SELECT oid AS object, 'v' || (oid // 100) AS name, commit_time AS tagged FROM commits WHERE oid % 100 = 0),
ra(oid) AS (SELECT a FROM tip UNION SELECT parent FROM ra JOIN edges ON child = ra.oid),
rb(oid) AS (SELECT b FROM tip UNION SELECT parent FROM rb JOIN edges ON child = rb.oid),
items AS (
  SELECT l_orderkey || '/' || l_linenumber AS path, l_orderkey, l_linenumber, min(l_shipdate) AS day, max(l_partkey) AS part,
         max(CAST(round(l_quantity) AS BIGINT)) AS quantity, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1, 2, 3),
base_tree AS (SELECT path, 33188 AS mode, md5(part || ':' || quantity || ':' || cents) AS oid FROM items WHERE day < TIMESTAMP '1998-01-01'),
tree_a AS (SELECT path, CASE WHEN part % 29 = 0 THEN 33261 ELSE 33188 END AS mode, md5(part || ':' || (quantity + CASE WHEN part % 13 = 0 THEN 1 ELSE 0 END) || ':' || cents) AS oid FROM items WHERE day < TIMESTAMP '1999-01-01' AND part % 19 <> 0),
tree_b AS (SELECT path, 33188 AS mode, md5(part || ':' || (quantity + CASE WHEN part % 11 = 0 THEN 2 ELSE 0 END) || ':' || cents) AS oid FROM items WHERE day < TIMESTAMP '1998-07-01' AND part % 23 <> 0),
urls AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
lines AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
blobs AS (SELECT doc_id, sha1(encode('blob ' || octet_length(encode(coalesce(text, ''))) || chr(0)) || encode(coalesce(text, ''))) AS oid, octet_length(encode(coalesce(text, ''))) AS size FROM documents),
reflog AS (SELECT 'refs/conv/' || conv_id AS ref, turn AS update_index, role AS who, text AS comment FROM conversations)
"""


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame; a statement that doesn't start with SELECT adds its own tables to HISTORY."""

    def add(f):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if oracle:
            body = oracle.strip()
            ORACLES[key] = HISTORY + ("" if body.startswith(("SELECT", "FROM")) else ", ") + body
        return f

    return add

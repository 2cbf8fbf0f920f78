"""Scalar functions as columns: object ids, codecs, dates, person lines, quoting, binary and line-end detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.plans.history import blobs, commits, reflog, refs, urls
from annals.registry import query
from annals.session import table


@query("SELECT doc_id, oid FROM blobs")
def blob_oids(spark, sf_dir):
    return blobs(spark, sf_dir).select("doc_id", "oid")


@query("SELECT doc_id, sha256(encode(coalesce(text, ''))) AS oid FROM documents")
def sha256_oid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("oid"))


@query("SELECT event_id AS oid, base64(encode(event_type)) AS coded, lower(hex(encode(event_type))) AS hexed, event_type = decode(from_base64(base64(encode(event_type)))) AS same FROM events")
def codecs(spark, sf_dir):
    raw = F.col("event_type").cast("binary")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("oid"), F.base64(raw).alias("coded"), F.lower(F.hex(raw)).alias("hexed"), (F.unbase64(F.base64(raw)) == raw).alias("same"))


@query("SELECT page_id, TRY_CAST(regexp_extract(path, '(\\d+)$', 1) AS BIGINT) AS suffix FROM urls")
def parse_suffix_number(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", F.expr("try_cast(regexp_extract(path, '(\\\\d+)$', 1) as bigint)").alias("suffix"))


_PERSON = "'U' || author || ' <u' || author || '@example.com> ' || CAST(floor(epoch(commit_time)) AS BIGINT) || ' +0130'"


@query(f"SELECT oid, regexp_extract(p, '^(.*) <', 1) AS name, regexp_extract(p, '<(.*)>', 1) AS email, CAST(regexp_extract(p, '> (\\d+)', 1) AS BIGINT) AS seconds, CAST(90 AS INTEGER) AS minutes FROM (SELECT oid, {_PERSON} AS p FROM commits)")
def person_parse(spark, sf_dir):
    """A person line taken apart again, the zone as minutes."""
    seconds = F.unix_timestamp(F.col("commit_time").cast("timestamp"))
    line = F.concat(F.lit("U"), "author", F.lit(" <u"), "author", F.lit("@example.com> "), seconds, F.lit(" +0130"))
    zone = F.regexp_extract("p", r"([+-]\d{4})$", 1)
    minutes = (F.substr(zone, F.lit(1), F.lit(3)).cast("int") * 60 + F.substr(zone, F.lit(4), F.lit(2)).cast("int")).alias("minutes")
    return commits(spark, sf_dir).select("oid", line.alias("p")).select("oid", F.regexp_extract("p", "^(.*) <", 1).alias("name"), F.regexp_extract("p", "<(.*)>", 1).alias("email"), F.regexp_extract("p", r"> (\d+)", 1).cast("long").alias("seconds"), minutes)


@query("SELECT oid, strftime(commit_time, '%Y-%m-%d') AS short, strftime(commit_time, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM commits")
def date_format(spark, sf_dir):
    return commits(spark, sf_dir).select("oid", F.date_format("commit_time", "yyyy-MM-dd").alias("short"), F.date_format("commit_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("""a AS (SELECT oid, CAST(epoch(TIMESTAMP '2024-03-01') AS BIGINT) - CAST(floor(epoch(commit_time)) AS BIGINT) AS s FROM commits)
SELECT oid, CASE WHEN s < 0 THEN 'in the future' WHEN s < 90 THEN s || ' seconds ago' WHEN s < 5400 THEN (s + 30) // 60 || ' minutes ago' WHEN s < 129600 THEN (s + 1800) // 3600 || ' hours ago' WHEN s < 1209600 THEN (s + 43200) // 86400 || ' days ago' ELSE (s + 302400) // 604800 || ' weeks ago' END AS age FROM a""")
def relative_date(spark, sf_dir):
    """Age against a fixed day, rounded in the largest unit that fits."""
    s = F.unix_timestamp(F.lit("2024-03-01 00:00:00")) - F.unix_timestamp(F.col("commit_time").cast("timestamp"))
    age = F.expr("case when s < 0 then 'in the future' when s < 90 then concat(s, ' seconds ago') when s < 5400 then concat((s + 30) div 60, ' minutes ago') when s < 129600 then concat((s + 1800) div 3600, ' hours ago') when s < 1209600 then concat((s + 43200) div 86400, ' days ago') else concat((s + 302400) div 604800, ' weeks ago') end")
    return commits(spark, sf_dir).select("oid", s.alias("s")).select("oid", age.alias("age"))


@query("""SELECT conv_id, turn, '"' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '"' AS quoted FROM conversations""")
def quote_path(spark, sf_dir):
    q = F.col("text")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit('"'), q, F.lit('"')).alias("quoted"))


@query("SELECT oid, 'I' || sha1(encode('tree ' || author || chr(10) || 'author ' || oid || chr(10) || message)) AS change_id FROM commits")
def change_id(spark, sf_dir):
    body = F.concat(F.lit("tree "), "author", F.lit("\nauthor "), "oid", F.lit("\n"), "message")
    return commits(spark, sf_dir).select("oid", F.concat(F.lit("I"), F.sha1(body.cast("binary"))).alias("change_id"))


@query("SELECT split_part(name, '/', 2) AS section, split_part(name, '/', 3) AS key, max(oid) AS value FROM refs GROUP BY 1, 2")
def config_lookup(spark, sf_dir):
    """The last value of each section and key."""
    part = lambda k: F.split_part("name", F.lit("/"), F.lit(k))
    return refs(spark, sf_dir).groupBy(part(2).alias("section"), part(3).alias("key")).agg(F.max("oid").alias("value"))


@query("SELECT doc_id, contains(left(coalesce(text, ''), 8000), chr(0)) AS is_binary FROM documents")
def binary_detect(spark, sf_dir):
    """The definition of a binary object: a zero among the first 8000 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.contains(F.left(F.coalesce("text", F.lit("")), F.lit(8000)), F.lit("\x00")).alias("is_binary"))


@query("SELECT doc_id, md5(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) AS crlf FROM documents")
def eol_convert(spark, sf_dir):
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cast("binary")).alias("crlf"))


@query("SELECT ref, update_index, length(comment) AS n, md5(lower(comment)) AS folded FROM reflog")
def comment_digest(spark, sf_dir):
    return reflog(spark, sf_dir).select("ref", "update_index", F.length("comment").cast("long").alias("n"), F.md5(F.lower("comment").cast("binary")).alias("folded"))

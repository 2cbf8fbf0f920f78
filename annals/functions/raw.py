"""Functions over raw commit texts, ids, paths, numbers and dates: all as columns, none in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annals.plans.history import blobs, commits, lines, refs, urls
from annals.registry import query
from annals.session import table

# ids


def byte_at(oid: Column, k: int) -> Column:
    """The k-th byte of an id in hexadecimal digits."""
    return F.conv(F.substr(oid, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int")


def prefix_compare(oid: Column, prefix: str) -> Column:
    """-1, 0 or 1 as an id sorts before, starts with or sorts behind a prefix."""
    return F.when(F.startswith(oid, F.lit(prefix)), 0).when(oid < prefix, -1).otherwise(1)


@query("SELECT doc_id, CAST('0x' || substr(oid, 1, 2) AS INTEGER) AS first, CAST('0x' || substr(oid, 39, 2) AS INTEGER) AS last, CASE WHEN oid LIKE '7f%' THEN 0 WHEN oid < '7f' THEN -1 ELSE 1 END AS side FROM blobs")
def id_access(spark, sf_dir):
    return blobs(spark, sf_dir).select("doc_id", byte_at(F.col("oid"), 0).alias("first"), byte_at(F.col("oid"), 19).alias("last"), prefix_compare(F.col("oid"), "7f").alias("side"))


def big_endian(raw: Column, at: int, size: int) -> Column:
    """The unsigned number of size bytes (seven at most) at a position of a binary column."""
    return F.conv(F.hex(F.substr(raw, F.lit(at + 1), F.lit(size))), 16, 10).cast("long")


@query("SELECT doc_id, CAST('0x' || substr(oid, 1, 8) AS BIGINT) AS u32, CAST('0x' || substr(oid, 9, 4) AS BIGINT) AS u16, substr(oid, 1, 8) > substr(oid, 9, 8) AS above FROM blobs")
def big_endian_numbers(spark, sf_dir):
    raw = F.unhex("oid")
    a, b = big_endian(raw, 0, 4), big_endian(raw, 4, 4)
    return blobs(spark, sf_dir).select("doc_id", a.alias("u32"), big_endian(raw, 4, 2).alias("u16"), (a > b).alias("above"))


# paths


def path_hash(path: Column) -> Column:
    """The hash by which a pack groups names: later characters weigh most, white space doesn't count; an unsigned 32-bit number."""
    chars = F.filter(F.split(path, ""), lambda c: ~c.rlike(r"^\s?$"))
    return F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: (F.shiftright(h, 2) + F.shiftleft(F.ascii(c).cast("long"), 24)).bitwiseAND(F.lit(0xFFFFFFFF)))


@query("""c AS (SELECT page_id, path, list_transform(string_split(regexp_replace(path, '\\s', '', 'g'), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS l FROM urls)
SELECT page_id, list_reduce(list_prepend(CAST(0 AS BIGINT), l), lambda h, x: ((h >> 2) + (x << 24)) & 4294967295) AS hash FROM c""")
def path_hashes(spark, sf_dir):
    return urls(spark, sf_dir).select("page_id", path_hash(F.col("path")).alias("hash"))


def strip_trailing_separator(path: Column) -> Column:
    return F.regexp_replace(path, "(?<=.)/+$", "")


def is_below(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies in it."""
    folder = folder.rstrip("/")
    return (path == folder) | F.startswith(path, F.lit(folder + "/"))


@query("SELECT page_id, CASE WHEN path LIKE '_%/' THEN rtrim(path, '/') ELSE path END AS bare, (split_part(path, '/', 1) LIKE 'www.%' AND split_part(path, '/', 2) = 'en') AS english FROM urls")
def path_helpers(spark, sf_dir):
    rows = urls(spark, sf_dir)
    host = F.split_part("path", F.lit("/"), F.lit(1))
    inside = F.expr("substr(path, length(split_part(path, '/', 1)) + 2)")
    return rows.select("page_id", strip_trailing_separator(F.col("path")).alias("bare"), (F.startswith(host, F.lit("www.")) & is_below(inside, "en")).alias("english"))


def common_prefix(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, prefix): what all values of a group start with; that of the smallest and the largest, so a partial aggregation."""
    ends = rows.groupBy(*keys).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    same = "size(filter(sequence(1, least(length(a), length(b))), i -> left(a, i) = left(b, i)))"
    return ends.select(*keys, F.expr(f"left(a, if(least(length(a), length(b)) = 0, 0, {same}))").alias("prefix"))


@query("e AS (SELECT split_part(name, '/', 2) AS kind, min(name) AS a, max(name) AS b FROM refs GROUP BY 1) SELECT kind, left(a, (SELECT count(*) FROM range(1, 200) t(i) WHERE i <= least(length(a), length(b)) AND left(a, i::INT) = left(b, i::INT))) AS prefix FROM e")
def common_prefixes(spark, sf_dir):
    return common_prefix(refs(spark, sf_dir).withColumn("kind", F.split_part("name", F.lit("/"), F.lit(2))), "name", "kind")


def normalized_ref(name: Column) -> Column:
    """A branch name made valid: forbidden characters become underscores, dots, slashes and the lock suffix at the ends go."""
    out = F.regexp_replace(name, r"[\x00-\x20~^:?*\[\\\x7f]+|\.\.+|@\{", "_")
    out = F.regexp_replace(out, r"/{2,}", "/")
    out = F.regexp_replace(out, r"(^|/)\.+", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"^/+|[/.]+$", ""), r"\.lock$", "_lock")


@query("SELECT page_id, regexp_replace(replace(replace('a b:' || page_id || '..x//y', ' ', '_'), ':', '_'), '\\.\\.', '_') AS raw, 'a_b_' || page_id || '_x/y' AS name FROM pages")
def normalized_refs(spark, sf_dir):
    text = F.concat(F.lit("a b:"), "page_id", F.lit("..x//y"))
    raw = F.regexp_replace(F.replace(F.replace(text, F.lit(" "), F.lit("_")), F.lit(":"), F.lit("_")), r"\.\.", "_")
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), normalized_ref(text).alias("name"))


# numbers


def parse_number(text: Column) -> Column:
    """A whole number with k, m or g behind it; null if it is none."""
    n = F.try_to_number(F.regexp_extract(text, r"^\s*([+-]?\d+)\s*[kKmMgG]?\s*$", 1), F.lit("S999999999999999999")).cast("long")
    unit = F.lower(F.regexp_extract(text, r"([kKmMgG])\s*$", 1))
    return n * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)


def format_number(n: Column) -> Column:
    """The shortest exact text: 2048 is 2k."""
    out = n.cast("string")
    for unit, size in (("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30)):
        out = F.when((n % size == 0) & (n != 0), F.concat((n / size).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return out


@query("""n AS (SELECT event_id AS oid, event_id * (CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END) AS n FROM events)
SELECT oid, CASE WHEN n = 0 THEN '0' WHEN n % 1073741824 = 0 THEN (n // 1073741824) || 'g' WHEN n % 1048576 = 0 THEN (n // 1048576) || 'm' WHEN n % 1024 = 0 THEN (n // 1024) || 'k' ELSE n || '' END AS shown, n AS back FROM n""")
def numbers_with_units(spark, sf_dir):
    n = F.col("oid") * F.when(F.col("oid") % 3 == 0, 1).when(F.col("oid") % 3 == 1, 1024).otherwise(1048576)
    rows = commits(spark, sf_dir).select("oid", format_number(n).alias("shown"))
    return rows.select("oid", "shown", parse_number(F.col("shown")).alias("back"))


def parse_boolean(text: Column) -> Column:
    """yes, true, 1, on; no, false, 0, off, empty; else null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("yes", "true", "1", "on"), True).when(low.isin("no", "false", "0", "off", ""), False)


@query("t AS (SELECT oid, CASE oid % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN '' WHEN 3 THEN '1' WHEN 4 THEN 'maybe' WHEN 5 THEN ' TRUE ' ELSE 'no' END AS t FROM commits) SELECT oid, CASE oid % 7 WHEN 0 THEN true WHEN 3 THEN true WHEN 5 THEN true WHEN 4 THEN NULL ELSE false END AS value FROM t")
def booleans(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, ("Yes", "off", "", "1", "maybe", " TRUE ", "no"))), (F.col("oid") % 7 + 1).cast("int"))
    return commits(spark, sf_dir).select("oid", parse_boolean(text).alias("value"))


# commit texts


def raw_commits(spark, sf_dir) -> DataFrame:
    """(oid, raw): commit objects as text, with a signature header over two lines, an encoding and trailers."""
    seconds = F.unix_timestamp(F.col("commit_time").cast("timestamp"))
    raw = F.concat(
        F.lit("tree "), F.lit("a" * 40), F.lit("\nparent "), F.lit("b" * 40), F.lit("\nparent "), F.lit("c" * 40), F.lit("\nauthor U"), "author", F.lit(" <u@x> "), seconds, F.lit(" +0130\ncommitter C <c@x> "), seconds + 60,
        F.lit(" -0200\ngpgsig -----BEGIN\n more\nencoding ISO-8859-1\n\nSubject of "), "message", F.lit("\ngoes on\n\nBody: not a trailer, "), "oid", F.lit("\n\nText.\n\nSigned-off-by: U <u@x>\nChange-Id: I"), "oid", F.lit("\nChange-Id: Ilast\n"),
    )
    return commits(spark, sf_dir).select("oid", raw.alias("raw"))


def header(raw: Column, name: str) -> Column:
    """The value of a header, its continued lines joined by line feeds; empty if it isn't there."""
    head = F.split_part(raw, F.lit("\n\n"), F.lit(1))
    return F.replace(F.regexp_extract(head, rf"(?m)^{name} (.*(?:\n .*)*)", 1), F.lit("\n "), F.lit("\n"))


def message_of(raw: str) -> str:
    """SQL for the text behind the headers of a column."""
    return f"substr({raw}, instr({raw}, '\\n\\n') + 2)"


def subject_of(message: str) -> str:
    """SQL for the first paragraph as one line."""
    return f"regexp_replace(rtrim('\\n', split_part(ltrim('\\n', {message}), '\\n\\n', 1)), '\\n', ' ')"


def trailers_of(message: str) -> str:
    """SQL for the array of (key, value) of the last paragraph, if all of its lines are trailers; the first paragraph is none."""
    last = f"element_at(split(rtrim('\\n', {message}), '\\n\\n+'), -1)"
    rows = f"split({last}, '\\n')"
    fine = f"size(split(rtrim('\\n', {message}), '\\n\\n+')) > 1 and forall({rows}, l -> l rlike '^[A-Za-z0-9-]+: ')"
    return f"if({fine}, transform({rows}, l -> struct(split_part(l, ': ', 1) as key, substr(l, instr(l, ': ') + 2) as value)), cast(array() as array<struct<key: string, value: string>>))"


@query("""SELECT oid, 'U' || author || ' <u@x> ' || CAST(floor(epoch(commit_time)) AS BIGINT) || ' +0130' AS author, 'C <c@x> ' || (CAST(floor(epoch(commit_time)) AS BIGINT) + 60) || ' -0200' AS committer, 'ISO-8859-1' AS encoding, '-----BEGIN' || chr(10) || 'more' AS signature, '' AS mergetag,
[repeat('b', 40), repeat('c', 40)] AS parents FROM commits""")
def commit_headers(spark, sf_dir):
    rows = raw_commits(spark, sf_dir)
    raw = F.col("raw")
    parents = F.regexp_extract_all(F.split_part(raw, F.lit("\n\n"), F.lit(1)), F.lit("(?m)^parent ([0-9a-f]{40})$"), F.lit(1))
    return rows.select("oid", header(raw, "author").alias("author"), header(raw, "committer").alias("committer"), header(raw, "encoding").alias("encoding"), header(raw, "gpgsig").alias("signature"), header(raw, "mergetag").alias("mergetag"), parents.alias("parents"))


@query("SELECT oid, 'Subject of ' || message || ' goes on' AS subject, ['Signed-off-by', 'Change-Id', 'Change-Id'] AS keys, 'Ilast' AS change_id FROM commits")
def message_parts(spark, sf_dir):
    """Subject, trailer keys in order, and the last value of one key."""
    rows = raw_commits(spark, sf_dir).select("oid", F.expr(message_of("raw")).alias("m")).select("oid", F.expr(subject_of("m")).alias("subject"), F.expr(trailers_of("m")).alias("t"))
    return rows.select("oid", "subject", F.transform("t", lambda x: x["key"]).alias("keys"), F.expr("element_at(filter(t, x -> x.key = 'Change-Id'), -1).value").alias("change_id"))


# bytes of texts


@query("SELECT doc_id, strpos(t, chr(10)) - 1 AS first_lf, length(t) - strpos(reverse(t), chr(10)) AS last_lf FROM (SELECT doc_id, text AS t FROM documents WHERE contains(text, chr(10)))")
def line_feeds(spark, sf_dir):
    """The places of the first and the last line feed, from 0."""
    rows = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("\n")))
    return rows.select("doc_id", (F.instr("text", "\n") - 1).cast("long").alias("first_lf"), (F.length("text") - F.instr(F.reverse("text"), "\n")).cast("long").alias("last_lf"))


@query("SELECT doc_id, line_no, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS BIGINT) AS start FROM lines")
def line_map(spark, sf_dir):
    """Where each line starts, from within each text alone: no window, no shuffle."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    ends = F.expr("aggregate(l, array(0L), (a, x) -> array_append(a, element_at(a, -1) + length(x) + 1))")
    return docs.select("doc_id", F.posexplode(F.slice(ends, 1, F.size("l"))).alias("at", "start")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "start")


@query("SELECT doc_id, line_no, length(ltrim(line, ' ' || chr(9))) AS lead, length(rtrim(line, ' ' || chr(9) || chr(13))) AS trail FROM lines")
def trimmed_ranges(spark, sf_dir):
    """What remains of lines without white space in front or behind."""
    return lines(spark, sf_dir).select("doc_id", "line_no", F.length(F.ltrim("line", F.lit(" \t"))).cast("long").alias("lead"), F.length(F.rtrim("line", F.lit(" \t\r"))).cast("long").alias("trail"))


def decoded(raw: Column, fallback: str = "ISO-8859-1") -> Column:
    """Bytes as UTF-8 if they are that, else in another encoding."""
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, fallback))


@query("SELECT doc_id, md5(coalesce(text, '')) AS kept, 'caf' || chr(233) AS latin FROM documents")
def charsets(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    latin = F.encode(F.lit("café"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(decoded(text.cast("binary")).cast("binary")).alias("kept"), decoded(latin).alias("latin"))


def is_binary(data: Column) -> Column:
    """A zero byte or a carriage return without line feed among the first 8 KiB."""
    head = F.decode(F.substr(data, F.lit(1), F.lit(8192)), "ISO-8859-1")
    return F.contains(head, F.lit("\0")) | F.rlike(head, F.lit(r"\r(?!\n|\z)"))


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id % 3 = 1 AS found FROM documents WHERE NOT contains(coalesce(text, ''), chr(0)) AND NOT contains(coalesce(text, ''), chr(13))")
def binary_full(spark, sf_dir):
    """Texts with a zero byte put in front, a lone carriage return, or only whole line ends."""
    text = F.coalesce("text", F.lit(""))
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\0"), text)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a\rb"), text)).otherwise(F.concat(F.lit("a\r\nb"), text))
    rows = table(spark, sf_dir, "documents").where(~F.contains(text, F.lit("\0")) & ~F.contains(text, F.lit("\r")))
    return rows.select("doc_id", is_binary(made.cast("binary")).alias("found"))


# dates


#: Patterns of the absolute date formats.
FORMATS = {"default": "EEE MMM dd HH:mm:ss yyyy", "iso": "yyyy-MM-dd HH:mm:ss", "rfc": "EEE, dd MMM yyyy HH:mm:ss", "short": "yyyy-MM-dd"}


@query("""SELECT oid, strftime(commit_time, '%a %b %d %H:%M:%S %Y') || ' +0000' AS "default", strftime(commit_time, '%Y-%m-%d %H:%M:%S') || ' +0000' AS iso, strftime(commit_time, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS rfc, strftime(commit_time, '%Y-%m-%d') AS short,
CAST(floor(epoch(commit_time)) AS BIGINT) || ' +0000' AS raw, strftime(commit_time, '%a %b %d %H:%M:%S %Y') AS local FROM commits""")
def date_formats(spark, sf_dir):
    t = F.col("commit_time").cast("timestamp")
    zone = lambda k: F.concat(F.date_format(t, FORMATS[k]), F.lit(" +0000")).alias(k)
    return commits(spark, sf_dir).select("oid", zone("default"), zone("iso"), zone("rfc"), F.date_format(t, FORMATS["short"]).alias("short"), F.concat(F.unix_timestamp(t), F.lit(" +0000")).alias("raw"), F.date_format(t, FORMATS["default"]).alias("local"))


def age(seconds: Column) -> Column:
    """How long ago, in the largest fitting unit; up to five years with months."""
    day = 86400
    months = F.round(seconds % (365 * day) / (30 * day)).cast("long")
    years = F.floor(seconds / (365 * day))
    years, months = years + (months == 12).cast("long"), F.when(months == 12, 0).otherwise(months)
    unit = lambda n, one: F.concat(n.cast("string"), F.lit(f" {one}"), F.when(n == 1, "").otherwise("s"))
    in_units = lambda size: F.floor((seconds + size // 2) / size)
    text = (
        F.when(seconds < 90, unit(seconds, "second"))
        .when(seconds < 90 * 60, unit(in_units(60), "minute"))
        .when(seconds < 36 * 3600, unit(in_units(3600), "hour"))
        .when(seconds < 14 * day, unit(in_units(day), "day"))
        .when(seconds < 70 * day, unit(in_units(7 * day), "week"))
        .when(seconds < 365 * day, unit(in_units(30 * day), "month"))
        .when((seconds < 5 * 365 * day) & (months > 0), F.concat(unit(years, "year"), F.lit(", "), unit(months, "month")))
        .when(seconds < 5 * 365 * day, unit(years, "year"))
        .otherwise(unit(in_units(365 * day), "year"))
    )
    return F.when(seconds < 0, "in the future").otherwise(F.concat(text, F.lit(" ago")))


_PLURAL = "|| CASE WHEN {0} = 1 THEN ' {1} ago' ELSE ' {1}s ago' END"


@query("""s AS (SELECT event_id AS oid, event_id * event_id * 97 + event_id AS s FROM events), m AS (SELECT *, CAST(floor(CAST(s % 31536000 AS DOUBLE) / 2592000 + 0.5) AS BIGINT) AS m0, s // 31536000 AS y0 FROM s), f AS (SELECT *, CASE WHEN m0 = 12 THEN 0 ELSE m0 END AS m, CASE WHEN m0 = 12 THEN y0 + 1 ELSE y0 END AS y FROM m)
SELECT oid, CASE WHEN s < 90 THEN s """ + _PLURAL.format("s", "second") + """ WHEN s < 5400 THEN (s + 30) // 60 """ + _PLURAL.format("(s + 30) // 60", "minute") + """ WHEN s < 129600 THEN (s + 1800) // 3600 """ + _PLURAL.format("(s + 1800) // 3600", "hour") + """ WHEN s < 1209600 THEN (s + 43200) // 86400 """ + _PLURAL.format("(s + 43200) // 86400", "day")
+ """ WHEN s < 6048000 THEN (s + 302400) // 604800 """ + _PLURAL.format("(s + 302400) // 604800", "week") + """ WHEN s < 31536000 THEN (s + 1296000) // 2592000 """ + _PLURAL.format("(s + 1296000) // 2592000", "month")
+ """ WHEN s < 157680000 AND m > 0 THEN y || CASE WHEN y = 1 THEN ' year, ' ELSE ' years, ' END || m """ + _PLURAL.format("m", "month") + """ WHEN s < 157680000 THEN y """ + _PLURAL.format("y", "year") + """ ELSE (s + 15768000) // 31536000 """ + _PLURAL.format("(s + 15768000) // 31536000", "year") + """ END AS age FROM f""")
def relative_dates(spark, sf_dir):
    """Ages from seconds to centuries."""
    return commits(spark, sf_dir).select("oid", age(F.col("oid") * F.col("oid") * 97 + F.col("oid")).alias("age"))


@query("SELECT event_type, CAST(quantile_cont(value, 0.5) AS DOUBLE) AS middle, CAST(quantile_cont(value, 0.9) AS DOUBLE) AS high FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("middle"), F.percentile("value", 0.9).alias("high"))


#: Results of updates and merges, and how they are shown.
RESULTS = {"NEW": "new", "FORCED": "forced update", "FAST_FORWARD": "fast-forward", "NO_CHANGE": "up to date", "REJECTED": "rejected", "LOCK_FAILURE": "failed to lock", "MERGED": "merge made", "CONFLICTING": "conflicts", "ABORTED": "aborted"}


def shown_result(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RESULTS.items() for x in kv]), kind), F.lower(F.replace(kind, F.lit("_"), F.lit(" "))))


@query("SELECT oid, CASE oid % 3 WHEN 0 THEN 'fast-forward' WHEN 1 THEN 'up to date' ELSE 'not a known one' END AS shown FROM commits")
def update_results(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("FAST_FORWARD", "NO_CHANGE", "NOT_A_KNOWN_ONE"))), (F.col("oid") % 3 + 1).cast("int"))
    return commits(spark, sf_dir).select("oid", shown_result(kind).alias("shown"))

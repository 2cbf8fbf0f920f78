"""Stores written and read back: packs, their indexes, several packs as one, reftables, staging indexes, text formats.

Each query makes files from the derived history in the shared folder and reads them again through the sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from annals.plans.history import blob_oid, commits, reflog, refs, trees, urls
from annals.plans.shared import shared_folder
from annals.registry import query
from annals.session import table
from annals.sources import commit_graph, loose_objects, packs, reftables, staging, texts
from annals.sources.files import each, open_fs, put


def _contents(spark, sf_dir):
    data = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", blob_oid(data, F.octet_length(data)).alias("oid"), F.lit("blob").alias("type"), data.alias("data"), F.coalesce("source", F.lit("")).alias("name"))


def _packed(spark, sf_dir, condition="true"):
    folder = shared_folder(spark, "packs")
    packs.write_packs(_contents(spark, sf_dir).where(condition), folder).collect()  # a row a pack
    return folder


@query("SELECT DISTINCT oid, 'blob' AS type, size FROM blobs")
def pack_read(spark, sf_dir):
    """Every object of written packs by its index, differences resolved, ids verified."""
    folder = _packed(spark, sf_dir)
    found = packs.objects(packs.indexes(spark, folder), folder, data=False)
    return found.where("problem is null").select("oid", "type", "size")


@query("SELECT DISTINCT oid, 'blob' AS type, size FROM blobs")
def pack_parse(spark, sf_dir):
    """Every object of written packs from front to back, without an index."""
    return packs.parse_packs(spark, _packed(spark, sf_dir)).where("problem is null").select("oid", "type", "size")


@query("SELECT 0::BIGINT AS problems, count(DISTINCT oid) AS objects FROM blobs")
def pack_check(spark, sf_dir):
    """Index rows against what the packs have."""
    folder = _packed(spark, sf_dir)
    index, found = packs.indexes(spark, folder), packs.parse_packs(spark, folder)
    return packs.checked(index, found).agg(F.count("*").alias("problems")).join(index.agg(F.count("*").alias("objects")), F.lit(True))


@query("SELECT DISTINCT oid FROM blobs WHERE oid LIKE 'a%'")
def pack_prefix_search(spark, sf_dir):
    """Ids that start with a digit, by fan-out and bisection of each index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(_packed(spark, sf_dir)).select("content")
    return each(files, lambda data: [(o,) for k in range(16) for o in packs.PackIndex(data).starting(f"a{k:x}", 1 << 30)], "oid string", 1).distinct()


@query("SELECT count(DISTINCT oid) AS objects, count(*) - count(DISTINCT oid) >= 0 AS fine FROM blobs")
def multi_pack_store(spark, sf_dir):
    """Overlapping packs as one store, through multi-pack index files."""
    folder = shared_folder(spark, "packs")
    for condition in ("doc_id % 3 <> 0", "doc_id % 5 = 0", "doc_id % 3 = 0"):
        packs.write_packs(_contents(spark, sf_dir).where(condition), folder).collect()  # a row a pack
    packs.write_multi_index(packs.indexes(spark, folder), folder).collect()  # sixteen rows
    store = packs.multi_index(spark, folder)
    whole = packs.objects(store, folder, data=False)
    return whole.agg(F.count_distinct("oid").alias("objects"), (F.count_if(F.col("problem").isNotNull()) == 0).alias("fine"))


@query("SELECT DISTINCT oid, 'blob' AS type, size FROM blobs WHERE doc_id % 4 = 0")
def loose_round_trip(spark, sf_dir):
    """Objects stored one a file, twice, and read back."""
    folder = shared_folder(spark, "loose")
    rows = _contents(spark, sf_dir).where("doc_id % 4 = 0").select("type", "data")

    def store(kind, data):
        oid, content = loose_objects.encode(kind, data)
        fs, root = open_fs(folder)
        path = f"{root}/{oid[:2]}/{oid[2:]}"
        new = not fs.get_file_info(path).is_file
        if new:
            put(fs, path, content)
        return [(oid, new)]

    for _ in range(2):
        each(rows, store, "oid string, stored boolean").count()
    return loose_objects.read(spark, folder).where("problem is null").select("oid", "type", "size")


_HEX = "sha1(encode(CAST(oid AS VARCHAR)))"


def _hexed(column="oid"):
    return F.sha1(F.col(column).cast("string").cast("binary"))


def _stack(spark, sf_dir):
    """Three files: all refs, deletions of every fifth object's, new values for every seventh's."""
    folder = shared_folder(spark, "reftable")
    none = F.lit(None).cast("string")
    rows = refs(spark, sf_dir).select("name", F.lit(1).cast("long").alias("update_index"), _hexed().alias("oid"), none.alias("peeled"), none.alias("target"), F.col("oid").alias("n"))
    reftables.write(rows, folder, "0001", files=3, block=1024).count()
    reftables.write(rows.where("n % 5 = 0").withColumn("update_index", F.lit(2).cast("long")).withColumn("oid", none), folder, "0002").count()
    reftables.write(rows.where("n % 7 = 0").withColumn("update_index", F.lit(3).cast("long")).withColumn("oid", F.sha1(F.lit("new").cast("binary"))), folder, "0003").count()
    return folder


_STACK = f"SELECT name, CAST(CASE WHEN oid % 7 = 0 THEN 3 ELSE 1 END AS BIGINT) AS update_index, CASE WHEN oid % 7 = 0 THEN sha1(encode('new')) ELSE {_HEX} END AS oid FROM refs WHERE oid % 7 = 0 OR oid % 5 <> 0"


@query(_STACK)
def reftable_merged(spark, sf_dir):
    """A stack as one table: the newest file wins, deletions hide."""
    return reftables.merged(reftables.read(spark, _stack(spark, sf_dir))).select("name", "update_index", "oid")


@query(_STACK)
def reftable_compacted(spark, sf_dir):
    """The same after all files became one."""
    from pyarrow.fs import FileSelector

    folder = _stack(spark, sf_dir)
    fs, root = open_fs(folder)
    old = [f.base_name for f in fs.get_file_info(FileSelector(root)) if f.base_name.endswith(".ref")]
    reftables.compacted(spark, folder, old, "0004", keep_deletions=False).count()
    return reftables.read(spark, folder).where("file like '0004%'").select("name", "update_index", "oid")


@query(f"SELECT name, {_HEX} AS oid FROM refs WHERE name LIKE 'refs/heads/u1%' AND oid % 5 <> 0 AND oid % 7 <> 0")
def reftable_prefix(spark, sf_dir):
    """A prefix by search in each file; only names that later files don't touch are asked for."""
    rows = reftables.merged(reftables.read(spark, _stack(spark, sf_dir), "refs/heads/u1"))
    return rows.where("update_index = 1").select("name", "oid")


@query("SELECT ref AS name, CAST(update_index AS BIGINT) AS update_index, who, comment AS message FROM (SELECT DISTINCT ON (ref, update_index) * FROM reflog ORDER BY ref, update_index, who, comment)")
def reftable_logs(spark, sf_dir):
    """Logs in their own files; of entries with one name and index the first by content is stored."""
    rows = reflog(spark, sf_dir).groupBy("ref", "update_index").agg(F.min(F.struct("who", "comment")).alias("x"))
    zero = F.lit("0" * 40)
    rows = rows.select(F.col("ref").alias("name"), F.col("update_index").cast("long").alias("update_index"), zero.alias("old"), zero.alias("new"), F.col("x.who").alias("who"), F.lit("a@b").alias("email"), F.lit(1).cast("long").alias("seconds"), F.lit(0).alias("zone"), F.col("x.comment").alias("message"))
    folder = shared_folder(spark, "logs")
    reftables.write_logs(rows, folder, "0001", 2).count()
    return reftables.read_logs(spark, folder).select("name", "update_index", "who", "message")


@query("SELECT path, mode, oid || '00000000' AS oid FROM base_tree")
def staging_read(spark, sf_dir):
    folder = shared_folder(spark, "staging")
    base = trees(spark, sf_dir)[0].withColumn("oid", F.concat("oid", F.lit("0" * 8)))
    staging.write(base, folder, 4).count()
    return staging.read(spark, folder).select("path", "mode", "oid")


@query("SELECT path, oid || '00000000' AS oid FROM base_tree WHERE path LIKE '12/%'")
def staging_subtree(spark, sf_dir):
    folder = shared_folder(spark, "staging")
    staging.write(trees(spark, sf_dir)[0].withColumn("oid", F.concat("oid", F.lit("0" * 8))), folder, 4).count()
    return staging.subtree(staging.read(spark, folder), "12").select("path", "oid")


@query("SELECT split_part(path, '/', 1) AS folder, count(*) AS entries FROM base_tree GROUP BY 1 UNION ALL SELECT '', count(DISTINCT split_part(path, '/', 1)) FROM base_tree")
def tree_objects(spark, sf_dir):
    """Tree objects made bottom up from entries; each read back for its entries."""
    made = staging.trees_of(trees(spark, sf_dir)[0].withColumn("oid", F.concat("oid", F.lit("0" * 8))))
    read = each(made.select("folder", "data"), lambda folder, data: [(folder, len(staging.read_tree(data)))], "folder string, entries long", 1024)
    return read.groupBy("folder").agg(F.sum("entries").alias("entries"))


@query("""p AS (SELECT split_part(path, '/', 1) AS folder, count(*) AS n FROM base_tree GROUP BY 1)
SELECT folder, CAST(((n + 1) * 10 + 7) // 8 AS BIGINT) AS bytes, true AS has_own FROM p""")
def changed_path_filters(spark, sf_dir):
    """A Bloom filter of each folder's paths as one commit's change: its size, and that it has all its paths."""
    rows = trees(spark, sf_dir)[0].groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.collect_list("path").alias("paths"))

    def work(folder, paths):
        bloom = commit_graph.path_filter([p.encode() for p in paths])
        return [(folder, len(bloom), all(commit_graph.may_have(bloom, p.encode()) for p in [folder, *paths]))]

    return each(rows, work, "folder string, bytes long, has_own boolean")


@query("SELECT n_nationkey AS id, 'https://' || lower(r_name) || '/' || n_nationkey || '#1' AS url, 'refs/remotes/n' || n_nationkey || '/main' AS tracking FROM nation JOIN region ON n_regionkey = r_regionkey")
def config_parse(spark, sf_dir):
    """Configuration texts taken apart: quoted values, continued lines, refspecs."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(
        F.lit('; made\n[core] bare\n[remote "n"]\n\turl = "https://'), F.lower("r_name"), F.lit("/"), "n_nationkey", F.lit('#1" # where\n\tfetch = +refs/heads/*:\\\nrefs/remotes/n'), "n_nationkey", F.lit('/*\n[branch "main"]\nremote=n\nmerge = refs/heads/main\n')
    )

    def work(i, text):
        c = texts.Config(texts.parse_config(text))
        return [(i, c.string("remote", "n", "url"), c.branch("main")["tracking"])] if c.boolean("core", None, "bare") else []

    return each(rows.select(F.col("n_nationkey").cast("long").alias("id"), text.alias("text")), work, "id long, url string, tracking string")


_RULES = "# made\n*.net\nfr/\n!fr/8*\nm.*\n!/m.th*\n"


@query("""SELECT page_id, path, ((path NOT LIKE 'm.th%' AND regexp_matches(split_part(path, '/', 1), '^m\\.|\\.net$'))
OR regexp_matches(path, '/([^/]*\\.net|m\\.[^/]*)(/|$)') OR regexp_matches(path, '(^|/)fr/')) AS ignored FROM urls""")
def ignore_full(spark, sf_dir):
    """Ignore rules in order: by name, folders only, anchored, negated; what is in an ignored folder stays ignored."""
    rules = {"": texts.parse_ignore(_RULES)}
    return each(urls(spark, sf_dir).select("page_id", "path"), lambda i, path: [(i, path, texts.is_ignored(rules, path))], "page_id long, path string, ignored boolean", 1024)


@query("SELECT page_id, path LIKE '%.net/%' OR path LIKE '%.net' AS net, CASE WHEN path LIKE 'www.%' THEN 'crlf' WHEN regexp_matches(path, '/en/[^/]*$') THEN 'lf' END AS eol FROM urls")
def attributes_resolved(spark, sf_dir):
    """Attributes of paths: later lines win, macros are spelled out."""
    files = {"": texts.parse_attributes("[attr]netish net\n**/en/* eol=lf\nwww.*/** eol=crlf\n*.net/** netish\n*.net netish\n")}

    def work(i, path):
        found = texts.attributes_of(files, path)
        return [(i, found.get("net") is True, found.get("eol"))]

    return each(urls(spark, sf_dir).select("page_id", "path"), work, "page_id long, net boolean, eol string", 1024)


@query("SELECT doc_id, sha256(encode(coalesce(text, ''))) AS oid, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def large_file_pointers(spark, sf_dir):
    """Contents cleaned to pointers, and the pointers read."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return each(rows, lambda i, data: [(i, *texts.parse_pointer(texts.format_pointer(data)))], "doc_id long, oid string, size long")


@query("SELECT ref, CAST(update_index AS BIGINT) AS update_index, who AS name, CAST(1700000000 + update_index AS BIGINT) AS seconds, CAST(-90 AS BIGINT) AS zone FROM reflog")
def reflog_lines(spark, sf_dir):
    """Reflog lines as a file has them, taken apart."""
    rows = reflog(spark, sf_dir).select("ref", F.col("update_index").cast("long"), "who")

    def work(ref, n, who):
        (_, _, name, _, seconds, zone, _), = texts.parse_reflog(texts.format_reflog("0" * 40, "1" * 40, who, "a@b", 1700000000 + n, -90, "commit: x\ny"))
        return [(ref, n, name, seconds, zone)]

    return each(rows, work, "ref string, update_index long, name string, seconds long, zone long", 1024)


@query("SELECT oid, lower(lpad(to_hex(octet_length(encode(message)) + 4), 4, '0')) || message AS framed FROM commits")
def framed_lines(spark, sf_dir):
    def work(oid, message):
        data = texts.frame(message.encode())
        return [(oid, data.decode())] if texts.unframe(data) == [message.encode()] else []

    return each(commits(spark, sf_dir).select("oid", "message"), work, "oid long, framed string", 1024)


@query("SELECT name, 'refs/mine/' || substr(name, 12) AS target FROM refs WHERE name LIKE 'refs/heads/%' AND name NOT LIKE 'refs/heads/u1%' UNION ALL SELECT name, name FROM refs WHERE name LIKE 'refs/remotes/%china'")
def refspecs(spark, sf_dir):
    """Refspecs with a wildcard, a suffix wildcard and a negative one."""
    specs = ["+refs/heads/*:refs/mine/*", "^refs/heads/u1*", "refs/remotes/*china"]
    return each(refs(spark, sf_dir).select("name"), lambda name: texts.map_refs(specs, [name]), "name string, target string", 1024)

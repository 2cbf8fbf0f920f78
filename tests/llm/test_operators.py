"""Every operator against a plain restatement of its contract, on the small tables and on odd rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annals.llm import html_main_text, maxent_lm, mixing, near_dedup, quality_rules, queries, sentencepiece_codec, token_tables, topk, toxicity, warc
from annals.llm.common import saved
from annals.session import table

from . import brute, pages


def pairs(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


# 1: SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


def digests(library, text):
    ids = [*library.encode(text or ""), library.eos_id()]
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_are_the_librarys(spark, small, library):
    texts = dict(pairs(table(spark, small, "documents"), "doc_id", "text"))
    got = {r[0]: r[1:] for r in pairs(queries.op1_sentencepiece(spark, small), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
    assert got == {i: digests(library, t) for i, t in texts.items()}


def test_pieces_of_odd_rows(odd_docs, no_docs, library):
    model = queries.tokenizer("piece_bpe_32k.model")
    got = {r[0]: r[1:] for r in pairs(queries.digest(sentencepiece_codec.roundtrip(odd_docs, model)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
    assert got == {i: digests(library, t) for i, t in pairs(odd_docs, "doc_id", "text")}
    assert sentencepiece_codec.encode(no_docs, model).count() == 0
    assert "size" in sentencepiece_codec.encode(odd_docs, model).columns


def test_spans_cover_the_original_bytes(odd_docs, library):
    model = queries.tokenizer("piece_bpe_32k.model")
    rows = sentencepiece_codec.encode(odd_docs.where("doc_id not in (10, 11, 15)"), model).collect()
    texts = dict(pairs(odd_docs, "doc_id", "text"))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert len(r.ids) == len(r.begins) == len(r.ends)
        assert all(a <= b for a, b in zip(r.begins, r.ends)) and list(r.begins) == sorted(r.begins)
        assert b"".join(data[a:b] for a, b in zip(r.begins, r.ends)) == data
        for i, a, b in zip(r.ids[:-1], r.begins, r.ends):
            if not library.is_byte(i):
                assert data[a:b].decode().replace(" ", "▁").lstrip("▁") == library.id_to_piece(i).lstrip("▁")


def test_spans_are_the_librarys(spark, small, library):
    """All texts of the table; of byte pieces the library gives the whole character to the last."""
    c = sentencepiece_codec.codec(queries.tokenizer("piece_bpe_32k.model"))
    texts = [t for t, in pairs(table(spark, small, "documents").limit(200), "text")] + ["é b▁c", "a\nb  c ", " x", "▁▁ y", "\n\n \n"]
    for text, (ids, begins, ends) in zip(texts, c.encode([t or "" for t in texts])):
        pieces = library.encode(text or "", return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in pieces if not library.is_byte(p.id)] == [x for x in zip(ids.tolist(), begins.tolist(), ends.tolist()) if not library.is_byte(x[0])]


def test_every_text_is_normalised(monkeypatch):
    """The spans come from the normaliser's record: with a record that is off by one they are, too."""
    c = sentencepiece_codec.Codec(queries.tokenizer("piece_bpe_32k.model"))
    plain = c.encode(["one two", "naïve"])
    normalize = c.normalizer.normalize
    monkeypatch.setattr(c.normalizer, "normalize", lambda t: (normalize(t)[0], normalize(t)[1] + 1))
    for (i, b, e), (j, x, y) in zip(plain, c.encode(["one two", "naïve"])):
        assert np.array_equal(i, j) and np.array_equal(b + 1, x) and np.array_equal(e + 1, y)


@pytest.mark.parametrize("squeeze", [0, 1])
def test_a_model_with_a_character_map(tmp_path, squeeze):
    """The tables' model with another normaliser, as a later field of the message replaces an earlier one."""
    import sentencepiece

    trie = _trie({b"a": b"o", b"ab": b"the", "é".encode(): b"e", b"\t": b" ", b"Q": b""})
    spec = b"\x0a\x01m\x12" + _size(len(trie)) + trie + bytes([0x18, 1, 0x20, squeeze, 0x28, 1])
    file = tmp_path / "mapped.model"
    file.write_bytes(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read() + b"\x1a" + _size(len(spec)) + spec)
    made, ours = sentencepiece.SentencePieceProcessor(model_file=str(file)), sentencepiece_codec.Codec(str(file))
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abéQx \t\n漢"), rng.integers(0, 20))) for _ in range(2000)]
    for text, (ids, begins, ends) in zip(texts, ours.encode(texts)):
        assert ids.tolist() == made.encode(text), text
        assert all(0 <= a <= b <= len(text.encode()) for a, b in zip(begins, ends)) and list(begins) == sorted(begins)


def _size(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_longest_prefix_of_a_character_map():
    """A hand-made trie: 'ab' -> 'X', 'a' -> 'Y' (leaves have bit 8 of a unit and the value at offset 0)."""
    made = sentencepiece_codec.CharacterMap(_trie({b"a": b"Y", b"ab": b"X", b"\xc3\xa9": b"e"}))
    assert made.longest(b"abc", 0) == (2, b"X")
    assert made.longest(b"acc", 0) == (1, b"Y")
    assert made.longest("é".encode(), 0) == (2, b"e")
    assert made.longest(b"zzz", 0) == (0, None)
    normal = sentencepiece_codec.Normalizer(b"")
    normal.map = made
    out, back = normal.normalize("  ab é  a ")
    assert out == "▁X▁e▁Y" and back[3] == 2 and back[-1] == len("  ab é  a".encode())


def _trie(words: dict[bytes, bytes]) -> bytes:
    """The compiled form of a small character map: every node's children at an offset of their own."""
    texts, place = b"", {}
    for to in words.values():
        place[to] = len(texts)
        texts += to + b"\0"
    units = np.zeros(1 << 14, np.uint32)
    free = [256]

    def grow(node: int, prefix: bytes):
        kids = sorted({w[len(prefix)] for w in words if w.startswith(prefix) and len(w) > len(prefix)})
        base = free[0]
        free[0] += 256
        units[node] |= ((node ^ base) << 10) & 0xFFFFFFFF
        if prefix in words:
            units[node] |= 1 << 8
            units[base] = 0x80000000 | place[words[prefix]]
        for k in kids:
            units[base ^ k] |= k
            grow(base ^ k, prefix + bytes([k]))

    grow(0, b"")
    units = units[: free[0] + 256]
    return len(units.tobytes()).to_bytes(4, "little") + units.tobytes() + texts


# 2: near duplicates


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    from annals.llm import common

    rng = np.random.default_rng(6)
    texts = pa.array(["".join(rng.choice(list("abC \n\té"), rng.integers(0, 60))) for _ in range(300)] + ["x" * 500, None, ""])
    whole = common.hashed_words(texts)
    monkeypatch.setattr(common, "PIECE", 37)
    for a, b in zip(whole, common.hashed_words(texts)):
        assert np.array_equal(a, b)
    words = [w for t in texts.to_pylist() for w in brute.words((t or "").translate(brute.LOWER))]
    assert len(set(words)) == len(np.unique(whole[0])) and len(words) == len(whole[0])


def test_words_that_share_power_sums_have_different_hashes():
    """A Thue-Morse word and its complement collide in every polynomial hash modulo 2**64."""
    from annals.llm import common

    for n in (1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        hashes, _ = common.hashed_words(pa.array(["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]))
        assert len(hashes) == 2 and hashes[0] != hashes[1]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_are_all_found(spark, small, words, percent):
    docs = table(spark, small, "documents")
    truth = brute.near_duplicates(pairs(docs, "doc_id", "text"), words, percent)
    got = {r[0]: r[1:] for r in pairs(near_dedup.link(docs, words, percent), "doc_id", "n_shingles", "component_id", "kept")}
    assert got == {i: (n, c, c == i) for i, (n, c) in truth.items()}


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    truth = brute.near_duplicates(pairs(odd_docs, "doc_id", "text"), 3, 85)
    got = {r[0]: r[1:] for r in pairs(near_dedup.link(odd_docs, 3, 85), "doc_id", "n_shingles", "component_id")}
    assert got == truth
    assert near_dedup.link(no_docs, 3, 85).count() == 0
    again = near_dedup.link(odd_docs.unionByName(odd_docs), 3, 85)
    assert {r[0]: r[1:] for r in pairs(again, "doc_id", "n_shingles", "component_id")} == truth
    nameless = odd_docs.unionByName(odd_docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    kept = near_dedup.deduplicated(nameless, 3, 85)
    assert kept.columns == odd_docs.columns
    assert {r[0] for r in pairs(kept, "doc_id")} == {i for i, (_, c) in truth.items() if c == i}


def test_rows_without_or_with_repeated_ids_are_documents_of_their_own(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, one, 1), (None, one, 1), (None, two, 1), (5, two, 1), (7, three, 1), (7, three, 2), (7, one, 1), (None, "", 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    linked = sorted(pairs(near_dedup.link(docs, 3, 85), "doc_id", "n_shingles", "component_id", "kept"), key=repr)
    assert linked == sorted([(None, 38, 7, False)] * 2 + [(None, 38, 5, False), (5, 38, 5, True)] + [(7, 38, 7, True)] * 3 + [(None, 0, None, True)] * 2, key=repr)
    kept = sorted(pairs(near_dedup.deduplicated(docs, 3, 85), "doc_id", "text"), key=repr)
    assert kept == sorted([(5, two), (7, three), (7, one), (None, ""), (None, None)], key=repr)


def test_pairs_of_one_bucket_that_the_estimate_rules_out_are_not_confirmed(spark, small):
    """_likely drops what signatures tell apart, by the same count as the numpy form; without it every pair would be confirmed."""
    sigs = near_dedup.signatures(table(spark, small, "documents"), 3).where("set_key is not null").limit(60)
    rows = sigs.select("doc_id", "n_shingles", "sig").collect()
    chief = spark.createDataFrame([(k, 100, list(r.sig)) for k, r in enumerate(rows)], "doc_id long, n_shingles long, sig array<long>")
    bits = np.array([r.sig for r in rows], np.int64).view(np.uint8)
    equal = near_dedup.equal_positions(bits[:1], bits[1:])[0]
    want = {k + 1 for k in range(len(equal)) if near_dedup.estimate(equal[k]) >= near_dedup.estimate(near_dedup.least_equal(0.85))}
    given = spark.createDataFrame([(0, k) for k in range(1, len(rows))], "a long, b long")
    assert {r.b for r in near_dedup._likely(given, chief, 85, 60).collect()} == want and len(want) < len(rows) - 1


def test_large_bucket_with_different_texts(spark):
    """Many texts that share most words with a hub and not with each other: links are lost if only hubs are compared."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(40):
        own = [f"u{k}_{i}" for i in range(40)]
        for copy in range(3):
            rows.append((k * 3 + copy, " ".join(base + own + [f"c{copy}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = brute.near_duplicates(rows, 3, 85)
    assert {r[0]: r[1:] for r in pairs(near_dedup.link(docs, 3, 85), "doc_id", "n_shingles", "component_id")} == truth


def test_few_links_are_joined_in_a_few_jobs(spark, monkeypatch):
    """However few the links, every round of joins costs the driver memory; both ways give the same components."""
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(i, i + 1) for i in range(1000, 1300)] + [(2000 + i, 3000) for i in range(300)] + [(-5, 7), (7, -5), (4000, 4000)]
    top: dict = {}
    for a, b in links:
        if a != b:
            both = top.setdefault(a, {a}) | top.setdefault(b, {b})
            top.update(dict.fromkeys(both, both))
    truth = sorted((x, min(group)) for x, group in top.items())
    df = spark.createDataFrame(links, "a long, b long")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        got = sorted(map(tuple, near_dedup.components(df).collect()))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == truth and jobs <= 8
    assert near_dedup.components(df.limit(0)).count() == 0
    monkeypatch.setattr("annals.llm.components.FEW", 10)
    assert sorted(map(tuple, near_dedup.components(df).collect())) == truth


def test_packed_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)
    a, b = np.concatenate([common, own[:100]]), np.concatenate([common, own[100:]])
    sig = [np.frombuffer(near_dedup.pack(near_dedup.minima(x)), np.uint8)[None] for x in (a, b)]
    assert len(sig[0][0]) == near_dedup.HASHES * near_dedup.BITS // 8
    equal = near_dedup.equal_positions(*sig)[0, 0]
    assert abs(near_dedup.estimate(equal) - 900 / 1100) < 0.2
    assert near_dedup.equal_positions(sig[0], sig[0])[0, 0] == near_dedup.HASHES


# 3: quality rules


def base_of(df):
    return {r[0]: r[1:] for r in pairs(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}


def test_quality_counts(spark, small, odd_docs, no_docs):
    docs = table(spark, small, "documents")
    got = quality_rules.judge(docs)
    assert base_of(got) == {i: brute.quality_base(t) for i, t in pairs(docs, "doc_id", "text")}
    assert not got.where("kept and base_failed").count()
    odd = quality_rules.judge(odd_docs)
    assert base_of(odd) == {i: brute.quality_base(t) for i, t in pairs(odd_docs, "doc_id", "text")}
    assert quality_rules.judge(no_docs).count() == 0
    assert quality_rules.accepted(odd_docs).columns == odd_docs.columns


def test_each_row_is_accepted_by_its_own_verdict(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(None, good, "a"), (None, "x x x", "a"), (7, good, "a"), (7, "bad", "a"), (7, good, None)]
    docs = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    assert sorted(pairs(quality_rules.accepted(docs), "doc_id", "text", "source"), key=repr) == sorted([(None, good, "a"), (7, good, "a"), (7, good, None)], key=repr)


def test_robust_outliers_beside_many_clean_texts(spark):
    """A tenth of symbol-ridden texts doesn't pull the estimate: they go, the others stay."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for i in range(600):
        w = [str(x) for x in rng.choice(vocabulary, 120)]
        if i % 10 == 0:
            w = [x + "$%|" for x in w]
        rows.append((i, " ".join(w), "en", "web"))
    got = dict(pairs(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "doc_id", "kept"))
    assert not any(got[i] for i in got if i % 10 == 0)
    assert sum(got[i] for i in got if i % 10) >= 0.99 * 540


def test_repeats_alone_reject(spark):
    """Beside clean texts, 60% duplicated lines or 46% repeated windows are enough; the base rules let both pass."""
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    some = lambda n: [str(x) for x in rng.choice(vocabulary, n)]
    rows = [(i, "\n".join(" ".join(some(12)) for _ in range(10))) for i in range(300)]
    rows += [(1000 + i, "\n".join(" ".join(some(12)) + "\nalpha\nbeta" for _ in range(10))) for i in range(5)]
    for i in range(5):
        twice = some(30)
        rows.append((2000 + i, " ".join(twice + some(35) + twice + some(35))))
    got = {r[0]: r[1:] for r in pairs(quality_rules.judge(spark.createDataFrame([(*r, "en", "web") for r in rows], "doc_id long, text string, lang string, source string")), "doc_id", "kept", "base_failed")}
    assert not any(failed for _, failed in got.values())
    assert [i for i, (kept, _) in got.items() if kept and i >= 1000] == []
    assert sum(got[i][0] for i in range(300)) >= 0.99 * 300


def test_verdicts_are_those_of_a_plain_estimate(spark, small):
    """Distances beside exact C-steps in numpy; verdicts agree wherever the plain distance isn't within a fifth of the cut."""
    got = quality_rules._judged(table(spark, small, "documents")).where("not base_failed").collect()
    plain = brute.robust_distances([(r.doc_id, r.n_words, r._cell, r._lang, [r.x1, r.x2, r.x3, r.x4, r.x5]) for r in got])
    assert len(plain) == len(got)
    clear = [r for r in got if abs(plain[r.doc_id] / quality_rules.CUTOFF - 1) > 0.2]
    assert len(clear) >= 0.97 * len(got)
    assert [r.doc_id for r in clear if r.kept != (plain[r.doc_id] <= quality_rules.CUTOFF)] == []
    assert np.median([abs(r.distance - plain[r.doc_id]) / (1 + plain[r.doc_id]) for r in got]) < 0.15


def test_quality_keeps_clean_labelled_documents(spark, small):
    marked = quality_rules.judge(table(spark, small, "documents")).join(table(spark, small, "labels"), "doc_id").where("not base_failed")
    good = marked.where("quality = 1 and toxic = 0")
    assert good.where("kept").count() >= 0.97 * good.count()


# 4: WARC


def test_archived_pages(spark, small):
    truth = brute.archive(pairs(table(spark, small, "pages"), "page_id", "html"))
    got = {r[0]: r[1:] for r in pairs(queries.op4_warc(spark, small), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
    assert got == truth


def odd_pages(spark):
    big = "<p>" + "x" * 300_000
    rows = [(1, "http://a.example/x", big), (2, "http://A.example:80/x#f", big), (3, None, None), (4, "", ""), (5, "http://b.example/ü \n?q", "s" * 99), (6, "x", "s" * 99), (7, "y", "s" * 100), (9, "y", "s" * 100), (8, "y", "s" * 100), (10, "http://a.example/x", "new")]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string")


def test_archived_odd_pages_and_lookup(spark):
    pages = odd_pages(spark)
    captures, index, folder = warc.archived(pages)
    found = warc.read(saved(warc.located(folder, pages), "located"), folder, payload=True)
    assert {r.page_id: bytes(r.payload) for r in found.where("record_type = 'response'").collect()} == {i: (h or "").encode() for i, h in pairs(pages, "page_id", "html") if truth_type(pages, i) == "response"}
    truth = brute.archive(pairs(pages, "page_id", "html"))
    assert {r.page_id: r.record_type for r in found.collect()} == {i: x[2] for i, x in truth.items()}
    asked = spark.createDataFrame([("http://a.example/x",), ("http://nowhere.example/",), (None,)], "url string")
    hits = warc.lookup(folder, asked)
    assert {r.page_id for r in hits.collect()} == {1, 2, 3, 4, 10}
    assert warc.archived(pages.limit(0))[0].count() == 0


def truth_type(pages, i):
    return brute.archive(pairs(pages, "page_id", "html"))[i][2]


def test_captures_are_found_by_bisection(spark, monkeypatch):
    """A key that fills several blocks, pages with equal keys and ids: few blocks are read, none twice for neighbours; a damaged directory is noticed."""
    monkeypatch.setattr(warc, "LINES", 8)
    rows = [(i, f"http://h{i % 7}.example/{i % 13}", "x") for i in range(300)] + [(1000 + i, "http://same.example/", "x") for i in range(40)] + [(5, "http://h5.example/5", "x")] * 20
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = warc.write(pages, folder := warc.shared_folder(spark, "warc"))
    warc.build_index(captures, folder)
    index = warc.CaptureIndex(folder)
    lines = sorted(pairs(captures, "key", "page_id", "file", "at", "size"))
    for key in {x[0] for x in lines}:
        assert sorted(index.find(key)) == [x[1:] for x in lines if x[0] == key]
    index.reads = 0
    assert len(list(index.find("example,h5)/5", 5))) == 21 and index.reads <= 5
    index.reads = 0
    assert len(list(index.find("example,same)/", 1007))) == 1 and index.reads <= 2
    assert not list(index.find("zz")) and not list(index.find("")) and not list(index.find("example,same)/", 7))
    assert sorted(pairs(warc.located(folder, pages), "key", "page_id", "file", "at", "size")) == lines


def test_reversed_host_keys():
    assert warc.reversed_host_key("http://www.Example.com:80/A?b#c") == "com,example,www)/A?b"


# 5: token tables


def test_token_tables(spark, small):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    start, truth = 0, {}
    for i, t in sorted(pairs(table(spark, small, "documents"), "doc_id", "text")):
        ids = np.array([*made.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        truth[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r[0]: r[1:] for r in pairs(queries.op5_token_tables(spark, small), "doc_id", "start", "n_tokens", "ids_crc32")} == truth


def test_ids_of_random_texts_are_the_librarys():
    from tokenizers import Tokenizer

    file = queries.tokenizer("byte_bpe_50k.json")
    made, ours = Tokenizer.from_file(file), token_tables.encoder(file)
    rng = np.random.default_rng(7)
    parts = list("ab'sZ9 \n\t\u00a0\u2028\u0085é漢\U0001f600.,-_") + [" ", "  ", "'re", "don't", "\r\n", "\u3000", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    assert [np.frombuffer(x, ours.dtype).tolist() for x in ours.encode(texts)] == [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_random_texts_are_the_librarys(library):
    rng = np.random.default_rng(8)
    parts = list("ab'sZ9 \n\t\u00a0\u2028é漢\U0001f600▁.,-_") + [" ", "  ", "the", "▁▁", "\u3000", "<s>", "\u0301"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    found = sentencepiece_codec.codec(queries.tokenizer("piece_bpe_32k.model")).encode(texts)
    assert [f[0].tolist() for f in found] == library.encode(texts)


def test_token_tables_of_odd_rows_and_lookup(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    file = queries.tokenizer("byte_bpe_50k.json")
    made = Tokenizer.from_file(file)
    manifest, folder = token_tables.written(odd_docs, file, 2)
    got = {r.doc_id: r for r in token_tables.read(manifest, folder).collect()}
    for i, t in pairs(odd_docs, "doc_id", "text"):
        ids = np.array([*made.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), i
    asked = spark.createDataFrame([(9,), (12,), (99,)], "doc_id long")
    hits = {r.doc_id: list(r.ids) for r in token_tables.lookup(spark, manifest, folder, asked).collect() if r.ids is not None}
    assert set(hits) == {9, 12} and hits[9] == [*made.encode("two words").ids, 2]
    assert token_tables.read(*token_tables.written(no_docs, file, 2)).count() == 0


# 6: top k


def test_top_k(spark, small):
    rows = pairs(table(spark, small, "embeddings"), "vec_id", "embedding")
    assert sorted(pairs(queries.op6_topk(spark, small), "query_id", "rank", "vec_id", "score")) == brute.top_k(rows, lambda i: i % 50 == 0, 5)


def test_top_k_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(220)]
    rows += [(i, rows[0][1]) for i in range(220, 320)]  # ties
    rows += [(1000, None), (1001, []), (1050, [float("nan")] * 6), (1051, [float("inf")] * 6), (1052, [None] + [1.0] * 5), (1100, [1.0, 2.0]), (1101, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, score string")
    got = topk.join(df, F.col("vec_id") % 50 == 0, 5, 256)
    assert sorted(pairs(got, "query_id", "rank", "vec_id", "score")) == brute.top_k([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 50 == 0, 5)
    assert topk.join(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_components_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(150)]
    rows += [(200, [1e8, -1e8, 3.5, 0.25]), (201, [1e8, 1e8, 1.0, 1.0]), (202, [1e30, 1.0, 0.0, 0.0]), (250, [-1e30, 2.0, 1.0, 1.0]), (203, [1e8, 1e8, 1.0, 1.25])]
    repeated = [(50, rows[50][1]), (7, rows[7][1]), (7, [99.0, 99.0, 99.0, 99.0])]
    assert rows[7][1] < repeated[2][1]
    df = spark.createDataFrame(rows + repeated, "vec_id long, embedding array<double>")
    want = [(q, r, i, min(2**63 - 1, max(-(2**63), s))) for q, r, i, s in brute.top_k(rows, lambda i: i % 50 == 0, 5)]
    assert sorted(pairs(topk.join(df, F.col("vec_id") % 50 == 0, 5, 256), "query_id", "rank", "vec_id", "score")) == want
    worst = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1e308, 2.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert sorted(pairs(topk.join(worst, F.col("vec_id") == 0, 5, 256), "rank", "vec_id")) == [(1, 1), (2, 2)]


def test_keys_sort_as_scores():
    scores = [-(2**200), -(2**64) - 1, -(2**64), -(2**63), -5, 0, 3, 2**63 - 1, 2**63, 2**64 + 1, 2**200]
    assert [topk.sort_key(s) for s in scores] == sorted(topk.sort_key(s) for s in scores)


# 7: language model


def test_base_scores(spark, small, odd_docs, no_docs):
    for docs in (table(spark, small, "documents"), odd_docs):
        truth = brute.unigram(pairs(docs, "doc_id", "text"))
        got = {r[0]: r[1:] for r in pairs(maxent_lm.scored(docs), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")}
        assert got.keys() == truth.keys()
        for i in truth:
            assert got[i][:4] == truth[i][:4]
            assert abs(got[i][4] - truth[i][4]) < 1e-6 * max(1, abs(truth[i][4]))
    assert maxent_lm.scored(no_docs).count() == 0


def test_model_is_better_than_its_base_on_held_out_text(spark, small):
    row = maxent_lm.scored(table(spark, small, "documents")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert row.s > row.b and row.s < 0


def _random_model(monkeypatch):
    monkeypatch.setattr(maxent_lm, "LEVELS", 2)
    monkeypatch.setattr(maxent_lm, "CELLS", maxent_lm.FAN**2)
    rng = np.random.default_rng(2)
    return rng, rng.normal(size=(1 << 12, maxent_lm.FAN)).astype(np.float32), rng.normal(size=(1 + maxent_lm.FAN, maxent_lm.FAN)).astype(np.float32)


def test_class_factored_probabilities_sum_to_one(monkeypatch):
    rng, weights, bias = _random_model(monkeypatch)
    context = rng.integers(0, 2**63, 3, dtype=np.uint64)
    cells = np.arange(maxent_lm.CELLS, dtype=np.uint64) << np.uint64(7)
    total = sum(np.exp(maxent_lm.log_probabilities(weights, bias, np.append(context, c), np.array([0, 4]))[-1]) for c in cells)
    assert abs(total - 1) < 1e-4


def test_context_tells_words_of_one_class_apart(monkeypatch):
    """Two words with the same first digit: another previous word changes the ratio of their probabilities."""
    rng, weights, bias = _random_model(monkeypatch)
    words = [np.uint64((3 * 16 + d) << 7) for d in (1, 9)]
    ratio = []
    for before in rng.integers(0, 2**63, 2, dtype=np.uint64):
        a, b = (maxent_lm.log_probabilities(weights, bias, np.array([before, w]), np.array([0, 2]))[-1] for w in words)
        ratio.append(a - b)
    assert abs(ratio[0] - ratio[1]) > 1e-3


def test_sums_and_scores_are_those_of_a_plain_loop(monkeypatch):
    rng, weights, bias = _random_model(monkeypatch)
    tokens, offsets = rng.integers(0, 2**63, 12, dtype=np.uint64) % np.uint64(1 << 20), np.array([0, 5, 5, 12])
    observed, expected = np.zeros(weights.shape, np.int64), np.zeros(weights.shape)
    maxent_lm.gradient(weights, bias, tokens, offsets, observed, expected)
    want_o, want_e, scores = np.zeros_like(observed), np.zeros_like(expected), []
    for i, token in enumerate(tokens):
        cell = int(maxent_lm.cell_of(np.array([token]))[0])
        found = maxent_lm.contexts(tokens, offsets, i, i + 1)
        total = 0.0
        for level, (before, digit) in enumerate([(0, cell // 16), (1 + cell // 16, cell % 16)]):
            rows = [int(maxent_lm.buckets(found[k], np.array([before]), 12)[0]) for k in maxent_lm.USED[level > 0]]
            z = bias[before].astype(float) + sum(weights[r].astype(float) for r in rows)
            p = np.exp(z) / np.exp(z).sum()
            total += np.log(p[digit])
            for r in rows:
                want_o[r, digit] += 1
                want_e[r] += p
        scores.append(total)
    assert np.array_equal(observed, want_o) and np.allclose(expected, want_e, atol=1e-5)
    assert np.allclose(maxent_lm.log_probabilities(weights, bias, tokens, offsets), scores, atol=1e-4)


# 8: toxicity


def test_toxicity_on_held_out_labels(spark, small):
    """Fitted on half of the labels, judged on the other half, of whose toxic rows about a fifth have no telling word."""
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    chain = toxicity.fit(docs, labels.where(half), toxicity.CATEGORIES)
    got = toxicity.score(docs, chain).select("doc_id", F.col("toxic").alias("guess")).join(labels.where(~half), "doc_id").select("guess", "toxic").collect()
    bad = [r for r in got if r.toxic == 1]
    fine = [r for r in got if r.toxic == 0]
    assert sum(r.guess for r in bad) >= 0.65 * len(bad)
    assert sum(r.guess for r in fine) <= 0.01 * len(fine)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES)
    again = toxicity.fit(docs.repartition(5), labels.repartition(3), toxicity.CATEGORIES)
    assert chain.threshold == again.threshold and chain.words == again.words
    got = toxicity.score(odd_docs, chain)
    assert got.count() == odd_docs.count() and not got.where("toxic is null or kept = toxic").count()
    assert toxicity.score(no_docs, chain).count() == 0
    assert toxicity.accepted(odd_docs, chain).columns == odd_docs.columns
    none = toxicity.fit(docs, labels.limit(0), toxicity.CATEGORIES)
    assert toxicity.score(docs, none).where("toxic").count() == 0


def test_chain_is_that_of_a_plain_loop(spark):
    """Scores of a trained chain against a loop over words and categories."""
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(30)]
    ids = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    labels = np.stack([[float(3 in x) for x in ids], [float(3 in x and 5 in x) for x in ids]], axis=1)
    chain = toxicity.train(["a", "b"], words, ids, labels, np.arange(200) % 5)
    for z, x in zip(chain.log_odds(ids), ids):
        first = chain.weights[0][0] + sum(chain.weights[0][1][i] for i in x)
        second = chain.weights[1][0] + sum(chain.weights[1][1][i] for i in x) + chain.weights[1][2][0] * first
        assert np.allclose(z, [first, second])
    assert chain.weights[1][2][0] != 0  # the earlier category feeds the later model


def test_labelled_rows_are_those_of_smallest_hash(spark):
    marked = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("toxic"))
    want = {r.doc_id for r in marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(700).collect()}
    assert {r.doc_id for r in toxicity._smallest(marked, 700).collect()} == want


# 9: main text


ARTICLE = """<html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p {}</style></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div id="wrapper"><article class="post"><h1>A &amp; B</h1><p>First   paragraph, with
 a <b>bold</b> word and caf&eacute;.</p><div class="ad">Buy now</div><p>Second paragraph, &lt;em&gt; is text.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside></div>
<div class="comments"><div class="comment"><p>Nice article, thanks.</p></div></div><footer>Copyright</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_main_text.main_texts([ARTICLE], html_main_text.model()) == ["A & B\nFirst paragraph, with a bold word and café.\nSecond paragraph, <em> is text."]


def test_main_text_of_unseen_practice_pages():
    """Held-out accuracy over blocks of pages that weren't trained on."""
    trees = html_main_text.model()
    right = total = 0
    for seed in range(10_000, 10_080):
        source = html_main_text.practice_page(seed)
        page = html_main_text.Page(source)
        truth = [1.0] + [float("data-main" in m[3]) for m in html_main_text._TAG.finditer(source) if m[2] and not m[1] and m[2].lower() in html_main_text.BLOCKS and m[2].lower() != "html"]
        kept = page.decode(trees.log_odds(page.features()))
        right += sum(bool(a) == bool(b) for a, b in zip(kept, truth))
        total += len(truth)
    assert right >= 0.99 * total


@pytest.mark.parametrize("name", list(pages.ALL))
def test_main_text_of_pages_written_by_hand(name):
    source, text = pages.ALL[name]
    assert html_main_text.main_texts([source], html_main_text.model()) == [text]


def test_decoding_is_the_best_of_all_consistent_choices():
    """Against every set of nodes with all parents in it, on random trees of up to nine nodes."""
    import itertools

    rng = np.random.default_rng(12)
    for _ in range(60):
        n = int(rng.integers(2, 10))
        page = html_main_text.Page("")
        page.tag, page.parent = ["div"] * n, [-1, *(int(rng.integers(0, k)) for k in range(1, n))]
        z = rng.normal(size=n) * 2
        value = lambda kept: sum(-np.logaddexp(0, -x) if k else -np.logaddexp(0, x) for x, k in zip(z, kept))
        sets = [(True, *c) for c in itertools.product((False, True), repeat=n - 1)]
        best = max((s for s in sets if all(s[page.parent[k]] or not s[k] for k in range(1, n))), key=value)
        assert tuple(page.decode(z)) == best


def test_decoding_keeps_no_child_of_a_dropped_node():
    page = html_main_text.Page(ARTICLE)
    rng = np.random.default_rng(4)
    kept = page.decode(rng.normal(size=len(page.tag)))
    assert all(kept[p] for k, p in enumerate(page.parent) if p >= 0 and kept[k])


def test_main_text_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text"), (4, "u", "<p>a<p>b"), (5, "u", "<div>" * 50_000 + "deep"), (6, "u", "<!-- never closed"), (6, "u", "<script>never closed")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(pairs(html_main_text.extract(df), "page_id", "text", "n_chars"))
    assert len(got) == 7 and got[0] == (1, "", 0) and got[2][1] == "just text"
    assert all(n == len(t) for _, t, n in got)
    assert html_main_text.extract(df.limit(0)).count() == 0


# 10: mixing


def check_mix(docs, got):
    rows = got.collect()
    sizes: dict = {}
    for i, t, s in pairs(docs, "doc_id", "text", "source"):
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    goal = brute.mix_targets(sizes)
    source = {i: s for i, s in pairs(docs, "doc_id", "source")}
    taken: dict = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(goal[s])) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1, (s, taken[s], goal[s])


def test_mix(spark, small, odd_docs, no_docs):
    docs = table(spark, small, "documents")
    one = mixing.plan(docs)
    check_mix(docs, one)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, mixing.plan(docs.repartition(7)).collect()))
    check_mix(odd_docs, mixing.plan(odd_docs))
    assert mixing.plan(no_docs).count() == 0


def test_mixed_texts_have_the_taken_words(spark, odd_docs):
    want = {i: t for i, t in pairs(mixing.plan(odd_docs), "doc_id", "taken")}
    got = mixing.mixed(odd_docs)
    assert got.columns == odd_docs.columns
    have: dict = {}
    for i, t, n in pairs(got, "doc_id", "text", "n_chars"):
        have[i] = have.get(i, 0) + len(brute.words(t))
        assert n == len(t)
    assert have == {i: n for i, n in want.items() if n}


def test_rows_of_one_id_and_size_keep_their_own_words(spark):
    rows = [(None, "red green blue", "s"), (None, "one two three", "s"), (None, "x y z", "s"), (4, "p q", "s"), (4, "r t", "s"), (4, "r t", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs).collect()
    taken: dict = {}
    for r in got:
        assert any(set(brute.words(r.text)) <= set(brute.words(t)) and r.doc_id == i for i, t, _ in rows)
        key = (r.doc_id, next(t for i, t, _ in rows if i == r.doc_id and set(brute.words(r.text)) <= set(brute.words(t))))
        taken[key] = taken.get(key, 0) + len(brute.words(r.text))
    want = sorted(r.taken for r in mixing.plan(docs).collect())
    assert sum(taken.values()) == sum(want) == 23  # 150% of 15, rounded
    assert set(taken) == {(i, t) for i, t, _ in rows}


def test_slots_are_drawn_by_shard_and_permuted_by_source(spark):
    """The numbers by shard are as uneven as a multinomial draw's, quotas are met and each pass takes each block once."""
    sizes = [("a1", 40_000, 52_345), ("a2", 9_001, 9_001), ("n", 30_007, 60_014)]
    goal = spark.createDataFrame([(s, n, w) for s, n, w in sizes], "skey string, source_size long, wanted long")
    got = pairs(mixing.slots(goal, block=10, shard_slots=64), "shard", "slot", "skey", "pass", "block", "words")
    assert sorted(got) == sorted(pairs(mixing.slots(goal.repartition(5), block=10, shard_slots=64), "shard", "slot", "skey", "pass", "block", "words"))
    total = len(got)
    assert sorted((a, b) for a, b, *_ in got) == [(k // 64, k % 64) for k in range(total)]
    uneven = 0.0
    for s, n, w in sizes:
        mine = [x for x in got if x[2] == s]
        assert sum(x[5] for x in mine) == w
        for turn in range(-(-w // n)):
            blocks = [x[4] for x in mine if x[3] == turn]
            need = min(n, w - turn * n)
            assert len(set(blocks)) == len(blocks) == -(-need // 10) and set(blocks) <= set(range(-(-n // 10)))
            if need == n:
                assert set(blocks) == set(range(-(-n // 10))) and blocks != sorted(blocks)
        share = len(mine) / total
        counts = np.bincount([x[0] for x in mine], minlength=total // 64 + 1)[: total // 64]
        uneven += ((counts - 64 * share) ** 2 / (64 * share)).sum()
    free = (total // 64) * 2
    assert 0.7 * free < uneven < 1.3 * free


# the queries as registered


def test_saved_rows_are_the_same(spark, odd_docs):
    assert saved(odd_docs, "t").count() == odd_docs.count()

"""Operators on small tables with nulls, empties, repeats and clashing columns, against brute force."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborq.llm import language_id, near_dup, neighbours, packing, pii, quality_model, quality_rules, toxicity, url_filter
from arborq.llm.piece_bpe import decode, encode, token_digests
from arborq.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_quality_rules(spark, small):
    got = quality_rules.quality_rules(documents(spark, small)).collect()
    texts = {r.doc_id: r.text or "" for r in documents(spark, small).collect()}
    assert len(got) == 130
    for r in got:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        threes = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p + k for p in range(len(w) - 2) if threes[tuple(w[p : p + 3])] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_outlier_is_rejected(spark):
    rows = [(i, " ".join(f"word{(i * 13 + j * j) % 97}" for j in range(80)), "en", "s") for i in range(150)]
    rows += [(900, " ".join(f"word{j}***" for j in range(80)), "en", "s")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900] and sum(got.values()) == 150



def test_copies_of_a_third_of_a_group_are_rejected(spark):
    rows = [(i, " ".join(f"word{(i * 13 + j * j) % 97}" for j in range(60 + i % 40)), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(f"word{j}***" for j in range(80)), "en", "s") for i in range(200)]
    rows += [(2000 + i, " ".join(f"word{j + i}***" for j in range(70 + i)), "en", "s") for i in range(20)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(k for i, k in got.items() if i >= 1000) and sum(got.values()) == 400



def test_small_groups_are_judged(spark):
    plain = lambda i: " ".join(f"word{(i * 13 + j * j) % 97}" for j in range(60 + i % 40))
    junk = " ".join(f"word{j}***" for j in range(80))
    rows = [(i, plain(i), "en", "s") for i in range(150)]
    rows += [(500, plain(3), "en", "small"), (501, junk, "en", "small"), (502, plain(4), "fr", "s"), (503, junk, "fr", "s"), (504, junk, None, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, r in got.items() if not r.kept} == {501, 503, 504}
    assert all(r.distance is not None for r in got.values())


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] != comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def test_near_duplicates(spark, small):
    rows = [(r.doc_id, r.text) for r in documents(spark, small).collect() if r.doc_id is not None]
    want = brute_components(rows, 4)
    got = near_dup.near_duplicates(documents(spark, small), shingle=4).collect()
    assert len(got) == 130
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_near_duplicate_chains(spark):
    """Chains of copies of copies, whose ends are not linked themselves, beside texts just below the limit."""
    base = [f"w{i}" for i in range(100)]
    rows, text = [], list(base)
    for step in range(12):
        rows.append((step, " ".join(text)))
        text[step * 8] = f"x{step}"
    rows += [(100 + i, " ".join(base[:70] + [f"y{i}.{j}" for j in range(30)])) for i in range(20)]
    want = brute_components(rows, 4)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1", "http://example.net/x", "https://www.spam-farm.example.com/en/1/?q#f", "http://spam-farm.example.com/en/1", "nothing", None, "http://x.org/fr/", "http://x.org", "http://y.example.com/de/2", "ftp://h?x://z/"]
    urls += ["http://copy.org/a", "https://www.copy.org/b/?x=1", "http://copy.org/b", "http://copy.org/c"]
    html = [None] * 10 + ["<article>same</article>", "<p><article>same</article>", "", "<article></article>"]
    rows = list(zip(range(len(urls)), urls, html, strict=True))
    rows.append(rows[3])
    pages = spark.createDataFrame([(*r, "clash") for r in rows] + [(None, urls[0], None, "")], "page_id long, url string, html string, host string")
    got = sorted((tuple(r) for r in url_filter.filter_urls(pages, url_filter.listed_pages(pages)).collect()), key=str)
    assert {r[0]: r[4] for r in got}[12] == "block" and {r[0]: r[4] for r in got}[10] == "allow"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows + [(None, urls[0], None)])
    assert got == sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.OP5_SQL})").fetchall(), key=str)


def test_bloom_filter_lets_some_through_that_the_join_removes(spark):
    """A list of 4,000 URLs and 200,000 others: the filter passes all listed ones and a few others; no other is blocked."""
    listed = spark.range(4000).select(F.concat(F.lit("bad.org/"), "id").alias("url"))
    pages = spark.range(204_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://bad.org/"), "id").alias("url"))
    got = url_filter.filter_urls(pages, listed, []).groupBy("verdict").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).collect()
    assert {r.verdict: (r.n, r.top) for r in got} == {"block": (4000, 3999), "allow": (200_000, 203_999)}
    blocks = -(-4000 * url_filter.BITS_PER_URL // 512)
    probes = pages.select(F.col("page_id"), F.substring("url", 8, 100).alias("url"))
    met = probes.withColumn("block", url_filter._block(F.col("url"), blocks)).join(url_filter.blocked_bloom(listed, blocks), "block")
    for i, bit in enumerate(url_filter._bits(F.col("url"))):
        met = met.where(F.col(f"w{i}").bitwiseAND(bit) != 0)
    passed = met.select("page_id").collect()
    wrong = sum(r.page_id >= 4000 for r in passed)
    assert len(passed) - wrong == 4000 and 0 < wrong < 4000


def test_models_on_odd_rows(spark, small):
    docs = documents(spark, small)
    net = pii.learn([f"word {i} mail a{i}.b@host{i}.org or +49 {i} 555-{1000 + i} and 10.{i}.3.{i}" for i in range(80)], steps=60)
    for df in (quality_model.score_documents(spark, small, docs), pii.find_pii(docs, net), toxicity.severity(docs, toxicity.fit(toxicity.labelled_documents(spark, small))), language_id.identify(docs, language_id.dictionaries(docs)), token_digests(docs), pii.find_pii(docs, None), packing.pack(docs).where("piece = 0")):
        rows = df.collect()
        assert len(rows) == 130 and sum(r.doc_id is None for r in rows) == 1
        assert [tuple(r)[1:3] for r in rows if r.doc_id == 207][0] == [tuple(r)[1:3] for r in rows if r.doc_id == 207][1]


def test_ids_decode_to_the_text(spark, small):
    ids = encode(documents(spark, small).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    texts = {r.doc_id: r.text or "" for r in documents(spark, small).collect()}
    assert all(r.text == texts[r.doc_id] for r in decode(ids).collect())


def test_toxic_words_are_learned(spark):
    rows = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(40)) + (" nastyword" * (1 + i % 3) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    labelled = spark.createDataFrame(rows, "id long, text string, toxic int")
    out = {r.doc_id: r for r in toxicity.severity(labelled.withColumnRenamed("id", "doc_id"), toxicity.fit(labelled)).collect()}
    assert all(out[i].toxic == bool(t) for i, _, t in rows)


def test_languages(spark):
    a, b = "der die und nicht schnell wasser strasse machen", "the and not quick water street making through"
    rows = [(i, " ".join((a if i % 2 else b).split()[(i + j * j) % 8] for j in range(40)), "de" if i % 2 else "en") for i in range(60)] + [(100, "123 !", None), (101, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.dictionaries(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:60]) and got[100].lang_pred == got[101].lang_pred == "und"


def test_neighbours_ties_and_invalid(spark):
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(0, 90)] + [(200, None), (201, [0.0, 0.0, 0.0]), (202, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (203, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, k + 1, 3 * k + 3) for k in range(5)] + [(50, k + 1, 3 * k + 2) for k in range(5)]


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "pipeline"))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def crc_fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def brute_mcd(x, floors, share, consistent, start):
    """Concentration steps with whole sorts, from one start, to the end: (log determinant, mean, covariance)."""
    h = int(np.ceil(share * len(x)))
    mean, cov = start
    for _ in range(60):
        full = cov * consistent + np.diag(floors) ** 2
        d2 = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(full), x - mean)
        near = np.argsort(d2, kind="stable")[:h]
        after = x[near].mean(0), np.cov(x[near].T, bias=True)
        if np.allclose(after[1], cov):
            break
        mean, cov = after
    return np.linalg.slogdet(cov * consistent + np.diag(floors) ** 2)[1], mean, cov


def test_estimate_is_the_brute_force_one(spark):
    """The determinant that is found is as small as that of concentration steps with whole sorts, from plain and median starts."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(700, 4)) @ np.array([[1, 0, 0, 0], [0.5, 1, 0, 0], [0, 0.3, 0.5, 0], [0.1, 0, 0.2, 0.3]]), rng.normal(6, 0.2, (300, 4))])
    points = spark.createDataFrame([("g", i % quality_rules.SALTS, *map(float, r)) for i, r in enumerate(x)], "grp string, salt int, x0 double, x1 double, x2 double, x3 double")
    r = quality_rules.mcd_moments(points).first()
    cov = np.zeros((4, 4))
    for i, j in quality_rules.PAIRS:
        cov[i, j] = cov[j, i] = r[f"s{i}{j}"]
    floors = np.array(quality_rules.FLOORS)
    ours = np.linalg.slogdet(cov * quality_rules.CONSISTENT + np.diag(floors) ** 2)[1]
    median = np.median(x, 0)
    starts = [(x.mean(0), np.cov(x.T)), (median, np.diag((1.4826 * np.median(np.abs(x - median), 0)) ** 2))]
    best = min((brute_mcd(x, floors, quality_rules.SHARE, quality_rules.CONSISTENT, s) for s in starts), key=lambda b: b[0])
    assert abs(ours - best[0]) < 0.05 and np.allclose([r[f"m{i}"] for i in range(4)], best[1], atol=0.1)


def test_null_and_repeated_ids_are_judged_each(spark):
    plain = lambda i: " ".join(f"word{(i * 13 + j * j) % 97}" for j in range(60 + i % 40))
    rows = [(None if i % 9 == 0 else i % 50, plain(i), "en" if i % 2 else None, f"s{i % 5}") for i in range(300)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == 300 and all(r.distance is not None and r.kept for r in got)


def test_one_label_or_one_language(spark, small, tmp_path):
    docs = documents(spark, small).where("doc_id < 50")
    for value in (0, 1):
        spark.createDataFrame([(i, value, value) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / f"{value}" / "labels.parquet"))
        folder = str(tmp_path / f"{value}")
        assert {r.predicted for r in quality_model.score_documents(spark, folder, docs).collect()} == {value}
        out = toxicity.severity(docs, toxicity.fit(toxicity.labelled_documents(spark, folder, docs))).collect()
        assert len(out) == 50 and (value or not any(r.toxic for r in out))
    one = docs.withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in language_id.identify(one, language_id.dictionaries(one)).collect()} <= {"xx", "und"}


DATA, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_quality_on_held_out_rows(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in QUERIES["op2_quality_model"](spark, DATA).collect() if r.held_out and r.doc_id in marks]
    assert all(crc_fold(r.doc_id, 5) == 0 for r in got)
    assert sum(r.predicted == marks[r.doc_id] for r in got) >= 0.95 * len(got) > 0


def test_language_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op3_language"](spark, DATA).collect() if r.held_out and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.95 * len(got) > 0


def test_toxicity_on_held_out_rows(spark):
    """A model of four folds of five, on the fifth: toxic texts are found, others left alone, and severity rises with the
    number of toxic words that none of its features were chosen from."""
    marked = toxicity.labelled_documents(spark, LARGER)
    model = toxicity.fit(marked.where("crc32(cast(id AS string)) % 5 <> 0"))
    held = marked.where("crc32(cast(id AS string)) % 5 = 0").withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r for r in toxicity.severity(held, model).collect()}
    truth = {r.doc_id: r.toxic for r in held.collect()}
    hit, false = (sum(got[i].toxic for i, t in truth.items() if t == k) for k in (1, 0))
    assert hit >= 0.85 * sum(truth.values()) > 0 and false <= 0.01 * len(truth)


def test_ids_are_placed_outside_python(spark, small):
    """Of a piece only its length and rank go through Python when it is placed, so no task holds the ids in a worker and in Arrow buffers."""
    plan = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), with_ids=True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [place(") == 1, plan


def test_no_piece_waits_for_a_worker(spark, small):
    """Rows that a Python worker is asked about wait whole, 16 KB of counts each among them; so only lengths are asked about."""
    plan = packing.pack(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :].splitlines()[1:]
    assert len(below) == 1 and "Range (1, 2049" in below[0], plan


def test_places_of_ranks(spark):
    """Ranks are looked up as numpy does it, whatever the number of a length's blocks."""
    rng = np.random.Generator(np.random.PCG64(7))
    for n in (1, 2, 3, 7, 8, 9, 100):
        firsts = [0, *sorted(rng.choice(np.arange(1, 500), n - 1, replace=False).tolist())]
        df = spark.range(510).withColumn("v", F.array(*map(F.lit, firsts)))
        got = {r.id: r.at for r in df.select("id", packing._last_at_most(F.col("v"), n, F.col("id")).alias("at")).collect()}
        assert got == {i: int(np.searchsorted(firsts, i, "right")) - 1 for i in range(510)}


def test_memory_of_cutting(small, monkeypatch):
    """Texts of 1.4 MB with ever new words are cut in less than 60 MB besides the tokenizer."""
    import tracemalloc

    import pyarrow as pa
    import pyspark
    from arborq.llm import word_bpe

    coder = word_bpe.WordBPE(packing.tokenizer_path())
    monkeypatch.setattr(word_bpe, "WordBPE", lambda path: coder)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + i % 26)}ing{chr(97 + i // 26 % 26)}er" for i in range(200)) for k in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(texts)], ["id", "text"])
    run = packing._cutter("", 2048, 0, True)
    small_text = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["a"])], ["id", "text"])
    assert [r.num_rows for r in run([small_text])] == [1]  # tables of powers and the like stay
    tracemalloc.start()
    try:
        assert sum(r.num_rows for r in run([batch])) == 700
        assert tracemalloc.get_traced_memory()[1] < 60e6, tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()


def test_packed_rows(spark, small):
    """Pieces, checksums and places of the query against the tokenizers library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in documents(spark, small).collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[(r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    rows = QUERIES["op7_packing"](spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.1 * sum(r.length for r in rows) / 2048 + 1
    again = packing.MAX_BROADCAST_PARTS
    packing.MAX_BROADCAST_PARTS = 0
    try:
        assert Counter((r.sequence_id, r.offset, r.length) for r in QUERIES["op7_packing"](spark, small).collect()) == Counter((r.sequence_id, r.offset, r.length) for r in rows)
    finally:
        packing.MAX_BROADCAST_PARTS = again


def test_piece_digests(spark, small):
    import hashlib

    import sentencepiece
    from arborq.llm.piece_bpe import model_path

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in documents(spark, small).collect():
        ids = sp.encode(r.text or "")
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] += 1
    assert Counter(tuple(r)[:4] for r in QUERIES["op8_sentencepiece"](spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_neighbours_in_several_blocks(spark, monkeypatch):
    """Blocks of vectors and of queries, and an id that stands with two vectors, against brute force."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    v = np.random.default_rng(3).normal(size=(1500, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = neighbours.nearest(spark.createDataFrame([*rows, (3, v[7].tolist()), (50, v[50].tolist())], "vec_id long, embedding array<double>"))
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q, own in found.items():
        own.sort()
        ids = [i for _, i, _ in own]
        assert [k for k, _, _ in own] == [1, 2, 3, 4, 5] and len(set(ids)) == 5 and q not in ids
        near = unit @ unit[q]
        assert all(abs(near[i] - s) < 1e-9 for _, i, s in own if i != 3)
        hits += len(set(ids) & set([i for i in np.argsort(-near) if i != q][:5]))
    assert len(found) == 30 and hits >= 0.9 * 150


def test_network_finds_variants_it_was_not_shown(spark):
    """Precision and recall on rewritten spans of texts that taught nothing, and spans that it adds through the query."""
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("".join(rng.choice(list("etaoinshrdlu"), int(rng.integers(2, 9)))) for _ in range(n))
    spans = [
        lambda: f"{word(1)}.{word(1)}@{word(1)}.org",
        lambda: ".".join(str(int(x)) for x in rng.integers(1, 255, 4)),
        lambda: f"+{rng.integers(1, 99)} ({rng.integers(100, 999)}) {rng.integers(100, 999)}-{rng.integers(1000, 9999)}",
    ]
    texts = [f"{word(12)} {spans[i % 3]()} {word(12)}" if i % 4 else word(30) for i in range(400)]
    net = pii.learn(texts, steps=450)
    precision, recall, n = net.held_out
    assert precision >= 0.9 and recall >= 0.7 and n >= 50
    new = [f"{word(40)} 49 (301) 555-6503 {word(60)}", f"{word(400)} jane.doe at mill dot org {word(10)}", word(300)]
    found = pii.find_pii(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), net).orderBy("doc_id").collect()
    assert found[0].n_added >= 1 and found[2].n_added == 0


def test_near_duplicates_of_documents_are_all_found(spark):
    """Components and set sizes of the query on a whole table against all pairs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_near_dup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute_components(rows, 4)


def test_neighbours_of_embeddings(spark):
    """Recall of the query on a whole table against all cosines, and exact scores."""
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding IS NOT NULL").collect()
    keep = [(r.vec_id, np.array(r.embedding, float)) for r in rows if None not in r.embedding]
    keep = [(i, v) for i, v in keep if np.isfinite(v).all() and v.any()]
    ids, unit = np.array([i for i, _ in keep]), np.array([v / np.linalg.norm(v) for _, v in keep])
    got = {}
    for r in QUERIES["op9_neighbours"](spark, DATA).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q, found in got.items():
        score = unit @ unit[ids == q][0]
        score[ids == q] = -2
        best = ids[np.lexsort((ids, -score))[:5]]
        hits, total = hits + len(set(best.tolist()) & set(found)), total + 5
        assert all(abs(score[ids == i][0] - s) < 1e-9 for i, s in found.items())
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0} and hits >= 0.9 * total

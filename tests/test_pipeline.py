"""Vectors, topic model, crawl files, streaming, driver contract."""

import glob
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF001


def _texts(spark):
    from webloom.operators.vectorize import cleaned_texts
    return cleaned_texts(spark.read.parquet(f"{SF001}/documents.parquet"))


def test_vectors_dense_ids_and_counts(spark):
    from webloom.operators.vectorize import corpus_terms, vectorize
    texts = _texts(spark)
    vocab, dt, vec = vectorize(texts)
    v = vocab.orderBy("term_id").collect()
    assert [r.term_id for r in v] == list(range(len(v)))
    assert [r.term for r in v] == sorted(r.term for r in v)
    # A6 sums to the token count
    assert dt.agg(F.sum("count")).first()[0] == corpus_terms(texts).count()
    line = vec.first().vector.split(" ")
    ids = [int(p.split(":")[0]) for p in line]
    assert ids == sorted(ids)


def test_vocab_join_has_no_hint(spark):
    from webloom.operators.vectorize import join_vocab
    a = spark.range(10).selectExpr("cast(id as string) as term")
    b = spark.range(10).selectExpr("cast(id as string) as term", "id as term_id")
    joined = join_vocab(a, b)
    assert joined.count() == 10
    assert "broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString().lower()


def test_lda_em_two_topics(spark):
    """Two-topic corpus of 10 documents: topics sum to 1 and separate the vocabularies."""
    from webloom.operators.topics import fit_lda_em, topics_table
    rows = []
    for d in range(10):
        words = range(0, 5) if d < 5 else range(5, 10)
        rows += [(str(d), w, 3 + (w % 2)) for w in words]
    corpus = spark.createDataFrame(rows, "doc_id string, term_id long, count long")
    lam, alpha, timings = fit_lda_em(corpus, 10, k=2, outer=5, inner=50)
    t = topics_table(lam)
    sums = {r.k: r.s for r in t.groupBy("k").agg(F.sum("value").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    mat = np.zeros((2, 10))
    for r in t.collect():
        mat[r.k, r.term_id] = r.value
    top = [set(np.argsort(-mat[k])[:5]) for k in range(2)]
    assert {frozenset(x) for x in top} == {frozenset(range(5)), frozenset(range(5, 10))}
    assert len(timings) == 5 and np.all(alpha > 0)


def _em_by_hand(rows, v, k, outer, inner, phi_weight):
    """The reference job's loops over documents, terms and topics, from the same start values."""
    from webloom.operators.topics import ALPHA0, ETA, digamma, start_values, update_alpha
    lam, alpha = start_values(np.arange(v), k, v), np.full(k, ALPHA0)
    docs = {}
    for d, w, c in rows:
        docs.setdefault(d, []).append((w, c))
    for _ in range(outer):
        new, seen, suff = np.zeros((v, k)), set(), np.zeros(k)
        for own in docs.values():
            gamma = np.full(k, ALPHA0 + v // k)
            for _ in range(inner):
                weight = gamma if phi_weight == "gamma" else np.exp(digamma(gamma))
                phi = [lam[w] * weight / (lam[w] * weight).sum() for w, _ in own]
                gamma = alpha + sum(c * p for p, (_, c) in zip(phi, own, strict=True))
            for p, (w, c) in zip(phi, own, strict=True):
                new[w] += c * p
                seen.add(w)
            suff += digamma(gamma) - digamma(gamma.sum())
        lam = np.array([ETA + new[w] if w in seen else lam[w] for w in range(v)])
        lam /= lam.sum(0)
        alpha = update_alpha(alpha, suff, len(docs))
    return lam, alpha


@pytest.mark.parametrize("phi_weight", ["digamma", "gamma"])
def test_em_on_blocks_equals_the_loops_of_the_job(spark, monkeypatch, phi_weight):
    """Documents and terms in several blocks, long and short documents, a term that no document has."""
    from webloom.operators import topics as L
    monkeypatch.setattr(L, "DOC_BLOCK_NUMBERS", 100)
    monkeypatch.setattr(L, "TERM_BLOCK_NUMBERS", 21)
    rng = np.random.default_rng(5)
    rows = [(f"d{d}", int(w), int(rng.integers(1, 6))) for d in range(25)
            for w in rng.choice(59, rng.integers(1, 4) if d % 2 else 45, replace=False)]
    want, want_alpha = _em_by_hand(rows, 60, 3, 3, 20, phi_weight)
    corpus = spark.createDataFrame(rows, "doc_id string, term_id long, count long")
    lam, alpha, _ = L.fit_lda_em(corpus, 60, k=3, outer=3, inner=20, phi_weight=phi_weight)
    got = {r.term_id: r.lam for r in lam.collect()}
    assert sorted(got) == list(range(60))
    assert np.allclose(np.array([got[w] for w in range(60)]), want, rtol=1e-9) and np.allclose(alpha, want_alpha, rtol=1e-8)
    empty, alpha, _ = L.fit_lda_em(corpus.limit(0), 60, k=3, outer=1)
    assert empty.count() == 60 and np.isfinite(alpha).all()


def test_sums_of_terms_are_rows_with_long_ids(spark, monkeypatch):
    """The E-step's sums per topic and term, in several term blocks, one of them past the ids of 32 bits."""
    from webloom.operators import topics as L
    monkeypatch.setattr(L, "TERM_BLOCK_NUMBERS", 8)
    rows = [(f"d{d}", w, 1 + (d + w) % 3) for d in range(6) for w in range(d, d + 9)]
    corpus = spark.createDataFrame(rows, "doc_id string, term_id long, count long")
    blocks = L.doc_blocks(corpus, 2)
    sums = L.e_step(blocks, L.block_needs(blocks, 2), L.term_blocks(spark, 2, 14), np.ones(2), np.full(2, 0.1), 2, 14, inner=5)
    got = {(r.k, r.term_id): r.value for r in L.sum_rows(sums, 2).collect()}
    assert set(got) == {(k, w) for k in range(2) for w in (L.SUFF_STAT_ID, *range(14))}
    for w in range(14):  # a term's count is shared out among the topics
        assert np.isclose(got[0, w] + got[1, w], sum(c for _, x, c in rows if x == w))
    far = spark.createDataFrame([(1 << 30, np.arange(4, dtype=np.int32).tobytes(), np.arange(8.0).tobytes())], "term_block long, offsets binary, sums binary")
    assert {(r.k, r.term_id): r.value for r in L.sum_rows(far, 2).collect()} == {
        (k, (1 << 32) + i): 2.0 * i + k for i in range(4) for k in range(2)}


def test_shuffles_of_ended_iterations_are_deleted(spark):
    """The disk that a fit needs doesn't grow with its iterations."""
    import time
    from webloom.operators import topics as L
    local = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    corpus = spark.createDataFrame([(f"d{d}", w, 1) for d in range(40) for w in range(d % 7, 30)], "doc_id string, term_id long, count long")

    def files(outer):
        L.fit_lda_em(corpus, 30, k=2, outer=outer, inner=2)
        time.sleep(1)  # deleted in the background
        return sum(f.startswith("shuffle_") for top in local for _, _, names in os.walk(top) for f in names)

    first = files(1)
    assert files(6) <= first + 20


def test_topics_of_ended_iterations_are_deleted(spark):
    from webloom.operators import topics as L
    from webloom.session import checkpoint_dir
    corpus = spark.createDataFrame([(f"d{d}", w, 1) for d in range(9) for w in range(d, 20)], "doc_id string, term_id long, count long")
    folder = checkpoint_dir(spark).removeprefix("file:")

    def written():
        return {f for f in os.listdir(folder) if f.startswith("lda-topics-")}

    before = written()
    lam, _, _ = L.fit_lda_em(corpus, 20, k=2, outer=4, inner=2)
    assert len(written() - before) == 1 and lam.count() == 20


@pytest.mark.parametrize("k, phi_weight", [(3, "digamma"), (3, "gamma"), (40, "digamma")])
def test_documents_worked_on_together_equal_those_alone(monkeypatch, k, phi_weight):
    """Groups of documents of many sizes, one longer than a group; with 40 topics of one-word documents no factor is far from 1."""
    from webloom.operators import topics as L
    monkeypatch.setattr(L, "GROUP_NUMBERS", 60 * k)
    rng = np.random.default_rng(3)
    sizes = np.array([1, 1, 2, 9, 30, 31, 33, 75, 1])
    starts, counts = np.cumsum(sizes) - sizes, rng.integers(1, 5, sizes.sum()).astype(float)
    index = np.concatenate([rng.choice(80, n, replace=False) for n in sizes]).astype(np.int32)
    lam, alpha = rng.random((80, k)), np.full(k, 0.001 if k > 3 else 0.1)
    sums, gammas = L.fixed_point(lam, index, starts, counts, alpha, 2.0, 30, phi_weight)
    want = np.zeros_like(lam)
    for d, (a, n) in enumerate(zip(starts, sizes, strict=True)):
        own, c, gamma = lam[index[a:a + n]], counts[a:a + n, None], np.full(k, 2.0)
        for _ in range(30):
            psi = L.digamma(gamma)
            phi = own * (gamma if phi_weight == "gamma" else np.exp(psi - psi.max()))
            phi /= phi.sum(1, keepdims=True)
            gamma = alpha + (c * phi).sum(0)
        assert np.allclose(gammas[d], gamma, rtol=1e-9)
        want[index[a:a + n]] += c * phi
    assert np.allclose(sums[:len(lam)], want, rtol=1e-9)


def test_old_topics_travel_only_where_a_term_has_no_document(spark, monkeypatch):
    """Term blocks all of whose terms are in documents bring no old values to the M-step; a last one without any does."""
    from webloom.operators import topics as L
    monkeypatch.setattr(L, "TERM_BLOCK_NUMBERS", 8)
    corpus = spark.createDataFrame([(f"d{d}", w, 1) for d in range(6) for w in range(d, d + 5) if w != 6], "doc_id string, term_id long, count long")
    needs = L.block_needs(L.doc_blocks(corpus, 2), 2)
    assert [r.term_block for r in L.unseen_blocks(needs, 2, 14).orderBy("term_block").collect()] == [1, 2, 3]
    assert L.unseen_blocks(L.block_needs(L.doc_blocks(corpus.where("term_id < 4"), 2), 2), 2, 4) is None


def test_steps_of_places_are_kept():
    from webloom.operators.topics import _from_steps, _steps
    for places in ([], [0], [7, 70_000, 90_000_000, 0, 3, 2, (1 << 31) - 1]):
        assert _from_steps(_steps(np.array(places, np.int64))).tolist() == places


def test_packed_documents_make_the_blocks_of_their_rows(spark, monkeypatch):
    """Documents of several rows, some with a repeated or no id, words without a term: the fit from packed documents is that from rows."""
    from webloom.operators import topics as L
    from webloom.operators import vectorize as V
    monkeypatch.setattr(V, "COUNTED_ROWS", 2)
    monkeypatch.setattr(L, "DOC_BLOCK_NUMBERS", 30)
    texts = ["tree house tree's the", "house of cards", None, "... 12 3", "cards CARDS table", "tree", "table garden house"]
    docs = spark.createDataFrame([(i % 5 if i != 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    vocab, packed, _ = V.vectorize_documents(docs, packed=True)
    rows = V.vectorize_documents(docs)[1]
    assert packed.filter("size = 0").count() == 0 and packed.count() == 6
    assert sorted((str(r.doc_id), r.term_id, r["count"]) for r in V.dictionary_doc_terms(packed).collect()) == sorted(
        (str(r.doc_id), r.term_id, r["count"]) for r in rows.collect())
    fits = [L.fit_lda_em(c, vocab.count(), k=2, outer=2, inner=5) for c in (packed, rows.withColumn("doc_id", F.coalesce("doc_id", F.lit("none"))))]
    (a, b), alphas = ({r.term_id: r.lam for r in f[0].collect()} for f in fits), [f[1] for f in fits]
    assert sorted(a) == sorted(b) and np.allclose([a[t] for t in sorted(a)], [b[t] for t in sorted(a)], rtol=1e-9)
    assert np.allclose(*alphas, rtol=1e-8)


def test_block_keys_are_dealt_out_evenly(spark):
    from webloom.operators.topics import even_keys
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in (1, parts, 3 * parts + 1):
        keys = even_keys(spark, n)
        dealt = spark.createDataFrame([(k,) for k in keys], "id long").groupBy(F.pmod(F.hash("id"), F.lit(parts))).count()
        assert len(set(keys)) == n and max(r["count"] for r in dealt.collect()) == -(-n // parts)


def test_block_counts_of_any_size_are_kept():
    from webloom.operators.topics import _short
    for counts, size in (([1.0, 65535.0], 2), ([1.5], 8), ([65536.0], 8), ([-1.0], 8), ([], 8)):
        short = _short(np.array(counts))
        assert short.itemsize == size and short.tolist() == counts


def test_rows_are_counted_without_an_exchange(spark):
    """Repeated ids and terms of another case add up in the vectors; no shuffle before the join."""
    from webloom.operators import vectorize as V
    docs = spark.createDataFrame([(1, "Tree tree's TREE house"), (1, "tree"), (2, None), (3, "the")], "doc_id long, text string")
    counts = V.raw_counts(docs)
    assert {(r.doc_id, r.raw, r.n) for r in counts.groupBy("doc_id", "raw").agg(F.sum("count").alias("n")).collect()} == {
        ("1", "tree", 4), ("1", "house", 1)}
    assert [r.vector for r in V.vectorize_documents(docs)[2].collect()] == ["0:1 1:4"]


def test_update_alpha_keeps_positive():
    from webloom.operators.topics import update_alpha
    a = update_alpha(np.full(3, 0.1), np.array([-50.0, -60.0, -70.0]), 20)
    assert np.all(a > 0)


def test_warc_roundtrip_and_incremental_stream(spark):
    from webloom.sources.crawl import read_warc, responses, warc_rejects, read_warc_raw, write_warc
    from webloom.sources.files import incremental_inputs
    from webloom.streaming.incremental import start_conversion
    d = tempfile.mkdtemp(prefix="webloom-warc-")
    pages = spark.read.parquet(f"{SF001}/pages.parquet")

    def write(part, cond):
        write_warc(pages.where(cond).coalesce(1), f"{d}/in/cw-data/{part}")
        for f in glob.glob(f"{d}/in/cw-data/{part}/part-*"):
            os.rename(f, f + ".warc")

    write("a", "page_id < 20")
    crawl = responses(read_warc(spark, f"{d}/in"))
    j = crawl.join(pages.selectExpr("concat('clueweb12-', page_id) as trec_id", "html as h", "url as u"), "trec_id")
    assert crawl.count() == 20 and j.where("html = h and url = u").count() == 20
    assert warc_rejects(read_warc_raw(spark, f"{d}/in")).count() == 0
    assert incremental_inputs(spark, f"{d}/in", f"{d}/out").count() == 1
    start_conversion(spark, f"{d}/in", f"{d}/out", checkpoint=f"{d}/ckpt")
    assert spark.read.parquet(f"{d}/out").count() == 20
    assert incremental_inputs(spark, f"{d}/in", f"{d}/out").count() == 0
    start_conversion(spark, f"{d}/in", f"{d}/out", checkpoint=f"{d}/ckpt")
    assert spark.read.parquet(f"{d}/out").count() == 20
    write("b", "page_id >= 20")
    assert incremental_inputs(spark, f"{d}/in", f"{d}/out").count() == 1
    start_conversion(spark, f"{d}/in", f"{d}/out", checkpoint=f"{d}/ckpt")
    assert spark.read.parquet(f"{d}/out").count() == 50


def test_sparse_vector_reader_and_files(spark):
    from webloom.sources.files import list_files, parse_sparse_vectors, read_text, read_whole_files, save_text
    d = tempfile.mkdtemp(prefix="webloom-files-")
    lines = spark.createDataFrame([("3 0:1 7:2 9:1",), ("1 4:5",)], ["value"])
    save_text(lines, f"{d}/vec", single_file=True)
    got = sorted((r["term_id"], r["count"]) for r in parse_sparse_vectors(spark.read.text(f"{d}/vec")).collect())
    assert got == [(0, 1.0), (4, 5.0), (7, 2.0), (9, 1.0)]
    assert read_text(spark, f"{d}/vec").count() == 2
    assert read_whole_files(spark, f"{d}/vec").count() == 1
    assert list_files(spark, d, "part-*").count() == 1


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 100 and df.columns == ["word", "cnt"]
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracles_at_sf0001(spark):
    """A sweep of registered queries against their DuckDB oracles on the smallest tables."""
    import duckdb

    import __spark_entry__ as E
    from webloom.sources.tables import TABLES
    from tools_check import digest
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    names = ["word_count", "top_k_words", "text_blocks", "title", "num_words_rules", "ignore_after_end",
             "proximity_fusion", "keep_largest_block", "extract_article", "page_top_words", "clean_text",
             "doc_vectors", "anchors", "low_quality", "read_warc"]
    qs, sql = E.queries(), E.oracle_sql()
    for n in names:
        df = qs[n](spark, SF001)
        rel = con.sql(sql[n])
        assert sorted(df.columns) == sorted(rel.columns), n
        assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(rel.columns, rel.fetchall())[0], n


def test_count_words_equals_block_words(spark):
    from webloom.functions.tokens import count_words
    from webloom.operators.html import html_events, text_blocks
    b = text_blocks(html_events(spark.read.parquet(f"{SF001}/pages.parquet")))
    assert b.where(count_words(F.col("text")) != F.col("num_words")).count() == 0


def test_seqfile_and_text_per_doc(spark):
    from webloom.sources.files import read_seqfile, write_text_per_doc
    d = tempfile.mkdtemp(prefix="webloom-seq-")
    spark.sparkContext.parallelize([("d1", "hello world\n"), ("d2", "second text\n")]).saveAsSequenceFile(f"{d}/seq")
    got = sorted((r.doc_id, r.text) for r in read_seqfile(spark, f"{d}/seq").collect())
    assert got == [("d1", "hello world\n"), ("d2", "second text\n")]
    docs = spark.createDataFrame([(i, f"text {i}\nline") for i in range(20)], "doc_id long, text string")
    write_text_per_doc(docs, f"{d}/per_doc", buckets=4)
    back = spark.read.text(f"{d}/per_doc")
    assert back.count() == 20 and back.select("bucket").distinct().count() <= 4


def test_records_with_other_first_headers_dates_and_case(spark):
    from pyspark.sql import functions as F

    from webloom.sources.crawl import parse_warc_records, warc_rejects
    head = "Content-Type: application/http\r\nWARC-Type: response\r\nwarc-trec-id: a-1\r\nWARC-Date: {}\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody"
    raw = spark.createDataFrame([(head.format("2012-02-12T09:08:06.25Z"), "p"), (head.format("soon"), "p"),
                                 ("no header here", "p"), ("", "p")], "value string, path string")
    rows = parse_warc_records(raw).select("trec_id", "html", F.col("warc_date").cast("string").alias("d")).collect()
    assert sorted(map(tuple, rows), key=str) == [("a-1", "body", "2012-02-12 09:08:06.25"), ("a-1", "body", None)]
    assert [r.value for r in warc_rejects(raw).collect()] == ["no header here"]


def test_sequence_files_keep_inputs_ids_and_texts(spark, tmp_path):
    from webloom.sources.files import read_seqfile, write_seqfile
    rows = [("a#1", "in/x#1.warc", "two\nlines é"), ("2", "in/x#1.warc", None), (None, None, ""), ("3", "in/y.warc", "a#b" * 50_000)]
    texts = spark.createDataFrame([(i.replace("a#", "a") if i else i, r, t) for i, r, t in rows], "doc_id string, rel string, text string")
    want = sorted((r or "", (i or "").replace("a#", "a"), t or "") for i, r, t in rows)
    for name, codec in (("plain", None), ("packed", "org.apache.hadoop.io.compress.DefaultCodec")):
        write_seqfile(texts, str(tmp_path / name), codec)
        back = read_seqfile(spark, str(tmp_path / name), with_rel=True)
        assert sorted((r.rel, r.doc_id, r.text) for r in back.collect()) == want
    assert read_seqfile(spark, str(tmp_path / "plain")).filter("doc_id = 'in/y.warc#3'").count() == 1
    write_seqfile(texts.limit(0), str(tmp_path / "none"))
    assert read_seqfile(spark, str(tmp_path / "none")).count() == 0

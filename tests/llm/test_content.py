"""Language ID, personal data, WARC, toxicity and the pipeline."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_jaccard import plain_components
from plain_pii import plain_spans
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import langid, pii, toxicity, warc
from cohortloom.llm.common import table
from cohortloom.llm.queries import op2_language_id, op10_toxicity

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    rows = op2_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == (r.c % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    words = {"aa": "lorem ipsum dolor", "bb": "über straße größe", "cc": "niño mañana señor"}
    rows = [(i, words[k] + f" {k}{i}", k) for i, k in enumerate(["aa", "bb", "cc"] * 30)] + [(900, None, "aa"), (901, "", None), (902, "123 !?", None), (None, words["bb"], "bb"), (903, words["cc"] * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(7)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.predict_languages(docs, langid.train(docs, 10)).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "cc" and got[None].lang_pred == "bb" and got[None].held_out is False
    assert langid.predict_languages(docs.limit(0), langid.train(docs.limit(0))).collect() == []
    assert {r.lang_pred for r in langid.predict_languages(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5)) + np.repeat([[2.0], [-2.0]], 40, axis=0)
    w = langid.train_svm(x, np.repeat([1.0, -1.0], 40))
    assert (np.sign(x @ w[:-1] + w[-1]) == np.repeat([1.0, -1.0], 40)).all()


PII_TEXTS = [
    "", None, "a@b.c x@y.z.w,", "aa..b%@c-d.e%@f.g", "x" * 3000 + "@" + "y" * 3000 + ".com", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "5 5105105105105100 12345678901234567890 4 11", "+1 (784) 555-8120 +12 +1+2 +1 2 3 4 5 6 7 8 9 0", "\U0001f600 a@b.cc \U0001f600 9.9.9.9", "1 " * 4000, "9" * 5000, "a.b@c.d" * 300, "@@@ a@ @b.c", "+" * 500, "4111111111111111+14111111111111111",
]


def test_pattern_spans_are_the_plain_ones(spark):
    rng = random.Random(3)
    alphabet = "0123456789.@+- ()ab%é"
    texts = PII_TEXTS + ["".join(rng.choice(alphabet) for _ in range(120)) for _ in range(400)] + ["".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: [(s.start, s.kind, list(pii.PATTERNS)[s.kind], s.end) for s in r.spans] for r in pii.base_spans(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), t


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i}@h{i % 7}.org" for i in range(1500))
    (row,) = pii.base_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [text[s.start : s.end] for s in row.spans] == [s.value for s in row.spans] and len(row.spans) == 1500


def test_terms_that_disclose_are_found_and_masked(spark):
    rng = random.Random(1)
    filler = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "po", "ki", "du")]
    text = lambda: " ".join(rng.choice(filler) for _ in range(20))
    rows = [(i, f"{text()} write to zanthorius at jo@x.org {text()}", "c") for i in range(8)] + [(100 + i, f"{text()} call +1 (784) 555-81{i % 90 + 10} {text()}", "c") for i in range(60)] + [(300 + i, text(), "c") for i in range(120)]
    docs = spark.createDataFrame([*rows, (900, None, "c"), (None, rows[0][1], "c")], "doc_id long, text string, added string")
    found = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    for i, t, _ in rows[:8]:
        assert ("term", "zanthorius") in {(pii.KINDS[s.kind], t[s.start : s.end].lower()) for s in found[i]}
        assert {(s.start, s.end) for s in found[i] if s.kind < 4} == {(a, e) for a, _, _, e in plain_spans(t)}
    assert not any(s.kind == 4 for i, t, _ in rows[8:] for s in found[i])
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert "zanthorius" not in clean[0].text and "jo@x.org" not in clean[0].text and "[EMAIL]" in clean[0].text and "[REMOVED]" in clean[0].text
    assert clean[900].text is None and clean[None].text == clean[0].text and clean[300].text == rows[68][1]
    assert pii.sanitise(docs).columns == docs.columns and pii.find_spans(docs.limit(0)).collect() == []


@given(st.lists(st.binary(max_size=300), max_size=6))
@settings(max_examples=50, deadline=None)
def test_split_records_and_members(payloads):
    made = [warc.record(i, f"http://h/{i} x", p, None) + warc.END_OF_RECORD for i, p in enumerate(payloads)]
    assert list(warc.split_records(gzip.compress(b"".join(made)))) == made
    packed = [gzip.compress(m) for m in made]
    found = list(warc.members(b"".join(packed) + warc.EMPTY_MEMBER))
    assert [c for _, _, c in found] == made and [n for _, n, _ in found] == list(map(len, packed))


def test_pages_round_trip(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "ü\r\n\r\nContent-Length: 9\r\n\r\n", "x" * 300_000, "<p>a</p>"]
    rows = [(i, f"http://e/{i}\r\n", h, "z") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string")
    from cohortloom.llm.common import new_path

    path = new_path(spark, "test-warc")
    got = {r.page_id: r for r in warc.archive_pages(pages, path, archive_bytes=100_000).collect()}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        keep = None if i is None else max(j for j, g in enumerate(html) if (g or "") == (h or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if keep in (None, i) else ("revisit", keep))
    index = warc.read_index(spark, path)
    (one,) = warc.read_records(spark, path, index.where("page_id = 4")).collect()
    assert warc.parse(bytes(one.record))["payload"] == html[4].encode()
    index = index.collect()
    assert len(index) == len(rows) and {r.record_type for r in index} == {"response", "revisit"}
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_pages_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 200)  # several chunks an archive
    rows = [(5, "A"), (5, "B"), (9, "A"), (12, "B"), (7, "C"), (7, "A"), (9, "A"), (None, "A")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.archive_pages(pages).collect())
    want = []
    for i, h in rows:
        keep = max(j for j, g in rows if g == h and j)
        want.append((i or 0, warc.payload_digest(h.encode()), *(("response", 0) if i in (None, keep) else ("revisit", keep))))
    assert got == sorted(want)


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.archive_pages(pages, least_bytes=4).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_toxicity_of_held_out_documents(spark):
    rows = op10_toxicity(spark, SF).join(table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in held)
    assert hit >= 0.8 * sum(r.toxic for r in held) and hit >= 0.6 * sum(r.predicted for r in held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_edges_and_sentences(spark):
    rows = [(i, "you vile brute. good day to all.\n" if i % 2 else "good day to all. fine weather.", i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "vile brute", "x"), (902, "good day. " * 20000 + "vile brute.", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert got[900].score == got[901].score == 0 and got[1].predicted == 1 and got[2].predicted == 0 and got[902].predicted == 1
    (hit,) = [r for r in toxicity.offending_sentences(docs, model).where("doc_id = 1").collect()]
    assert rows[1][1][hit.start : hit.end] == "you vile brute"
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.train(docs, labels.limit(0)).words == {}
    assert toxicity.score_documents(docs.limit(0), model).collect() == []


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        from cohortloom.llm.common import store

        after = store(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def test_pipeline_stages(staged):
    columns = staged[0][0].columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for before, after in staged[:4]:
        assert after.columns == columns and ids(after) <= ids(before)
    (all_, clean), (_, exact), (_, near), (_, masked), (_, packed) = staged
    texts = {r.doc_id: r.text or "" for r in clean.collect()}
    norm = lambda t: t.encode().lower()
    best = {}
    for i, t in texts.items():
        best[norm(t)] = max(i, best.get(norm(t), -1))
    assert ids(exact) == set(best.values())
    rows = [(i, texts[i]) for i in sorted(ids(exact))]
    kept = ids(near)
    # Of each component of texts alike one stays, the one with the smallest id.
    assert kept == set(plain_components(rows)) and len(kept) < len(rows)
    assert ids(masked) == kept and all(not plain_spans(r.text) for r in masked.collect()) and ids(packed) == kept
    assert len(ids(clean)) >= 0.8 * all_.count()


def test_pipeline_stages_with_null_and_shared_ids(spark, tmp_path):
    near = "one two three four five six seven eight nine ten " * 20
    rows = [(1, "A b"), (9, "a B"), (9, "another text"), (None, "a b"), (None, "lonely words here"), (9, "a B"), (5, near), (6, near + "eleven"), (None, near), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone_key string")
    kept = corpus_pipeline.drop_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    key = lambda df: sorted((r.doc_id or -1, r.text or "") for r in df.collect())
    assert key(kept) == sorted([(9, "a B"), (9, "a B"), (9, "another text"), (-1, "lonely words here"), (5, near), (6, near + "eleven"), (8, "")])
    once = corpus_pipeline.drop_near_copies(spark, kept, SF)
    assert key(once) == sorted(x for x in key(kept) if x[0] != 6)
    masked = corpus_pipeline.mask_personal_data(spark, docs, SF)
    assert masked.columns == docs.columns and key(masked) == key(docs)
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert sorted(r.doc_id or -1 for r in pieces if r.start == 0) == sorted(i or -1 for i, _ in rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert key(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))) == key(docs)
    for stage in (corpus_pipeline.mask_personal_data, corpus_pipeline.pack_sequences, corpus_pipeline.drop_toxic):
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert corpus_pipeline.drop_copies(spark, docs.limit(0), SF).collect() == corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).collect() == []

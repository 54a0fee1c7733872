"""Operators with models, tokens and archives."""

import base64
import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pedalgrid.llm import bpe_codec, language_id, secret_scan, warc_captures


def rows(values):
    return sorted(values, key=repr)


# languages


def test_models_are_distributions():
    """Over all known characters, the probabilities after any seen context sum to one at most, and to
    nearly one where the lower orders know every character."""
    grams, _ = language_id.char_grams(["the cat sat on the mat", "then the hat", "that cat"])
    model = language_id.fit([("en", *language_id.counted(grams))])
    letters = sorted(set(" thecasonmtd") & set("the cat sat on the mat then hat"))
    for context in ("the", " th", "cat", "zzz"):
        keys = [sum(ord(c) << (16 * i) for i, c in enumerate(reversed(context + x))) for x in letters]
        total = np.exp(model.log_probs(np.array(keys, np.uint64))).sum()
        assert 0.8 < total <= 1.0001


def test_hash_array_finds_all():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    table = language_id.HashArray(keys)
    at = table.find(keys)
    assert (at >= 0).all() and (np.sort(at) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1 << 63)) == -1).all()


def test_grams_of_texts():
    grams, offsets = language_id.char_grams(["Ab", "", "12", "É x"])
    shown = ["".join(chr(int(g) >> s & 0xFFFF) for s in (48, 32, 16, 0)) for g in grams]
    assert shown[offsets[0] : offsets[1]] == ["   a", "  ab", " ab "]
    assert offsets[1] == offsets[2] == offsets[3]
    assert shown[offsets[3] :] == ["   é", "  é ", " é x", "é x "]


def test_only_letters_are_letters(spark, sample):
    """Emoji and other symbols beyond the basic plane are none; letters there are."""
    grams, offsets = language_id.char_grams(["🙂🙂 12", "a🙂b", "𐐨"])
    assert np.diff(offsets).tolist() == [0, 4, 2]
    assert grams[offsets[1]] & np.uint64(0xFFFF) == ord("a") and (grams[offsets[1] + 1] & np.uint64(0xFFFF)) == ord(" ")
    asked = spark.createDataFrame([(1, "🙂🙂 🚀 12"), (2, "𝄞 🂡 34"), (3, "🙂")], "doc_id long, text string")
    got = language_id.predict(asked, language_id.train(sample)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_all_of_fold_3_calibrates(spark):
    """More than 2,000 documents of one language there; the limit is the quantile over every one of them."""
    rng = random.Random(4)
    letters = lambda i: "etaoinshrdlu" if i % 100 else "qxzjkvwpybg"
    word = lambda i: "".join(rng.choice(letters(i)) for _ in range(rng.randint(2, 9)))
    texts = [(i, " ".join(word(i) for _ in range(rng.randint(3, 8)))) for i in range(14_000)]
    docs = spark.createDataFrame([(*t, "en") for t in texts], "doc_id long, text string, lang string").repartition(4)
    model = language_id.train(docs)
    held = [t for i, t in texts if zlib.crc32(str(i).encode()) % 4 == 3]
    assert len(held) > 3000
    want = np.quantile(model.entropies(held)[0][:, 0], 1 - language_id.REJECTED)
    assert model.limits[0] == pytest.approx(want, abs=2e-4)


def test_language_accuracy(sample):
    lang = {r["doc_id"]: r["lang"] for r in sample.collect()}
    got = language_id.language_id(sample).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and len(held) > 20
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(edge_docs, collected, no_docs, spark):
    got = language_id.language_id(edge_docs).collect()
    assert len(got) == len(collected)
    for r in got:
        if r["doc_id"] in (0, 1, 2, 3):
            assert r["lang_pred"] in ("und", "en", "de")
    blank = spark.createDataFrame([(1, None, None), (2, "12 34", "en"), (None, "", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.language_id(blank).collect()} == {"und"}
    assert language_id.language_id(no_docs).count() == 0


# secrets


def test_base_spans(edge_docs, collected, as_bag):
    got = as_bag(secret_scan.secret_digests(edge_docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == rows((d, *brute.secrets(t)) for d, t in collected)


def test_base_spans_on_documents(sample, as_bag):
    got = as_bag(secret_scan.secret_digests(sample), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == rows((r["doc_id"], *brute.secrets(r["text"])) for r in sample.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="pasword=:\"' tokenAKIA09fghé_-\n", max_size=80))
def test_base_spans_of_any_text(text):
    spans = [f"{k}:{a}:{z}" for k, a, z, _ in secret_scan.base_spans(text)]
    assert brute.sha(",".join(spans)) == brute.secrets(text)[-1]


def test_automaton_tells_formats_apart():
    rng = random.Random(2)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    machine, least = secret_scan.infer([key() for _ in range(200)])
    assert len(machine.states) < 100
    fresh = [machine.score(key()) >= least for _ in range(200)]
    assert np.mean(fresh) > 0.9
    assert machine.score("chapter-12.section-3.html") < least
    assert secret_scan.infer(["abc"] * 3) is None


def test_learned_spans(spark):
    """A token of a learned format without its surroundings is found; it does not touch base spans."""
    rng = random.Random(6)
    mixed = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24))
    texts = [(i, f"words here secret={mixed()} and more words") for i in range(60)] + [(99, f"see {mixed()} there")]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_digests(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[99] == "format:4:28"
    assert all("format" not in got[i] for i in range(60))


def test_no_secrets(no_docs):
    assert secret_scan.secret_digests(no_docs).count() == 0


# tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe_codec.default_vocabulary())


def digests(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), brute.sha(",".join(map(str, ids))), brute.sha(tokenizer.decode(ids, skip_special_tokens=False))


COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_codec(edge_docs, collected, tokenizer, as_bag):
    got = as_bag(bpe_codec.encode(edge_docs, output="digests"), *COLUMNS)
    assert got == rows((d, *digests(tokenizer, t)) for d, t in collected)


def test_codec_on_documents(sample, tokenizer, as_bag):
    got = as_bag(bpe_codec.encode(sample, output="digests"), *COLUMNS)
    assert got == rows((r["doc_id"], *digests(tokenizer, r["text"])) for r in sample.collect())


def test_round_trip(edge_docs, collected, as_bag):
    back = bpe_codec.decode(bpe_codec.encode(edge_docs))
    assert as_bag(back, "doc_id", "text") == rows((d, t or "") for d, t in collected)


TEXT = st.text(alphabet="ab1.,' \n\t 　é日🙂<|>endoftext\x1c", max_size=60) | st.just("a <|endoftext|> b<|endoftext|>")


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.lists(st.booleans(), min_size=5, max_size=5))
def test_repaired_joins(tokenizer, parts, taken):
    """Whatever the chunks and whichever of them come from elsewhere, the ids are those of the whole."""
    codec = bpe_codec.codec(bpe_codec.default_vocabulary())
    whole, chunks, at = "".join(parts), [], 0
    for part, take in zip(parts, taken, strict=False):
        size = len(part.encode())
        if size and take:
            chunks.append((at, at + size, codec.encode(part)))
        at += size
    want = tokenizer.encode(whole, add_special_tokens=False).ids
    assert codec.encode(whole).tolist() == want
    assert codec.assemble(whole.encode(), chunks).tolist() == want


def test_cuts_follow_content():
    rng = random.Random(9)
    passage = bytes(rng.randrange(97, 123) for _ in range(20_000))
    a, b = bpe_codec.chunk_cuts(b"x" * 777 + passage), bpe_codec.chunk_cuts(b"some other start" + passage)
    common = {c - 777 for c in a.tolist()} & {c - 16 for c in b.tolist()}
    assert len(common) > 5


def test_no_tokens(no_docs):
    assert bpe_codec.encode(no_docs, output="digests").count() == 0


# archives


def pages(spark):
    data = [
        (1, "http://a/1", "<p>one</p>"),
        (2, "http://a/2\r\nX: y", "<p>one</p>"),
        (0, None, "<p>zero\r\n\r\nWARC/1.1\r\nno header</p>"),
        (3, "http://a/3", None),
        (4, "http://a/4", ""),
        (5, "http://ä/5", "<p>é🙂</p>" * 500),
        (None, "http://a/n", "<p>one</p>"),
        (None, "http://a/m", "only here"),
        (5, "http://ä/5", "<p>é🙂</p>" * 500),
    ]
    return data, spark.createDataFrame(data, "page_id long, url string, html string")


def want_pages(data):
    first = {}
    for i, _, html in data:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in data:
        raw, head = (html or "").encode(), first.get(html or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = head is not None and i != head
        out.append((i, len(raw), digest, "revisit" if again else "response", head if again else None))
    return out


def test_captures(spark, as_bag):
    data, df = pages(spark)
    got = as_bag(warc_captures.capture_digests(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == rows(want_pages(data))


def test_captures_on_pages(spark, sf_dir, as_bag):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    data = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    got = as_bag(warc_captures.capture_digests(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == rows(want_pages(data))


def test_nested_rows(spark, tmp_path):
    data, df = pages(spark)
    path = warc_captures.write_archives(df, f"{tmp_path}/warc", per_file=4)
    found = warc_captures.assemble(warc_captures.read_records(spark, path)).collect()
    assert len(found) == len(data)
    texts = rows(r["response"]["payload"] for r in found if r["response"]["record_type"] == "response")
    assert texts == rows(["<p>one</p>", data[2][2], "", data[5][2], data[5][2], "only here"])
    assert all(r["request"]["http_head"].startswith("GET ") and r["metadata"]["fields"]["payload-bytes"] for r in found)


def test_small_payloads_are_always_stored(spark, tmp_path):
    _, df = pages(spark)
    path = warc_captures.write_archives(df, f"{tmp_path}/warc", min_bytes=1000)
    kinds = [r[0] for r in warc_captures.read_records(spark, path).select("record_type").collect()]
    assert kinds.count("revisit") == 0
    assert warc_captures.capture_digests(df.limit(0)).count() == 0

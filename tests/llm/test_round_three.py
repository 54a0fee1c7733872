"""Merkle manifest, spelling variants and window dedup against plain loops."""

import random
import string

import brute
import numpy as np
import pytest

from pedalgrid.llm import count_min_dedup, merkle_manifest, spelling_variants


def rows(values):
    return sorted(values, key=repr)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def fields_of(docs):
    return [tuple(r) for r in docs.select(*FIELDS).collect()]


# op11


def test_manifest(edge_docs, as_bag):
    assert as_bag(merkle_manifest.manifest_digests(edge_docs), *MANIFEST) == rows(brute.merkle(fields_of(edge_docs)))


def test_manifest_of_large_trees(spark, as_bag):
    """Several blocks per tree, a tree of one leaf, a null language, ids out of order and over several ranges."""
    rng = random.Random(1)
    made = [(i, "s", ["a", "b", None][min(i % 7, 2)], i, f"text {i}") for i in range(1500)] + [(5000, None, "z", None, "")]
    rng.shuffle(made)
    docs = spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert as_bag(merkle_manifest.manifest_digests(docs), *MANIFEST) == rows(brute.merkle(made))


@pytest.mark.parametrize("fanout,depth", [(2, 1), (3, 2), (5, 1)])
def test_paths_of_other_shapes(spark, fanout, depth):
    made = [(i, None, "ab"[i % 2], i, str(i)) for i in range(40)]
    docs = spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string")
    leaves = docs.select(
        merkle_manifest.tree_name(docs["lang"]).alias("tree"),
        "doc_id",
        merkle_manifest.leaf_hash(*(docs[c] for c in FIELDS)).alias("h"),
    )
    want = {r[0]: r[1:5] for r in brute.merkle(made, fanout)}
    for r in merkle_manifest.merkle_manifest(leaves, fanout, depth).collect():
        proof = brute.sha("".join(s["left"] + s["right"] for s in r["steps"]))
        assert (r["h"], r["subroot"], r["root"], proof) == want[r["doc_id"]]


def test_manifest_of_nothing(no_docs):
    assert merkle_manifest.manifest_digests(no_docs).collect() == []


def test_manifest_needs_no_shuffle_within_a_block(edge_docs):
    """All levels of a block: one exchange for the blocks, whatever the depth."""
    nodes = edge_docs.selectExpr("'' AS tree", "doc_id AS pos", "100L AS size", "text AS h")
    plan = merkle_manifest.climbed(nodes, 2, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rows_for_verification(edge_docs):
    found = merkle_manifest.document_manifest(edge_docs)
    right = merkle_manifest.folded(found["leaf"], found["steps"]) == found["root"]
    assert found.filter(~right).count() == 0


# op12

VARIANTS = ["word", "n", "n_near", "form", "form_n", "root"]


def test_variants(edge_docs, collected, as_bag):
    counts = brute.word_counts(collected)
    got = as_bag(spelling_variants.spelling_digests(edge_docs), *VARIANTS)
    assert got == rows(brute.variants(counts))


def many_words(rng):
    """Words over few letters, so that many are neighbours, with runs of equal letters and letters beyond ASCII."""
    found = {}
    for _ in range(400):
        word = "".join(rng.choice("aabé÷") for _ in range(rng.randint(7, 9)))
        found[word] = rng.choice([1, 2, 3, 25, 300, 4000])
    return found


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_variants_of_many_words(spark, as_bag, parts):
    """Also with more ranges than words share a range with: prefixes over several borders."""
    counts = many_words(random.Random(parts))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(list(counts.items()), "word string, n long")
        got = as_bag(spelling_variants.spelling_variants(frame), *VARIANTS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute.variants(counts)
    assert got == rows(want)
    assert any(r[5] not in (r[0], r[3]) for r in want)  # chains of forms


def test_nodes_are_prefixes(spark):
    """Equal numbers mean equal prefixes, over all ranges."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(300)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        frame = spark.createDataFrame([(w, w) for w in words], "word string, key string")
        got = spelling_variants.trie_numbers(frame, "key", "nodes").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    number, prefix = {}, {}
    for r in got:
        path = np.frombuffer(r["nodes"], np.int64).tolist()
        assert len(path) == len(r["word"])
        for depth, n in enumerate(path, 1):
            assert number.setdefault(r["word"][:depth], n) == n
            assert prefix.setdefault(n, r["word"][:depth]) == r["word"][:depth]


def test_very_long_words(spark, as_bag):
    rng = random.Random(3)
    long = "".join(rng.choice(string.ascii_lowercase) for _ in range(30_000))
    counts = {long: 2, long[:17_000] + long[17_001:]: 40, long[1:]: 30, "x" * 30_000: 7, "x" * 29_999: 90}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["form_n"]) for r in spelling_variants.spelling_variants(frame).collect()}
    assert got[long] == (2, 40)
    assert got["x" * 30_000] == (1, 90)


def test_variants_of_nothing(no_docs):
    assert spelling_variants.spelling_digests(no_docs).collect() == []


# op13


def test_windows(edge_docs, collected, as_bag):
    got = as_bag(count_min_dedup.window_digests(edge_docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == rows(brute.late_windows(collected))


@pytest.mark.parametrize("width", [1, 2, 7])
def test_short_windows(spark, as_bag, width, monkeypatch):
    """Few different words: many windows repeat, in one document and over several; a crowded sketch."""
    monkeypatch.setattr(count_min_dedup, "MOST_CELLS", 1 << 17)
    rng = random.Random(width)
    made = [(i % 25 if i % 11 else None, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))) for i in range(60)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    out = count_min_dedup.kept_words(docs, width, digest=True)
    assert as_bag(out, "doc_id", "n_words", "n_removed", "kept") == rows(brute.late_windows(made, width))


def test_windows_of_nothing(no_docs):
    assert count_min_dedup.window_digests(no_docs).collect() == []


def test_sketch_never_underestimates(spark):
    """Each window of two documents passes, however small the sketch."""
    rng = random.Random(9)
    shared = " ".join(str(rng.random()) for _ in range(60))
    made = [(i, f"{' '.join(str(rng.random()) for _ in range(80))} {shared if i < 2 else ''}") for i in range(50)]
    docs = count_min_dedup.text_rows(spark.createDataFrame(made, "doc_id long, text string")).selectExpr("*", "false AS no_id")
    bits = count_min_dedup.merged_sketch(docs, 1 << 17)
    passed = count_min_dedup.repeated_windows(docs, bits).groupBy("h1").count().filter("count = 2").count()
    assert passed == 11


def test_least_hash_of_a_window():
    words = count_min_dedup.Words(["a b c d e f g h", "x a b c d e"])
    for width in (1, 2, 3, 5, 6):
        gram = (width + 1) // 2
        grams = words.hashes(np.arange(14 - gram + 1), gram)
        least = words.least(width)
        for i in words.windows(width)[1]:
            assert least[i] == grams[i : i + width - gram + 1].min()

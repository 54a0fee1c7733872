"""Operators on documents against plain loops, on texts with all edge cases and on real ones."""

import math
import random
import zlib

import brute
import compare
import duckdb
import numpy as np
import pytest

from pedalgrid.llm import decontaminate, jaccard_join, license_scan, line_dedup, quality_rules, repeat_spans
from pedalgrid.llm.components import components


def rows(values):
    return sorted(values, key=repr)


def plain(sample):
    return [(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()]


def test_line_dedup(edge_docs, collected, as_bag):
    got = as_bag(line_dedup.line_dedup_digests(edge_docs), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == rows(brute.line_dedup(collected))


def test_line_dedup_keeps_rows_and_columns(edge_docs, collected):
    out = line_dedup.apply_line_dedup(edge_docs, line_dedup.line_dedup(edge_docs))
    assert out.columns == edge_docs.columns
    assert out.count() == len(collected)
    assert out.filter("text IS NULL").count() == 1


def test_first_occurrences_over_partition_borders(spark, as_bag):
    """One line in all documents, sorted over several partitions, and batches of two rows."""
    texts = [(i, f"the very same line\nline number {i} of its own") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = as_bag(line_dedup.line_dedup_digests(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == rows(brute.line_dedup(texts))


def test_bitmap(spark):
    docs = spark.createDataFrame([(1, "a long shared line\nb"), (2, "x\na long shared line\ny")], "doc_id long, text string")
    found = {r["doc_id"]: r["keep_bitmap"] for r in line_dedup.line_dedup(docs).collect()}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(found[2]), np.uint8))[:3]
    assert bits.tolist() == [1, 0, 1]


def test_index_against_counting():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.choice([8, 9, 20])
        base = bytes(rng.choice(b"ab\0") for _ in range(120))
        parts = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, 100)
            part = bytearray(base[a : a + rng.randint(0, 90)])
            for _ in range(rng.randint(0, 3)):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(b"abc")
            parts.append(bytes(part))
        seen = {}
        for p in parts:
            for i in range(len(p) - length + 1):
                seen[p[i : i + length]] = seen.get(p[i : i + length], 0) + 1
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in parts]
        got = [[i for a, z in runs for i in range(a, z)] for runs in repeat_spans.repeated_runs(parts, length)]
        assert got == want


def test_run_compression():
    """Copies add hardly any runs to the transform."""
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(500))
    one, many = repeat_spans.RunIndex([text]), repeat_spans.RunIndex([text] * 20)
    assert len(many.lengths) < 3 * len(one.lengths)
    assert many.lengths.sum() == many.n


@pytest.mark.parametrize("block,largest", [(1 << 20, 1 << 22), (1500, 1500)])
def test_repeats(edge_docs, collected, as_bag, block, largest):
    """Small bounds send groups the way of the divided ones."""
    out = repeat_spans.without_repeats(edge_docs, 40, 16, block, largest, digest=True)
    got = [(d, n, r, s, bytes(k).hex()) for d, n, r, s, k in as_bag(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept")]
    assert rows(got) == rows(brute.repeats(collected, 40))


def test_long_texts_are_cut_without_loss(edge_docs, collected, as_bag, monkeypatch):
    whole = repeat_spans.segments(np.frombuffer(collected[0][1].encode() if collected[0][1] else b"z" * 900, np.uint8), 40, 16)
    assert whole[1][-1] >= whole[0][-1]
    monkeypatch.setattr(repeat_spans, "PIECE", 100)
    data = np.frombuffer((collected[13][1] or "q" * 900).encode(), np.uint8)
    starts = [a + i for a, part in repeat_spans._pieces(data, 40) for i in range(len(part) - 39)]
    assert starts == list(range(len(data) - 39))


def test_repeats_on_documents(sample, as_bag):
    some = sample.limit(60).cache()
    out = repeat_spans.repeat_digests(some)
    got = as_bag(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == rows(brute.repeats(plain(some), 400))


def test_jaccard(edge_docs, collected, as_bag):
    got = as_bag(jaccard_join.jaccard_components(edge_docs), "doc_id", "n_shingles", "component_id")
    assert got == rows(brute.jaccard(collected))


def test_jaccard_large_groups(spark, as_bag, monkeypatch):
    """Near copies of one text, links by chains, and a passage that unrelated texts share."""
    monkeypatch.setattr(jaccard_join, "LONG", 4)
    monkeypatch.setattr(jaccard_join, "HOT", 30)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        texts.append((100 + i, " ".join(copy)))
    chain = [f"k{i}" for i in range(200)]
    texts += [(300 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(20)]
    texts += [(400 + i, " ".join([f"u{i}x{j}" for j in range(40)] + passage)) for i in range(40)]
    for i in range(40):  # around one text, too far from it or from each other to link in part
        copy = list(base)
        for j in rng.sample(range(120), rng.randint(4, 12)):
            copy[j] = f"d{i}x{j}"
        texts.append((500 + i, " ".join(copy)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = as_bag(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    assert got == rows(brute.jaccard(texts))


def test_prefixes_share_enough():
    """Similar sets share at least the smaller l of their prefix tokens."""
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 500, jaccard_join.SKETCH).astype(np.uint64)
    seen = set()
    for _ in range(300):
        n = int(rng.integers(1, 60))
        own = rng.integers(0, 1 << 63, n).astype(np.uint64)
        drop = int(rng.integers(0, n // 4 + 1))
        other = np.concatenate((own[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)))
        own, other = np.unique(own), np.unique(other)
        both = len(np.intersect1d(own, other))
        if 4 * both < 3 * (len(own) + len(other) - both):
            continue
        (p, _, a), (q, _, b) = (jaccard_join.prefix(x, sketch, 250.0) for x in (own, other))
        seen |= {a, b}
        least, overlap = min(a, b), -(-3 * (len(own) + len(other)) // 7)
        _, at, to = np.intersect1d(p, q, return_indices=True)
        assert ((at <= len(own) - overlap + least - 1) & (to <= len(other) - overlap + least - 1)).sum() >= least
    assert len(seen) > 1


def test_within_reach_loses_no_link():
    """Of all lists of some sets: a posting that may count towards a link of similar sizes stays."""
    rng = np.random.default_rng(6)
    tokens = np.sort(rng.integers(0, 40, 300)).astype(np.uint64)
    n, least, places = rng.integers(10, 40, 300), rng.integers(1, 5, 300), rng.integers(0, 12, 300)
    stays = jaccard_join.within_reach(tokens, np.arange(300), (n << 3 | least).astype(np.uint32), places)
    for i in range(300):
        for j in np.flatnonzero(tokens == tokens[i]):
            if i != j and 4 * min(n[i], n[j]) >= 3 * max(n[i], n[j]):
                reach = min(least[i], least[j]) - 1 - -(-3 * (n[i] + n[j]) // 7)
                if places[i] <= n[i] + reach and places[j] <= n[j] + reach:
                    assert stays[i]
    assert not stays.all()


def test_drop_near_copies(edge_docs, collected):
    out = jaccard_join.drop_near_copies(edge_docs)
    assert out.columns == edge_docs.columns
    groups = {c for (_, n, c) in brute.jaccard(collected) if n}
    empty = [1 for _, t in collected if not brute.shingles(t)]
    assert out.count() == len(groups) + len(empty)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (60, 61), (61, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {60: 60, 61: 60}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contamination(spark, edge_docs, collected, as_bag):
    items = [(0, collected[0][1]), (1, None), (2, ""), (3, "one two three"), (None, "never seen in any of these texts at all")]
    items += [(10 + i, " ".join(t.split()[5:45])) for i, (_, t) in enumerate(collected) if t and len(t.split()) > 60]
    items.append(items[-1])
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(edge_docs, table)
    got = set(as_bag(found, "doc_id", "item_id", "n_item", "n_shared"))
    assert got == set(brute.contaminated(collected, items))
    kept = decontaminate.decontaminate(edge_docs, table)
    assert kept.columns == edge_docs.columns
    bad = {t for d, t in collected if brute.contaminated([(d, t)], items)}
    assert kept.count() == sum(t not in bad for _, t in collected)


def test_contamination_recall(spark, sample, sf_dir, as_bag):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(sample, items)
    want = brute.contaminated(plain(sample), [tuple(r) for r in items.select("item_id", "text").collect()])
    assert as_bag(found, "doc_id", "item_id", "n_item", "n_shared") == rows(want)


def test_minhash_search_finds_items_of_all_sizes(spark):
    """Items of 1 to 100 shingles, three quarters of each or all, at the start, in the middle and at the end of long
    documents: the size classes alone find nine in ten of every size, together with the exact rest all."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(10**7)}"
    items, docs = [], []
    for n in (1, 2, 3, 5, 17, 100):
        for i in range(30):
            own = [word() for _ in range(n + 4)]
            items.append((f"{n}-{i}", " ".join(own)))
            part = own[: n + 4 - n // 4] if i % 2 else own
            before = [0, 500, 1000][i % 3]
            text = [word() for _ in range(before)] + part + [word() for _ in range(1000 - before)]
            docs.append((len(docs), " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.contamination(frame, spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, t[0]) for i, t in enumerate(items)}
    for n in (1, 2, 3, 5, 17, 100):
        by_size = [r["by_minhash"] for r in found if r["item_id"].startswith(f"{n}-")]
        assert len(by_size) == 30 and sum(by_size) >= 27


def test_contamination_short_items_in_long_documents(spark, as_bag):
    """Items of 5 to 17 words, whole, or in pieces far apart with one shingle in four lost, in documents of 3,000 words."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    items = [(i, " ".join(words(5 + i % 8 if i < 200 else 30))) for i in range(240)]
    docs = []
    for i, text in items:
        own, fill = text.split(), words(3000)
        if i < 200:
            held = fill[:1500] + own + fill[1500:]
        else:  # 22 of 26 shingles, in two pieces a thousand words apart
            held = fill[:700] + own[:15] + fill[700:2000] + own[15:] + fill[2000:]
        docs.append((i, " ".join(held)))
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    )
    want = brute.contaminated(docs, items)
    assert len(want) == len(items)
    assert as_bag(found, "doc_id", "item_id", "n_item", "n_shared") == rows(want)


def test_looked_up_shingles_meet_every_document():
    for share in (0.1, 0.5, 0.75, 0.8, 1.0):
        for n in range(1, 200):
            least = min(k for k in range(1, n + 1) if k >= share * n)
            assert decontaminate.looked_up(n, share) + least == n + 1


def test_quality_counts(edge_docs, collected, no_labels, as_bag):
    out = quality_rules.quality_digests(edge_docs, no_labels)
    got = as_bag(out, "doc_id", *quality_rules.COUNTS, "kept")
    assert got == rows((d, *brute.quality(t), not brute.quality(t)[-1]) for d, t in collected)


def test_quality_counts_on_documents(sample, no_labels, as_bag):
    got = as_bag(quality_rules.quality_digests(sample, no_labels), "doc_id", *quality_rules.COUNTS)
    assert got == rows((d, *brute.quality(t)) for d, t in plain(sample))


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(0, 10, 0.1), (3, 50, 0.1), (200, 50_000, 0.005), (0, 0, 0.005), (5, 2000, 0.005)]
    for k, n, p in cases:
        row = spark.range(1).select(F.lit(k).cast("long").alias("k"), F.lit(n).cast("long").alias("n"))
        got = row.select(quality_rules.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
        log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        assert got == pytest.approx(sum(map(math.exp, log)), rel=1e-6)


def test_binomial_tail_of_large_holdouts(spark):
    from pyspark.sql import functions as F

    for k, n in [(4700, 1_000_000), (990, 200_000), (0, 400_000)]:
        row = spark.range(1).select(F.lit(k).cast("long").alias("k"), F.lit(n).cast("long").alias("n"))
        got = row.select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.005)).first()[0]
        log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.005) + (n - i) * math.log1p(-0.005) for i in range(k + 1)]
        assert got == pytest.approx(sum(map(math.exp, log)), rel=1e-6)


def holdout(spark, parts):
    """Values and labels of good documents: (language, documents, one in how many has many symbols) each."""
    from pyspark.sql import functions as F

    first, made = 0, []
    for lang, n, every in parts:
        high = F.when(F.pmod("doc_id", F.lit(every)) == 0, 0.9).otherwise(0.0) if every else F.lit(0.0)
        zero = {r: F.lit(0.0) for r in quality_rules.RULES} | {"symbols_per_word": high}
        part = spark.range(first, first + n, 1, 4).withColumnRenamed("id", "doc_id")
        made.append(part.withColumns({"lang": F.lit(lang).cast("string"), "base_failed": F.lit(False)} | zero))
        first += n
    values = made[0]
    for part in made[1:]:
        values = values.unionAll(part)
    return values, values.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))


def test_cutoffs_take_the_whole_holdout(spark):
    """Documents above all symbol cutoffs but the last are 0.45% of the good ones. A cutoff may lose 0.5%:
    400,000 documents show that it does not, 50,000 do not."""
    found = quality_rules.cutoffs(*holdout(spark, [("en", 400_000, 222), ("de", 50_000, 222)])).collect()
    assert {r["stratum"]: r["cut_symbols_per_word"] for r in found} == {"en": 0.02, "de": 1.2}


def test_every_language_is_a_stratum(spark):
    from pyspark.sql import functions as F

    values, labels = holdout(spark, [("en", 70 * 2500, 0)])
    values = values.withColumn("lang", F.format_string("l%02d", F.pmod("doc_id", F.lit(70))))
    found = {r["stratum"] for r in quality_rules.cutoffs(values, labels).collect()}
    assert found == {f"l{i:02d}" for i in range(70)}


def test_strata_without_cutoffs_have_their_rules_off(spark):
    """Good documents of a small and of an unlabelled language, all with many symbols, beside null languages with few."""
    values, labels = holdout(spark, [(None, 6000, 0), ("ja", 100, 1), ("zh", 100, 1), (None, 50, 1)])
    chosen = quality_rules.cutoffs(values, labels.filter("doc_id < 6100"))
    assert [r["stratum"] for r in chosen.collect()] == [quality_rules.POOLED]
    kept = {(r["lang"], r["symbols_per_word"] > 0, r["kept"]) for r in quality_rules.judged(values, chosen).collect()}
    assert kept == {(None, False, True), (None, True, False), ("ja", True, True), ("zh", True, True)}


def test_cutoffs_limit_false_rejection(spark):
    """Many good texts, a few bad ones with marks: the cutoff parts them, and small strata get none."""
    rng = random.Random(1)
    data, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        text = " ".join(f"w{rng.randrange(10**6)}" + ("#" if bad else "") for _ in range(55))
        data.append((i, text, "en" if i % 60 else "xx"))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(8)
    found = quality_rules.quality_digests(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    good = [kept[i] for i, q, _ in labels if q and i % 60]
    assert sum(good) >= (1 - quality_rules.MAX_LOSS) * len(good)
    assert not any(kept[i] for i, q, _ in labels if not q and i % 60)
    assert all(kept[i] for i, _, _ in labels if i % 60 == 0)


def test_quality_stage(edge_docs, collected, no_labels):
    out = quality_rules.quality_rules(edge_docs, no_labels)
    assert out.columns == edge_docs.columns
    assert out.count() == sum(not brute.quality(t)[-1] for _, t in collected)


def test_licenses(edge_docs, collected, as_bag):
    got = as_bag(license_scan.license_scan(edge_docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == rows((d, *brute.licenses(t)) for d, t in collected)


def test_licenses_on_documents(sample, as_bag):
    got = as_bag(license_scan.license_scan(sample), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == rows((d, *brute.licenses(t)) for d, t in plain(sample))


def test_notice_spans(spark):
    mit = license_scan.TEMPLATES["mit"][1]
    changed = mit.replace("a copy of", "any one copy of")  # a word added and one changed
    texts = [(1, f"some words before {mit} and after"), (2, f"x {changed}"), (3, "permission is hereby granted to leave")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_scan(docs).collect()}
    assert got[1] == ("mit", 1.0)
    assert got[2][0] == "mit" and 0.7 < got[2][1] < 1
    assert got[3] == ("", 0.0)


def test_empty_tables(no_docs, no_labels, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.line_dedup_digests(no_docs).count() == 0
    assert repeat_spans.repeat_digests(no_docs).count() == 0
    assert jaccard_join.jaccard_components(no_docs).count() == 0
    assert quality_rules.quality_digests(no_docs, no_labels).count() == 0
    assert license_scan.license_scan(no_docs).count() == 0
    assert decontaminate.contamination(no_docs, items).count() == 0


def test_quality_twin_where_strata_differ(spark, tmp_path):
    """Null languages have cutoffs of their own, another language has too few labels for any: its documents stay."""
    plain_words = " ".join(f"w{i}" for i in range(60))
    many_symbols = " ".join(f"#{i}" for i in range(60))
    made = [(i, plain_words + str(i), None, "s", 1) for i in range(2500)]
    made += [(3000 + i, many_symbols + str(i), None, "s", 1) for i in range(3)]
    made += [(4000 + i, many_symbols + str(i), "de", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.filter("doc_id < 3000 OR doc_id >= 4000").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = quality_rules.quality_digests(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in found.collect()}
    assert not any(kept[3000 + i] for i in range(3)) and all(kept[4000 + i] for i in range(30))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert compare.difference(found, con, quality_rules.SQL) is None

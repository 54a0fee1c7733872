"""Language ID by interpolated Kneser-Ney models over characters.

Learning: every training document gives its character 4-grams, pre-counted per task and summed by
Spark. All counts of all languages give the lower orders (continuation counts), the discounts, and the
interpolated probabilities: one row per n-gram, one number per language. MAX_GRAMS and MAX_CELLS bound what
is sent to the tasks, as arrays sorted by hash. Counts that fit are fitted there as a whole (``fit``). More are
fitted as stored tables (``tables_of``); the arrays then hold the 4-grams seen most often, with the same probabilities.

Prediction: all characters of a text are scored under all languages at once; the language
with the lowest cross-entropy per character is predicted. 4-grams that the arrays lack are counted per text,
looked up in the tables and added, so no n-gram and no language is left out. A language rejects what costs more than
almost all of its own calibration documents (``rejected``; the score falls with the distance).

Folds by crc32(doc_id as text) mod 4: 2 is held out, 3 calibrates, 0 and 1 are counted. Text
is lower-cased, runs of other characters than letters become one space.

Defined results: null text, or a text without letters, is ``und`` with score 0, and so is everything
if nothing could be learned. A null doc_id is held out. Rows are predicted each; equal texts get
equal predictions; equal cross-entropies take the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pedalgrid.llm.common import mix64, text_groups
from pedalgrid.session import cut_lineage

#: Bounds of the arrays that tasks get: rows, and numbers (rows times languages). Tables hold what is beyond.
MAX_GRAMS, MAX_CELLS = 1 << 19, 1 << 22
#: The share of the calibration documents that may be rejected, and the places of their costs that count.
REJECTED, PLACES = 0.005, 4
ORDER = 4
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def char_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, offsets): each 4-gram as one number of four 16-bit characters.

    A text of n cleaned characters, the last one a space, has n grams; spaces stand before it.
    """
    parts = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(parts), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(p) // 4 for p in parts])
    letter = _letters()[codes]
    codes = np.minimum(codes, 0xFFFF)  # stands for all letters beyond the basic plane
    after = np.concatenate(([False], letter[:-1]))
    keep = letter | after  # a letter, or the first other character after one
    codes = np.where(letter, codes, 32).astype(np.uint64)[keep]
    owner = owner[keep]
    n = len(codes)
    grams = codes.copy()
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    place = np.arange(n) - first[owner] if n else np.zeros(0, int)
    for back in range(1, ORDER):
        shifted = np.full(n, 32, np.uint64)
        shifted[back:] = codes[:-back] if n > back else codes[:0]
        shifted[place < back] = 32
        grams |= shifted << np.uint64(16 * back)
    return grams, first


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their (weighted) counts."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
        edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        return values[edge], np.diff(np.append(edge, len(values)))
    order = np.argsort(values, kind="stable")
    values = values[order]
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[edge], np.add.reduceat(weights[order], edge)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}

    def merge(lang):
        parts = held[lang]
        v, n = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        held[lang] = [(v, n)]

    for b in batches:
        for lang, own in b.groupby("lang"):
            texts = own["text"].tolist()
            parts = held.setdefault(lang, [])
            for a, z in text_groups(texts):
                parts.append(counted(char_grams(texts[a:z])[0]))
                if sum(len(p[0]) for p in parts) > 1 << 21:
                    merge(lang)
                    parts = held[lang]
    for lang in held:
        merge(lang)
        v, n = held[lang][0]
        for a in range(0, len(v), 100_000):
            yield pd.DataFrame({"lang": lang, "gram": v[a : a + 100_000].view(np.int64), "n": n[a : a + 100_000]})


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text)."""
    counts = training.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """(gram) of those seen most often in all languages, by a least count: at most ``most``."""
    totals = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    above = W.orderBy(F.desc("n"))  # over distinct counts, not n-grams
    sizes = totals.groupBy("n").agg(F.count("*").alias("grams")).withColumn("upto", F.sum("grams").over(above))
    least = sizes.filter(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return totals.filter(F.lit(False) if least is None else F.col("n") >= least).select("gram")


class HashArray:
    """Keys in the order of their hashes, found by the top bits and a short walk."""

    def __init__(self, keys: np.ndarray):
        hashes = mix64(keys)
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(4, int(len(keys)).bit_length())
        at = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.searchsorted(hashes[self.order], at).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        want = mix64(keys)
        at = self.start[want >> np.uint64(64 - self.bits)]
        got = self.hashes[at]
        behind = np.flatnonzero(got < want)
        while len(behind):
            at[behind] += 1
            more = self.hashes[at[behind]] < want[behind]
            behind = behind[more]
        return np.where(self.hashes[at] == want, at, -1)


@dataclass
class Model:
    languages: list[str]
    #: Per order n: the n-grams with log P(last | rest), and the contexts with the log weight
    #: of the next lower order.
    grams: list[tuple[HashArray, np.ndarray]]
    contexts: list[tuple[HashArray, np.ndarray]]
    unseen: float
    limits: np.ndarray | None = None
    #: Whether the arrays hold all there is; else only 4-grams, and a row of zeros for the others.
    whole: bool = True
    tables: Tables | None = None

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """(n-grams x languages), shorter contexts taken where an n-gram is unknown."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        todo = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            table, values = self.grams[order - 1]
            at = table.find(keys[todo] & _mask(order))
            hit = at >= 0
            if hit.all() and order == ORDER:
                return values[at]
            out[todo[hit]] += values[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if order > 1:
                table, values = self.contexts[order - 1]
                at = table.find((keys[todo] & _mask(order)) >> np.uint64(16))
                out[todo[at >= 0]] += values[at[at >= 0]]
        out[todo] += self.unseen
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) cross-entropy per character, and the characters."""
        grams, offsets = char_grams(texts)
        n = np.diff(offsets)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(n > 0)
        step = max(1, (1 << 22) // max(1, len(self.languages)))
        if len(grams) <= step:
            if len(full):
                out[full] = np.add.reduceat(self.log_probs(grams), offsets[full], axis=0)
        else:
            for i in full:
                for a in range(offsets[i], offsets[i + 1], step):
                    out[i] += self.log_probs(grams[a : min(a + step, offsets[i + 1])]).sum(axis=0, dtype=np.float64)
        return -out / np.maximum(n, 1)[:, None], n

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list]:
        """(texts x languages) log probabilities of the 4-grams in the arrays, the characters, and per text
        the 4-grams that are not there, with their counts."""
        if self.whole:
            costs, n = self.entropies(texts)
            return -costs * np.maximum(n, 1)[:, None], n, [None] * len(texts)
        grams, offsets = char_grams(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        table, values = self.grams[-1]
        at = table.find(grams)
        out = np.zeros((len(texts), len(self.languages)))
        step = max(1, (1 << 22) // len(self.languages))
        for a in range(0, len(grams), step):
            own = owner[a : a + step]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            out[own[first]] += np.add.reduceat(values[at[a : a + step]], first, axis=0, dtype=np.float64)
        parts = [slice(a, z) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        return out, np.diff(offsets), [counted(grams[p][at[p] < 0]) for p in parts]


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (16 * order)) - 1)


def fit(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney from (language, 4-grams, counts): the highest order by count, the lower
    ones by the number of distinct characters seen before."""
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for _, grams, n in counts:
        keys, values = grams, n
        for order in range(ORDER, 0, -1):
            levels[order - 1].append((keys, values.astype(np.float64)))
            keys, values = counted(keys & _mask(order - 1)) if order > 1 else (keys, values)
    tables, contexts = [], []
    lower_keys, lower = np.zeros(1, np.uint64), None
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([k for k, _ in levels[order - 1]]))
        rests = np.unique(union >> np.uint64(16))
        probs = np.zeros((len(union), len(counts)))
        weights = np.ones((len(rests), len(counts)))
        own = np.searchsorted(rests, union >> np.uint64(16))
        base = (
            np.full((len(union), len(counts)), 1.0 / (len(union) + 1))
            if order == 1
            else lower[np.searchsorted(lower_keys, union & _mask(order - 1))]
        )
        for j, (keys, values) in enumerate(levels[order - 1]):
            ones, twos = (values == 1).sum(), (values == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            mine = np.searchsorted(union, keys)
            total = np.bincount(own[mine], values, len(rests))
            kinds = np.bincount(own[mine], minlength=len(rests))
            seen = np.zeros(len(union))
            seen[mine] = np.maximum(values - discount, 0)
            known = total > 0
            weights[known, j] = discount * kinds[known] / total[known]
            probs[:, j] = seen / np.maximum(total[own], 1) + weights[own, j] * base[:, j]
        tables.append((union, probs))
        contexts.append((rests, weights))
        lower_keys, lower = union, probs
    stored = []
    for group in (tables, contexts):
        made = []
        for keys, values in group:
            array = HashArray(keys)
            made.append((array, np.log(np.maximum(values, 1e-12))[array.order].astype(np.float32)))
        stored.append(made)
    return Model([c[0] for c in counts], stored[0], stored[1], float(np.log(1.0 / (len(tables[0][0]) + 1))))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


@dataclass
class Tables:
    """A model as stored tables: per order its n-grams (gram, p) and its contexts (context, w), an array over all languages each."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    unseen: float
    languages: int

    def log_probs(self, wanted: DataFrame) -> DataFrame:
        """(gram, logs) of the 4-grams ``wanted``, by the shorter contexts where one is unknown."""
        log = lambda values: F.transform(values, lambda x: F.log(F.greatest(x, F.lit(1e-12))))
        found, value = wanted.select("gram"), None
        for order in range(1, ORDER + 1):
            key = F.col("gram").bitwiseAND(_bits(order))
            known = self.grams[order - 1].select(F.col("gram").alias("known"), F.col("p").alias(f"p{order}"))
            found = found.join(known, key == F.col("known"), "left").drop("known")
            own = log(F.col(f"p{order}"))
            if value is None:
                value = F.coalesce(own, F.array_repeat(F.lit(self.unseen), self.languages))
                continue
            after = self.contexts[order - 1].select(F.col("context").alias("known"), F.col("w").alias(f"w{order}"))
            found = found.join(after, F.shiftrightunsigned(key, 16) == F.col("known"), "left").drop("known")
            weight = F.col(f"w{order}")
            lower = F.when(weight.isNull(), value).otherwise(F.zip_with(log(weight), value, lambda x, y: x + y))
            value = F.coalesce(own, lower)
        return found.select("gram", value.alias("logs"))
def _bits(order: int) -> Column:
    return F.lit(-1 if order == ORDER else (1 << (16 * order)) - 1).cast("long")


def tables_of(counts: DataFrame, languages: list[str]) -> Tables:
    """:func:`fit` as joins: the probabilities of every 4-gram, and of all lower orders, from all of ``counts``."""

    def dense(value: str, missing: float) -> Column:
        held = F.map_from_entries(F.collect_list(F.struct("lang", value)))
        names = F.array(*(F.lit(x) for x in languages))
        return F.transform(names, lambda x: F.coalesce(F.try_element_at(held, x), F.lit(missing)))

    levels = [counts.select("lang", "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[0].groupBy("lang", F.col("gram").bitwiseAND(_bits(order)).alias("gram"))
        levels.insert(0, cut_lineage(shorter.agg(F.count("*").alias("n")), f"grams-{order}"))
    base = 1.0 / (levels[0].select("gram").distinct().count() + 1)
    grams, contexts = [], []
    for order, level in enumerate(levels, 1):
        rows = level.withColumn("context", F.shiftrightunsigned("gram", 16))
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5)
        kinds = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        after = kinds.join(F.broadcast(level.groupBy("lang").agg(discount.alias("d"))), "lang")  # a row per language
        seen = rows.join(after, ["lang", "context"]).withColumn("s", F.greatest(F.col("n") - F.col("d"), F.lit(0)) / F.col("total"))
        weights = after.withColumn("w", F.col("d") * F.col("kinds") / F.col("total"))
        contexts.append(cut_lineage(weights.groupBy("context").agg(dense("w", 1.0).alias("w")), f"contexts-{order}"))
        known = seen.groupBy("gram", "context").agg(dense("s", 0.0).alias("s")).join(contexts[-1], "context")
        if order == 1:
            p = F.zip_with("s", "w", lambda s, w: s + w * F.lit(base))
        else:
            lower = grams[-1].select(F.col("gram").alias("shorter"), F.col("p").alias("q"))
            known = known.join(lower, F.col("gram").bitwiseAND(_bits(order - 1)) == F.col("shorter"))
            p = F.zip_with("s", F.zip_with("w", "q", lambda w, q: w * q), lambda s, x: s + x)
        grams.append(cut_lineage(known.select("gram", p.alias("p")), f"model-{order}"))
    return Tables(grams, contexts, float(np.log(base)), len(languages))


def model_of(counts: DataFrame) -> Model | None:
    """The model of stored (lang, gram, n): as arrays if all of it fits, else as tables with arrays before them."""
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    most = min(MAX_GRAMS, MAX_CELLS // len(languages))
    if counts.count() <= most:
        found = counts.toPandas().sort_values(["lang", "gram"])
        parts = []
        for lang, own in found.groupby("lang"):
            grams, n = own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy()
            order = np.argsort(grams)
            parts.append((lang, grams[order], n[order]))
        return fit(parts)
    tables = tables_of(counts, languages)
    near = tables.grams[-1].join(frequent(counts, most), "gram").toPandas()
    array = HashArray(near["gram"].to_numpy(np.int64).view(np.uint64))
    values = np.zeros((len(near) + 1, len(languages)), np.float32)  # the last row is of all others
    if len(near):
        values[:-1] = np.log(np.maximum(np.stack(near["p"]), 1e-12))[array.order]
    return Model(languages, [(array, values)], [], tables.unseen, whole=False, tables=tables)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` without their text, with the number of characters n and the costs under all languages per character."""
    beside = [c for c in rows.columns if c != "text"]
    arrays = replace(model, tables=None)  # DataFrames stay with the driver
    shared = rows.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"]]
            for a, z in text_groups(texts, 1 << 19):
                sums, n, others = shared.value.sums(texts[a:z])
                out = b.iloc[a:z][[*beside, "k1", "k2"]].copy()
                out["n"], out["sums"] = n, list(sums)
                out["grams"] = [None if o is None or not len(o[0]) else o[0].view(np.int64) for o in others]
                out["times"] = [None if o is None or not len(o[0]) else o[1] for o in others]
                yield out

    text = F.col("text")
    keyed = rows.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)})  # equal texts cost the same
    kept = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    made = keyed.mapInPandas(
        run, f"{kept}, k1 long, k2 long, n long, sums array<double>, grams array<long>, times array<long>"
    )
    total = F.col("sums")
    if not model.whole:
        made = cut_lineage(made, "scored")
        others = made.filter("grams IS NOT NULL").select("k1", "k2", "grams", "times").dropDuplicates(["k1", "k2"])
        others = others.select("k1", "k2", F.inline(F.arrays_zip("grams", "times")).alias("gram", "times"))
        logs = cut_lineage(model.tables.log_probs(others.select("gram").distinct()), "logs")
        each = (F.sum(F.col("times") * F.get("logs", F.lit(j))) for j in range(len(model.languages)))
        rest = others.join(logs, "gram").groupBy("k1", "k2").agg(F.array(*each).alias("rest"))
        made = made.join(rest, ["k1", "k2"], "left")
        total = F.when(F.col("rest").isNull(), total).otherwise(F.zip_with("sums", "rest", lambda x, y: x + y))
    per = F.greatest("n", F.lit(1))
    return made.select(*beside, "n", F.transform(total, lambda x: -x / per).alias("costs"))


def train(docs: DataFrame) -> Model | None:
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_fold", fold(F.col("doc_id")))
    model = model_of(cut_lineage(gram_counts(labelled.filter("_fold IN (0, 1)")), "gram-counts"))
    if model is None:
        return None
    model.limits = np.full(len(model.languages), np.inf)
    place = F.array_position(F.array(*(F.lit(x) for x in model.languages)), F.col("lang"))
    calibration = scored(labelled.filter("_fold = 3").select("lang", "text"), model).filter((F.col("n") > 0) & (place > 0))
    costs = calibration.select("lang", F.element_at("costs", place.cast("int")).alias("cost"))
    # All of them, as counts of costs rounded up: as many as costs can have, not as there are documents.
    unit = F.lit(float(10**PLACES))
    histogram = costs.groupBy("lang", (F.ceil(F.col("cost") * unit) / unit).alias("cost")).agg(F.count("*").alias("n"))
    limits = histogram.groupBy("lang").agg(F.percentile("cost", F.lit(1 - REJECTED), F.col("n")).alias("limit"))
    for row in limits.collect():
        model.limits[model.languages.index(row["lang"])] = row["limit"]  # a row per language
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected per row of ``docs``."""
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(True)).alias("held_out")
    if model is None:
        return docs.select(
            "doc_id", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"),
        )
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out, "text")  # null stays null in pandas
    low = F.array_min("costs")
    best = F.array_position("costs", low).cast("int")
    costs = scored(rows, model).withColumns({"low": low, "best": best})
    names, limits = (F.array(*(F.lit(x) for x in values)) for values in (model.languages, model.limits.tolist()))
    chances = F.transform("costs", lambda c: F.exp(-F.least("n", F.lit(50)) * (c - F.col("low"))))
    chance = 1 / F.aggregate(chances, F.lit(0.0), lambda x, y: x + y)
    over, none = F.col("low") - F.element_at(limits, F.col("best")), F.col("n") == 0
    return costs.select(
        F.col("doc_id").cast(kind),
        "held_out",
        F.when(none, UNKNOWN).otherwise(F.element_at(names, F.col("best"))).alias("lang_pred"),
        F.when(none, 0.0).otherwise(chance * F.exp(-F.greatest(over, F.lit(0.0)))).alias("score"),
        F.when(~none, F.col("low")).alias("cross_entropy"),
        (none | (over > 0)).alias("rejected"),
    )


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))

"""Secret scan: fixed patterns, and formats learned by grammar inference.

The fixed patterns find credentials by their surroundings or alphabet. What they find is the labelled
sample from which a probabilistic automaton per kind is inferred: the strings form a prefix tree,
and states whose outgoing and ending frequencies agree within a Hoeffding bound are merged (ALERGIA).
Every other long token of every text is then scored by its likelihood per character under
each automaton; what scores like the held-back half of the sample is a span of kind ``format``.

Texts are read once; their spans and candidate tokens are stored, and only these are scored. The
sample is the SAMPLE distinct strings per kind with the smallest hashes; the automata are bounded
by it and sent to the tasks.

Defined results: a null or empty text has no spans. Spans are in code points, end exclusive, by start
and then kind. Base spans may overlap between kinds; a learned span overlaps none of them.
Repeated rows are scanned each. Without base spans nothing is learned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedalgrid.llm.common import text_groups
from pedalgrid.session import cut_lineage

# The base patterns, in the order of their kinds, and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # whole runs of [0-9a-f]+ with 32 characters or more
KINDS = ["assign", "access", "hex", "format"]
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

TOKEN = r"[A-Za-z0-9+/_.=-]{16,}"
TOKEN_LEAST = 16

SAMPLE = 256
#: Confidence of the Hoeffding test, and the share of held-back credentials that may score lower.
ALPHA, MISSED = 0.05, 0.02

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS, _HEX, _TOKEN = re.compile(ACCESS), re.compile(HEX), re.compile(TOKEN)
_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[[i for i in range(128) if re.match("[A-Za-z0-9+/_.=-]", chr(i))]] = True


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of the fixed patterns, in order."""
    found = []
    if "=" in text or ":" in text:
        found += [
            ("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST
        ]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidate_tokens(text: str, spans: list[tuple]) -> list[tuple[int, int, str]]:
    """Long tokens with a digit that no base span touches."""
    return [
        (m.start(), m.end(), m[0])
        for m in _TOKEN.finditer(text)
        if re.search("[0-9]", m[0]) and not any(a < m.end() and m.start() < z for _, a, z, _ in spans)
    ]


def _long_token(texts: list[str]) -> np.ndarray:
    """Whether a text holds a run of token characters as long as a hex string or a candidate."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = np.concatenate(([False], _IN_TOKEN[data]))
    edge = np.diff(inside.astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = first[last - first >= TOKEN_LEAST]
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), first, side="right")] = True
    return out


FOUND = (
    "doc_id string, base array<struct<kind:string,start:long,stop:long,value:string>>, "
    "tokens array<struct<start:long,stop:long,value:string>>"
)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [t if isinstance(t, str) else "" for t in b["text"]]
        for a, z in text_groups(texts):
            own = texts[a:z]
            base, tokens = [], []
            for text, long in zip(own, _long_token(own), strict=True):
                hit = long or "AKIA" in text or ((":" in text or "=" in text) and _ASSIGN.search(text))
                spans = base_spans(text) if hit else []
                base.append([dict(zip(("kind", "start", "stop", "value"), s, strict=True)) for s in spans])
                more = candidate_tokens(text, spans) if long else []
                tokens.append([dict(zip(("start", "stop", "value"), s, strict=True)) for s in more])
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[a:z].to_numpy(), "base": base, "tokens": tokens})


def symbol(ch: str) -> str:
    """Letters by class and range, digits as one, everything else by itself."""
    if ch.isdigit():
        return "0"
    if ch.isalpha():
        return ("a" if ch <= "f" else "g") if ch.islower() else ("A" if ch <= "F" else "G")
    return ch


_CLASS_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}
_CLASSES = 11  # five above, the marks + / _ . = -


class Automaton:
    """A probabilistic automaton inferred from strings."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in strings:
            at = 0
            for c in map(symbol, s):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.taken.append({})
                    self.ends.append(0)
                self.taken[at][c] = self.taken[at].get(c, 0) + 1
                at = self.next[at][c]
            self.ends[at] += 1
        self._merge()

    def _visits(self, q: int) -> int:
        return self.ends[q] + sum(self.taken[q].values())

    def _agree(self, a: int, b: int) -> bool:
        """Whether two states end and go on alike, and so do the states they lead to."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            m, n = self._visits(p), self._visits(q)
            if not m or not n:
                continue
            most = self.bound * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.ends[p] / m - self.ends[q] / n) > most:
                return False
            for c in self.taken[p].keys() | self.taken[q].keys():
                if abs(self.taken[p].get(c, 0) / m - self.taken[q].get(c, 0) / n) > most:
                    return False
                if c in self.next[p] and c in self.next[q] and self.next[q][c] != self.next[p][c]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for c, n in self.taken[q].items():
                self.taken[p][c] = self.taken[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge(self) -> None:
        kept = [0]
        while True:
            edge = [(p, c, q) for p in kept for c, q in self.next[p].items() if q not in kept]
            if not edge:
                break
            p, c, q = max(edge, key=lambda e: (self._visits(e[2]), -e[2]))
            for r in kept:
                if self._agree(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                kept.append(q)
        self.states = kept

    def score(self, text: str) -> float:
        """Mean log-likelihood per character, the end included; -inf if the automaton has no such path."""
        at, total = 0, 0.0
        for ch in text:
            c = symbol(ch)
            n = self._visits(at)
            if c not in self.next[at]:
                return -math.inf
            total += math.log(self.taken[at][c] / n / _CLASS_SIZE.get(c, 1))
            at = self.next[at][c]
        total += math.log((self.ends[at] + 1e-3) / (self._visits(at) + 1e-3 * _CLASSES))
        return total / (len(text) + 1)


def infer(strings: list[str]) -> tuple[Automaton, float] | None:
    """An automaton from one half of the strings; the least score from the other half."""
    if len(strings) < 8:
        return None
    machine = Automaton(strings[::2])
    scores = sorted(s for s in (machine.score(x) for x in strings[1::2]) if s > -math.inf)
    if not scores:
        return None
    return machine, scores[int(MISSED * len(scores))]


def learned_formats(found: DataFrame) -> list[tuple[Automaton, float]]:
    out = []
    values = found.select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct()
    values = cut_lineage(values, "credentials")
    for kind in KINDS[:3]:
        own = values.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
        made = infer([r["value"] for r in own.collect()])  # at most SAMPLE strings
        if made:
            out.append(made)
    return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base and learned spans as arrays of (kind, start, stop, value)."""
    kind = dict(docs.dtypes)["doc_id"]
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # null stays null in pandas
    found = cut_lineage(named.mapInPandas(_scan, FOUND), "secrets")
    formats = found.sparkSession.sparkContext.broadcast(learned_formats(found))

    @F.pandas_udf("array<boolean>")
    def fits(tokens: pd.Series) -> pd.Series:
        known = formats.value
        return tokens.map(
            lambda ts: [any(m.score(t) >= least for m, least in known) for t in ts] if ts is not None else []
        )

    values = F.transform("tokens", lambda t: t["value"])
    some = found.withColumn("_fits", fits(F.when(F.size("tokens") > 0, values)))
    picked = F.filter("tokens", lambda t, i: F.get("_fits", i))
    return some.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "base",
        F.transform(
            F.when(F.size("tokens") > 0, picked).otherwise(F.slice("tokens", 1, 0)),
            lambda t: F.struct(F.lit("format").alias("kind"), t["start"].alias("start"), t["stop"].alias("stop"), t["value"].alias("value")),
        ).alias("learned"),
    )


def secret_digests(docs: DataFrame) -> DataFrame:
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(
        F.concat("base", "learned"),
        lambda s: F.struct(
            s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")
        ),
    )
    return secret_spans(docs).select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(written("base"), 256).alias("base_sha256"),
        written(F.sort_array(keyed)).alias("spans"),
    )

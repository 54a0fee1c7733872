"""Plain loops that say what the operators must return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

BLANKS = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else bytes(data)).hexdigest()


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def none_last(doc_id):
    return (doc_id is None, doc_id if doc_id is not None else 0)


def line_dedup(docs):
    key = lambda line: low(line.strip(BLANKS))
    first = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, none_last(doc_id)), none_last(doc_id))
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == none_last(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def repeats(docs, length):
    raws = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(x[i : i + length] for _, x in raws for i in range(len(x) - length + 1))
    out = []
    for doc_id, x in raws:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((doc_id, len(x), sum(gone), spans, sha(kept)))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(docs):
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = defaultdict(lambda: (True, 0))
    for i, (doc_id, _) in enumerate(docs):
        least[root(i)] = min(least[root(i)] if root(i) in least else none_last(doc_id), none_last(doc_id))
    named = lambda i: None if least[root(i)][0] else least[root(i)][1]
    return [(d, len(sets[i]), named(i)) for i, (d, _) in enumerate(docs)]


def contaminated(docs, items, share=0.75):
    asked = [(i, shingles(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        own = shingles(text)
        out += [(doc_id, i, len(q), len(q & own)) for i, q in asked if q and len(q & own) >= share * len(q)]
    return out


def quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    again = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(again),
        len(w) < 50 or 100 * len(again) > 50 * len(w),
    )


PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def secrets(text):
    text, out = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 16), (2, "hex", "[0-9a-f]+", 32)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    spans = [s for _, _, s in sorted(out)]
    kinds = [s.split(":")[0] for s in spans]
    return (*(kinds.count(k) for k in ("assign", "access", "hex")), sha(",".join(spans)))


def merkle(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return sha("".join(map(field, r)))

    def tree(nodes):
        """Root, and per node the (left, right) siblings of each level."""
        paths, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
        while len(level) > 1:
            for i, p in enumerate(at):
                run = p - p % fanout
                paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + fanout])))
            level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
            at = [p // fanout for p in at]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (none_last(r[0]), leaf(r)))
        made[g] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([made[g][1] for g in order]) if order else (None, [])
    out = []
    for g, upper in zip(order, above, strict=True):
        own, subroot, paths = made[g]
        for r, path in zip(own, paths, strict=True):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for left, right in path + upper:
                h = sha(left + h + right)
            proof = sha("".join(a + b for a, b in path + upper))
            out.append((r[0], leaf(r), subroot, root, proof, h, h == root))
    return out


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(count, least=2, ratio=10):
    """(word, n, n_near, form, form_n, root) of word counts."""
    words = {w: n for w, n in count.items() if n >= least}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return [(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()]


def word_counts(docs, least=7, deleted=31):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % deleted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    return count


def late_windows(docs, width=50):
    split = [(none_last(d), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(first.get(key, d), d)
    out = []
    for (doc_id, _), (d, w) in zip(docs, split, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out

"""Plain versions of the operators over lists of rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import regex

UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def words(text):
    return WORD.findall(text or "")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeat_words(w):
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    return len({i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)})


def quality(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    out = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(w),
    }
    out["base_failed"] = len(w) < 50 or 100 * out["n_repeat_words"] > 50 * len(w)
    letters = sum(c.isalpha() for c in t)
    bullets = sum(bool(re.match(r"[ \t]*[-*•]", x)) for x in t.split("\n"))
    unspaced = sum(bool(UNSPACED.match(c)) for c in t)
    bad = (out["word_chars"] < 2 * len(w) or (out["word_chars"] > 20 * len(w) and (len(t) - unspaced) * 2 > len(t)) or out["n_symbols"] * 10 > len(w)
           or out["n_dup_lines"] * 10 > len(lines) * 3 or letters * 2 < out["word_chars"] or bullets * 10 > len(lines) * 9)
    out["kept"] = not out["base_failed"] and not bad
    return out


def gram_set(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def groups(docs, similarity=0.8):
    """Per text with a word: smallest id, number of linked texts, smallest id of its group."""
    first = {}
    for i, t in docs:
        if gram_set(t):
            first[t] = min(first.get(t, LAST), LAST if i is None else i)
    texts = list(first)
    sets = [gram_set(t) for t in texts]
    root, links = list(range(len(texts))), Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = defaultdict(lambda: LAST)
    for i, t in enumerate(texts):
        low[find(i)] = min(low[find(i)], first[t])
    return {t: (first[t], links[i], low[find(i)]) for i, t in enumerate(texts)}


def without_repeats(docs, n=13):
    """(id, words, removed, kept words joined) of each (id, text)."""
    order = sorted(docs, key=lambda r: LAST if r[0] is None else r[0])
    first, out = {}, []
    for i, t in order:
        w, key = words(t), LAST if i is None else i
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first.setdefault(tuple(w[p:p + n]), key) < key:
                gone[p:p + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            new[j + 1] = max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1)
        best, row = max(best, max(new)), new
    return best


def contaminated(text, items):
    """Items (id -> text) whose whole-text alignment is good enough."""
    w = words(lower(text))
    out = set()
    for i, t in items.items():
        a = words(lower(t))
        if a and set(zip(a, a[1:], a[2:])) & set(zip(w, w[1:], w[2:])) and smith_waterman(a, w) >= 0.5 * min(2 * len(a), 60):
            out.add(i)
    return out


def runs(w, shortest=12):
    """Maximal runs (start, length, smallest period) of a list of words."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(shortest, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def made_periodic(doc_id, w):
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def run_columns(doc_id, text):
    w = made_periodic(doc_id, words(text))
    found = runs(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def nearest(rows, query, k):
    """(vec_id, score) of the largest inner products; rows are (vec_id, vector), the query's own left out once."""
    rest = list(rows)
    rest.remove(query)
    scored = [(i, sum(float(a) * float(b) for a, b in zip(query[1], v))) for i, v in rest]
    return sorted(scored, key=lambda r: (-r[1], r[0]))[:k]


def hard_negatives(rows, is_anchor, k=5):
    """Rows (vec_id, label, vector) to tuples of anchor, positive, rank, negative and both scores."""
    size = max((len(v) for _, _, v in rows), default=0)
    whole = [(i, c, [math.floor(256 * x) for x in v] + [0] * (size - len(v))) for i, c, v in rows]
    place = lambda r: (-r[0], LAST if r[1] is None else r[1], r[2])
    out = []
    for n, (i, c, v) in enumerate(whole):
        if not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, u)), j, m, d) for m, (j, d, u) in enumerate(whole) if m != n]
        scored.sort(key=place)
        for p in [s for s in scored if s[3] == c][:k]:
            inside = [s for s in scored if s[3] != c and 80 * p[0] <= 100 * s[0] <= 100 * p[0]][:k]
            out += [(i, p[1], r + 1, s[1], p[0], s[0]) for r, s in enumerate(inside)]
    return out

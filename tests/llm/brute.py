"""Plain versions of the operators, for small tables."""

import base64
import hashlib
import re
from collections import defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def base32_sha1(raw):
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def substring_dedup(rows, width):
    """[(id, n_words, n_removed, sha)] in input order; a null id is larger than any other."""
    key = lambda i: float("inf") if i is None else i
    words = [SPACE_WORDS.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - width + 1):
            g = tuple(w[s : s + width])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < key(i):
                gone |= set(range(s, s + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def suffix_dedup(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = defaultdict(int)
    for t in texts:
        for s in range(len(t) - length + 1):
            count[t[s : s + length]] += 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        out.append((i, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(t, gone) if not g))))
    return out


def contamination(rows, items, window):
    wins = defaultdict(set)
    for i, t in items:
        w = FOLD_WORDS.findall(lower(t))
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[s : s + k])].add(i)
    out = []
    for i, t in rows:
        w = FOLD_WORDS.findall(lower(t))
        hit, owners = set(), set()
        for g, own in wins.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    owners |= own
        out.append((i, len(w), len(hit), sorted(str(x) for x in owners if x is not None)))
    return out


def shingle_set(text, width):
    w = SPACE_WORDS.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def near_components(rows, width, percent):
    """(smallest id reachable, or None) per row."""
    sets = [shingle_set(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                top[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [min(least[find(k)], default=None) for k in range(len(rows))], [len(s) for s in sets]


def capped_targets(sizes, weights, share, epochs):
    left, rest, out = share * sum(sizes.values()), dict(weights), {}
    while rest:
        total = sum(rest.values())
        over = [s for s, w in rest.items() if left * w / total > epochs * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in rest.items()}
        given = {s: epochs * sizes[s] for s in over}
        out |= given
        left -= sum(given.values())
        rest = {s: w for s, w in rest.items() if s not in given}
    return out


def sainte_lague(votes, seats):
    got = {k: 0 for k in votes}
    for _ in range(seats):
        best = max(votes, key=lambda k: (votes[k] / (2 * got[k] + 1), [-ord(c) for c in k]))
        got[best] += 1
    return got


TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def license_scan(rows, phrases, templates, threshold, stride):
    """[(id, n_words, places, labels, score)]: every block against every template."""
    out = []
    for i, t in rows:
        w = FOLD_WORDS.findall(lower(t))
        places = sorted((s, label) for label, p in phrases for s in range(len(w)) if p.split() and w[s : s + len(p.split())] == p.split())
        found, best = {label for _, label in places}, 0.0
        for b in range(0, max(1, len(w)), stride):
            block = set(w[b : b + 2 * stride])
            for label, p in templates:
                need = set(p.split())
                share = len(need & block) / len(need) if need else 0
                if need and share >= threshold - 1e-9:
                    found.add(label)
                    best = max(best, share)
        out.append((i, len(w), places, sorted(found), 1.0 if places else best))
    return out


def divergence(rows, min_docs, top):
    """{(lang, source, part, item, value, rank)} of (lang, source, text) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count, groups = defaultdict(int), defaultdict(int), {(r[0], r[1]) for r in rows}
    for lang, source, text in rows:
        terms = TERMS.findall(lower(text))
        for t in set(terms):
            docs[lang, t] += 1
        for t in terms:
            count[lang, source, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)
        own = sorted(s for x, s in groups if x == lang)
        n = {s: {t: count.get((lang, s, t), 0) for t in kept} for s in own}
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))
        p = {s: {t: share(n[s][t], sum(n[s].values())) for t in kept} for s in own}
        whole = sum(sum(n[s].values()) for s in own)
        q = {t: share(sum(n[s][t] for s in own), whole) for t in kept}
        for s in own:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            ahead = [(p[s][t] - q[t], t) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", ahead)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[: top if part == "term" else None]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def alignment(rows, a, a_bytes, b, b_bytes):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)], whole texts, token by token."""
    found = []
    for i, text in rows:
        raw = b" " + (text or "").encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or b"".join(a_bytes[t] for t in x) != raw or b"".join(b_bytes[t] for t in y) != raw:
            found.append((i, [], [], [], ""))
            continue
        spans = []
        for ids, sizes in ((x, a_bytes), (y, b_bytes)):
            end, out = 0, []
            for t in ids:
                out.append((end, end + len(sizes[t]), t))
                end += len(sizes[t])
            spans.append(out)
        links, k = [], 0
        for lo, hi, t in spans[0]:
            while spans[1][k][1] <= lo:
                k += 1
            j = k
            while j < len(y) and spans[1][j][0] < hi:
                links.append((t, spans[1][j][2]))
                j += 1
        ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(t) for s, e, t in side if lo < e <= hi) for side in spans))
            lo = hi
        found.append((i, x, y, links, ";".join(groups)))
    docs = defaultdict(int)
    for f in found:
        for pair in set(f[3]):
            docs[pair] += 1
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    return [(i, len(x), len(y), g.count(";") + bool(g), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), sha(g) if g else "")
            for i, x, y, links, g in found]

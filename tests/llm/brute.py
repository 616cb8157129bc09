"""Plain versions of the operators for small inputs."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_words(text):
    return (text or "").encode().translate(LOWER).split()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m)) <= 15),
]


def pii(text):
    found = sorted((m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(PII) for m in re.finditer(p, text or "") if ok(m[0]))
    counts = Counter(f[2] for f in found)
    return *(counts[k] for k, _, _ in PII), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()


def redacted(text):
    """The text with the base kinds' spans replaced; overlapping ones become one."""
    if text is None:
        return None
    out, at = [], 0
    for start, _, kind, end in sorted((m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(PII) for m in re.finditer(p, text) if ok(m[0])):
        if end > at:
            out.append(text[at:start] + f"[{kind.upper()}]" if start >= at else "")
            at = end
    return "".join(out) + text[at:]


def pipeline(rows, trusted, buckets, least):
    """(id, redacted text) of the rows that the first three stages keep, from (id, text)."""
    ids = {n: i for n, (i, _) in enumerate(rows)}
    score = importance([(n, t) for n, (_, t) in enumerate(rows)], {n for n, i in ids.items() if i in trusted}, buckets)
    good = [(i, t) for n, (i, t) in enumerate(rows) if not rules(t)[5] and score[n] >= least]
    group = components([r for r in good if r[0] is not None], 5)
    return [(i, redacted(t)) for i, t in good if i is None or group[i][1] == i]


def secrets(text):
    text = text or ""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.A) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    found.sort()
    counts = Counter(k for _, k, _ in found)
    return counts[0], counts[1], counts[2], hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered), n < 10 or 100 * len(covered) > 20 * n


def importance(rows, trusted, buckets):
    """Score by id, from (id, text)."""
    grams = {}
    for i, text in rows:
        codes = [zlib.crc32(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        grams[i] = [c % buckets for c in codes] + [(a * 31 + b) % buckets for a, b in zip(codes, codes[1:])]
    raw, target = Counter(), Counter()
    for i, own in grams.items():
        raw.update(own)
        if i in trusted:
            target.update(own)
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    weight = lambda g: math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw)
    return {i: sum(map(weight, own)) / len(own) if own and n_target > buckets else 0.0 for i, own in grams.items()}


def components(rows, size):
    """(set size, smallest id reachable) by id, from (id, text)."""
    sets = {}
    for i, text in rows:
        words = lower_words(text)
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
    having, parent = defaultdict(list), {i: i for i in sets}
    for i, own in sets.items():
        for x in own:
            having[x].append(i)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        shared = Counter(j for x in own for j in having[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(own), top(i)) for i, own in sets.items()}


def language_model(rows):
    """(held_out, n_tokens, n_known, train_tokens, base, score) by id, with an unquantised model."""
    tokens = {i: [*lower_words(t), b" "] for i, t in rows}
    trained = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for i in trained for w in tokens[i])
    pairs = Counter(p for i in trained for p in zip([b" ", *tokens[i]], tokens[i]))
    types = Counter(a for a, _ in pairs)
    n, v = sum(count.values()), len(count)
    base = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))
    model = lambda a, w: max(pairs[a, w] - 0.75, 0) / count[a] + 0.75 * types[a] / count[a] * base(w) if count[a] else base(w)
    return {i: (zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), sum(math.log10(model(a, w)) for a, w in zip([b" ", *t], t))) for i, t in tokens.items()}


def trigram_scores(rows):
    """Score by id, with an unquantised trigram model; a document's first word has one context, the end."""
    tokens = {i: [b" ", *lower_words(t), b" "] for i, t in rows}
    trained = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for i in trained for w in tokens[i][1:])
    n, v = sum(count.values()), len(count)
    grams = Counter(tuple(tokens[i][k : k + size]) for i in trained for size in (2, 3) for k in range(len(tokens[i]) - size + 1))
    total, types = Counter(), Counter()
    for g, c in grams.items():
        total[g[:-1]] += c
        types[g[:-1]] += 1

    def p(context, w):
        if not context:
            return (count[w] + 0.1) / (n + 0.1 * (v + 1))
        shorter, own = p(context[1:], w), total[context]
        return max(grams[(*context, w)] - 0.75, 0) / own + 0.75 * types[context] / own * shorter if own else shorter

    return {i: sum(math.log10(p(tuple(t[max(0, k - 2) : k]), t[k])) for k in range(1, len(t))) for i, t in tokens.items()}


def warc(pages):
    """Sorted result rows from (page_id, html), ids not null."""
    first = {}
    for i, html in sorted(pages):
        first.setdefault(html or "", i)
    rows = []
    for i, html in pages:
        payload, origin = (html or "").encode(), first[html or ""]
        rows.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if origin == i else "revisit", None if origin == i else origin))
    return sorted(rows)


def packing_faults(rows, lengths):
    """What is wrong with pieces, given each document's number of ids."""
    faults, by_doc, by_sequence = [], defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    if set(by_doc) != set(lengths):
        faults.append("documents")
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            if r.start != at or r.doc_tokens != lengths[doc] or r.length < 1:
                faults.append(r)
            at += r.length
        if at != lengths[doc]:
            faults.append(doc)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            if r.offset != at:
                faults.append(r)
            at += r.length
        if at > 1024:
            faults.append("too long")
    return faults


def resampled(rows, targets, percent, least, seed, buckets):
    """{id: (n_features, weight, score, rank)} of (id, text); ids are distinct."""
    def feats(text):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
        return len(w), [zlib.crc32(f) % buckets for f in w + [a + b" " + b for a, b in zip(w, w[1:])]]

    own = {i: feats(t) for i, t in rows}
    raw, aim = Counter(b for _, f in own.values() for b in f), Counter(b for t in targets for b in feats(t)[1])
    s, t = sum(raw.values()) + buckets, sum(aim.values()) + buckets
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * s / ((raw[b] + 1) * t))) for b in raw}
    out, order = {}, []
    for i, (n, f) in own.items():
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(f), weight, score, None]
        if n >= least:
            order.append((-score, i is None, i or 0, i))
    for place, (*_, i) in enumerate(sorted(order)[: len(order) * percent // 100]):
        out[i][3] = place + 1
    return {i: tuple(v) for i, v in out.items()}


def searched(rows, queries, k):
    """[(item, rank, id, score)] of (id, text) and (item, text); rows of one item are one query."""
    def terms(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))

    docs = [(i, Counter(terms(t))) for i, t in rows if i is not None]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(own for *_, own in docs)
    df, asked, out = Counter(w for _, c, _ in docs for w in c), defaultdict(set), []
    for item, text in queries:
        if item is not None:
            asked[item].update(terms(text))
    for item, words in sorted(asked.items()):
        scores = []
        for i, c, own in docs:
            norm = 10 + 90 * own * n // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * norm)) for w in words if w in c), i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(s for s in scores if s[0] < 0)[:k])]
    return out


def mixed(rows, weights, share, most, seed):
    """Sorted (id, size, source_size, target, copies) of (id, source, size)."""
    def uniform(*names):
        digest = hashlib.sha256(":".join(map(str, (seed, *names))).encode()).hexdigest()
        return (int(digest[:12], 16) + 0.5) / (1 << 48)

    def size_class(n):
        e = n.bit_length() - 1
        return e * 64 + ((n >> (e - 6)) - 64 if e >= 6 else n)

    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), share * sum(sizes.values())
    while True:
        each = rest / sum(weight[s] for s in open_) if open_ else 0.0
        full = {s for s in open_ if each * weight[s] > most * sizes[s]}
        if not full:
            break
        rest -= sum(most * sizes[s] for s in full)
        target |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
    target |= {s: each * weight[s] for s in open_}
    out = []
    for s in order:
        ratio = target[s] / sizes[s] if sizes[s] else 0.0
        whole, fraction = math.floor(ratio), ratio - math.floor(ratio)
        classes = defaultdict(list)
        for i, source, n in rows:
            if source == s:
                classes[size_class(n) if n else -1].append((uniform("" if i is None else i), n, i))
        over = 0.0
        for c in sorted(classes, reverse=True):
            draw = 0
            if c >= 0:
                words, n = sum(x[1] for x in classes[c]), len(classes[c])
                want = over + fraction * words
                draw = min(max(math.floor(want / (words / n) + uniform("" if s is None else f"={s}", c)), 0), n)
                over = want - draw * (words / n)
            out += [(i, n, sizes[s], target[s], whole + (place < draw)) for place, (_, n, i) in enumerate(sorted(classes[c], key=lambda x: x[:2]))]
    return out

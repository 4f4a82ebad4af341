"""Plain Python versions of the operators, for small fixtures."""

import collections
import hashlib
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def near_groups(rows, percent=75):
    """{id: (shingles, least id reachable)}"""
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for x in sets[i] for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in sets[i]:
            holders[x].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def without_repeats(rows, width=20):
    """{id: (words, removed, hash of what stays)}"""
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        hit = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[s : s + width]), (i, s)) != (i, s):
                hit[s : s + width] = [True] * width
        kept = b" ".join(x for x, h in zip(w, hit, strict=True) if not h)
        out[i] = (len(w), sum(hit), hashlib.sha256(kept).hexdigest())
    return out


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def code_length(tree, text, order=4):
    """Bits of a text under counts {context: {byte: n}}, escape method C."""
    import math

    x, total = b" " * order + text, 0.0
    for i in range(order, len(x)):
        for k in range(order, -1, -1):
            seen = tree.get(x[i - k : i])
            if seen is None:
                continue
            n = sum(seen.values())
            if x[i] in seen:
                total += math.log2((n + len(seen)) / seen[x[i]])
                break
            total += math.log2((n + len(seen)) / len(seen))
        else:
            total += 8
    return total


def tree_of(texts, order=4):
    tree = collections.defaultdict(collections.Counter)
    for t in texts:
        x = b" " * order + t
        for i in range(order, len(x)):
            for k in range(order + 1):
                tree[x[i - k : i]][x[i]] += 1
    return tree


def rebuilt(rows):
    """{conv_id: [(role, text)]} of rows (conv_id, turn, role, text), with the contract's shared starts"""
    import zlib

    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def trie(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, hash)}"""
    seqs = rebuilt(rows)
    members = collections.defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len([w for w in re.split("[\x20\x09-\x0d]+", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    return {
        (m[0], len(p)): (
            members[p[:-1]][0] if p else None,
            len(m),
            kids[p],
            leaves[p],
            saved[p],
            hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    }


def chat_digests(rows):
    """{conv_id: (turns, hash, loss characters, hash)}"""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, v in own.items():
        v = [x[2:] for x in sorted(v)]
        loss = "".join(t for r, t in v if r == "assistant")
        out[c] = (
            len(v),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in v).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return out


def spelling_variants(rows):
    """{word: (form, root, n, n_near, form_n)}"""
    import zlib

    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near = {w: set() for w in n}
    stars = collections.defaultdict(list)
    for w in n:
        for k in range(len(w)):
            stars[(w[:k], w[k + 1 :])].append(w)
            if w[:k] + w[k + 1 :] in n:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in stars.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    best = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}

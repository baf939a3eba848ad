"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

ORDER = lambda i: (i is None, i)  # noqa: E731  null ids count as largest


def exact(rows):
    """rows: (id, text) -> per row (keep_id, group_size, kept); the first of equal rows stays."""
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((ORDER(i), at))
    out = {}
    for members in groups.values():
        best = min(members)
        for _, at in members:
            out[at] = (rows[best[1]][0], len(members), at == best[1])
    return [out[k] for k in range(len(rows))]


def substring(rows, window=20):
    """rows: (id, text) -> kept words of each."""
    words = [(t or "").encode().split() for _, t in rows]
    first, flagged = {}, set()
    for _, at in sorted((ORDER(i), at) for at, (i, _) in enumerate(rows)):
        for s in range(len(words[at]) - window + 1):
            key = tuple(words[at][s : s + window])
            if key in first:
                flagged |= {(at, s + k) for k in range(window)}
            else:
                first[key] = (at, s)
    return [b" ".join(w for k, w in enumerate(ws) if (at, k) not in flagged).decode() for at, ws in enumerate(words)]


def fold(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination(rows, items, n=10):
    """rows: (id, text), items: (id, text) -> (n_words, positions hit, item ids as text) of each row."""
    patterns = defaultdict(set)
    for item, text in items:
        ws = fold(text)
        if ws:
            for k in range(max(1, len(ws) - n + 1)):
                patterns[tuple(ws[k : k + n])].add(None if item is None else str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for _, text in rows:
        ws, hit, found = fold(text), set(), set()
        for m in sizes:
            for k in range(len(ws) - m + 1):
                if (got := patterns.get(tuple(ws[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    found |= got
        out.append((len(ws), hit, found))
    return out


def bag(text, n=5):
    ws = (text or "").encode().split()
    return Counter(tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))) if ws else Counter()


def near_classes(rows, threshold=0.8):
    """rows: (id, text) -> class (least member row) of each, from all pairs."""
    bags = [bag(t) for _, t in rows]
    sizes = [sum(b.values()) for b in bags]
    common, where = Counter(), defaultdict(list)
    for at, b in enumerate(bags):
        for g, c in b.items():
            for other in where[g]:
                common[other, at] += min(c, bags[other][g])
            where[g].append(at)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for (a, b), c in common.items():
        if c >= threshold * (sizes[a] + sizes[b] - c):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for at in range(len(rows)):
        members[find(at)].append(at)
    out = {}
    for group in members.values():
        best = min(group, key=lambda at: (ORDER(rows[at][0]), at))
        out |= dict.fromkeys(group, best)
    return [out[k] for k in range(len(rows))]


def best_fit(items, capacity, bins):
    """Loads of the bins after best fit of items in falling order; None if they don't fit."""
    loads = []
    for x in items:
        open_ = [(capacity - load, k) for k, load in enumerate(loads) if capacity - load >= x]
        if open_:
            loads[min(open_)[1]] += x
        elif len(loads) < bins and x <= capacity:
            loads.append(x)
        else:
            return None
    return loads


def near_equal(items, shards, slack=0.01):
    """Loads of the shards: items above the mean alone, the rest in the least capacity found by doubling and halving."""
    items, done = sorted(items, reverse=True), []
    while items:
        room = shards - len(done)
        if room > 1 and items[0] * room > sum(items):
            done.append(items.pop(0))
            continue
        base, low, extra = max(-(-sum(items) // room), items[0]), -1, 0
        while best_fit(items, base + extra, room) is None:
            low, extra = extra, max(1, extra * 2)
        while extra - low > 1:
            middle = (low + extra) // 2
            if best_fit(items, base + middle, room) is None:
                low = middle
            else:
                extra = middle
        loads = best_fit(items, base + extra, room)
        if len(loads) < room or min(loads) * room < (1 - slack) * sum(items):
            raise NotImplementedError("uneven loads: settle the fullest bin only")
        return [*done, *loads]
    return done


def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()

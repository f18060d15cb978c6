"""Plain Python versions of what the operators compute, for small tables."""

import collections
import hashlib
import re

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(f[1] == k for f in found) for k in range(3)], sha(joined)


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
             ("card", CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", PHONE, lambda m: 8 <= len(digits(m)) <= 15)]
    found = [(name, *m.span()) for name, pattern, good in kinds for m in pattern.finditer(text) if good(m)]
    return [sum(f[0] == k[0] for f in found) for k in kinds], sha(",".join(f"{a}:{b}:{c}" for a, b, c in found))


def repeats(texts, length):
    """n_bytes, n_removed, n_spans, kept sha of each text, in the given order."""
    seen, out = set(), []
    for data in texts:
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if (s := data[i:i + length]) in seen:
                covered[i:i + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(data), sum(covered), runs, sha(bytes(x for x, c in zip(data, covered) if not c))))
    return out


def shingles(text):
    words = WORDS.findall(text or "")
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(texts, threshold=0.8):
    """Links of every document and the smallest id of its class, from {doc_id: text}."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    links, parent = collections.Counter(), {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        common = collections.Counter(o for x in s for o in holders[x])
        for o, n in common.items():
            if o != k and n >= threshold * (len(s) + len(sets[o]) - n) - 1e-9:
                links[k] += 1
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
    return links, {k: root(k) for k in sets}


def targets(sizes):
    """Target of every source by resharing until nothing is above its cap; sizes by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, left = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        level = left / max(sum(weight[s] for s in free), 1)
        above = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not above:
            return capped | {s: weight[s] * level for s in free}
        for s in above:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]

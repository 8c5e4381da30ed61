"""The operators once more, as plainly as can be, for comparison."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A, Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(A, Z)


def line_dedup(rows):
    """(id, text) to id, text, n_lines, n_dropped."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), (True, 1)), order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shingles(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2)))


def similar(rows):
    """(id, text) to (n_shingles, n_similar, component: the least row that is reached)."""
    sets = [shingles(t) for _, t in rows]
    count, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 70 * (len(sets[a]) + len(sets[b]) - i):
            count[a] += 1
            count[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [(len(s), c, root(k)) for k, (s, c) in enumerate(zip(sets, count))]


def token_ids(texts, path, specials_as_text=False):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = specials_as_text
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def repeated_words(words):
    places = defaultdict(list)
    for k in range(len(words) - 7):
        places[tuple(words[k : k + 8])].append(k)
    return len({k + j for p in places.values() if len(p) > 1 for k in p for j in range(8)})


def base_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def earliest_deadlines(blocks, weights):
    """(source, block) to phase, slot, release and deadline: each slot looks at all sources."""
    done, slot, out, phase = [0] * len(blocks), 0, {}, 0
    active = [s for s, n in enumerate(blocks) if n]
    while active:
        whole, first, t = sum(weights[s] for s in active), list(done), 0
        while True:
            k = {s: done[s] - first[s] for s in active}
            due = {s: (-(-(k[s] + 1) * whole // weights[s]), -weights[s], s) for s in active if k[s] * whole // weights[s] <= t}
            s = min(due, key=due.get)
            out[s, done[s]] = phase, slot + t, slot + k[s] * whole // weights[s], slot + due[s][0]
            done[s] += 1
            t += 1
            if done[s] == blocks[s]:
                break
        active.remove(s)
        slot, phase = slot + t, phase + 1
    return out

"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(rows):
    """rows: (id, text) with unique ids -> {id: (shingles, smallest id of the component)}"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_repeats(rows):
    """rows: (id, text) -> {id: (words, removed, kept text)}"""
    least, out = {}, {}
    for i, t in sorted(rows):
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            if least.setdefault(tuple(w[k:k + 50]), i) < i:
                gone.update(range(k, k + 50))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


KINDS = ["assign", "access", "hex", "prefixed", "key"]
ASSIGN = re.compile(r"(?:%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k).replace("_", "_?")
    for k in ("password", "passwd", "secret", "token", "api_key")))
ADDED = [re.compile(r"(?:gh[pousr]_|xox[abprs]-|sk-|glpat-|eyJ)[A-Za-z0-9_.-]{16,}"),
         re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}")]


def base_spans(text):
    t = text or ""
    out = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]


def secret_spans(rows, max_owners=3):
    """rows: (id, text, owner) -> {id: spans (start, kind, end), base ones and live added ones}"""
    found, owners = {}, defaultdict(set)
    for i, t, owner in rows:
        found[i] = base_spans(t) + [(m.start(), k, m.end(), m[0]) for k, p in enumerate(ADDED, 3)
                                    for m in p.finditer(t or "") if len(m[0]) >= (20 if k == 3 else 24)]
        for s in found[i]:
            owners[s[3]].add(owner)

    def live(v):
        return len(owners[v]) <= max_owners and len(set(v)) >= 8 and re.search("[0-9]", v) and re.search("[A-Za-z]", v)
    return {i: sorted(s[:3] for s in ss if s[1] < 3 or live(s[3])) for i, ss in found.items()}


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text, spans, mark="[secret]"):
    out, at = "", 0
    for a, _, b in sorted(spans, key=lambda s: (s[0], s[2])):
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]


def quality_counts(text):
    t = text or ""
    w = words(t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    again = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again),
            n < 50 or 100 * len(again) > 50 * n)

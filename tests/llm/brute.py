"""Plain Python versions of the operators, as their contracts state them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def shingles(text):
    words = [fold(x) for x in WORD.findall(text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_components(rows):
    """id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    holders, common = defaultdict(list), Counter()
    for i, own in sets.items():
        for x in own:
            for j in holders[x]:
                common[j, i] += 1
            holders[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spans(flags):
    found, k = [], 0
    for k, flag in enumerate(flags):
        if flag and (k == 0 or not flags[k - 1]):
            found.append([k, k])
        if flag:
            found[-1][1] = k + 1
    return ",".join(f"{a}-{b}" for a, b in found)


def repeated(rows, length=50):
    """id -> (n_words, repeated, later, spans, later spans)."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    holders = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            holders[tuple(w[k : k + length])].add(i)
    out = {}
    for i, w in words.items():
        some, later = [False] * len(w), [False] * len(w)
        for k in range(len(w) - length + 1):
            who = holders[tuple(w[k : k + length])]
            if len(who) > 1:
                some[k : k + length] = [True] * length
                if min(who) < i:
                    later[k : k + length] = [True] * length
        out[i] = (len(w), sum(some), sum(later), spans(some), spans(later))
    return out


RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return fold(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(url):
    """host, path, rule, action."""
    host, path = url_parts(url)
    fits = [(len(rule), rule, action) for rule, action in RULES for of, start in [rule.split("/", 1)] if (host == of or host.endswith("." + of)) and path.startswith("/" + start)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def ranks(edges, seeds, damping=0.85, rounds=200):
    """Personalised PageRank; what hosts without links hold goes back to the seeds."""
    total = sum(seeds.values())
    start = {h: n / total for h, n in seeds.items()}
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    score = dict(start)
    for _ in range(rounds):
        new = Counter()
        for host, n in score.items():
            for b in out[host]:
                new[b] += damping * n / len(out[host])
        given = sum(new.values())
        for host, n in start.items():
            new[host] += n * (1 - given)
        score = new
    return score


def bigrams(text):
    words = re.findall("[a-z0-9]+", fold(text))
    return set(zip(words, words[1:], strict=False))


def licenses(text, templates, least=0.8):
    """Names of the licences that a line, a paragraph, the whole or any window of a template's length is alike to."""
    text = text or ""
    plain = re.sub("[^a-z0-9\n]+", " ", fold(text))
    words = plain.split()
    units = [bigrams(x) for x in {*plain.split("\n"), *re.split("\n *\n", plain), plain}]
    found = set()
    for name, template in templates:
        other, n = bigrams(template), len(re.findall("[a-z0-9]+", fold(template)))
        windows = [set(zip(words[k : k + n], words[k + 1 : k + n], strict=False)) for k in range(len(words) - 1) if (words[k], words[k + 1]) in other]
        if any(own and 2 * len(own & other) >= least * (len(own) + len(other)) - 1e-12 for own in units + windows):
            found.add(name)
    return sorted(found)


def water_levels(sizes, total, epochs=2.0, weights=(5.0, 2.0, 1.0)):
    """source -> target, by clamping until no target is above its cap; None comes last."""
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        target |= {s: epochs * sizes[s] for s in above}
        free -= above
    return target

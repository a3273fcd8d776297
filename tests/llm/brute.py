"""Plain, slow versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_components(rows, percent=75):
    """{row number: least doc_id reachable} of (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j < i)
        for j, x in shared.items():
            if 100 * x >= percent * (len(s) + len(sets[j]) - x):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return {i: least.get(root(i)) for i in range(len(rows))}, [len(s) for s in sets]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def normal_line(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def kept_documents(rows, min_documents=20, max_share=0.005, max_removed=0.8):
    """{row number: (kept, lines removed)} of (text, host) rows."""
    hosts = Counter(h for _, h in {(t or "", h) for t, h in rows})
    found = defaultdict(set)
    split = []
    for text, host in rows:
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        normal = [normal_line(x) for x in lines]
        split.append((lines, normal))
        for x in set(normal):
            found[host, x].add(text)
    out = {}
    for i, (text, host) in enumerate(rows):
        n, _, _, _, repeat = quality(text)
        lines, normal = split[i]
        gone = {x for x in normal if len(found[host, x]) > min_documents and len(found[host, x]) > hosts[host] * max_share}
        lost = sum(len(WORD.findall(a)) for a, b in zip(lines, normal, strict=True) if b in gone)
        failed = n < 10 or 100 * repeat > 20 * n
        depleted = lost > 0 and (lost > n * max_removed or n - lost < 10)
        out[i] = (not failed and not depleted, gone)
    return out


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))

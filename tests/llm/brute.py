"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

PLAIN, STRICT = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def quality(text: str | None) -> tuple:
    text = text or ""
    words = PLAIN.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if PLAIN.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def kept(rows: list[tuple], own: int = 50, accuracy: float = 0.02) -> list[bool]:
    """Verdicts on (lang, source, text): all six rates against the fences of each row's group."""
    rates, groups = [], defaultdict(list)
    for lang, source, text in rows:
        n_words, chars, symbols, dup, repeated, failed = quality(text)
        if failed:
            rates.append(None)
            continue
        lines = sum(1 for line in text.split("\n") if PLAIN.search(line))
        capitals, marks = (sum(c in of for c in text) for of in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!?"))
        rate = [chars / n_words, symbols / n_words, dup / lines, repeated / n_words, capitals / chars, marks / n_words]
        rates.append(rate)
        for key in ((lang, source), (lang,), ()):
            groups[key].append(rate)

    def fence(key, i):
        def binned(x):
            return (1 + accuracy) ** math.ceil(math.log(x) / math.log1p(accuracy)) * 2 / (2 + accuracy) if x else 0.0

        values = sorted(binned(r[i]) for r in groups[key])
        at = lambda q: next(v for k, v in enumerate(values, 1) if k >= len(values) * q)
        slack = 0.02 if i else 1.0
        low = (at(0.25) - 1.5 * (at(0.25) - at(0.02))) * (1 - accuracy) - slack if i == 0 else -math.inf
        return low, (at(0.75) + 1.5 * (at(0.98) - at(0.75))) * (1 + accuracy) + slack

    fences, out = {}, []
    for (lang, source, _), rate in zip(rows, rates, strict=True):
        key = next(k for k in ((lang, source), (lang,), ()) if not k or len(groups[k]) >= own)
        if rate and key not in fences:
            fences[key] = [fence(key, i) for i in range(6)]
        out.append(bool(rate) and all(lo <= x <= hi for x, (lo, hi) in zip(rate, fences[key], strict=True)))
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    words = PLAIN.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, prints: list[int], radius: int = 3) -> list:
    label = list(range(len(ids)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[top(i)] = top(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(least.get(top(i), x), x)
    return [least.get(top(i)) for i in range(len(ids))]


def decontaminate(texts: list, items: list[tuple], width: int = 10) -> list[tuple]:
    grams = defaultdict(set)
    for item, text in items:
        words = STRICT.findall((text or "").translate(LOWER))
        if words:
            for i in range(max(1, len(words) - width + 1)):
                grams[tuple(words[i : i + width])].add(item)
    out = []
    for text in texts:
        words, hit, found = STRICT.findall((text or "").translate(LOWER)), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(words) - k + 1):
                if (g := tuple(words[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((len(words), len(hit), len(found), sha256(",".join(sorted(found))), bool(hit)))
    return out


def repeats(texts: list, width: int = 400) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if often[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g))))
    return out


def shares_passage(texts: list, width: int = 51) -> list[bool]:
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    found = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in rows]
    often = Counter(x for of_row in found for x in of_row)
    return [any(often[x] > 1 for x in of_row) for of_row in found]


def repeated_lines(docs: list[tuple], width: int = 3) -> dict:
    """docs: (doc_id, text) with different ids, none NULL."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        lines = (text or "").split("\n") if text is not None else []
        worded = [i for i, line in enumerate(lines) if PLAIN.search(line)]
        gone = set()
        for i in range(len(worded) - width + 1):
            at = worded[i : i + width]
            key = tuple(lines[j] for j in at)
            if key in seen:
                gone.update(at)
            seen.add(key)
        out[doc_id] = (len(lines), len(gone), "\n".join(line for i, line in enumerate(lines) if i not in gone))
    return out


def secrets(text: str | None) -> tuple:
    text = text or ""
    found = [(0, m) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(1, m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(2, m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    spans = sorted((m.start(), k, m.end()) for k, m in found)
    names = ["assign", "access", "hex"]
    listed = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
    return *(sum(k == i for _, k, _ in spans) for i in range(3)), sha256(",".join(listed)), listed


def targets(sizes: dict, share: float = 1.5, most: int = 2) -> dict:
    """sizes: words by source (None is the last)."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        left = budget - sum(held.values())
        given = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if given[s] > most * sizes[s]]
        if not over:
            return held | given
        held |= {s: most * sizes[s] for s in over}


def taken(docs: list[tuple]) -> list[int]:
    """Words that the mix takes of each of (source, size, place in the shuffle)."""
    sizes = Counter()
    for source, size, _ in docs:
        sizes[source] += size
    goals = targets(sizes)
    ranked = [s for s in sorted(goals, key=lambda s: (s is None, s or "")) if goals[s] > 0]
    slot_words = {s: 1 << min(6, max(0, math.floor(math.log2(max(1.0, goals[s]) / 32)))) for s in ranked}
    out = [0] * len(docs)
    for tier in set(slot_words.values()):
        its = [s for s in ranked if slot_words[s] == tier]
        total = sum(goals[s] for s in its)
        bits = max(1, math.ceil(math.log2(max(2.0, total / tier))))
        length = max(1, math.ceil(total / (1 << bits) * 1024))  # of a slot, in 1024ths of a word
        ends, owner = [], []
        for s in its:
            ends.append((ends[-1] if ends else 0.0) + goals[s])
        for slot in range(1 << bits):
            point = int(f"{slot:0{bits}b}"[::-1], 2)
            owner.append(next((s for s, e in zip(its, ends, strict=True) if point < math.ceil(e / total * (1 << bits))), its[-1]))
        for s in its:
            blocks, times = (sizes[s] - 1) * 1024 // length + 1, Counter()
            for turn in range(min(owner.count(s), 2 * blocks)):
                times[turn % blocks] += 1
            line = [i for _, i in sorted((place, i) for i, (of, _, place) in enumerate(docs) if of == s) for _ in range(docs[i][1])]
            for word, i in enumerate(line):
                out[i] += times[word * 1024 // length]
    return out

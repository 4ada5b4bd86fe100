"""Small transcripts with copies, near copies, shared passages and odd rows, and plain versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "transcript_id BIGINT, text STRING, language STRING, stream_id STRING, n_words STRING, key STRING, size STRING, label STRING"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentences(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return "\n".join(" ".join(f"w{rng.randrange(vocabulary):x}é"[:rng.randrange(2, 6)] + rng.choice("abcdefgh") for _ in range(rng.randrange(3, 40)))
                     for _ in range(n))


def texts(seed: int = 3, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [sentences(rng, rng.randrange(1, 7)) for _ in range(n)]
    passage = " ".join(f"passage{i}" for i in range(60))
    for i in range(0, n, 7):
        out.append(out[i] + "\n" + passage + "\nend " + str(i))          # a passage many share
    for i in range(0, n, 6):
        words = out[i].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))                                        # near copies
    out += [out[5], out[5], out[9], out[9].upper()]                        # exact copies, other case
    out += [None, "", "   ", "\n\n", "one", "one two three four", "ONE two three four", "a\tb\x0bc\r\nd  e f", "ha " * 300, "x" * 5000,
            sentences(rng, 900), "same line of some words here\n" * 40, "|#*$%&<> " * 60, "日本語 テキスト " * 30]
    return out


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    body = texts(seed, n)
    order = list(range(len(body)))
    random.Random(seed + 1).shuffle(order)
    return [(o, t, ("en", "de", None)[o % 3], None if o % 11 == 0 else f"tower{o % 2}", "x", "y", "z", "q") for o, t in zip(order, body)]


def transcripts(spark, seed: int = 3, n: int = 60, extra: tuple = ()):
    return spark.createDataFrame([*rows(seed, n), *extra], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(pairs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in pairs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def without_repeats(pairs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[bytes, int]]:
    bodies = {i: (t or "").encode() for i, t in pairs}
    first: dict[bytes, int] = {}
    for i in sorted(bodies):
        for k in range(len(bodies[i]) - length + 1):
            first.setdefault(bodies[i][k:k + length], i)
    out = {}
    for i, b in bodies.items():
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = [True] * length
        out[i] = bytes(c for c, g in zip(b, gone) if not g), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    return out


def line_runs(pairs: list[tuple[int, str | None]], min_words: int = 50) -> dict[int, str | None]:
    """Texts without later copies of windows of whole lines, window by window."""
    seen: dict[tuple, tuple[int, int, int]] = {}
    windows = []
    for i, t in sorted(pairs):
        cut = [(p, x.strip(" \t\r\x0b\x0c")) for p, x in enumerate((t or "").split("\n"))]
        cut = [(p, x, len(re.split(r"[\x20\x09-\x0D]+", x))) for p, x in cut if x]
        found = set()
        for a in range(len(cut)):
            for step in (1, -1):
                n, b = 0, a
                while 0 <= b < len(cut) and n < min_words:
                    n += cut[b][2]
                    b += step
                if n >= min_words:
                    lo, hi = (a, b - 1) if step == 1 else (b + 1, a)
                    found.add((lo, hi))
        for lo, hi in sorted(found):
            body = tuple(x for _, x, _ in cut[lo:hi + 1])
            windows.append((i, cut[lo][0], cut[hi][0], body))
            seen[body] = min(seen.get(body, (1 << 60, 0, 0)), (i, cut[lo][0], cut[hi][0]))
    gone = defaultdict(set)
    for i, a, b, body in windows:
        o = seen[body]
        if not (o[0] == i and a <= o[2]):
            gone[i].update(range(a, b + 1))
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) if gone[i] else t for i, t in pairs}

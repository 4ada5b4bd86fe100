"""Abuse in transcripts: Levenshtein automata over a learned lexicon trie, and windows that tell quotation from abuse.

The lexicon is learned from labels: terms, and stems that many terms begin with. All of them form one trie. A word runs through the
product of that trie with a Levenshtein automaton of each term's edit budget, so misspelled terms are found with their distance.
A hit counts by its weight and by what stands around it: inside quotation marks or after a reporting word it is weaker, next to
other hits or a word that addresses someone it is stronger. A logistic model over such window scores gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aetherlog.llm.chunks import buffers, pieces
from aetherlog.llm.shared import stored

# fixed values: words before a quotation, words that address someone, quotation marks, letters written as digits or signs
REPORTING = ("said", "says", "say", "called", "calls", "quoted", "quote", "wrote", "writes", "sagte", "sagt", "nannte", "schrieb",
             "dijo", "dice", "llamó", "dit", "appelé", "écrit")
ADDRESS = ("you", "your", "youre", "u", "ur", "du", "dich", "dein", "ihr", "euch", "tu", "te", "vous", "toi", "tú", "ti", "usted")
QUOTES = "\"“”„«»‟"
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
WINDOW = 12  # words before and after a hit that make its window
STEMS = (3, 4, 5, 6)  # code points of stems
FEATURES = ("abuse", "quoted", "densest", "exact", "misspelled", "stems", "addressed", "share", "words")
_DEAD, _ROOT = 0, 1


def _budget(term: str) -> int:
    """Edits that a term may have: none in short ones, which are near too many words."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


# --- lexicon and automaton ------------------------------------------------------------------

@dataclass(frozen=True)
class Lexicon:
    """Entries ``(text, is stem, weight)``; a stem stands for all words that begin with it."""

    entries: tuple[tuple[str, bool, float], ...] = ()


class Matcher:
    """The determinised product of the lexicon's trie with the entries' Levenshtein automata, worked out as far as texts reach.

    A state is a set of pairs (trie node, edits so far) and the stem that the word began with, if any. ``next`` is
    a table of states by character class; all words of a piece advance one character at a time together.
    """

    def __init__(self, lexicon: Lexicon):
        self.entries = lexicon.entries
        self.children: list[dict[str, int]] = [{}]
        self.terms: list[int] = [-1]  # the entry that ends at a node
        self.spare = [0]  # the largest budget of the terms below a node
        for i, (text, stem, _) in enumerate(self.entries):
            node, budget = 0, 0 if stem else _budget(text)
            self.spare[0] = max(self.spare[0], budget)
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.terms.append(-1)
                    self.spare.append(0)
                node = self.children[node][ch]
                self.spare[node] = max(self.spare[node], budget)
            if self.terms[node] < 0 or self.entries[self.terms[node]][1]:
                self.terms[node] = i if self.terms[node] < 0 or not stem else self.terms[node]
        self.alphabet = sorted({ch for text, _, _ in self.entries for ch in text})
        self.classes = np.zeros(max([0x10000, *[ord(c) + 1 for c in self.alphabet]]), np.int64)
        for i, ch in enumerate(self.alphabet):
            self.classes[ord(ch)] = i + 1
        for sign, letter in LOOKALIKES.items():
            if letter in self.alphabet:
                self.classes[ord(sign)] = self.classes[ord(letter)]
        self.number: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next = np.zeros((0, len(self.alphabet) + 1), np.int64)
        self.hit, self.edits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._state((frozenset(), -1))
        self._state((self._closed({(0, 0)}), -1))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With all nodes reached by leaving out characters of terms; fewer edits at a node make more edits there idle."""
        best: dict[int, int] = {}
        todo = sorted(pairs, key=lambda p: p[1])
        while todo:
            node, e = todo.pop(0)
            if e > self.spare[node] and not (e == 0) or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values() if e < self.spare[child]]
        return frozenset(best.items())

    def _state(self, key: tuple) -> int:
        if key in self.number:
            return self.number[key]
        at = self.number[key] = len(self.sets)
        self.sets.append(key)
        pairs, stem = key
        ends = [(e, i) for node, e in pairs if (i := self.terms[node]) >= 0 and e <= (0 if self.entries[i][1] else _budget(self.entries[i][0]))]
        if stem >= 0:
            ends.append((0, stem))
        # fewest edits first, then the whole term before a stem, then the larger weight
        e, i = min(ends, default=(0, -1), key=lambda x: (x[0], self.entries[x[1]][1], -self.entries[x[1]][2]))
        if at >= len(self.next):
            more = max(1024, len(self.next))
            self.next = np.concatenate([self.next, np.full((more, len(self.alphabet) + 1), -1)])
            self.hit, self.edits = np.concatenate([self.hit, np.zeros(more, np.int64)]), np.concatenate([self.edits, np.zeros(more, np.int64)])
        self.hit[at], self.edits[at] = i, e
        if not pairs:
            self.next[at] = at
        return at

    def _step(self, state: int, letter: int) -> int:
        pairs, stem = self.sets[state]
        ch = self.alphabet[letter - 1] if letter else None
        out: set[tuple[int, int]] = set()
        for node, e in pairs:
            for own, child in self.children[node].items():
                cost = e + (own != ch)
                if cost == 0 or cost <= self.spare[child]:
                    out.add((child, cost))
            if e < self.spare[node]:
                out.add((node, e + 1))
        closed = self._closed(out)
        for node, e in closed:
            i = self.terms[node]
            if e == 0 and i >= 0 and self.entries[i][1] and (stem < 0 or self.entries[i][2] > self.entries[stem][2]):
                stem = i
        return self._state((closed, stem))

    def run(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry that each word ``points[start:end]`` is (-1: none), and its edits."""
        state = np.full(len(starts), _ROOT, np.int64)
        live = np.arange(len(starts)) if self.entries else np.zeros(0, np.int64)
        if not self.entries:
            state[:] = _DEAD
        letters = self.classes[np.where(points < len(self.classes), points, 0)]
        at = starts.copy()
        while len(live):
            live = live[at[live] < ends[live]]
            now, letter = state[live], letters[at[live]]
            to = self.next[now, letter]
            if (to < 0).any():
                for s, c in np.unique(np.stack([now[to < 0], letter[to < 0]]), axis=1).T:
                    reached = self._step(int(s), int(c))  # may move the table
                    self.next[s, c] = reached
                to = self.next[now, letter]
            state[live] = to
            at[live] += 1
            live = live[self.next[to, 0] != to]  # from dead ends and finished stems no character leads on
        return self.hit[state], self.edits[state]


# --- texts -----------------------------------------------------------------------------------

def _word_table() -> np.ndarray:
    """Which code points below U+3040 belong to words; all above do."""
    table = np.zeros(0x3040, bool)
    table[[*range(48, 58), *range(97, 123), ord("@"), ord("$")]] = True
    table[0xC0:0x2000] = True
    table[[0xD7, 0xF7]] = False
    return table


_IN_WORD = _word_table()


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(code points in lower case, starts, ends, first)`` of the words of some texts; first[r] is row r's first word."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32).astype(np.int64)
    edges = np.cumsum([0] + [len(t) + 1 for t in low])
    inside = _IN_WORD[np.minimum(points, len(_IN_WORD) - 1)] | (points >= len(_IN_WORD))
    step = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return points, starts, ends, np.searchsorted(starts, edges)


def _spelled(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: frozenset[str]) -> np.ndarray:
    """Which words are one of a few short ones."""
    out = np.zeros(len(starts), bool)
    for w in known:
        at = np.flatnonzero(ends - starts == len(w))
        for k, ch in enumerate(w):
            at = at[points[starts[at] + k] == ord(ch)]
        out[at] = True
    return out


def hit_features(texts: list[str], matcher: Matcher, weights: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text; ``weights[entry, edits]`` is what a hit is worth."""
    points, starts, ends, first = words(texts)
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(first)
    out[:, 8] = np.log1p(size) / 5
    if not len(starts):
        return out
    entry, edits = matcher.run(points, starts, ends)
    at = np.flatnonzero(entry >= 0)
    if not len(at):
        return out
    row = np.searchsorted(first, at, "right") - 1
    worth = weights[entry[at], edits[at]]
    stem = np.array([s for _, s, _ in matcher.entries])[entry[at]]
    # a hit is quoted if an odd number of quotation marks of its line stand before it, or a reporting word does closely
    mark = np.isin(points, [ord(q) for q in QUOTES])
    total = np.concatenate([[0], np.cumsum(mark)])
    line = np.concatenate([[0], np.flatnonzero(points == 10) + 1])
    line_at = line[np.searchsorted(line, starts[at], "right") - 1]
    quoted = (total[starts[at]] - total[line_at]) % 2 == 1
    report = np.concatenate([[0], np.cumsum(_spelled(points, starts, ends, frozenset(REPORTING)))])
    quoted |= report[at] - report[np.maximum(at - 4, first[row])] > 0
    address = np.concatenate([[0], np.cumsum(_spelled(points, starts, ends, frozenset(ADDRESS)))])
    low, high = np.maximum(at - WINDOW, first[row]), np.minimum(at + WINDOW + 1, first[row + 1])
    addressed = address[high] - address[low] > 0
    open_worth = np.where(quoted, 0.0, worth)
    so_far = np.concatenate([[0], np.cumsum(open_worth)])
    window = so_far[np.searchsorted(at, high)] - so_far[np.searchsorted(at, low)]
    for k, x in ((0, open_worth), (1, np.where(quoted, worth, 0.0)), (3, (edits[at] == 0) & ~stem), (4, edits[at] > 0), (5, stem), (6, open_worth * addressed)):
        out[:, k] = np.log1p(np.maximum(np.bincount(row, weights=x, minlength=n), 0))
    np.maximum.at(out[:, 2], row, np.where(quoted, 0.0, np.log1p(np.maximum(window, 0))))
    out[:, 7] = np.sqrt(np.bincount(row, weights=open_worth, minlength=n) / np.maximum(size, 1)).clip(0, 3)
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """``(first row, texts)`` of parts of bounded size; a null is an empty text."""
    _, offsets = buffers(column)
    for a, b in pieces(offsets):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


# --- learning --------------------------------------------------------------------------------

@dataclass
class Model:
    """Lexicon, what a hit of each entry is worth by its edits, and the logistic weights; of fixed size."""

    prior: float = 0.0
    lexicon: Lexicon = Lexicon()
    worth: np.ndarray = field(default_factory=lambda: np.zeros((1, 3)))
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.01, steps: int = 50) -> np.ndarray:
    """Weights and, last, the bias: Newton steps on the logistic loss with a ridge on the weights."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.full(x.shape[1], decay)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: str) -> Column:
    """Whether a key belongs to the part that is never learned from: crc32 of its text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term, stem, toxic, clean)``: in how many texts of each label a word or a stem occurs, counted piece by piece."""
    for batch in batches:
        labels = batch.column(0).to_numpy()
        for a, texts in _texts(batch.column(1)):
            counts: dict[tuple[str, bool], list[int]] = {}
            points, starts, ends, first = words(texts)
            said = points.astype(np.uint32).tobytes().decode("utf-32-le")
            for r in range(len(texts)):
                own = {said[s:e] for s, e in zip(starts[first[r]:first[r + 1]].tolist(), ends[first[r]:first[r + 1]].tolist()) if 2 < e - s <= 40}
                stems = {(w[:k], True) for w in own for k in STEMS if len(w) > k}
                for t in [*((w, False) for w in own), *stems]:
                    counts.setdefault(t, [0, 0])[0 if labels[a + r] else 1] += 1
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in counts]), pa.array([s for _, s in counts]), pa.array([c[0] for c in counts.values()], pa.int64()),
                     pa.array([c[1] for c in counts.values()], pa.int64())], names=["term", "stem", "toxic", "clean"])


def learn_lexicon(sample: DataFrame, text: str = "text", label: str = "toxic", size: int = 400, least: int = 3, sure: float = 20.0,
                  odds: float = 1.5) -> Lexicon:
    """The terms and stems that speak most surely for the label: at most ``size``, each in ``least`` labelled texts.

    Counted over all texts of the sample by partial aggregation; only the best candidates come to the driver, ordered by the
    likelihood ratio of their counts. It has to reach ``sure``, and the entry's weight, its log odds ratio, ``odds``. A stem that a chosen
    entry begins with has to be in far more labelled texts than that entry; a word that a chosen stem covers has to be far surer, or in half of the stem's texts.
    """
    n = {bool(r[0]): r["count"] for r in sample.groupBy(F.col(label) > 0).count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    counted = sample.select(F.col(label).cast("int"), F.col(text).cast("string")).mapInArrow(
        _candidates, "term STRING, stem BOOLEAN, toxic BIGINT, clean BIGINT")
    t, c = F.col("toxic"), F.col("clean")
    weight = F.log((t + 0.5) / (bad - t + 0.5)) - F.log((c + 0.5) / (good - c + 0.5))
    share = bad / max(bad + good, 1)
    ratio = 2 * (t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0))
    chosen = counted.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(t >= least).select(
        "term", "stem", "toxic", weight.alias("weight"), ratio.alias("ratio")).filter((F.col("weight") > odds) & (F.col("ratio") >= sure))
    chosen = chosen.orderBy(F.desc("ratio"), "stem", F.desc(F.length("term")), "term").limit(8 * size).collect()
    entries: list[tuple[str, bool, float]] = []
    begun: dict[str, int] = {}  # by what chosen entries begin with: the most labelled texts of one
    stems: dict[str, tuple[float, int]] = {}
    for r in chosen:
        covering = [stems[r.term[:k]] for k in STEMS if r.term[:k] in stems]
        # a term in half of its stem's texts stays beside it: its misspellings may not begin with the stem
        covered = any(w > r.weight - 1.0 and (r.stem or r.toxic < 0.5 * n) for w, n in covering)
        if r.stem and r.toxic < 1.3 * begun.get(r.term, 0) or covered:
            continue
        entries.append((r.term, r.stem, float(r.weight)))
        for k in STEMS:
            begun[r.term[:k]] = max(begun.get(r.term[:k], 0), r.toxic)
        if r.stem:
            stems[r.term] = (r.weight, r.toxic)
    return Lexicon(tuple(entries[:size]))


def train(transcripts: DataFrame, labels: DataFrame, key: str = "transcript_id", text: str = "text", label: str = "toxic",
          sample: int = 20000, size: int = 400) -> Model:
    """Learn lexicon and weights from at most ``sample`` labelled transcripts that are not held out, those with the smallest key hashes.

    Two thirds of them give the lexicon and what its hits are worth, the rest the logistic weights, so that these know how
    the lexicon does on texts it was not learned from. To the driver come the lexicon (``size`` entries), its hits' counts by label and
    one row of fixed size per labelled transcript. A null label or key is not learned from; if labels for a key repeat, the largest
    counts. Without both labels the model knows the share of the label only.
    """
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("__label"))
    chosen = marked.orderBy(F.xxhash64(key), key).limit(sample)
    body = transcripts.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("__key") == F.col(key)).select(  # at most ``sample`` rows
            (F.col("__label") > 0).cast("int").alias("toxic"), "text", (F.pmod(F.xxhash64("__key", F.lit(1)), F.lit(3)) > 0).alias("first"))
    body = stored(body, "toxicity-sample")
    lexicon = learn_lexicon(body.filter("first"), size=size)
    shape = (max(len(lexicon.entries), 1), 3)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, *shape), np.int64)
        own = Matcher(lexicon)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for a, texts in _texts(batch.column(1)):
                points, starts, ends, first = words(texts)
                entry, edits = own.run(points, starts, ends)
                at = np.flatnonzero(entry >= 0)
                row = np.searchsorted(first, at, "right") - 1
                once = np.unique(np.stack([row, entry[at], edits[at]]), axis=1)
                np.add.at(seen, (y[a + once[0]], once[1], once[2]), 1)
        at = np.argwhere(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, k].astype(np.int32)) for k in range(3)] + [pa.array(seen[tuple(at.T)])],
                                         names=["toxic", "entry", "edits", "n"])

    seen = np.zeros((2, *shape))
    for r in body.filter("first").select("toxic", "text").mapInArrow(count, "toxic INT, entry INT, edits INT, n BIGINT").groupBy(
            "toxic", "entry", "edits").agg(F.sum("n").alias("n")).collect():
        seen[r.toxic, r.entry, r.edits] = r.n
    n = {bool(r[0]): r["count"] for r in body.filter("first").groupBy(F.col("toxic") > 0).count().collect()}
    # what a hit with edits is worth: its own log odds, with two texts' worth of half the exact term's
    exact = np.array([w for _, _, w in lexicon.entries] or [0.0])
    worth = np.zeros(shape)
    for e in range(3):
        prior = np.exp(np.minimum(exact, 8) * 0.5 ** e) * n.get(True, 0) / max(n.get(False, 0), 1)
        bad, good = seen[1, :, e] + 2 * prior / (1 + prior), seen[0, :, e] + 2 / (1 + prior)
        worth[:, e] = np.maximum(np.log(np.maximum(bad, 1e-9) / max(n.get(True, 0), 1)) - np.log(good / max(n.get(False, 0), 1)), 0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(lexicon)
        for batch in batches:
            x = np.zeros((batch.num_rows, len(FEATURES)))
            for a, texts in _texts(batch.column(1)):
                x[a:a + len(texts)] = hit_features(texts, own, worth)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], names=["toxic", *FEATURES])

    rows = body.filter(~F.col("first")).select("toxic", "text").mapInArrow(
        measure, "toxic INT, " + ", ".join(f"{f} DOUBLE" for f in FEATURES)).toArrow().sort_by([(c, "ascending") for c in ("toxic", *FEATURES)])
    y = rows.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else n.get(True, 0) / max(sum(n.values()), 1))
    x = np.stack([rows.column(f).to_numpy() for f in FEATURES], axis=1)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    return Model(float(y.mean()), lexicon, worth, mean, scale, fit_logistic((x - mean) / scale, y))


def score_transcripts(transcripts: DataFrame, model: Model, key: str = "transcript_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every whole text.

    Only the text is looked at. A null text counts as an empty one, which has no words and no hits. Repeated rows give
    repeated results; an empty table gives an empty one. A narrow pass: nothing is shuffled, the model is of fixed size.
    """
    source = transcripts.select(F.col(key), held_out(key).alias("held_out"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.lexicon)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, texts in _texts(batch.column(2)):
                score[a:a + len(texts)] = model.score(hit_features(texts, matcher, model.worth))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[key, "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"`{key}` {source.dtypes[0][1]}, held_out BOOLEAN, score DOUBLE, predicted INT")

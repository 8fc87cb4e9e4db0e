"""Toxicity by a weighted lexicon.

Texts are folded (case, lookalike letters of other scripts, digits and signs that stand for letters), an Aho-Corasick
automaton finds lexicon entries at word starts, entries inside an exception phrase don't count, and the summed weights
are set against the text's length. The lexicon holds words and word beginnings, learned from labelled rows alone: those
that stand in more toxic documents than chance explains (at a false discovery rate, so at any number of labelled rows), and
of which there are far more in toxic text than in other text. Their weights are the log odds of that. What counts are
different surroundings, so copies and near copies of a document count once.
"""

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, tidy
from .linear import fit_logistic, sigmoid

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ı": "i", "ɡ": "g", "ſ": "s",
}
# Common phrases in which such words are harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash compactor", "circus clown", "class clown", "clown fish", "rodeo clown",
    "pond scum", "soap scum", "loser bracket", "pathetic fallacy",
)
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
WORD = re.compile(r"[^\W_]+")
#: Share of entries that may be there by chance; how many times (as a logarithm) an entry must be more frequent in toxic
#: text; documents or surroundings in which an entry or a learned exception must stand at least.
FALSE_DISCOVERIES = 1e-3
LEAST_WEIGHT = 3.4
LEAST_SEEN = 3
PREFIXES = range(3, 8)
MAX_ENTRIES = 2_000
MAX_EXCEPTIONS = 500

_FOLDS = {
    **{ord(a): b for a, b in (LOOKALIKES | SUBSTITUTES).items()},
    **{0xFF01 + k: chr(0x21 + k).lower() for k in range(94)},
    **dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], None),
}


def fold(text: str) -> str:
    return text.lower().translate(_FOLDS)


@dataclass
class Lexicon:
    """entries: weight of each word or (ending in *) word beginning. exceptions: phrases in which entries don't count."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: tuple[float, float] = (0.0, 0.0)
    intercept: float = -50.0

    def automaton(self):
        import ahocorasick

        found: dict[str, list] = {}
        for entry, weight in self.entries.items():
            found.setdefault(entry.rstrip("*"), [len(entry.rstrip("*")), 0.0, 0.0, False])[2 if entry.endswith("*") else 1] = weight
        for phrase in self.exceptions:
            found.setdefault(phrase, [len(phrase), 0.0, 0.0, False])[3] = True
        made = ahocorasick.Automaton()
        for text, value in found.items():
            made.add_word(text, tuple(value))
        if found:
            made.make_automaton()
        return made

    def hits(self, automaton, folded: str) -> list[float]:
        """Weights of the entries that count. At one place the heaviest entry counts."""
        if not len(automaton):
            return []
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []  # in order of their ends
        for end, (width, word, beginning, exception) in automaton.iter(folded):
            start = end + 1 - width
            if start and folded[start - 1].isalnum():
                continue
            whole = end + 1 == len(folded) or not folded[end + 1].isalnum()
            if exception and whole:
                spared.append((start, end))
            weight = max(word if whole else 0.0, beginning)
            if weight:
                at[start] = max(at.get(start, 0.0), weight)
        if not spared:
            return list(at.values())
        ends, least = [b for _, b in spared], [a for a, _ in spared]
        for k in range(len(least) - 2, -1, -1):
            least[k] = min(least[k], least[k + 1])  # the earliest beginning of a phrase that ends here or later
        inside = lambda start: (k := bisect_left(ends, start)) < len(ends) and least[k] <= start
        return [w for start, w in at.items() if not inside(start)]

    def features(self, automaton, text: str | None) -> tuple[float, float]:
        """Weight per word, and the logarithm of the weight."""
        folded = fold(text or "")
        found = self.hits(automaton, folded)
        if not found:
            return 0.0, 0.0
        total = sum(found)
        return 100 * total / (20 + len(folded.split())), math.log1p(total)

    def score(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(features @ np.array(self.weights) + self.intercept)


def _significance(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Likelihood ratio of an entry's share of toxic documents against the share of all; 0 if below it."""
    n, base = toxic + clean, n_toxic / (n_toxic + n_clean)
    if toxic <= base * n:
        return 0.0
    return 2 * (toxic * math.log(toxic / (n * base)) + (clean * math.log(clean / (n * (1 - base))) if clean else 0.0))


def _discoveries(scores: dict[str, float], tests: int) -> set[str]:
    """The entries whose significance holds at a false discovery rate (Benjamini and Hochberg) among so many tests."""
    ranked = sorted(scores, key=lambda w: (-scores[w], w))
    most = 0
    for k, w in enumerate(ranked, 1):
        if math.erfc(math.sqrt(scores[w] / 2)) <= FALSE_DISCOVERIES * k / max(1, tests):
            most = k
    return set(ranked[:most])


def learn_lexicon(rows: list[tuple[str, int]], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """rows: text and label. Words and beginnings are chosen by significance; a beginning replaces the words it covers
    if it is about as pure as they are. Phrases of two words, of which one is an entry, that stand only in documents that
    aren't toxic join the exceptions.

    Rows equal after folding count once, null and empty texts as texts without words; order doesn't matter. With labels of
    one kind only the lexicon is empty and all scores are 0. An entry must stand in LEAST_SEEN documents at least; with
    one toxic document in ten it takes about 8 toxic documents that hold it among 20,000 candidates.
    """
    folded = sorted({(fold(text or ""), y) for text, y in rows})
    n = Counter(y for _, y in folded)
    if not n[0] or not n[1]:
        return Lexicon()
    seen: tuple[Counter, Counter] = Counter(), Counter()
    starts: tuple[Counter, Counter] = Counter(), Counter()
    for y in (1, 0):  # of clean documents only what toxic ones hold too
        for words in (set(WORD.findall(text)) for text, own in folded if own == y):
            beginnings = {w[:k] for w in words for k in PREFIXES if len(w) > k}
            seen[y].update(words if y else words & seen[1].keys())
            starts[y].update(beginnings if y else beginnings & starts[1].keys())

    def likely(counts: tuple) -> dict[str, float]:
        found = {w: _significance(c, counts[0][w], n[1], n[0]) for w, c in counts[1].items() if c >= LEAST_SEEN}
        return {w: found[w] for w in _discoveries(found, len(counts[1]))}

    words, beginnings = likely(seen), likely(starts)
    places, sizes = _surroundings(folded, words, beginnings)

    def settle(chosen: dict, counts: tuple, mark: str) -> dict[str, float]:
        """The weights of those that are still significant with each surroundings counted once, and frequent enough."""
        tests = len(counts[1])
        at = [{w: len(places[y].get(w + mark, ())) for w in chosen} for y in (0, 1)]
        found = {w: _significance(min(counts[1][w], at[1][w]), min(counts[0][w], at[0][w]), n[1], n[0]) for w in chosen}
        weights = {w: math.log((at[1][w] + 0.5) / (sizes[1] + 1)) - math.log((at[0][w] + 0.5) / (sizes[0] + 1)) for w in _discoveries(found, tests)}
        return {w: x for w, x in weights.items() if x >= LEAST_WEIGHT}

    words, beginnings = settle(words, seen, ""), settle(beginnings, starts, "*")
    entries: dict[str, float] = {}
    covered = lambda w: any(w[:k] + "*" in entries for k in PREFIXES if k < len(w))
    for w in sorted(beginnings, key=lambda w: (len(w), w)):
        most = max((seen[1][x] for x in words if x.startswith(w)), default=0)
        if not covered(w) and starts[1][w] > 1.5 * most:  # it stands for more than one word
            entries[w + "*"] = beginnings[w]
    entries |= {w: words[w] for w in sorted(words) if not covered(w)}
    lexicon = Lexicon(dict(sorted(entries.items(), key=lambda x: (-x[1], x[0]))[:MAX_ENTRIES]))

    automaton, pairs = lexicon.automaton(), ({}, {})
    for text, y in folded:
        if lexicon.hits(automaton, text):
            found = ["", *WORD.findall(text), ""]
            known = [w in entries or covered(w) for w in found]
            for k in range(1, len(found) - 2):
                if known[k] != known[k + 1]:
                    pairs[y].setdefault(f"{found[k]} {found[k + 1]}", set()).add((found[k - 1], found[k + 2]))
    learned = [p for p, x in sorted(pairs[0].items(), key=lambda x: (-len(x[1]), x[0])) if len(x) >= LEAST_SEEN and p not in pairs[1]]
    lexicon.exceptions = [*exceptions, *(p for p in learned[:MAX_EXCEPTIONS] if p not in exceptions)]
    automaton = lexicon.automaton()
    x = np.array([lexicon.features(automaton, text) for text, _ in folded])
    weights, lexicon.intercept = fit_logistic(x, np.array([y for _, y in folded], "f8"))
    lexicon.weights = tuple(np.maximum(weights, 0).tolist())
    return lexicon


def _surroundings(folded: list[tuple[str, int]], words: dict, beginnings: dict) -> tuple[tuple[dict, dict], list[int]]:
    """By label: the different pairs of words before and after each candidate (beginnings marked *), and all words' number."""
    out: tuple[dict, dict] = {}, {}
    sizes = [0, 0]
    for text, y in folded:
        found = ["", *WORD.findall(text), ""]
        sizes[y] += len(found) - 2
        for k in range(1, len(found) - 1):
            w = found[k]
            if w in words:
                out[y].setdefault(w, set()).add((found[k - 1], found[k + 1]))
            for p in PREFIXES:
                if len(w) > p and w[:p] in beginnings:
                    out[y].setdefault(w[:p] + "*", set()).add((found[k - 1], found[k + 1]))
    return out, sizes


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, then tox_score and tox_density of every row, repeated rows and null ids included. A null or empty
    text scores as one without hits; an empty table gives an empty table. Other columns don't matter, whatever their names."""
    fields = [docs.select(c).schema[0] for c in named(list(keep))]
    schema = T.StructType([*fields, T.StructField("tox_score", T.DoubleType()), T.StructField("tox_density", T.DoubleType())])

    def score(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([lexicon.features(automaton, t) for t in batch.column(len(keep)).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lexicon.score(x)), pa.array(x[:, 0])], [*keep, "tox_score", "tox_density"])

    return docs.select(*named(list(keep)), F.col("text").alias("_tox_text")).mapInArrow(tidy(score), schema)

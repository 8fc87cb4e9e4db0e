"""Quality by a sparse rule ensemble: boosted shallow trees over text statistics give paths, each path is a conjunction
of thresholds, lasso logistic regression keeps few of them, and those are compiled into one Spark column."""

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, tidy
from .linear import fit_lasso_logistic, sigmoid

STATISTICS = (
    "n_words", "word_length", "unique_share", "repeat_share", "top_share", "upper_share", "digit_share", "mark_share", "symbol_share", "bar_share",
    "capital_words", "sentence_words", "line_words", "line_repeat_share", "ended_share", "bracket_share"
)
_LONG_RUN = re.compile(r"[.!?]+(?:\s|$)")
_SPACE = re.compile(r"\s")
#: Texts longer than so many characters are counted in parts.
PART_CHARS = 1_000_000


def _parts(text: str):
    """Parts of about PART_CHARS characters, each but the last with white space at its end."""
    at = 0
    while len(text) - at > PART_CHARS and (found := _SPACE.search(text, at + PART_CHARS)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def _lines(text: str):
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def statistics(text: str | None) -> tuple[float, ...]:
    """The STATISTICS of a text; all 0 where it is null or has no word. Of a long text only a part or a line is held in
    pieces at once; its distinct words are counted, and lines that repeat told by their hashes."""
    text = text or ""
    counts, kinds = Counter(), np.zeros(129, "i8")
    n = repeats = capitals = sentences = 0
    last = None
    for part in _parts(text):
        words = part.split()
        kinds += np.bincount(np.minimum(np.frombuffer(part.encode("utf-32-le"), "<u4"), 128), minlength=129)
        sentences += len(_LONG_RUN.findall(part))
        if words:
            n += len(words)
            counts.update(words)
            repeats += sum(map(str.__eq__, words, words[1:])) + (words[0] == last)
            capitals += sum(map(str.isupper, words))
            last = words[-1]
    if not n:
        return (0.0,) * len(STATISTICS)
    n_lines = ended = 0
    lines = set()
    for line in _lines(text):
        if shown := line.rstrip():
            n_lines += 1
            ended += shown[-1] in ".!?"
            lines.add(hash(line))
    chars = len(text)
    upper, digits, marks = kinds[65:91].sum(), kinds[48:58].sum(), kinds[33] + kinds[63]
    brackets = kinds[[60, 62, 91, 93, 123, 125]].sum()
    symbols = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum() - kinds[44] - kinds[46]
    return (
        float(n), (chars - n) / n, len(counts) / n, repeats / n, max(counts.values()) / n, upper / chars, digits / chars, marks / chars, symbols / chars, kinds[124] / chars,
        capitals / n, n / (sentences or 1), n / n_lines, 1 - len(lines) / n_lines, ended / n_lines, brackets / chars,
    )


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and one double for each of STATISTICS, of every row, repeated rows and null ids included; null and
    empty texts have zeros, an empty table gives an empty table. Other columns don't matter, whatever their names."""
    fields = [docs.select(c).schema[0] for c in named(list(keep))]
    schema = T.StructType([*fields, *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])

    def count(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(len(keep)).to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(np.ascontiguousarray(c)) for c in x.T)], [*keep, *STATISTICS])

    return docs.select(*named(list(keep)), F.col("text").alias("_quality_text")).mapInArrow(tidy(count), schema)


@dataclass
class RuleEnsemble:
    """rules: conjunctions of (statistic, above, threshold). The score is a logistic function of the weights of those
    that hold."""

    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self) -> Column:
        """The score as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, above, limit in rule:
                holds = holds & ((F.col(STATISTICS[k]) > limit) if above else (F.col(STATISTICS[k]) <= limit))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(_holding(self.rules, x) @ np.array(self.weights) + self.intercept) if self.rules else np.full(len(x), sigmoid(self.intercept))


def _holding(rules, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, above, limit in rule:
            out[:, j] *= (x[:, k] > limit) if above else (x[:, k] <= limit)
    return out


def _grow(binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: set, least: int) -> np.ndarray:
    """Best splits by squared error on the residual; adds each node's path; returns the leaf means of the rows."""
    mean = residual[rows].mean()
    if path:
        paths.add(path)
    if depth == 0 or len(rows) < 2 * least:
        return np.full(len(rows), mean)
    best = (1e-9, -1, 0)
    total, n = residual[rows].sum(), len(rows)
    for k, e in enumerate(edges):
        if not len(e):
            continue
        b = binned[rows, k]
        sums, counts = np.bincount(b, residual[rows], len(e) + 1).cumsum()[:-1], np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
        fair = (counts >= least) & (n - counts >= least)
        gain = np.where(fair, sums**2 / np.maximum(counts, 1) + (total - sums) ** 2 / np.maximum(n - counts, 1) - total**2 / n, 0)
        if gain.max() > best[0]:
            best = (gain.max(), k, int(gain.argmax()))
    _, k, cut = best
    if k < 0:
        return np.full(len(rows), mean)
    low, out = binned[rows, k] <= cut, np.empty(len(rows))
    for side in (True, False):
        pick = low if side else ~low
        out[pick] = _grow(binned, edges, residual, rows[pick], depth - 1, (*path, (k, not side, float(edges[k][cut]))), paths, least)
    return out


def learn_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, strength: float = 5e-4, seed: int = 7) -> RuleEnsemble:
    """x: statistics, y: labels. With labels of one kind the score is their share everywhere."""
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(intercept=0.0 if len(y) == 0 else 4.0 if y[0] else -4.0)
    edges = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 60)))[:-1] for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    rng, paths, z = np.random.default_rng(seed), set(), np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        rows = np.sort(rng.choice(len(y), max(1, int(0.7 * len(y))), replace=False))
        use = set(rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False).tolist())
        some = [e if k in use else e[:0] for k, e in enumerate(edges)]
        residual = y - sigmoid(z)
        found: set = set()
        _grow(binned, some, residual, rows, depth, (), found, max(5, len(y) // 400))
        paths |= found
        grown = np.zeros(len(y))
        leaves = [p for p in found if not any(q != p and q[: len(p)] == p for q in found)]
        for leaf in leaves:
            holds = _holding([leaf], x)[:, 0] > 0
            if holds.any():
                p = sigmoid(z[holds])
                grown[holds] = residual[holds].sum() / max(1e-3, (p * (1 - p)).sum())
        z = z + rate * np.clip(grown, -4, 4)
    rules = sorted(paths)
    held = _holding(rules, x)
    weights, intercept = fit_lasso_logistic(held, y, strength)
    kept = np.flatnonzero(np.abs(weights) > 1e-4)
    return RuleEnsemble([rules[k] for k in kept], [float(weights[k]) for k in kept], intercept)

"""Ranked full-text search: tokens or an index of them, a query grammar and BM25.

A pattern is parsed on the driver into a tree of phrases; whether a row matches, and how often each phrase occurs in it,
are column expressions over the places at which the pattern's words stand in the row. Those come either from a token table
(a row for each text with its tokens in order: two passes over all of it) or from an index (a row for each text and word
with the word's places, sorted by word: only the pattern's words are read). One pass counts rows with each phrase, the
other scores and keeps the best.
"""

import math
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.porter import stem

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
NEAR_TOKENS = 10
#: Up to this distance NEAR compares sets of places; beyond it, each place with each.
WIDEST = 64
COLUMNS = ("content", "role")
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _accents() -> tuple[str, str]:
    """Letters with marks, and the letters they are without."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and all(unicodedata.combining(c) for c in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(text: Column, accents: bool = False) -> Column:
    """The tokens of a text in lower case; accents are stripped unless wanted. A null text has none."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    if not accents:
        plain = F.regexp_replace(F.translate(plain, *_accents()), "[̀-ͯ]", "")
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))


def plain_tokens(text: str, accents: bool = False) -> list[str]:
    """The same on the driver, for patterns."""
    text = text.lower()
    if not accents:
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return ["".join(g) for g in re.findall(r"[^\W_]+", text)]


def token_table(texts: DataFrame, content: str = "content", accents: bool = True) -> DataFrame:
    """texts with `tokens` in place of the content."""
    return texts.withColumn("tokens", tokens(F.col(content), accents)).drop(content)


#: Tokens of whole texts that are put in order of their words at a time.
TOKENS_AT_ONCE = 1 << 21


def index(table: DataFrame, key: tuple[str, ...], stemmed: bool = False) -> DataFrame:
    """From a token table: term, the key columns, n_tokens, and the term's places in the row. A text's words lie together already,
    so nothing is shuffled to group them: rows come in runs of about TOKENS_AT_ONCE tokens, each sorted by term. Written as they
    come, a search reads of each run the pages of its words; sorted as a whole, only the files of its words. stemmed: terms are
    stems, made of the distinct words of a run."""
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = ", ".join(["term string", *[f"`{k}` {kinds[k]}" for k in key], "n_tokens int", "places array<int>"])

    def postings(batches):
        for batch in batches:
            ends = batch.column("tokens").offsets.to_numpy()
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS_AT_ONCE, "right")) - 1)
                if ends[end] > ends[at]:
                    yield _by_word(batch.slice(at, end - at), key, stemmed)
                at = end

    return table.select(*key, "tokens").mapInArrow(postings, schema)


def _by_word(texts: pa.RecordBatch, key: tuple[str, ...], stemmed: bool) -> pa.RecordBatch:
    """Some texts with their tokens to a row for each word of a text, in order of words."""
    lists = texts.column("tokens")
    ends = lists.offsets.to_numpy().astype("i8")
    coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    terms, of_word = np.unique(np.array([stem(w) for w in words] if stemmed else words, object), return_inverse=True)
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], sizes)
    group = of_word[coded.indices.to_numpy()] * len(sizes) + row
    order = np.argsort(group, kind="stable")
    group = group[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    term, row = np.divmod(group[starts], len(sizes))
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)), pa.int32()), pa.array(place[order], pa.int32()))
    columns = [pa.array(terms, pa.string()).take(pa.array(term)), *[texts.column(k).take(pa.array(row)) for k in key]]
    return pa.RecordBatch.from_arrays([*columns, pa.array(sizes[row], pa.int32()), places], ["term", *key, "n_tokens", "places"])


def stems_of(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """term and stem of each distinct term, without those that `known` (term, stem) has."""

    @F.pandas_udf("string")
    def stems(batch: pd.Series) -> pd.Series:
        return batch.map(stem)

    new = words.select("term").distinct()
    new = new if known is None else new.join(known.select("term"), "term", "left_anti")
    return new.withColumn("stem", stems("term"))


def stemmed_index(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """An index of words as one of stems: words of one stem meet in one row of a text. Only distinct words are stemmed."""
    key = [c for c in words.columns if c not in ("term", "places")]
    found = words.join(vocabulary, "term").groupBy("stem", *key)
    return found.agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places")).withColumnRenamed("stem", "term").select(*words.columns)


# The grammar -----------------------------------------------------------------------------------------------------------


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    column: bool = True  # False: looked for in a column that isn't indexed

    def starts(self, places) -> Column:
        """Places where the phrase starts, in order. places: a function from a word, and whether it is the beginning of
        one, to the column of its places."""
        if not self.column or not self.words:
            return F.array().cast("array<int>")
        found = places(self.words[0], self.prefix and len(self.words) == 1)
        for k, word in enumerate(self.words[1:], 1):
            here = places(word, self.prefix and k == len(self.words) - 1)
            found = F.array_intersect(found, F.transform(here, _shifted(k)))
        return F.filter(found, lambda i: i == 0) if self.first else found


def _shifted(k: int):
    return lambda i: i - k


@dataclass
class Near:
    phrases: list[Phrase]
    within: int


@dataclass
class Both:
    parts: list


@dataclass
class Either:
    parts: list


@dataclass
class Without:
    left: object
    right: object


_LEXEMES = re.compile(r'\s*(?:("(?:[^"]|"")*")|([(){}:+*^,-])|((?:[^\W]|[\x80-\U0010ffff])+))')


class _Parser:
    """expression := and-terms joined by OR; and-term := not-terms joined by AND; not-term := groups joined by NOT;
    group := primaries side by side (both must match)."""

    def __init__(self, text: str, stemmed: bool, accents: bool):
        self.stemmed, self.accents = stemmed, accents
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            found = _LEXEMES.match(text, at)
            if not found or found.end() == at:
                raise QueryError(f'syntax error near "{text[at:at + 10].strip()}"')
            quoted, mark, word = found.groups()
            self.items.append(("string", quoted[1:-1].replace('""', '"')) if quoted else ("mark", mark) if mark else ("word", word))
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self, kind: str, value: str | None = None):
        item = self.peek()
        if item[0] != kind or value is not None and item[1] != value:
            raise QueryError(f'syntax error near "{item[1]}"')
        self.at += 1
        return item[1]

    def is_(self, kind: str, value: str, ahead: int = 0) -> bool:
        return self.peek(ahead) == (kind, value)

    def parse(self):
        if not self.items:
            raise QueryError("syntax error: an empty pattern")
        tree = self.either(True)
        self.take("end")
        return tree

    def either(self, column: bool):
        parts = [self.both(column)]
        while self.is_("word", "OR"):
            self.at += 1
            parts.append(self.both(column))
        return parts[0] if len(parts) == 1 else Either(parts)

    def both(self, column: bool):
        parts = [self.without(column)]
        while self.is_("word", "AND"):
            self.at += 1
            parts.append(self.without(column))
        return parts[0] if len(parts) == 1 else Both(parts)

    def without(self, column: bool):
        left = self.group(column)
        while self.is_("word", "NOT"):
            self.at += 1
            left = Without(left, self.group(column))
        return left

    def group(self, column: bool):
        parts = [self.primary(column)]
        while self.peek()[0] == "string" or self.peek()[0] == "word" and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() in (
            ("mark", "("), ("mark", "^"), ("mark", "{"), ("mark", "-")
        ):
            parts.append(self.primary(column))
        return parts[0] if len(parts) == 1 else Both(parts)

    def columns(self) -> bool | None:
        """A column filter if one is next: whether the indexed column passes it."""
        start, but = self.at, False
        if self.is_("mark", "-"):
            self.at, but = self.at + 1, True
        names = None
        if self.is_("mark", "{"):
            self.at += 1
            names = []
            while not self.is_("mark", "}"):
                if self.peek()[0] not in ("word", "string"):
                    raise QueryError(f'syntax error near "{self.peek()[1]}"')
                names.append(self.peek()[1])
                self.at += 1
            self.at += 1
        elif self.peek()[0] in ("word", "string") and self.is_("mark", ":", 1):
            names = [self.peek()[1]]
            self.at += 1
        if names is None or not self.is_("mark", ":"):
            if but or names is not None:
                raise QueryError(f'syntax error near "{self.peek()[1] or "-"}"')
            self.at = start
            return None
        self.at += 1
        for name in names:
            if name.lower() not in COLUMNS:
                raise QueryError(f"no such column: {name}")
        return ("content" in [n.lower() for n in names]) != but

    def primary(self, column: bool):
        passed = self.columns()
        if passed is not None:
            return self.primary(column and passed)
        if self.is_("mark", "("):
            self.at += 1
            tree = self.either(column)
            self.take("mark", ")")
            return tree
        if self.is_("word", "NEAR") and self.is_("mark", "(", 1):
            self.at += 2
            phrases, within = [self.phrase(column)], NEAR_TOKENS
            while not self.is_("mark", ")") and not self.is_("mark", ","):
                phrases.append(self.phrase(column))
            if self.is_("mark", ","):
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise QueryError(f"expected integer, got {number}")
                within = int(number)
            self.take("mark", ")")
            return Near(phrases, within) if len(phrases) > 1 else phrases[0]
        return self.phrase(column)

    def phrase(self, column: bool) -> Phrase:
        first = self.is_("mark", "^")
        self.at += first
        words, prefix = self.string(), False
        while self.is_("mark", "+"):
            self.at += 1
            words += self.string()
        if self.is_("mark", "*"):
            self.at += 1
            prefix = True
        return Phrase(words, prefix, first, column)

    def string(self) -> list[str]:
        kind, value = self.peek()
        if kind not in ("word", "string") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise QueryError(f'syntax error near "{value}"')
        self.at += 1
        found = plain_tokens(value, self.accents)
        if kind == "word" and self.is_("mark", "-"):
            raise QueryError(f"no such column: {self.peek(1)[1]}")
        prefixed = self.is_("mark", "*")
        return [w if prefixed and k == len(found) - 1 and not self.stemmed else stem(w) if self.stemmed else w for k, w in enumerate(found)]


def parse(pattern: str, stemmed: bool = True) -> object:
    """The tree of a pattern; QueryError where it isn't in the grammar."""
    return _Parser(pattern, stemmed, accents=not stemmed).parse()


# Plans -----------------------------------------------------------------------------------------------------------------


class _Plan:
    """Numbers the words and phrases of a tree and writes its match and counts as columns over `starts_k`, and those over
    `places_k`."""

    def __init__(self, tree):
        self.phrases: list[Phrase] = []
        self.counts: list[Column] = []
        self.words: dict[tuple[str, bool], str] = {}
        self.matches = self._of(tree)
        self.starts = [p.starts(self._places).alias(f"starts_{k}") for k, p in enumerate(self.phrases)]

    def _places(self, word: str, prefix: bool) -> Column:
        return F.col(self.words.setdefault((word, prefix), f"places_{len(self.words)}"))

    def _phrase(self, phrase: Phrase) -> Column:
        self.phrases.append(phrase)
        return F.col(f"starts_{len(self.phrases) - 1}")

    def _of(self, node) -> Column:
        """Whether the node matches; its phrases' counts are 0 where it doesn't."""
        at = len(self.counts)
        if isinstance(node, Phrase):
            starts = self._phrase(node)
            self.counts.append(F.size(starts))
            return F.size(starts) > 0
        if isinstance(node, Near):
            starts = [self._phrase(p) for p in node.phrases]
            reach = [len(p.words) + node.within for p in node.phrases]
            ends = F.array_distinct(F.flatten(F.array(*starts)))
            close = ends
            for s, r in zip(starts, reach):
                close = F.array_intersect(close, _after(s, r)) if r <= WIDEST else F.filter(close, _within(s, r))
            self.counts += [F.size(F.array_intersect(s, _before(close, r)) if r <= WIDEST else F.filter(s, _reached(close, r))) for s, r in zip(starts, reach)]
            return F.size(close) > 0
        if isinstance(node, Both):
            holds = _all([self._of(p) for p in node.parts])
        elif isinstance(node, Either):
            parts = [self._of(p) for p in node.parts]
            holds = parts[0]
            for p in parts[1:]:
                holds = holds | p
        else:
            holds = self._of(node.left)
            own = len(self.counts)
            holds = holds & ~self._of(node.right)
            self.counts[own:] = [F.lit(0)] * (len(self.counts) - own)
        self.counts[at:] = [F.when(holds, c).otherwise(F.lit(0)) for c in self.counts[at:]]
        return holds


def _after(starts: Column, reach: int) -> Column:
    """All places up to so many after some start: sets are met by hashing, which takes time in proportion to their sizes."""
    return F.flatten(F.transform(starts, lambda x: F.sequence(x, x + reach)))


def _before(lasts: Column, reach: int) -> Column:
    return F.flatten(F.transform(lasts, lambda m: F.sequence(m - reach, m)))


def _within(starts: Column, reach: int):
    """Whether some start lies so near before the last start of a group."""
    return lambda last: F.exists(starts, lambda x: (x <= last) & (x >= last - reach))


def _reached(lasts: Column, reach: int):
    """Whether a start belongs to one of the groups that end with these starts."""
    return lambda x: F.exists(lasts, lambda m: (x <= m) & (x >= m - reach))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def search(table: DataFrame, pattern: str, limit: int, order: tuple[str, ...], stemmed: bool = True, where: Column | None = None) -> DataFrame:
    """The best rows of a token table with `rank` (negative; the lower the better), ties in the given order.

    Frequencies and lengths are counted over the whole table, `where` only narrows what is returned.
    """
    plan = _Plan(parse(pattern, stemmed))

    def places(word: str, prefix: bool) -> Column:
        # the tokens are arguments of functions, never named within a lambda, where they would be made anew for every element
        return F.array_compact(F.transform("tokens", lambda t, i: F.when(F.startswith(t, F.lit(word)) if prefix else t == word, i)))

    rows = table.select("*", F.size("tokens").alias("n_tokens"), *[places(*word).alias(name) for word, name in plan.words.items()])
    total = [F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")]
    n, n_tokens, *holders = rows.select("*", *plan.starts).agg(*total, *[F.count_if(F.size(f"starts_{k}") > 0) for k in range(len(plan.starts))]).first()
    return _best(rows, plan, (n, n_tokens), holders, limit, order, where, [c for c in table.columns if c != "tokens"])


def _entries(tree, frequent: dict[tuple[str, bool], int]) -> set[tuple[str, bool]]:
    """Words of which each matching text has one at least, chosen to be rare: of what must hold together the rarest, of
    alternatives all."""
    if isinstance(tree, Phrase):
        words = [(w, tree.prefix and k == len(tree.words) - 1) for k, w in enumerate(tree.words)] if tree.column else []
        return {min(words, key=lambda w: (frequent[w], w))} if words else set()
    if isinstance(tree, Without):
        return _entries(tree.left, frequent)
    parts = [_entries(p, frequent) for p in (tree.phrases if isinstance(tree, Near) else tree.parts)]
    if isinstance(tree, Either):
        return set().union(*parts)
    return min(parts, key=lambda words: sum(frequent[w] for w in words))


def search_index(
    postings: DataFrame, n: int, n_tokens: int, pattern: str, limit: int, order: tuple[str, ...], stemmed: bool = True, where: DataFrame | None = None
) -> DataFrame:
    """The same from an index of n texts with n_tokens tokens in all: its key columns and rank. Only rows of the pattern's
    words are read. They are counted first; then texts are put together from the rows of words that are rare and that every
    match needs, and those of frequent words are met by them, so a word that stands in most texts is counted and looked up but
    never grouped whole. A pattern without words matches nothing. where: keys (one column) to which the result is narrowed."""
    tree = parse(pattern, stemmed)
    plan = _Plan(tree)
    key = [c for c in postings.columns if c not in ("term", "places")]
    holds = lambda word, prefix: F.startswith(F.col("term"), F.lit(word)) if prefix else F.col("term") == word
    any_of = lambda words: _any([holds(*w) for w in sorted(words)])
    rows = postings.where(any_of(plan.words))
    counts = [F.count_if(holds(*word)).alias(name) for word, name in plan.words.items()]
    tally = rows.agg(F.lit(0).alias("none"), *[F.coalesce(c, F.lit(0)).alias(name) for c, name in zip(counts, plan.words.values())]).first()
    frequent = {word: tally[name] for word, name in plan.words.items()}

    def texts(of: DataFrame, wanted: set) -> DataFrame:
        """A row for each text that has a wanted word, with the places of all words."""
        if len(plan.words) == 1 and not any(prefix for _, prefix in plan.words):  # its rows are the texts
            return of.select(*key, F.col("places").alias("places_0"))
        held = of
        if wanted != set(plan.words):
            here = of.where(any_of(wanted)).select(*[c for c in key if c != "n_tokens"]).distinct()
            held = of.join(here, here.columns, "left_semi")
        sums = [F.sort_array(F.flatten(F.collect_list(F.when(holds(*word), F.col("places"))))).alias(name) for word, name in plan.words.items()]
        return held.groupBy(*key).agg(*sums, F.count("*").alias("n_words")).drop("n_words")

    # in how many texts each phrase stands: of a whole word that is known, of others their rarest words' texts tell
    holders, asked = [], []
    for k, phrase in enumerate(plan.phrases):
        plain = phrase.column and len(phrase.words) == 1 and not phrase.prefix and not phrase.first
        holders.append(frequent[phrase.words[0], False] if plain else 0)
        asked += [] if plain else [k]
    wanted = set().union(*[_entries(plan.phrases[k], frequent) for k in asked]) if asked else set()
    if wanted:
        found = texts(rows, wanted).select(*[plan.starts[k] for k in asked])
        for k, count in zip(asked, found.agg(*[F.count_if(F.size(f"starts_{k}") > 0) for k in asked]).first()):
            holders[k] = count
    entries = _entries(tree, frequent)
    rows = texts(rows, entries) if entries else texts(rows, set(plan.words)).where("false")
    return _best(rows, plan, (n, n_tokens), holders, limit, order, where, [c for c in key if c != "n_tokens"])


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _best(
    rows: DataFrame, plan: _Plan, sizes: tuple[int, int], holders: list[int], limit: int, order: tuple[str, ...], where: Column | DataFrame | None, kept: list[str]
) -> DataFrame:
    """sizes: of the whole table, texts and tokens. holders: in how many texts each phrase stands."""
    rows = rows.select("*", *plan.starts)
    n, tokens_ = sizes
    mean = tokens_ / n if n else 0.0
    score = F.lit(0.0)
    for k, count in enumerate(plan.counts):
        idf = max(LEAST_IDF, math.log((n - holders[k] + 0.5) / (holders[k] + 0.5)))
        score = score + F.lit(idf) * count * F.lit(K1 + 1) / (count + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_tokens") / F.lit(mean or 1.0)))
    found = rows.where(plan.matches)
    if isinstance(where, DataFrame):
        found = found.join(where, where.columns, "left_semi")
    elif where is not None:
        found = found.where(where)
    return found.select(*kept, (-score).alias("rank")).orderBy("rank", *order).limit(limit)

"""Language identification in two steps: a linear machine names the family, then one-versus-one linear support vector
machines vote among the languages of that family. Texts are square roots of hashed character trigram shares."""

import unicodedata
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .linear import fit_svm, sigmoid

# Families of common language codes; every other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "ur", "bn", "mr", "pa", "gu", "ne"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMENSIONS = 4096
UNKNOWN = "und"
#: Most rows that are learned from, most characters they have together, and characters turned into trigrams at once.
MAX_LEARNED = 6_000
MAX_LEARNED_CHARS = 32_000_000
CHUNK_CHARS = 1_000_000


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark on one; made once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(k))[0] in "LM" for k in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def has_letter(text: str) -> bool:
    """Whether any character is alphabetic; numbers like ² and Ⅷ are not."""
    return any(map(str.isalpha, text))


def trigram_shares(texts: list[str]) -> np.ndarray:
    """A row of unit length for each text. Anything but letters counts as one kind of gap."""
    out = np.zeros((len(texts), DIMENSIONS), "f4")
    for k, text in enumerate(texts):
        code = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le"), "<u4")
        code = np.where(letters()[code], code, 32).astype("u4")
        code = code[np.append(True, (code[1:] != 32) | (code[:-1] != 32))]
        mixed = (code[:-2] * np.uint32(0x9E3779B1)) ^ (code[1:-1] * np.uint32(0x85EBCA77)) ^ (code[2:] * np.uint32(0xC2B2AE3D))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts = np.bincount((mixed >> np.uint32(20)).astype("i8"), minlength=DIMENSIONS) if len(mixed) else np.zeros(DIMENSIONS)
        out[k] = np.sqrt(counts / max(1, counts.sum()))
    return out


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None  # one column a family
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        texts = [t or "" for t in texts]
        known = [k for k, t in enumerate(texts) if has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(known) and self.families:
            part, size = [], 0
            while at < len(known) and size < CHUNK_CHARS and len(part) < 256:
                part.append(known[at])
                size += len(texts[known[at]])
                at += 1
            x = trigram_shares([texts[k] for k in part])
            x = np.column_stack([x, np.ones(len(x), "f4")])
            margins = x @ self.family_weights if len(self.families) > 1 else np.zeros((len(x), 1), "f4")
            best = margins.argmax(1)
            ranked = np.sort(margins, axis=1)
            sure = sigmoid(4.0 * (ranked[:, -1] - ranked[:, -2]).astype("f8")) if len(self.families) > 1 else np.ones(len(x))
            for f in np.unique(best):
                rows, languages = np.flatnonzero(best == f), self.members[self.families[f]]
                votes, support = np.zeros((len(rows), len(languages))), np.zeros((len(rows), len(languages)))
                for (a, b), w in self.pair_weights.items():
                    if a in languages and b in languages:
                        m = (x[rows] @ w).astype("f8")
                        for name, sign in ((a, 1), (b, -1)):
                            votes[:, languages.index(name)] += sign * m > 0
                            support[:, languages.index(name)] += sign * m
                won = (votes + 1e-3 * np.tanh(support)).argmax(1)
                margin = support[np.arange(len(rows)), won] / max(1, len(languages) - 1)
                confidence = sigmoid(4.0 * margin) if len(languages) > 1 else np.ones(len(rows))
                for r, w, c in zip(rows, won, confidence * sure[rows]):
                    names[part[r]], scores[part[r]] = languages[w], float(c)
        return names, scores


def learn_languages(rows: list[tuple[str, str]], family_of: dict[str, str] = FAMILY_OF) -> LanguageModel:
    """rows: text and language. Rows without a letter teach nothing. Without rows every text is `und`."""
    rows = [(t, lang) for t, lang in rows if t and lang and has_letter(t)]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return LanguageModel()
    members: dict[str, list[str]] = {}
    for lang in languages:
        members.setdefault(family_of.get(lang, lang), []).append(lang)
    model = LanguageModel(sorted(members), members)
    x, y = trigram_shares([t for t, _ in rows]), np.array([lang for _, lang in rows])
    own = np.array([family_of.get(lang, lang) for lang in y])
    sign = lambda mask: np.where(mask, 1, -1).astype("f4")
    if len(model.families) > 1:
        model.family_weights = np.column_stack([fit_svm(x, sign(own == f)) for f in model.families])
    for group in members.values():
        for a, b in combinations(group, 2):
            pick = (y == a) | (y == b)
            model.pair_weights[a, b] = fit_svm(x[pick], sign(y[pick] == a))
    return model


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and lang_score of every row; `und` and 0 where the text is null or has no letter. Of languages with
    equal votes and margins the first in order is predicted. Rows that repeat are predicted alike, null ids too; an empty
    table gives an empty table."""

    def predict(batches):
        for batch in batches:
            names, scores = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "lang_score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(predict), "doc_id long, lang_pred string, lang_score double")

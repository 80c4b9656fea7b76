"""Language identification by a mixture of languages in each document.

A model holds, for each learned language, the log probability of a letter given the two before it
in its word (seen trigrams, else bigrams, else letters).  A document is a mixture: each of its words
comes from one language.  Expectation-maximisation finds the proportions; languages whose
proportion stays below ``MIN_SHARE`` go; among the rest the set is taken by penalised likelihood
(one more language must pay for itself, ``log n`` for each extra proportion).  The predicted language is the one
with the largest proportion in the chosen set, and that proportion is the score.

The model is fitted on at most ``SAMPLE_DOCS`` labelled documents of each language.  Predictions
use the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text
where nothing was learned; ties go to the language that sorts first; rows with equal or null ids are all returned;
columns that aren't kept are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, map_arrow, pieces_of

SAMPLE_DOCS = 400
MIN_SHARE = 0.02
#: EM goes on until no proportion of a document moves by more than this, and so many rounds at most; all documents of a
#: batch share the first rounds.
STILL, MOST_ROUNDS, SHARED_ROUNDS = 1e-3, 200, 6
WORD_CACHE = 150_000
WORDS = re.compile(r"[^\W\d_]+")


def grams_of(text: str) -> Counter:
    """Counts of the letters of a text's words, each alone and with the one or two before it in its word."""
    out: Counter = Counter()
    for word, n in Counter(WORDS.findall(text.lower())).items():
        w = f"^^{word}$"
        for i in range(2, len(w)):
            for order in range(3):
                out[w[i - order : i + 1]] += n
    return out


@dataclass
class NgramModel:
    languages: list[str]
    index: dict[str, int]  # trigram, bigram or letter -> row of table
    table: np.ndarray  # (rows, languages); row 0: unseen letters

    @classmethod
    def fit(cls, texts: list[tuple[str, str]]) -> NgramModel:
        """From (language, text) pairs."""
        counts: dict[str, Counter] = {}
        for lang, text in texts:
            counts.setdefault(lang, Counter()).update(grams_of(text))
        return cls.of_counts([(lang, gram, n) for lang, c in counts.items() for gram, n in c.items()] + [(lang, "", 0) for lang in counts])

    @classmethod
    def of_counts(cls, found: list[tuple[str, str, int]]) -> NgramModel:
        """From (language, n-gram, count): interpolated, at each order shrunk towards the one below."""
        languages = sorted({lang for lang, _, _ in found})
        at = {lang: i for i, lang in enumerate(languages)}
        counts = [[Counter() for _ in languages] for _ in range(3)]
        for lang, gram, n in found:
            if gram:
                counts[len(gram) - 1][at[lang]][gram] += n
        index: dict[str, int] = {}
        rows = [np.full(len(languages), np.log(1e-7))]
        below: dict[str, np.ndarray] = {}
        letters = max(1, len(set().union(*counts[0]))) if languages else 1
        for order in range(3):
            grams = sorted(set().union(*counts[order])) if languages else []
            contexts = [Counter() for _ in languages]
            for i, c in enumerate(counts[order]):
                for gram, n in c.items():
                    contexts[i][gram[:-1]] += n
            own: dict[str, np.ndarray] = {}
            for gram in grams:
                base = below[gram[1:]] if order else np.full(len(languages), 1.0 / letters)
                seen = np.array([c[gram] for c in counts[order]], float)
                context = np.array([c[gram[:-1]] for c in contexts], float)
                own[gram] = (seen + 5.0 * base) / (context + 5.0)
                index[gram] = len(rows)
                rows.append(np.log(own[gram]))
            below = own
        return cls(languages, index, np.asarray(rows, np.float32).reshape(len(rows), len(languages)))

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """(words, languages): the log likelihood of each word."""
        get, flat, ends = self.index.get, [], [0]
        for word in words:
            w = f"^^{word}$"
            for i in range(3, len(w) + 1):
                flat.append(get(w[i - 3 : i]) or get(w[i - 2 : i]) or get(w[i - 1 : i], 0))
            ends.append(len(flat))
        return np.add.reduceat(self.table[flat], ends[:-1], axis=0)


def _rounds(odds: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions after some rounds of EM, whether they stand still) of documents whose words lie one after the other."""
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    still = np.zeros(len(sizes), bool)
    for _ in range(rounds):
        joint = odds * share.astype(np.float32)[doc]
        joint /= joint.sum(axis=1, keepdims=True) + np.float32(1e-30)
        new = np.add.reduceat(joint, starts, axis=0, dtype=np.float64) / sizes[:, None]
        still, share = np.abs(new - share).max(axis=1) <= STILL, new
        if still.all():
            break
    return share, still


def _words(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rows of some documents' words."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _proportions(odds: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once, until it stands still: (proportions, log likelihoods up to the words' own scale).

    ``odds``: words' likelihoods, each row scaled by its maximum; ``allowed``: (documents, languages), 0 or 1.
    """
    share, still = _rounds(odds, sizes, allowed / allowed.sum(axis=1, keepdims=True), SHARED_ROUNDS)
    moving, done = np.flatnonzero(~still), SHARED_ROUNDS
    while len(moving) and done < MOST_ROUNDS:
        share[moving], still = _rounds(odds[_words(starts[moving], sizes[moving])], sizes[moving], share[moving], SHARED_ROUNDS)
        moving, done = moving[~still], done + SHARED_ROUNDS
    fit = np.log((odds * share.astype(np.float32)[np.repeat(np.arange(len(sizes)), sizes)]).sum(axis=1) + 1e-30)
    return share, np.add.reduceat(fit.astype(np.float64), starts)


def mixtures(odds: np.ndarray, sizes: np.ndarray, min_share: float = MIN_SHARE) -> np.ndarray:
    """(documents, languages): the proportions in each document's chosen language set."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    share, _ = _proportions(odds, starts, sizes, np.ones((len(sizes), odds.shape[1])))
    share[share < min_share] = 0
    mixed = np.flatnonzero((share > 0).sum(axis=1) > 1)
    out = (share == share.max(axis=1, keepdims=True)) & (np.cumsum(share == share.max(axis=1, keepdims=True), axis=1) == 1)
    out = out.astype(float)
    if len(mixed):
        part, n = odds[_words(starts[mixed], sizes[mixed])], sizes[mixed]
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        rank = np.argsort(np.argsort(-share[mixed], axis=1, kind="stable"), axis=1)
        many = (share[mixed] > 0).sum(axis=1)
        best = np.full(len(mixed), np.inf)
        for k in range(1, int(many.max()) + 1):
            allowed = (rank < np.minimum(k, many)[:, None]).astype(float)
            got, fit = _proportions(part, at, n, allowed)
            price = -2 * fit + (np.minimum(k, many) - 1) * np.log(np.maximum(n, 2)) * 2
            better = price < best - 1e-9
            best[better] = price[better]
            out[mixed[better]] = got[better]
    return out


class Identifier:
    """A model with a bounded cache of words' likelihoods; one for each Python worker."""

    def __init__(self, model: NgramModel):
        self.model, self.rows = model, {}
        self.odds = np.empty((0, len(model.languages)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.model.languages:
            return langs, scores
        found = [WORDS.findall(t.lower()) if t else [] for t in texts]
        distinct = set(chain.from_iterable(found))
        new = list(distinct.difference(self.rows))
        if len(self.rows) + len(new) > WORD_CACHE:
            self.rows, self.odds = {}, self.odds[:0]
            new = list(distinct)
        if new:
            fit = self.model.likelihoods(new)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.odds = np.concatenate([self.odds, np.exp(fit - fit.max(axis=1, keepdims=True))])
        for i, words in enumerate(found):
            if not any(c.isalpha() for w in words for c in w):  # numbers that are no decimal digits pass for words, but are no letters
                found[i] = []
        docs = [i for i, words in enumerate(found) if words]
        if docs:
            sizes = np.array([len(found[i]) for i in docs])
            at = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
            share = mixtures(self.odds[at], sizes)
            best = share.argmax(axis=1)
            for i, k, s in zip(docs, best, share, strict=True):
                langs[i], scores[i] = self.model.languages[k], min(1.0, float(s[k]))
        return langs, scores


def sample(labelled: DataFrame, label: str, keys: list[str], bound: int, salt: int = 0, totals: dict | None = None) -> DataFrame:
    """About ``bound`` rows of each label, by a hash of their keys: the same rows on every run."""
    totals = totals or {r[0]: r[1] for r in labelled.groupBy(label).count().collect() if r[0] is not None}
    keep = F.lit(False)
    draw = F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1_000_000))
    for value, n in totals.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (draw < F.lit(min(1_000_000, int(1_000_000 * bound / n) + 1))))
    return labelled.filter(keep)


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", bound: int = SAMPLE_DOCS) -> NgramModel:
    """``labelled``: rows that may be learned from; null languages and texts teach nothing.

    The sample's n-grams are counted by the cluster; what the driver gets is one row for each language and distinct n-gram.
    """
    rows = sample(labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), lang_col, [id_col], bound)

    def count(batches):
        for b in pieces_of(batches):
            held: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter({"": 0})).update(grams_of(text))
            flat = [(lang, gram, n) for lang, c in held.items() for gram, n in c.items()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*flat, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "gram", "n"])

    counted = map_arrow(rows.select(lang_col, text_col), count, "lang string, gram string, n long")
    return NgramModel.of_counts([tuple(r) for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()])


def identify(docs: DataFrame, model: NgramModel, *, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of each row, with the predicted language and its share under ``names``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    shape = docs.select(*keep).schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in shape] + [f"`{names[0]}` string", f"`{names[1]}` double"])

    def run(batches):
        who = Identifier(held.value)
        for b in pieces_of(batches):
            langs, scores = who.predict(b.column(len(keep)).to_pylist())
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return map_arrow(docs.select(*keep, F.col(text_col).alias(fresh("_text", keep))), run, schema)

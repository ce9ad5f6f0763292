"""Language identification by a linear-chain conditional random field over words.

Each word's features are its prefixes, suffixes, character n-grams, itself, and its membership in per-language lexicons
built from the training texts; transitions between neighbouring words' languages are learned too. Forward-backward gives
every word a distribution, also in code-switched text; a text's language is the one with the largest mean.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, claim

PER_LANGUAGE = 400  # training texts of a language at most, about; chosen by a hash of the id
PER_TEXT = 20_000  # characters of a training text at most
SEGMENT = 40  # words of a chain; longer texts are cut into several
SPACE = 1 << 18
LEXICON = 300  # words in a language's lexicon
CACHE = 300_000  # words a worker remembers
PIECES = 200_000  # pieces of words whose hashes it remembers
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def _code(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SPACE


class _Codes(dict):
    """Hashes of the features that many words share."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= PIECES:
            self.clear()
        self[feature] = code = _code(feature)
        return code


_codes = _Codes()


def features(word: str, lexicons: dict[str, int]) -> list[int]:
    """Hashed features of a word; `lexicons` maps a word to the bits of the languages that list it."""
    w = f"<{word}>"
    found = {"p" + w[:2], "p" + w[:3], "p" + w[:4], "s" + w[-2:], "s" + w[-3:], "s" + w[-4:]}
    found.update([w[i : i + 2] for i in range(len(w) - 1)])
    found.update([w[i : i + 3] for i in range(len(w) - 2)])
    if marks := lexicons.get(word, 0):
        found.update(f"l{b}" for b in range(marks.bit_length()) if marks >> b & 1)
    return [_code("w" + word), *map(_codes.__getitem__, found)]


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the word (-1: none) at each place of each chain, and the text of each chain."""
    cuts = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), cuts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start = (np.cumsum(lengths) - lengths)[text] + nth * SEGMENT
    size = np.minimum(SEGMENT, lengths[text] - nth * SEGMENT)
    at = start[:, None] + np.arange(SEGMENT)
    return np.where(np.arange(SEGMENT) < size[:, None], at, -1), text


class Crf:
    """Weights of a trained model: `weight` (feature, label), `link` (label, next label), labels and lexicons."""

    def __init__(self, labels: list[str], weight: np.ndarray, link: np.ndarray, lexicons: dict[str, int]):
        self.labels, self.weight, self.link, self.lexicons = labels, weight, link, lexicons
        self._index: dict[str, int] = {}
        self._rows = np.zeros((1024, len(labels)))

    def forget(self):
        _codes.clear()
        self._index, self._rows = {}, np.zeros((1024, len(self.labels)))

    def __getstate__(self):
        return self.labels, self.weight, self.link, self.lexicons

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, every: list[str]) -> np.ndarray:
        if len(self._index) > CACHE:
            self.forget()
        fresh = [w for w in dict.fromkeys(every) if w not in self._index]
        for lo in range(0, len(fresh), 20_000):
            part, n = fresh[lo : lo + 20_000], len(self._index)
            lists = [features(w, self.lexicons) for w in part]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))
            if n + len(part) > len(self._rows):
                self._rows = np.concatenate((self._rows[:n], np.zeros((n + len(part), len(self.labels)))))
            self._rows[n : n + len(part)] = np.add.reduceat(self.weight[flat], np.cumsum(sizes) - sizes)
            self._index.update(zip(part, range(n, n + len(part))))
        return self._rows[np.fromiter(map(self._index.__getitem__, every), np.int64, len(every))]

    def label_texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's label (`und` without letters) and its mean probability over the words."""
        split = [words(t) for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        if not lengths.sum() or not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts))
        at, text = chains(lengths)
        emit = self.emissions([w for s in split for w in s])
        inside = at >= 0
        odds, _ = forward_backward(emit[np.where(inside, at, 0)], inside, self.link, transitions=False)
        summed = np.zeros((len(texts), len(self.labels)))
        np.add.at(summed, text, (odds * inside[:, :, None]).sum(1))
        mean = summed / np.maximum(lengths, 1)[:, None]
        best = mean.argmax(1)
        return [self.labels[b] if n else "und" for b, n in zip(best.tolist(), lengths.tolist())], np.where(lengths > 0, mean.max(1), 0).clip(0, 1)


def forward_backward(emit: np.ndarray, inside: np.ndarray, link: np.ndarray, transitions: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chain, place, label) and expected transitions summed over all chains (zeros if not asked for, as by a
    trained model). emit: (chain, place, label)."""
    n, places, k = emit.shape
    local = np.exp(np.maximum(emit - emit.max(2, keepdims=True), -60))
    local[~inside] = 1
    step = np.exp(link - link.max())
    ahead, back = np.empty((n, places, k)), np.ones((n, places, k))
    a = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    ahead[:, 0] = a
    for t in range(1, places):
        b = (a @ step) * local[:, t]
        b /= b.sum(1, keepdims=True)
        a = np.where(inside[:, t, None], b, a)
        ahead[:, t] = a
    b = back[:, places - 1]
    for t in range(places - 2, -1, -1):
        c = (b * local[:, t + 1]) @ step.T
        c /= c.sum(1, keepdims=True)
        b = np.where(inside[:, t + 1, None], c, 1.0)
        back[:, t] = b
    odds = ahead * back
    odds /= odds.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(places - 1) if transitions else ():
        on = inside[:, t + 1]
        joint = ahead[on, t][:, :, None] * step * (local[on, t + 1] * back[on, t + 1])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return odds, pairs


def train(texts: list[str], langs: list[str], rounds: int = 20, chains_most: int = 8_000, seed: int = 5) -> Crf:
    """Fits a model by Adam steps on the penalised likelihood. A quarter of the chains join halves of two texts, so that
    transitions between languages are seen. Texts without letters teach nothing."""
    labels = sorted(set(langs))
    if not labels:
        return Crf([], np.zeros((SPACE, 0)), np.zeros((0, 0)), {})
    k = len(labels)
    frame = pd.DataFrame({"word": [words(t) for t in texts], "label": [labels.index(x) for x in langs]}).explode("word").dropna()
    if frame.empty:
        return Crf(labels, np.zeros((SPACE, k)), np.zeros((k, k)), {})
    share = frame.groupby("label").word.value_counts(normalize=True).rename("share").reset_index()
    share["part"] = share.share / share.groupby("word").share.transform("sum")
    listed = share[share.part > 0.5].sort_values(["share", "word"], ascending=[False, True]).groupby("label").head(LEXICON)
    lexicons: dict[str, int] = {}
    for w, label in zip(listed.word, listed.label):
        lexicons[w] = lexicons.get(w, 0) | 1 << int(label)

    rng = np.random.default_rng(seed)
    codes, vocabulary = pd.factorize(frame.word)
    gold = frame.label.to_numpy()
    at, _ = chains(frame.groupby(level=0, sort=False).size().to_numpy())
    at = at[rng.permutation(len(at))[:chains_most]]
    mixed = at[: len(at) // 4]
    half = SEGMENT // 2
    mixed[:, half:] = np.where((mixed[:, half - 1] >= 0)[:, None], np.roll(at, len(at) // 3, 0)[: len(mixed), :half], mixed[:, half:])
    inside = at >= 0
    word, truth = np.where(inside, codes[at], 0), np.where(inside, gold[at], 0)
    lists = [np.array(features(w, lexicons), np.int32) for w in vocabulary]
    sizes = np.array([len(x) for x in lists])
    flat, owner, edges = np.concatenate(lists), np.repeat(np.arange(len(lists), dtype=np.int32), sizes), np.cumsum(sizes) - sizes
    del lists, frame, share, listed

    weight, link = np.zeros((SPACE, k)), np.zeros((k, k))
    seen = np.zeros((k, k))
    for t in range(SEGMENT - 1):
        on = inside[:, t + 1]
        np.add.at(seen, (truth[on, t], truth[on, t + 1]), 1)
    total = inside.sum()
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(link), np.zeros_like(link)]
    for step in range(1, rounds + 1):
        emit = np.stack([np.add.reduceat(weight[:, c][flat], edges) for c in range(k)], 1)
        odds, pairs = forward_backward(emit[word], inside, link)
        error = -odds
        np.put_along_axis(error, truth[:, :, None], np.take_along_axis(error, truth[:, :, None], 2) + 1, 2)
        error *= inside[:, :, None]
        by_word = np.stack([np.bincount(word.ravel(), error[:, :, c].ravel(), len(sizes)) for c in range(k)], 1)
        up = np.stack([np.bincount(flat, by_word[owner, c], SPACE) for c in range(k)], 1) / total - 1e-7 * weight
        for grad, value, m, v in ((up, weight, state[0], state[1]), ((seen - pairs) / total - 1e-5 * link, link, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Crf(labels, weight, link, lexicons)


def held_out_of(id_col: str, fold: int = 2):
    """True where crc32 of the id as text, modulo 4, is `fold`; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == fold, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int | None = 2, per_language: int = PER_LANGUAGE) -> Crf:
    """Trains on about `per_language` labelled texts of each language (a bounded sample, by a hash of the id; PER_TEXT
    characters of each at most) outside `fold`."""
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    if fold is not None:
        usable = usable.where(~held_out_of(id_col, fold))
    mark = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("crf")), F.lit(1 << 30))
    counts = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col(lang_col) == lang) & (mark < int(min(1.0, per_language / n) * (1 << 30))))
    rows = usable.where(wanted).select(mark.alias("m"), F.substring(text_col, 1, PER_TEXT).alias("t"), F.col(lang_col).alias("l")).collect()
    rows.sort(key=lambda r: (r.m, r.l, r.t))
    return train([r.t for r in rows], [r.l for r in rows])


def identify(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs`, and lang_pred and score (replacing columns of these names).

    Null texts and texts without letters are `und` with score 0. Every word of a text counts, whole; long texts are cut into
    chains of SEGMENT words. Equal means go to the first language by name. An empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        crf = held.value
        claim("language", crf.forget)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 500_000):
                    size += len(texts[hi] or "")
                    hi += 1
                langs, scores = crf.label_texts(texts[lo:hi])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(langs), pa.array(scores)], [*kept, "lang_pred", "score"])
                lo = hi

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*kept).mapInArrow(run, schema)

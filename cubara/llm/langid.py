"""Language identification as multilingual mixture inference.

Training counts hashed byte n-grams (2 to 4 bytes of folded text) for each
language over a bounded sample of its labelled rows and smooths them into
likelihoods. A document is taken as a mixture of languages: expectation-
maximisation estimates the proportion of its n-grams that each language gave,
and the set of languages is chosen by penalised likelihood: languages leave from
the smallest proportion on as long as what the likelihood loses is less than the
penalty. The prediction is the language of the largest proportion, the score its
proportion.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import map_batches, utf8

BUCKETS, ROUNDS, SMOOTH, SLICE = 1 << 15, 12, 0.5, 1 << 20
#: Labelled rows that are counted for each language, about, and languages that are learnt, the most frequent ones: a table of 128 kB each.
SAMPLE, LANGUAGES = 5_000, 512
#: Numbers that the mixtures of some texts may take at once; texts of one call are divided so.
CELLS = 8 << 20
#: N-grams overlap, so they are about this many times as many as independent ones.
PENALTY = 2.0
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def _folded(text: bytes) -> np.ndarray:
    """The text with a space before it and three behind; letters are lower-cased ASCII or anything beyond it, the rest is a space."""
    return np.concatenate((np.full(1, 32, np.uint8), _FOLD[np.frombuffer(text, np.uint8)], np.full(3, 32, np.uint8)))


def grams(folded: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Buckets of the n-grams that begin before the bytes lo to hi of the text."""
    n = hi - lo
    b = folded[lo : hi + 4].astype(np.uint32)
    two = b[:n] << 8 | b[1 : n + 1]
    three = two << 8 | b[2 : n + 2]
    four = three << 8 | b[3 : n + 3]
    mix = lambda x, salt: ((x * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(17)).astype(np.int32)
    plain = b[1 : n + 1] > 32
    return np.concatenate((mix(two, 0x1234567)[plain], mix(three, 0x7654321)[plain], mix(four, 0x1357924)[plain]))


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how often each occurs; long texts are gone through in slices, with the n-grams of the whole."""
    folded = _folded(text)
    if len(text) <= SLICE:
        found = grams(folded, 0, len(text))
        if len(found) < BUCKETS // 2:
            found.sort()
            first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
            return found[first], np.diff(np.append(first, len(found)))
        total = np.bincount(found, minlength=BUCKETS)
    else:
        total = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(text), SLICE):
            total += np.bincount(grams(folded, at, min(at + SLICE, len(text))), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """languages (sorted), and the likelihood of each bucket in each: p[bucket, language]."""

    def __init__(self, languages: list[str], p: np.ndarray):
        self.languages, self.p = languages, p.astype(np.float32)

    def mixtures(self, texts: list[bytes | None]) -> list[tuple[str, float, dict[str, float]]]:
        """(prediction, score, proportions of the chosen languages) of each text; the iterations of many run side by side."""
        out: list = [("und", 0.0, {})] * len(texts)
        held: list = []
        size = 0
        if self.languages:
            for k, t in enumerate(texts):
                if t and _LETTER.search(t.decode("utf-8", "replace")):
                    b, c = counts(t)
                    if len(b):
                        if held and (size + len(b)) * len(self.languages) > CELLS:
                            self._mixtures(held, out)
                            held, size = [], 0
                        held.append((k, b, c))
                        size += len(b)
        if held:
            self._mixtures(held, out)
        return out

    def _mixtures(self, held: list, out: list) -> None:
        sizes = np.array([len(b) for _, b, _ in held])
        heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        c = np.concatenate([c for _, _, c in held]).astype(np.float32)
        p = self.p[np.concatenate([b for _, b, _ in held])]
        doc = np.repeat(np.arange(len(held)), sizes)
        total = np.add.reduceat(c, heads)
        allowed = np.ones((len(held), len(self.languages)), bool)
        share = np.full(allowed.shape, 1 / len(self.languages), np.float32)
        share, fit = self._climb(share, c, p, doc, heads, total)
        # Languages leave, the smallest first, while the likelihood loses less than the penalty.
        open_ = np.ones(len(held), bool)
        for _ in range(len(self.languages) - 1):
            small = np.where(share > 0, share, 2).argmin(axis=1)
            try_ = np.flatnonzero(open_ & ((share > 0).sum(axis=1) > 1))
            if not len(try_):
                break
            rows = np.flatnonzero(np.isin(doc, try_)) if len(try_) < len(held) else np.arange(len(doc))
            part = share[try_].copy()
            part[np.arange(len(try_)), small[try_]] = 0
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-9)
            cut = np.concatenate(([0], np.cumsum(sizes[try_])[:-1]))
            part, now = self._climb(part, c[rows], p[rows], np.repeat(np.arange(len(try_)), sizes[try_]), cut, total[try_], rounds=4)
            good = fit[try_] - now <= PENALTY * np.log(np.maximum(total[try_], 2)) + 0.005 * total[try_]
            share[try_[good]], fit[try_[good]] = part[good], now[good]
            open_[try_[~good]] = False
        for k, (row, _, _) in enumerate(held):
            best = int(share[k].argmax())  # ties: the first in the order of the languages
            out[row] = (self.languages[best], float(min(1.0, share[k, best])), {self.languages[i]: float(share[k, i]) for i in np.flatnonzero(share[k] > 0)})

    @staticmethod
    def _climb(share, c, p, doc, heads, total, rounds: int = ROUNDS):
        for _ in range(rounds):
            mass = p * share[doc]
            whole = mass.sum(axis=1)
            mass *= (c / np.maximum(whole, 1e-30))[:, None]
            new = np.add.reduceat(mass, heads, axis=0) / total[:, None]
            new[new < 1e-4] = 0
            new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-9)
            moved = np.abs(new - share).max()
            share = new
            if moved < 2e-3:
                break
        whole = np.einsum("ij,ij->i", p, share[doc])
        return share, np.add.reduceat(c * np.log(np.maximum(whole, 1e-30)), heads)


def train(labelled: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """A model from (doc_id, text, lang); rows with a null text or lang are left out.

    Of each label about `sample` rows are counted (chosen by a hash of their id
    and text, all of a rarer label), and of labels the `languages` most frequent
    ones; labels without n-grams in these rows aren't learnt. The counts that
    reach the driver are at most BUCKETS for each label.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    names = sorted(r["lang"] for r in sizes)
    number = {n: k for k, n in enumerate(names)}
    # Of 2^20 parts of a label's rows, as many as are needed.
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1 << 20, -(-(sample << 20) // r["n"])))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.try_element_at(shares, F.col("lang")))

    def count(batches):
        got: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                b, c = counts(t)
                got.setdefault(number[name], np.zeros(BUCKETS, np.int64))[b] += c
        for k, c in got.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    sums = chosen.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS, len(names)))
    table[sums.column("bucket").to_numpy(), sums.column("lang").to_numpy()] = sums.column("n").to_numpy()
    learnt = table.any(axis=0)
    table = table[:, learnt] + SMOOTH
    return Model([n for n, x in zip(names, learnt) if x], table / table.sum(axis=0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, langs (proportions of the chosen languages).

    A text that is null or has no letter is `und` with score 0, as is any text
    if the model knows no language. Texts are read whole, very long ones one at
    a time. Ties go to the first language by name. Rows stay as they are,
    repeated ones and null ids too; other columns are not looked at, whatever
    their names; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.p))

    def make():
        own = Model(*sent.value)

        def each(b: pa.RecordBatch) -> dict:
            found = own.mixtures(utf8(b.column(1)))
            return {"doc_id": b.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "langs": [list(f[2].items()) for f in found]}

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double, langs map<string,double>", rows=64)


def held_out() -> Column:
    """Whether a document isn't learnt from: crc32(doc_id as text) mod 4 is 2, or the id is null."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def learnt(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the documents that aren't held out."""
    return train(docs.where(~held_out()), sample)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs: learnt from the documents that aren't held out, predicted for all. See predict for nulls and edges."""
    # Where a row falls depends on its id; what is predicted for it only on its text.
    return predict(docs, learnt(docs, sample)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "langs")

"""Language identification as inference of a mixture of languages in each document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, per_document, text_blocks

#: N-grams are 4 bytes wide and hashed to 2**BITS classes. A model has a number per class and language, MODEL_NUMBERS at most: where
#: languages are more than MODEL_NUMBERS >> BITS, each doubling of them halves the classes.
GRAM, BITS, MODEL_NUMBERS = 4, 16, 1 << 24
#: N-grams of a window, the unit whose language the mixture leaves open.
WINDOW = 48
#: Numbers of the model that are looked up at once.
GATHERED = 1 << 23
UNDETERMINED = "und"

_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def gram_classes(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a block's n-grams in order, and n+1 offsets of the texts into these.

    A-Z count as a-z and other ASCII characters that are no letters as blanks, of which two stand before and after
    each text; n-grams of blanks alone are left out.
    """
    offsets = offsets + 4 * np.arange(len(offsets))
    clean = np.full(int(offsets[-1]), 0x20, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inner = np.ones(len(clean), bool)
    for k in (0, 1):
        inner[offsets[:-1] + k] = False
        inner[offsets[1:] - 1 - k] = False
    clean[inner] = _LETTERS[data]
    n = len(clean) - GRAM + 1
    blank = (clean == 0x20).astype(np.uint8)
    code = np.zeros(n, np.uint32)
    blanks = np.zeros(n, np.uint8)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | clean[k : k + n]
        blanks += blank[k : k + n]
    keep = blanks < GRAM
    for k in range(1, GRAM):  # across a text's end
        ends = offsets[1:-1] - k
        keep[ends[(ends >= 0) & (ends < n)]] = False
    at = np.flatnonzero(keep)
    classes = (code[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return classes.astype(np.int64), np.searchsorted(at, offsets).astype(np.int64)


def count_grams(labelled: DataFrame, languages: list[str], bits: int) -> DataFrame:
    """(lang, gram, n) over the columns text and lang, lang as its place in `languages`: counts within tasks first, then over all."""
    number = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for some, data, offsets in text_blocks(batches, "text"):
            classes, marks = gram_classes(data, offsets, bits)
            labels = some.column("lang").dictionary_encode()
            of = np.asarray(labels.indices)[per_document(marks)]
            names = labels.dictionary.to_pylist()
            found = np.bincount((of << bits) + classes, minlength=len(names) << bits).reshape(len(names), -1)
            for name, row in zip(names, found):
                k = number[name]
                counts[k] = counts[k] + row if k in counts else row
        for k, row in counts.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(some), k, np.int32)), "gram": pa.array(some, pa.int32()), "n": pa.array(row[some], pa.int64())})

    return labelled.select("text", "lang").mapInArrow(run, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages and the log-probability of each n-gram class (row) in each (column), MODEL_NUMBERS at most."""

    languages: list[str]
    log_p: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.log_p).bit_length() - 1

    @staticmethod
    def fit(labelled: DataFrame, smoothing: float = 0.5) -> Model:
        """Add-constant estimates from every row whose lang is not null, for each lang with an n-gram.

        The driver gets the names of the languages and the sums alone, of which there are MODEL_NUMBERS at most.
        """
        labelled = labelled.where(F.col("lang").isNotNull())
        every = sorted(x[0] for x in labelled.select("lang").distinct().collect())
        bits = max(1, min(BITS, (MODEL_NUMBERS // max(len(every), 1)).bit_length() - 1))
        counts = count_grams(labelled.where(F.col("text").isNotNull()), every, bits).toArrow()
        table = np.zeros((len(every), 1 << bits))
        table[counts.column("lang").to_numpy(), counts.column("gram").to_numpy()] = counts.column("n").to_numpy()
        learned = np.flatnonzero(table.any(1))
        table = table[learned] + smoothing
        return Model([every[k] for k in learned], np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32).copy())


def estimate(scores: np.ndarray, marks: np.ndarray, active: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each document's proportions over its active languages, and its log-likelihood.

    scores: the log-likelihood of each window in each language; marks: n+1 offsets of the documents, none empty.
    """
    of, counts = per_document(marks), np.diff(marks)[:, None]
    top = np.where(active[of], scores, -np.inf).max(1, keepdims=True)
    relative = np.exp(np.where(active[of], scores - top, -np.inf))
    shares = active / active.sum(1, keepdims=True)
    for _ in range(rounds):
        joint = relative * shares[of]
        total = joint.sum(1, keepdims=True)
        new = np.add.reduceat(joint / np.maximum(total, 1e-300), marks[:-1], axis=0) / counts
        moved = np.abs(new - shares).max(initial=0)
        shares = new
        if moved < 1e-4:
            break
    total = (relative * shares[of]).sum(1)
    return shares, np.add.reduceat(np.log(np.maximum(total, 1e-300)) + top[:, 0], marks[:-1])


def select_languages(scores: np.ndarray, marks: np.ndarray, penalty: float = 3.0) -> np.ndarray:
    """Proportions over the set of languages with the best penalised likelihood, found by dropping from all
    languages the rarest one while that pays: each further language must raise the log-likelihood
    by `penalty` plus half the logarithm of the number of windows.

    The rarest languages that have less than half a window together go at once, if all of them are worth no more than a single one must be.
    """
    n, languages = len(marks) - 1, scores.shape[1]
    counts = np.diff(marks)
    active = np.ones((n, languages), bool)
    cost = penalty + 0.5 * np.log(counts)
    shares, likelihood = estimate(scores, marks, active)
    rest = np.flatnonzero(active.sum(1) > 1)
    several = np.ones(n, bool)
    while len(rest):
        sizes = counts[rest]
        held = np.where(active[rest], shares[rest], 2)
        order = np.argsort(held, axis=1, kind="stable")
        slight = np.cumsum(np.take_along_axis(held, order, 1), axis=1) * sizes[:, None] < 0.5
        slight &= several[rest][:, None]
        slight[:, 0] = True
        fewer = active[rest].copy()
        np.put_along_axis(fewer, order, np.take_along_axis(fewer, order, 1) & ~slight, axis=1)
        # The languages left, side by side: these are few soon.
        columns = np.argsort(~fewer, axis=1, kind="stable")[:, : fewer.sum(1).max()]
        of = np.repeat(np.arange(len(rest)), sizes)
        own = np.repeat(marks[:-1][rest] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        found, value = estimate(scores[own[:, None], columns[of]], np.append(0, np.cumsum(sizes)), np.take_along_axis(fewer, columns, 1))
        new = np.zeros((len(rest), languages))
        np.put_along_axis(new, columns, found, axis=1)
        pays = value + cost[rest] >= likelihood[rest]
        took = rest[pays]
        shares[took], likelihood[took], active[took] = new[pays], value[pays], fewer[pays]
        again = rest[~pays & (slight.sum(1) > 1)]
        several[again] = False
        several[took] = True
        rest = np.sort(np.append(took[active[took].sum(1) > 1], again))
    return shares


def predictor(model: Model):
    """An Arrow function from texts to (lang, score, languages, shares); null where nothing can be said."""
    names = np.array(model.languages, object)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
    log_p, bits = model.log_p, model.bits

    def window_scores(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-likelihoods of the windows in each language; only so many n-grams are looked up at once."""
        out = np.empty((len(starts), len(names)))
        ends = np.append(starts[1:], len(classes))
        some = max(1, GATHERED // (WINDOW * len(names)))
        for a in range(0, len(starts), some):
            b = min(a + some, len(starts))
            out[a:b] = np.add.reduceat(log_p[classes[starts[a] : ends[b - 1]]], starts[a:b] - starts[a], axis=0)
        return out

    def of_block(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
        n = len(offsets) - 1
        classes, marks = gram_classes(data, offsets, bits)
        full = np.flatnonzero(np.diff(marks))
        shares = np.zeros((n, len(names)))
        if len(full):
            lengths = np.diff(marks)[full]
            windows = -(-lengths // WINDOW)
            ends = np.cumsum(windows)
            within = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
            starts = np.repeat(marks[:-1][full], windows) + within * WINDOW
            # Documents without n-grams hold none between these, so reduceat sees windows alone.
            shares[full] = select_languages(window_scores(classes, starts), np.append(0, ends))
        empty = np.setdiff1d(np.arange(n), full)
        shares[empty, :] = 1 / len(names)
        best = shares.argmax(1)
        present = shares > 1e-6
        listed = np.nonzero(present)
        sizes = pa.array(np.append(0, np.cumsum(present.sum(1))), pa.int32())
        return pa.StructArray.from_arrays([
            pa.array(names[best], pa.string()), pa.array(np.clip(shares[np.arange(n), best], 0, 1)),
            pa.ListArray.from_arrays(sizes, pa.array(names[listed[1]], pa.string())), pa.ListArray.from_arrays(sizes, pa.array(shares[listed])),
        ], fields=list(kind))

    def predict(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], kind)
        blocks = text_blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text")
        return pa.concat_arrays([of_block(data, offsets) for _, data, offsets in blocks])

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, languages and shares.

    The n-grams of a text are cut into windows of WINDOW; expectation-maximisation estimates the share of the
    windows that each language has, and the language set is that of the best penalised likelihood. lang_pred is the
    language with the largest share (the first by name of equal ones), score that share. A null text, or one without a letter, is `und` with
    score 0 and no languages; so is every text if no language was learned. Columns of docs with the four names are
    replaced. Repeated rows are predicted alike. A task holds the scores of a block's windows, a number per language and WINDOW n-grams.
    """
    predict = F.arrow_udf(predictor(model), "struct<lang: string, score: double, languages: array<string>, shares: array<double>>") if model.languages else None
    text = F.col(text_col).cast("string")
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    if predict is None:
        found = docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
        return found.withColumns({"languages": F.array().cast("array<string>"), "shares": F.array().cast("array<double>")})
    out = docs.withColumn("__found", predict(text)).withColumn("__known", known)
    none = lambda name, value: F.when(F.col("__known"), F.col(f"__found.{name}")).otherwise(value)
    return out.withColumns({
        "lang_pred": none("lang", F.lit(UNDETERMINED)), "score": none("score", F.lit(0.0)),
        "languages": none("languages", F.array().cast("array<string>")), "shares": none("shares", F.array().cast("array<double>")),
    }).drop("__found", "__known")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of the ids that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learns from the labelled documents that are not held out, and identifies all."""
    model = Model.fit(docs.where(~held_out(id_col)).select("text", "lang"))
    return identify(docs, model)

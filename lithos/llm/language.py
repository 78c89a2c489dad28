"""Operator 1: language identification by mixture inference.

Each language is a smoothed multinomial over letter trigrams, learned from
labelled rows. A document is a mixture of languages whose words are each in
one: expectation-maximisation finds the proportions, and a penalised
likelihood (a charge that grows with the logarithm of the number of words for
each further language) chooses how many languages a document has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import flat, owners, pieces, runs, strings

#: Trigrams are hashed into so many cells.
CELLS = 1 << 16
#: Rows that a model is fitted on, at most about; dealt evenly to the languages.
SAMPLE_ROWS = 6_000
#: Languages that a model may have.
MAX_LANGUAGES = 256
#: Steps of expectation-maximisation over all languages, and over each smaller set.
STEPS, SET_STEPS = 8, 3
#: Nats charged for each further language, times log(1 + words).
PENALTY = 3.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of the trigram around each letter byte, first letter of each word, and the n+1 offsets of the rows in the words."""
    data, offsets = flat(pc.utf8_lower(column))
    inside = _LETTER[data]
    starts, ends = runs(inside, offsets)
    letters = np.where(inside, data, 32).astype(np.uint32)
    before, after = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    before[starts], after[ends - 1] = 32, 32
    code = (before << 16) | (letters << 8) | after
    cells = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    lengths = ends - starts
    return cells[inside], np.cumsum(lengths) - lengths, np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class LanguageModel:
    """log_p[cell, language]; a language never seen has no column."""

    languages: tuple[str, ...]
    log_p: np.ndarray


def fit(docs: DataFrame, key: str, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from the rows whose text and label are not null.

    About `sample_rows` rows, chosen by a hash of `key` and dealt evenly to
    the labels, are counted; counts are made on the executors, and what comes
    to the driver has at most CELLS rows for each label. More than
    MAX_LANGUAGES labels raise ValueError. No labelled rows give a model
    without languages, which predicts `und` everywhere.
    """
    known = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")).where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if not sizes:
        return LanguageModel((), np.zeros((CELLS, 0), np.float32))
    each = max(1, sample_rows // len(sizes))
    share = F.create_map(*[F.lit(v) for l, n in sizes.items() for v in (l, min(1.0, each / n))])
    unit = (F.xxhash64("k", F.lit("sample")).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)).cast("double")
    sample = known.where(unit < F.element_at(share, F.col("l"))).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "t"):
            cells, word_starts, word_offsets = _trigrams(b.column("t"))
            labels = b.column("l").dictionary_encode()
            row = np.repeat(owners(word_offsets), np.diff(np.append(word_starts, len(cells))))
            slot = labels.indices.to_numpy().astype(np.int64)[row] * CELLS + cells
            n = np.bincount(slot, minlength=1)
            full = np.flatnonzero(n)
            names = np.array(labels.dictionary.to_pylist(), object)
            yield pa.RecordBatch.from_arrays([strings(names[full // CELLS].tolist()), pa.array((full % CELLS).astype(np.int32)), pa.array(n[full])], ["l", "cell", "n"])

    counted = sample.mapInArrow(count, "l string, cell int, n long").groupBy("l", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(sizes))
    n = np.zeros((CELLS, len(languages)))
    place = {l: i for i, l in enumerate(languages)}
    n[counted["cell"].to_numpy(dtype=np.int64), [place[l] for l in counted["l"]]] = counted["n"].to_numpy(dtype=float)
    smoothed = n + 0.5 * (n.sum(1, keepdims=True) > 0) + 1e-3
    return LanguageModel(languages, np.log(smoothed / smoothed.sum(0)).astype(np.float32))


def _em(p: np.ndarray, pi: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after so many steps, and the log-likelihood (less what all sets share) at the last but one."""
    total = None
    for _ in range(steps):
        share = p * pi[doc]
        total = share.sum(1)
        share /= total[:, None]
        pi = np.add.reduceat(share, starts, axis=0) / n[:, None]
    return pi, np.add.reduceat(np.log(total), starts)


def infer(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, languages) proportions of each row's chosen set, and each row's score."""
    rows, k = len(column), len(model.languages)
    out, score = np.zeros((rows, k)), np.zeros(rows)
    cells, word_starts, word_offsets = _trigrams(column)
    if not len(word_starts) or not k:
        return out, score
    ll = np.add.reduceat(model.log_p[cells], word_starts, axis=0).astype(np.float64)
    top = ll.max(1)
    p = np.exp(np.maximum(ll - top[:, None], -60.0))
    counts = np.diff(word_offsets)
    full = np.flatnonzero(counts)
    starts, n = word_offsets[:-1][full], counts[full]
    doc = np.repeat(np.arange(len(full)), n)
    alone = np.add.reduceat(ll - top[:, None], starts, axis=0)
    pi, _ = _em(p, np.full((len(full), k), 1.0 / k), doc, starts, n, STEPS)
    order = np.argsort(-pi, axis=1, kind="stable")
    best = np.zeros((len(full), k))
    best[np.arange(len(full)), alone.argmax(1)] = 1.0
    value = alone.max(1)
    charge = PENALTY * np.log1p(n)
    for size in range(2, k + 1):  # until no document has a share left for another language
        may = np.flatnonzero(pi[np.arange(len(full)), order[:, size - 1]] > 0.02)
        if not len(may):
            break
        chosen = np.zeros((len(may), k))
        np.put_along_axis(chosen, order[may, :size], 1.0, axis=1)
        part = pi[may] * chosen + 1e-300
        part /= part.sum(1, keepdims=True)
        take = np.isin(doc, may) if len(may) < len(full) else slice(None)
        m = n[may]
        sub, fit_value = _em(p[take], part, np.repeat(np.arange(len(may)), m), np.cumsum(m) - m, m, SET_STEPS)
        fit_value -= (size - 1) * charge[may]
        better = fit_value > value[may]
        best[may[better]], value[may[better]] = sub[better], fit_value[better]
    best[best < 1e-6] = 0.0
    best /= best.sum(1, keepdims=True)
    rest = np.exp(np.maximum(alone - alone.max(1, keepdims=True), -700.0))
    sure = 1.0 / rest.sum(1)
    out[full] = best
    score[full] = np.where((best > 0).sum(1) > 1, best.max(1), sure)
    return out, score


def identify(docs: DataFrame, text: str, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns `keep`, with lang_pred, score (0 to 1) and lang_mix (language and proportion of the chosen set, largest first).

    The prediction reads nothing but the whole text. `und` with score 0: the
    text is null or empty, has no letter, or the model has no language. Equal
    proportions go to the first language in alphabetical order. Columns of
    these three names in `keep` raise ValueError, others may have any name;
    repeated rows are predicted again; no rows give no rows. Texts are read
    whole, in pieces of some megabytes or one text.
    """
    if clash := {"lang_pred", "score", "lang_mix"} & set(keep):
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    own = "_text"
    while own in keep:
        own = "_" + own
    names = np.array(model.languages, object)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS x MAX_LANGUAGES floats at most
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, own):
            column = b.column(own)
            mixes, score = infer(shared.value, column)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            good = lettered & (mixes.sum(1) > 0 if mixes.shape[1] else False)
            first = mixes.argmax(1) if mixes.shape[1] else np.zeros(len(column), int)
            pred = ["und" if not g else names[i] for g, i in zip(good, first, strict=True)]
            order = np.argsort(-mixes, axis=1, kind="stable") if mixes.shape[1] else np.zeros((len(column), 0), int)
            listed = [[{"lang": names[j], "share": float(m[j])} for j in o if m[j] > 0] if g else [] for g, m, o in zip(good, mixes, order, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], strings(pred), pa.array(np.where(good, score, 0.0)), pa.array(listed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                [*keep, "lang_pred", "score", "lang_mix"],
            )

    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(predict, f"{schema + ', ' if schema else ''}lang_pred string, score double, lang_mix array<struct<lang:string,share:double>>")


def held_out(key: str) -> Column:
    """Rows that no model learns from: a quarter, by the key's checksum."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))

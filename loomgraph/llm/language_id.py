"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.samples import held_out, labelled_sample, placed
from loomgraph.llm.worker import parts, release

DOCUMENTS_A_LANGUAGE = 400  # the sample's bound
_BITS = 14
_ORDERS = (2, 3, 4)
_SCALE = 60.0
_BATCH_BYTES = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")  # and numbers such as fractions, which aren't letters

#: Families of related languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn pa mr gu ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "iranian": "fa ps ku tg",
    "celtic": "ga gd cy br",
    "austronesian": "id ms tl jv su mg",
    "sinitic": "zh yue",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, f"only {lang}")


def _grams(data: bytes) -> list[np.ndarray]:
    """Bins of the byte n-grams of a buffer, by order; letters folded to lower case, the rest of ASCII to spaces."""
    b = _FOLD[np.frombuffer(data, np.uint8)]
    out, packed = [], b
    with np.errstate(over="ignore"):
        for k in range(1, max(_ORDERS)):
            packed = packed[:-1] | b[k:] << np.uint32(8 * k)
            if k + 1 in _ORDERS:
                out.append((packed * np.uint32(2654435761 + 2 * k) >> np.uint32(32 - _BITS)).astype(np.int32))
    return out


def _svm(gram: np.ndarray, y: np.ndarray, cost: float = 10.0, sweeps: int = 25) -> np.ndarray:
    """Dual coordinate descent of a linear SVM with hinge loss: a weight for each training row."""
    alpha, margin = np.zeros(len(y)), np.zeros(len(y))
    order = np.random.default_rng(5)
    for _ in range(sweeps):
        for i in order.permutation(len(y)):
            new = min(cost, max(0.0, alpha[i] + (1 - y[i] * margin[i]) / gram[i, i]))
            if new != alpha[i]:
                margin += (new - alpha[i]) * y[i] * gram[i]
                alpha[i] = new
    return alpha * y


@dataclass
class LanguageModel:
    """Column k of ``weights`` (bins x k) is a linear SVM; the last row is its bias."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> LanguageModel:
        x = np.zeros((len(texts), (1 << _BITS) + 1), np.float32)
        for row, text in zip(x, texts, strict=True):
            for bins in _grams(b" " + text.encode("utf-8", "replace") + b"    "):
                row[:-1] += np.bincount(bins, minlength=1 << _BITS)
        x[:, :-1] *= _SCALE / np.maximum(1, x[:, :-1].sum(1, keepdims=True))
        x[:, -1] = 1
        gram = (x @ x.T).astype(np.float64)
        members: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            members.setdefault(family_of(lang), []).append(lang)
        families, langs_ = sorted(members), np.array(langs)
        own = np.array([family_of(x) for x in langs])
        columns = []
        if len(families) > 1:
            for f in families:
                columns.append(x.T @ _svm(gram, np.where(own == f, 1.0, -1.0)).astype(np.float32))
        pairs = [p for f in families for p in combinations(members[f], 2)]
        for a, b in pairs:
            rows = np.flatnonzero((langs_ == a) | (langs_ == b))
            columns.append(x[rows].T @ _svm(gram[np.ix_(rows, rows)], np.where(langs_[rows] == a, 1.0, -1.0)).astype(np.float32))
        return cls(families, members, pairs, np.stack(columns, 1) if columns else np.zeros(((1 << _BITS) + 1, 0), np.float32))

    def margins(self, texts: list[str]) -> np.ndarray:
        """Margins of every SVM over the whole of each text."""
        data = [b" " + t.encode("utf-8", "replace") + b"    " for t in texts]
        ends = np.cumsum([len(d) for d in data])
        starts = ends - [len(d) for d in data]
        sums, counts = np.zeros((len(data), self.weights.shape[1])), np.zeros(len(data))
        for order, bins in zip(_ORDERS, _grams(b"".join(data)), strict=True):
            last = np.minimum(ends - order + 1, len(bins))
            flat = np.stack([starts, last], 1).ravel()
            flat[-1] = min(flat[-1], len(bins))
            at = flat[:-1] if flat[-1] >= len(bins) else flat
            for k in range(self.weights.shape[1]):
                column = np.ascontiguousarray(self.weights[:-1, k])[bins]
                sums[:, k] += np.add.reduceat(column, at, dtype=np.float64)[::2]
            counts += last - starts
        return sums * (_SCALE / counts[:, None]) + self.weights[-1]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """A language and a score from 0 to 1 for each text that has a letter."""
        if not self.families:
            return [("und", 0.0)] * len(texts)
        m = 1 / (1 + np.exp(-3 * np.clip(self.margins(texts), -20, 20)))
        n = len(self.families) if len(self.families) > 1 else 0
        family = m[:, :n].argmax(1) if n else np.zeros(len(texts), int)
        out = []
        for row, f in zip(m, family, strict=True):
            sure = row[f] / max(1e-12, row[:n].sum()) if n else 1.0
            langs = self.members[self.families[f]]
            votes = {x: [0, 0.0] for x in langs}
            for k, (a, b) in enumerate(self.pairs):
                if a in votes:
                    votes[a if row[n + k] >= 0.5 else b][0] += 1
                    votes[a][1] += row[n + k]
                    votes[b][1] += 1 - row[n + k]
            best = max(langs, key=lambda x: votes[x])
            out.append((best, float(min(1.0, sure * (votes[best][1] / (len(langs) - 1) if len(langs) > 1 else 1.0)))))
        return out


def fit_language_model(documents: DataFrame, bound: int = DOCUMENTS_A_LANGUAGE) -> LanguageModel:
    """Fit on at most ``bound`` documents of each language, of those with a text and a lang."""
    rows = labelled_sample(placed(documents.where("text is not null and lang is not null").select("doc_id", "text", "lang")), "lang", bound)
    rows = [r for r in rows if has_letter(r["text"])]
    return LanguageModel.fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict_language(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Add lang_pred and score to (doc_id, held_out, text), reading nothing but the text.

    ``und`` with score 0 where the text is null, empty or has no letter. Equal texts get equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch.column("text"), _BATCH_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                texts = rows.column("text").to_pylist()
                some = [i for i, t in enumerate(texts) if t and has_letter(t)]
                out = [("und", 0.0)] * len(texts)
                for i, found in zip(some, model.predict([texts[i] for i in some]) if some else (), strict=True):
                    out[i] = found
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out(4, 2).alias("held_out"))
    return predict_language(documents, fit_language_model(documents.where(~F.col("held_out"))))

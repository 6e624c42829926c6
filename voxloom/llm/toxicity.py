"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, takes compatibility forms and homoglyphs to Latin letters, digits and signs inside words
to the letters that they stand for, drops invisible characters and leaves words parted by one space.
The lexicon holds words and beginnings of words, weighted by the log-odds of toxic documents,
learned from labelled rows; longer forms and phrases of two or three words that speak against toxicity are
exceptions and cancel the matches inside them, and so do the exception phrases given by the caller. A document's score is a
logistic function of its weights' sum, of that sum per word, and of its largest weight.

Bound: the lexicon and the logistic function are fitted on about ``fit_rows`` labelled rows at most, chosen by
a hash of their id, and on all their text; what is learned from these is not bounded otherwise. Entries are in at least
``least_rows`` toxic rows and ``least_share`` of them. Scoring covers all rows and whole texts.

Defined cases: null, empty and blank text scores as a text without matches; ids without text or label don't
take part in the fit; labels of one class only, or none, score 0 everywhere; repeated rows each give a
row; a null id is not held out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, id_type, keyed_text, sampled, slices, stored, tidy

# fixed values: letters that look like Latin ones, and digits and signs written for letters
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһκονρτυχαεικпмтвнк", "aeopcyxijsdhkovptuxaeiknmtbhk")
LEET = str.maketrans("013457@$!|", "oieastasil")
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_SIGN = re.compile(r"(?<=\w)[@$!|](?=\w)")
_DIGIT = re.compile(r"(?<=[^\W\d_])\d+|\d+(?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")
SHORTEST, LONGEST = 4, 9
_BLOCK = 1 << 20


def fold(text: str) -> str:
    """The folded words of a text with a space before and after each."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(INVISIBLE).translate(HOMOGLYPHS)
    else:
        text = text.lower()
    text = _SIGN.sub(lambda m: m[0].translate(LEET), text)
    text = _DIGIT.sub(lambda m: m[0].translate(LEET), text)
    return f" {_GAP.sub(' ', text).strip()} "


def patterns(word: str) -> list[str]:
    """The entries that a word can stand for: itself and its beginnings."""
    return [f" {word} ", *(f" {word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST + 1)))]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    logistic: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, w in {**self.weights, **self.exceptions}.items():
            a.add_word(word, (w, len(word), word in self.exceptions))
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def features(folded: str, automaton) -> tuple[float, float, float]:
        """Of the weights matched outside exceptions: their sum, the sum per word, and the largest; all 0 without any."""
        hits = list(automaton.iter(folded)) if len(automaton) else []
        spans = sorted((at - n, at) for at, (_, n, exception) in hits if exception)
        starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

        def cancelled(a: int, b: int) -> bool:
            k = bisect_right(starts, a)
            return k > 0 and reach[k - 1] >= b

        found = [w for at, (w, n, exception) in hits if not exception and not cancelled(at - n, at)]
        total = sum(found)
        if total <= 1e-9:
            return 0.0, 0.0, 0.0
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100 * total / words), max(found)

    def score(self, *features: float) -> float:
        z = self.logistic[0] + sum(a * x for a, x in zip(self.logistic[1:], features))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _labelled(docs: DataFrame, labels: DataFrame, train: Column | None, fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of the rows to fit on, texts folded. Stored."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    if train is not None:
        known = known.where(train)
    known = known.where(sampled(F.xxhash64("id", F.lit("fit")), fit_rows, known.count()))
    rows = keyed_text(docs, id_col, text_col).join(known, "id").select("text", (F.col("label") > 0).cast("int").alias("label"))
    arrow = arrow_schema("text string, label int")

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(0), _BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in batch.column(0).slice(i, j - i).to_pylist()], pa.string()), batch.column(1).slice(i, j - i)], schema=arrow)

    return stored(rows.mapInArrow(tidy(run), "text string, label int"), "labelled")


def _counted(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(pattern, n): documents with each pattern; of ``only`` these, if given."""
    arrow = arrow_schema("pattern string, n bigint")

    def run(batches):
        from collections import Counter

        for batch in batches:
            for i, j in slices(batch.column(0), _BLOCK):
                seen: Counter = Counter()
                for text in batch.column(0).slice(i, j - i).to_pylist():
                    found = {p for w in set(text.split()) for p in patterns(w)}
                    seen.update(found if only is None else found & only)
                yield pa.RecordBatch.from_pydict({"pattern": list(seen), "n": list(seen.values())}, schema=arrow)

    return rows.select("text").mapInArrow(tidy(run), "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def _around(rows: DataFrame, weights: frozenset[str]) -> DataFrame:
    """(pattern, bad, good): toxic and clean documents with each longer form of a weighted entry, and with each phrase of
    two or three words around a word that has one."""
    arrow = arrow_schema("pattern string, label int, n bigint")

    def longer(word: str) -> list[str]:
        forms = patterns(word)
        least = min((len(p) for p in forms if p in weights), default=None)
        return [] if least is None else [p for p in forms if len(p) >= least]

    def run(batches):
        from collections import Counter

        for batch in batches:
            for i, j in slices(batch.column(0), _BLOCK):
                seen: Counter = Counter()
                known: dict[str, list[str]] = {}
                for text, label in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()):
                    words, found = text.split(), set()
                    for k, word in enumerate(words):
                        if word not in known:
                            known[word] = longer(word)
                        if known[word]:
                            found.update(known[word])
                            found.update(f" {' '.join(words[a : a + n])} " for n in (2, 3) for a in range(max(0, k - n + 1), min(k, len(words) - n) + 1))
                    seen.update((p, label) for p in found if p not in weights)
                yield pa.RecordBatch.from_pydict({"pattern": [p for p, _ in seen], "label": [y for _, y in seen], "n": list(seen.values())}, schema=arrow)

    n = rows.select("text", "label").mapInArrow(tidy(run), "pattern string, label int, n bigint")
    of = lambda y: F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0))
    return n.groupBy("pattern").agg(of(1).alias("bad"), of(0).alias("good"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column | None = None,
    fit_rows: int = 20_000,
    least_rows: int = 3,
    least_share: float = 0.004,
    least_odds: float = 2.0,
    phrases: tuple[str, ...] = (),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """``train`` is a condition on the column ``id`` of the labels."""
    rows = _labelled(docs, labels, train, fit_rows, id_col, text_col, label_col)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model()
    often = _counted(rows.where("label = 1"), None).where(F.col("n") >= max(least_rows, least_share * bad))
    toxic = {r["pattern"]: r["n"] for r in often.collect()}
    clean = {r["pattern"]: r["n"] for r in _counted(rows.where("label = 0"), frozenset(toxic)).collect()}
    odds = {p: math.log((n + 0.5) / (bad + 1)) - math.log((clean.get(p, 0) + 0.5) / (good + 1)) for p, n in toxic.items()}
    weights: dict[str, float] = {}
    for p in sorted((p for p in odds if odds[p] >= least_odds), key=lambda p: (len(p.rstrip()), p)):
        shorter = max((weights.get(p[:k], 0.0) for k in range(SHORTEST + 1, len(p))), default=0.0)
        # a longer form has to say clearly more than its beginning
        if odds[p] > shorter + 1.0 or not shorter:
            weights[p] = odds[p] - shorter
    # forms and phrases that clean rows have relatively more often; ``least_rows`` clean rows at least
    share = (F.col("bad") + 0.5) / (bad + 1) < (F.col("good") + 0.5) / (good + 1)
    against = [r["pattern"] for r in _around(rows, frozenset(weights)).where((F.col("good") >= least_rows) & share).select("pattern").collect()]
    automaton = Model(weights).automaton()
    inside = lambda p: -sum(x[0] for _, x in automaton.iter(p))
    exceptions: dict[str, float] = {}
    for p in sorted(against, key=lambda p: (len(p), p)):
        # the longer form of an exception has no more to cancel
        if not any(p[:k] in exceptions for k in range(SHORTEST + 1, len(p))) or " " in p.strip():
            exceptions[p] = inside(p)
    for phrase in phrases:
        exceptions[fold(phrase)] = inside(fold(phrase))
    model = Model(weights, exceptions)
    found = score_rows(rows.withColumn("id", F.monotonically_increasing_id()), model, "label", folded=True).select("x", "y", "z", "label").toPandas()
    x = np.column_stack([np.ones(len(found)), found.x, found.y, found.z])
    model.logistic = tuple(_newton(x, found.label.to_numpy(np.float64)).tolist())
    return model


def _newton(x: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(beta)), x.T @ (label - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_rows(rows: DataFrame, model: Model, *keep: str, folded: bool = False) -> DataFrame:
    """(id, *keep, x, y, z, score) for rows with columns id and text."""
    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"id {id_type(rows, 'id')}{kinds}, x double, y double, z double, score double"
    arrow = arrow_schema(schema)

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            for i, j in slices(batch.column(0), _BLOCK):
                part = batch.slice(i, j - i)
                found = [model.features(t if folded else fold(t), automaton) for t in part.column(0).to_pylist()]
                columns = [*part.columns[1:], *(pa.array([f[k] for f in found], pa.float64()) for k in range(3)), pa.array([model.score(*f) for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.select("text", "id", *keep).mapInArrow(tidy(run), schema)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    return score_rows(keyed_text(docs, id_col, text_col), model).select("id", "score")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the limit."""

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for i, j in slices(texts, _BLOCK):
                clean = [model.score(*model.features(fold(t or ""), automaton)) < limit for t in texts.slice(i, j - i).to_pylist()]
                yield batch.slice(i, j - i).filter(pa.array(clean))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out(column: str) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, train=~held_out("id"))
    return toxicity(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

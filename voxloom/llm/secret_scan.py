"""Secret scans: fixed forms, and character Markov models of random strings against ordinary identifiers.

Three fixed forms give the base spans: assignments to names such as ``password``, access keys, long hexadecimal numbers.
The models add spans of kind ``markov``: every stretch of ``LEAST`` characters or more that identifiers and encodings use is
scored by the log-likelihood ratio of its characters, each given the one before, under both models. All of it is DataFrame
functions. The models have a row and a column for each character of the alphabet, whatever the size of the table.

Training samples: of about ``fit_docs`` documents, chosen by a hash of their ids, the stretches of four characters or more
outside the fixed forms that are too short to be scored, or all letters or all digits, are ordinary identifiers, each as often
as it occurs; hexadecimal and base64 digests of their ids
and what the forms for keys and hexadecimal numbers find in them are random strings.

Defined cases: null text is empty and has no spans; letters of the names are ASCII letters in either case; a base match that
is too short is dropped, and what it covered is not looked at again for its kind; spans of different kinds may overlap and
are all given; repeated rows give a row each; an empty table gives no rows (its models are even, and find nothing); further
columns are ignored; null ids are not sampled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import keyed_text


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(_either, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Lengths below these would be dropped, and shorter matches hide no longer ones, as both stop at the same character.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
VALUE = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
LEAST = 16
LONG, WORD = f"[A-Za-z0-9+/_-]{{{LEAST},}}", "[A-Za-z0-9+/_-]{4,}"
PLAIN = "^([A-Za-z]+|[0-9]+)$"
#: Kinds in the order in which spans with one start are listed.
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": LONG}
#: Thousandths of a nat that a random string's characters have in favour of it, on average.
THRESHOLD = 2000
FIT_DOCS = 20_000
#: Random strings made of each sampled id, in each of two alphabets.
DIGESTS = 4
#: A character after another is expected so many times as it is after any, before it is counted.
PRIOR = 8
#: Spans are gathered in pieces of so many, as an array is copied whenever it grows.
_PIECE = 512


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(hits: str, gaps: Column) -> tuple[Column, Column]:
    """Two steps to array<struct<start, end, hit>>: the texts between the matches with the matches, then their places."""
    pairs = F.zip_with(gaps, F.col(hits), lambda g, h: F.struct(F.length(g).cast("long").alias("gap"), h.alias("hit")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    at = f"_{hits}"
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(at), F.lit(1)), F.lit(_PIECE)), lambda i: F.slice(F.col(at), i, _PIECE))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        return F.struct(end.alias("at"), F.array_append(a["out"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))).alias("out"))

    start = lambda at: F.struct(at.alias("at"), none.alias("out"))
    placed = F.aggregate(pieces, F.array(start(F.lit(0).cast("long"))), lambda all_, p: F.array_append(all_, F.aggregate(p, start(F.element_at(all_, -1)["at"]), step)))
    # what follows the last match has none
    out = F.filter(F.flatten(F.transform(placed, lambda a: a["out"])), lambda x: x["hit"].isNotNull())
    return pairs, F.when(F.size(hits) > 0, out).otherwise(none)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, assign, access, hex, markov): the matches of each form with their places in code points; those of ``markov``
    are all stretches that the models are to score."""
    found = keyed_text(docs, id_col, text_col).select("id", "text", *(_found(F.col("text"), p).alias(k) for k, p in KINDS.items()))
    steps = {k: _spans(k, F.split("text", p)) for k, p in KINDS.items()}
    # most texts have no match of a form, and are not split by it
    pairs = found.select("id", *KINDS, *(F.when(F.size(k) > 0, pair).alias(f"_{k}") for k, (pair, _) in steps.items()))
    out = pairs.select("id", *(placed.alias(k) for k, (_, placed) in steps.items()))
    value = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= VALUE
    return out.withColumn("assign", F.filter("assign", value))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """(random, item): the labelled samples."""
    rows = keyed_text(docs, id_col, text_col)
    share = fit_docs / max(rows.count(), 1)
    name = F.col("id").cast("string")
    some = rows.where(F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") / 2.0**48 < share)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    digests = [F.sha2(F.concat(name, F.lit(f":{k}")).cast("binary"), 256) for k in range(DIGESTS)]
    made = F.array(*digests, *(F.rtrim(F.base64(F.unhex(d)), F.lit("=")) for d in digests))
    random = F.concat(made, _found(F.col("text"), ACCESS), _found(F.col("text"), HEX))
    item = lambda kind, c: some.select(F.lit(kind).alias("random"), F.explode(c).alias("item"))
    ordinary = F.filter(_found(rest, WORD), lambda w: (F.length(w) < LEAST) | w.rlike(PLAIN))
    return item(False, ordinary).unionAll(item(True, random))


def fit(samples: DataFrame) -> list[int]:
    """Weights in thousandths of a nat: row by row for the character before (the first row: none) and the character, the
    logarithm of its likelihood as random over that as ordinary. Counts of pairs of characters are all that is collected."""
    chars = F.split("item", "")
    pairs = F.zip_with(F.array_prepend(chars, F.lit("")), chars, lambda a, b: F.concat(a, b))
    counts = samples.groupBy("random", "item").agg(F.count("*").alias("n")).select("random", "n", F.explode(pairs).alias("pair")).where("pair IS NOT NULL").groupBy("random", "pair").agg(F.sum("n").alias("n"))
    number = {c: i for i, c in enumerate(ALPHABET, 1)}
    size = len(ALPHABET)
    table = {kind: [[0] * size for _ in range(size + 1)] for kind in (False, True)}
    for r in counts.collect():
        row, column = (number[c] for c in r["pair"]) if len(r["pair"]) == 2 else (0, number[r["pair"]])
        table[r["random"]][row][column - 1] += r["n"]

    def likelihoods(rows: list[list[int]]) -> list[list[float]]:
        alone = [sum(column) + 1 for column in zip(*rows)]
        return [[(n + PRIOR * alone[k] / sum(alone)) / (sum(row) + PRIOR) for k, n in enumerate(row)] for row in rows]

    random, ordinary = likelihoods(table[True]), likelihoods(table[False])
    return [math.floor(1000 * (math.log(x) - math.log(y)) + 0.5) for row in zip(random, ordinary) for x, y in zip(*row)]


def score(item: Column, weights: list[int]) -> Column:
    """The sum of an item's weights, from its first character on."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # a constant of the plan
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    add = lambda a, c: F.struct(place(c).alias("before"), (a["total"] + F.get(table, a["before"] * len(ALPHABET) + place(c) - 1)).alias("total"))
    return F.aggregate(F.split(item, ""), F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("total")), add)["total"]


def scan(docs: DataFrame, weights: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id, base, spans): arrays of (start, nth, end, kind), in order of start and kind (the nth of ``KINDS``)."""
    nth = {k: i for i, k in enumerate(KINDS)}
    named = lambda k, c: F.transform(c, lambda x: F.struct(x["start"], F.lit(nth[k]).alias("nth"), x["end"], F.lit(k).alias("kind")))
    random = lambda x: score(x["hit"], weights) >= threshold * F.length(x["hit"])
    found = matches(docs, id_col, text_col)
    base = F.concat(*(named(k, F.col(k)) for k in list(KINDS)[:3]))
    rows = found.select("id", base.alias("base"), named("markov", F.filter("markov", random)).alias("more"))
    return rows.select("id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op11(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs, fit(labelled(docs))).select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )

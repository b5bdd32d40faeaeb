"""Language identification by rank order: a text's most frequent n-grams against each language's, by out-of-place distance.

A language's profile ranks the n-grams (1 to 3 letters, words padded by a space) of a bounded sample of its labelled
texts.  A text is profiled in the same way, over the whole of it.  Its distance to a language is the sum, over its own
n-grams, of how far each stands from its rank in the language's profile; an n-gram that the profile lacks costs the
profile's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwright.llm.shared import hinted, lean, whole

#: n-grams in a profile.
PROFILE = 400
#: Labelled texts of each language that profiles are learnt from, on average; chosen by a hash of doc_id.
SAMPLE = 2_000
#: Languages that are learnt: those with the most labelled texts, so that a dirty column makes no unbounded model.
LANGUAGES = 1_000
UNKNOWN = "und"
_GAP = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text (21 bits a letter) and their counts."""
    letters = f" {_GAP.sub(' ', text.lower())} ".encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(letters, "<u4").astype(np.int64)
    c = c[np.insert((c[1:] != 32) | (c[:-1] != 32), 0, True)]
    word = c != 32
    two, three = c[:-1] | c[1:] << 21, c[:-2] | c[1:-1] << 21 | c[2:] << 42
    return np.unique(np.concatenate([c[word], two, three[word[1:-1]]]), return_counts=True)


def ranked(text: str, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, by falling count; ties by the n-gram's code."""
    codes, counts = grams(text)
    return codes[np.argsort(-counts, kind="stable")[:most]]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            codes, counts = grams(" ".join(texts))
            yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})


def profiles(labelled: DataFrame, sample: int = SAMPLE, most: int = PROFILE, languages: int = LANGUAGES) -> dict[str, list[int]]:
    """Each language's n-grams by falling count (ties by code), from text and lang of rows where neither is null.

    The `languages` values of lang with the most rows are learnt (ties: the first by name); a text of any other is still
    read, and predicted as the nearest of these.  About `sample` rows of each language are read, those whose hash of doc_id is lowest; fewer if there are fewer.
    """
    known = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.orderBy(F.col("rows").desc(), "lang").limit(languages)
    sizes = sizes.select("lang", (F.lit(float(sample)) / F.col("rows")).alias("share")).collect()
    if not sizes:
        return {}
    shares = hinted(known.sparkSession.createDataFrame([tuple(x) for x in sizes], "lang string, share double"), len(sizes))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("profiles")), F.lit(1_000_000)) / 1e6
    drawn = known.join(shares, "lang").filter(draw < F.col("share")).select("lang", "text")
    counted = drawn.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram"))
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    out: dict[str, list[int]] = {}
    for lang, gram, _ in sorted(top.select("lang", "gram", "rank").collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(lang, []).append(gram)
    return out


class Ranks:
    """The profiles as one matrix: a row for each language, a column for each n-gram of any."""

    def __init__(self, learnt: dict[str, list[int]], most: int = PROFILE):
        self.langs, self.most = sorted(learnt), most
        self.grams = np.unique(np.array([g for p in learnt.values() for g in p], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, learnt[lang])] = np.arange(len(learnt[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 less its share of the largest possible distance."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        own = ranked(text, self.most)
        at = np.searchsorted(self.grams, own)
        at = np.where(self.grams[np.minimum(at, len(self.grams) - 1)] == own, at, len(self.grams))
        theirs = self.ranks[:, at]
        distance = np.where(theirs < 0, self.most, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.most * len(own)))


def held_out() -> Column:
    """Whether crc32 of doc_id as text leaves 2 by 4; a null doc_id isn't held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, learnt: dict[str, list[int]] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score.

    Profiles are learnt from rows that aren't held out, unless given.  A text that is null or has no letter is `und`
    with score 0, and so is every text if no language could be learnt.  Of languages equally near the first by name counts.
    Repeated rows repeat; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", *[c for c in ("lang",) if learnt is None])
    if learnt is None:
        learnt = profiles(docs.filter(~held_out()))
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(learnt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return narrow.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, learnt: dict[str, list[int]] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of docs, with all their columns, whatever these are named, whose language is known with a score above `least`.

    A text that is null, empty or has no letter is of no language and goes, and so does every row if none could be
    learnt.  Of languages equally near the first by name counts.  Repeated rows stay or go together; very long texts are
    read whole; an empty table gives an empty result.
    """
    learnt = profiles(docs.filter(~held_out())) if learnt is None else learnt
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(learnt))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column("row").field(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score > least for lang, score in found], pa.bool_()))

    rows = whole(docs)
    return rows.mapInArrow(lean(run), rows.schema).select("row.*")

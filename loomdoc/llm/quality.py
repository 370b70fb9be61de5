"""Quality rules as a short-circuit cascade.

Every rule rejects on one measure of the text. On a sample, chosen by a hash over the whole
table, the tasks measure each rule's cost (seconds a text) and selectivity (share rejected) and
send back nothing else; rules run in the order of rejections per cost, and a text leaves at
the first rule that rejects it. The order changes which rule is named and what is computed,
never the verdict, as a text is kept only if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import str_texts, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Text:
    """A text whose measures are computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # of bytes, split() takes exactly \x20 and \x09-\x0D

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.text.split("\n") if _ASCII_WORD.search(x)]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 8-word windows that occur twice or more, the first included."""
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, self.n_words)
        if len(ids) < 9 or len(number) == len(ids):
            return 0
        for step in (1, 2, 4):  # names of 2-, 4- and 8-word windows, made of two names each
            pair = ids[:-step] * np.int64(len(self.words) + 1) + ids[step:]
            values, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
            if len(values) == len(pair):
                return 0
        starts = np.flatnonzero(counts[ids] > 1)
        edge = np.bincount(starts, minlength=self.n_words + 8) - np.bincount(starts + 8, minlength=self.n_words + 8)[: self.n_words + 8]
        return int((np.cumsum(edge[: self.n_words]) > 0).sum())

    @cached_property
    def n_same_words(self) -> int:
        """Words equal to the word before."""
        return sum(map(bytes.__eq__, self.words, self.words[1:]))

    @cached_property
    def case_ratio(self) -> float:
        letters = sum(map(str.isalpha, self.text))
        return sum(map(str.isupper, self.text)) / max(letters, 1)


#: name -> whether it rejects. Thresholds are the usual ones of web-text filters.
RULES: dict[str, Callable[[Text], bool]] = {
    "few_words": lambda t: t.n_words < 20,
    "symbols": lambda t: t.n_symbols * 10 > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "upper_case": lambda t: t.case_ratio > 0.5,
    "repeated_lines": lambda t: t.n_dup_lines >= 3 and t.n_dup_lines * 10 > 3 * len(t.text.split("\n")),
    "same_words": lambda t: t.n_same_words * 10 > 3 * t.n_words,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 30 * t.n_words,
}


def _measured(batches):
    """Of each rule: texts rejected and seconds taken, nothing being known of a text beforehand."""
    import pyarrow as pa

    rejected, took = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0.0)
    for batch in batches:
        for text in str_texts(batch.column(0)):
            for name, rule in RULES.items():
                began = time.perf_counter()
                rejected[name] += rule(Text(text))
                took[name] += time.perf_counter() - began
    yield pa.RecordBatch.from_arrays([pa.array(list(RULES)), pa.array(list(rejected.values()), pa.int64()), pa.array(list(took.values()), pa.float64())], ["rule", "rejected", "seconds"])


def order_rules(texts: DataFrame, sample_rows: int) -> list[str]:
    """Rule names by rejections per second on about sample_rows of texts (doc_id, text), best first; ties by name.

    A row is in the sample if a hash of its id and text says so. Costs are wall times, so two runs
    may order rules of near equal worth differently.
    """
    n = texts.count()
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n // sample_rows))) == 0)
    sums = drawn.select("text").mapInArrow(_measured, "rule string, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    rate = {r.rule: r.rejected / max(r.seconds, 1e-9) for r in sums.collect()}
    return sorted(RULES, key=lambda name: (-rate.get(name, 0.0), name))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, measures: bool = False, order: list[str] | None = None) -> DataFrame:
    """One row a document: doc_id, kept, rejected_by (null if kept).

    measures: also the five measures and base_failed, for which every text is read to its end;
    without them a text costs what the rules up to its rejection cost. order: rule names, if not
    to be drawn from a sample; it changes rejected_by alone. A null text is an empty one: no
    words, so rejected. Ids may be null or repeat; each row is judged. An empty input gives no
    rows. Other columns of docs are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = order or order_rules(texts, sample_rows)
    names = MEASURES if measures else ()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in map(Text, str_texts(batch.column(1))):
                by = next((n for n in order if RULES[n](text)), None)
                rows.append((by is None, by, *(getattr(text, n) for n in names)))
            columns = list(zip(*rows, strict=True)) or [[]] * (2 + len(names))
            kinds = [pa.bool_(), pa.string()] + [pa.int64()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "kept", "rejected_by", *names])

    out = texts.mapInArrow(run, "doc_id long, kept boolean, rejected_by string" + "".join(f", {n} long" for n in names))
    if not measures:
        return out
    # every base failure is a rule's rejection too (few_words, repeated_words)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), measures=True).select("doc_id", *MEASURES, "base_failed", "kept")

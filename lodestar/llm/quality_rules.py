"""Quality rules: base rules, and a decision list learned by sequential covering.

Method. Each text is reduced to counts. From the counts of a sample of labelled rows, rules for low quality are learned one by
one: a conjunction of thresholds grows by the condition of the largest information gain on two thirds of the rows,
and its last conditions are pruned as long as that helps on the other third; the rows that it covers are put aside, and learning ends when a
rule isn't precise enough. The list becomes one ordered CASE expression over the counts, which Spark evaluates
inside its generated code.

Scale. A text is read once, by the task that scans it; nothing is shuffled but the sample (at most SAMPLE rows of counts).

Defined cases. A null text has no words: all counts 0, base_failed. Null doc_ids are judged like any; they teach nothing. Without labels of
both classes the list is empty and the verdict is base_failed alone. Repeated rows come out as often as they come in;
an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .labelled import label_sample

#: Labelled rows to learn from, at most; thresholds tried for a feature; conditions in a rule.
SAMPLE, CUTS, CONDITIONS = 20_000, 64, 4
#: A rule must be this precise on the rows held back for pruning, and cover so many there.
PRECISION, SUPPORT = 0.9, 3

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_marks")
#: Share of the second count in the first (the denominator at least 1).
FEATURES = {
    "word_length": ("n_words", "word_chars"),
    "symbols": ("n_words", "n_symbols"),
    "dup_lines": ("n_lines", "n_dup_lines"),
    "repeats": ("n_words", "n_repeat_words"),
    "upper": ("n_words", "n_upper_words"),
    "marks": ("n_words", "n_marks"),
    "line_words": ("n_lines", "n_words"),
}

_SPACE, _SYMBOLS, _MARKS, _WINDOW = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?", 5


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode()
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, _SPACE)))
    symbols, marks = (len(data) - len(data.translate(None, x)) for x in (_SYMBOLS, _MARKS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), sum(map(bytes.isupper, words)), marks


def repeat_words(words: list[bytes], n: int = _WINDOW) -> int:
    """Words in windows of n words that the text has twice or more."""
    grams = list(zip(*(words[i:] for i in range(n))))
    distinct = set(grams)
    if len(distinct) == len(grams):
        return 0
    seen, twice = set(), set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    total, end = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            total += i + n - max(end, i)
            end = i + n
    return total


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS."""
    names = ["doc_id", *COUNTS]

    def tasks(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                found = zip(*map(counts, b.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in found)], names=names)

    return docs.select("doc_id", "text").mapInArrow(tasks, ", ".join(f"{n} long" for n in names))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        over, of = FEATURES[self.feature]
        share = F.col(of) / F.greatest(F.col(over), F.lit(1))
        return share > self.cut if self.above else share <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def features(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: table[of] / np.maximum(table[over], 1) for k, (over, of) in FEATURES.items()}


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grown(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS and (~bad[rows]).any():
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        best, now = (1e-9, None, None), np.log2(p / (p + n))
        for name, values in x.items():
            v = values[rows]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS), method="midpoint"))[:-1]:
                for above in (True, False):
                    on = v > cut if above else v <= cut
                    pp = (on & bad[rows]).sum()
                    if pp and (gain := pp * (np.log2(pp / on.sum()) - now)) > best[0]:
                        best = gain, Condition(name, above, float(cut)), on
        if best[1] is None:
            break
        rule, rows = (*rule, best[1]), rows[best[2]]
    return rule


def learn(table: dict[str, np.ndarray], quality: np.ndarray) -> list[Rule]:
    """Rules for quality 0, in order; rows must come in an order that has nothing to do with their label."""
    x, bad, n = features(table), quality == 0, len(quality)
    hold = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while (bad & left & ~hold).any() and (~bad & left & ~hold).any():
        rule = _grown(x, bad, np.flatnonzero(left & ~hold))

        def worth(r: Rule) -> float:
            on = covers(r, x, n) & left & hold
            return (2 * (on & bad).sum() - on.sum()) / max(1, on.sum()) if r else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
        on = covers(rule, x, n) & left
        got = on & hold
        if not rule or (got & bad).sum() < SUPPORT or (got & bad).sum() < PRECISION * got.sum():
            break
        rules.append(rule)
        left &= ~on
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True (keep) unless a rule of the list holds: one ordered conditional expression."""
    out = None
    for r in rules:
        held = r[0].column()
        for c in r[1:]:
            held &= c.column()
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    ids = label_sample(labels, sample)
    known = counted(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi"))  # ids: `sample` numbers at most
    one = known.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in COUNTS)).join(ids, "doc_id")
    rows = sorted(one.collect(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["doc_id"]))  # bounded by sample
    return learn({c: np.array([r[c] for r in rows], float) for c in COUNTS}, np.array([r["label"] for r in rows], int))


def judge(table: DataFrame, rules: list[Rule]) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return table.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rules = train(docs, read_table(spark, sf_dir, "labels"))
    return judge(counted(docs), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose measure lies beyond a cutoff. For every stratum the cutoffs come from labelled documents
that pass the base rule, in two halves dealt by a hash of the text:

* On the fit half a path of ever stricter cutoffs is laid. Again and again the rule and cutoff are added that reject most bad
  documents per good one lost among those not rejected yet (the middle of equals), until none is worth its losses. Each rule's
  cutoff moves there one bin at a time, from the laxest that rejects a bad document on.
* On the holdout half the path is walked from its lax end. A step passes if the exact (Clopper-Pearson) upper bound, at level
  delta / m, of the share of good documents that all cutoffs so far reject together is at most alpha; the last step before the
  first failure gives the cutoffs, and there are none if the first step fails. Tests in an order that the other half has fixed
  need no correction; m, the number of strata, corrects for the rest (Bonferroni).

So with probability 1 - delta no stratum loses more than the share alpha of its good documents by these rules. The bound takes
independent trials, so copies of a text count once and lie in one half; a text is good if one of its copies is.

The counts behind this cover all labelled documents. They are histograms over (stratum, rule, label, bin) and (stratum, step)
with fixed numbers of bins and steps; only these bounded tables, never a row of the corpus, reach the driver. Strata with too
few good documents in the holdout to certify any cutoff at the level used share one pooled stratum, and so does the next larger
one where the pool itself has too few; the number of strata is bounded by the labels, not by the values of the column.

Defined cases: null or empty text has zero words and fails the base rule; null strata form one stratum; documents without
a label, or with a null one, aren't counted; a table without labels gets no cutoffs, and the base rule alone decides;
repeated rows are judged one by one; a repeated id has one label, the best; all columns of the input are kept, whatever their
names."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import append, free_name, slices, table, texts, with_fields
from millrace.session import drop_materialized, materialize

SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\x0b\x0c\r"
#: Measure of each rule, as a share between 0 and 1; a document beyond a cutoff is rejected.
RULES = ("symbol_share", "upper_share", "mark_share", "repeat_share", "dup_line_share", "short_word_share", "long_word_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BINS = 200


def repeated(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a run of `width` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == n:
        return 0
    number: dict[tuple, int] = {}
    own = np.fromiter((number.setdefault(g, len(number)) for g in grams), dtype=np.int64, count=n)
    twice = np.bincount(own)[own] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts and the rules' measures of one text (UTF-8)."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0), (0.0,) * len(RULES)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, _WHITE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    dup = len(lines) - len(set(lines))
    repeats = repeated(words)
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(text) - len(text.translate(None, b"!?@^~=_+{}[]\\"))
    mean = chars / n
    shares = (symbols / chars, upper / chars, marks / chars, repeats / n, dup / max(1, len(lines)), 1 / (1 + mean), mean / (mean + 30))
    return (n, chars, symbols, dup, repeats), shares


def add_measures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str], str]:
    """docs with the counts (longs) and one array of the measures; the names of these columns."""
    counts = [free_name(docs, c) for c in COUNTS]
    shares = free_name(docs, "rule_measures")
    schema = with_fields(docs.schema, *((c, T.LongType()) for c in counts), (shares, T.ArrayType(T.DoubleType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            both = [measure(t) for t in texts(batch.column(batch.schema.get_field_index(text_col)))]
            own = [pa.array([b[0][i] for b in both], pa.int64()) for i in range(len(COUNTS))]
            own.append(pa.array([b[1] for b in both], pa.list_(pa.float64())))
            kinds = [*(pa.field(c, pa.int64()) for c in counts), pa.field(shares, pa.list_(pa.float64()))]
            yield append(batch, kinds, own)

    return docs.mapInArrow(run, schema), counts, shares


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """Log of P(X <= k) for X ~ Binomial(n, p), summed from the largest term outwards while terms count."""
    if k >= n:
        return 0.0
    top = min(k, int((n + 1) * p))
    first = math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p)

    def run(ratios, least: int, most: int, step: int) -> float:
        total, last, i = 0.0, 1.0, least
        while (most - i) * step >= 0 and last > 1e-18 * (1 + total):
            at = np.arange(i, max(most, i - 4095) - 1, -1) if step < 0 else np.arange(i, min(most, i + 4095) + 1)
            terms = last * np.cumprod(ratios(at.astype(np.float64)))
            total, last, i = total + float(terms.sum()), float(terms[-1]), int(at[-1]) + step
        return total

    below = run(lambda i: i * (1 - p) / ((n - i + 1) * p), top, 1, -1)  # term i - 1 over term i
    above = run(lambda i: (n - i + 1) * p / (i * (1 - p)), top + 1, k, 1)  # term i over term i - 1
    return first + math.log1p(below + above)


@functools.lru_cache(1 << 12)
def certified(losses: int, n: int, alpha: float, level: float) -> bool:
    """Whether the exact upper bound of the loss rate, at this level, is at most alpha: P(X <= losses | alpha) <= level."""
    if n <= 0 or losses > alpha * n:
        return False
    return log_binomial_cdf(losses, n, alpha) <= math.log(level)


@dataclass
class Cutoffs:
    """For each stratum and rule the least bin that is rejected; BINS + 1 (no bin) where nothing is certified."""

    by_stratum: dict[str | None, list[int]] = field(default_factory=dict)
    pooled: list[int] = field(default_factory=lambda: [BINS + 1] * len(RULES))


@dataclass(frozen=True)
class Stage:
    """A rule's cutoff goes from bin `lax` down to `strict`; `first` is the number of the path's step at `lax`."""

    rule: int
    lax: int
    strict: int
    first: int


def beyond(h: np.ndarray) -> np.ndarray:
    """How many are rejected at each cutoff bin c: those in bins >= c."""
    return np.concatenate([np.cumsum(h[::-1])[::-1], [0]])


def propose(good: np.ndarray, bad: np.ndarray, worth: float) -> tuple[int, int, int] | None:
    """(rule, laxest cutoff that rejects a bad document, proposed cutoff) from histograms (rule, bin) of documents that no cutoff
    rejects yet: the most bad documents less `worth` for each good one; ties go to the first rule, and
    among its equal cutoffs to the middle of the laxest run of them (between a good and a bad document)."""
    best = None
    for rule in range(len(good)):
        lost, won = beyond(good[rule]), beyond(bad[rule])
        gain = won - worth * lost
        strict = last = int(len(gain) - 1 - np.argmax(gain[::-1]))
        while last > 0 and gain[last - 1] == gain[strict]:
            last -= 1
        strict = (last + strict + 1) // 2
        if gain[strict] > 0 and (best is None or gain[strict] > best[0]):
            best = gain[strict], rule, int(np.flatnonzero(won)[-1]), strict
    return best[1:] if best else None


def steps(path: list[Stage]) -> int:
    return path[-1].first + path[-1].lax - path[-1].strict + 1 if path else 0


def cutoffs_after(path: list[Stage], number: int) -> list[int]:
    """The cutoff of each rule after so many steps of the path."""
    out = [BINS + 1] * len(RULES)
    for s in path:
        if s.first < number:
            out[s.rule] = min(out[s.rule], max(s.strict, s.lax - (number - 1 - s.first)))
    return out


def walk(losses: np.ndarray, n: int, alpha: float, level: float) -> int:
    """How many steps pass before the first failure. losses[i]: good holdout documents that step i is the first to reject."""
    for i, lost in enumerate(np.cumsum(losses).tolist()):
        if not certified(int(lost), n, alpha, level):
            return i
    return len(losses)


def own_strata(sizes: dict[str | None, int], total: int, alpha: float, delta: float) -> tuple[list[str | None], float]:
    """The strata with cutoffs of their own, and the level of each test: as many, by good holdout documents, as let each of them,
    and the pool of all others if there are any, certify a cutoff without losses at that level."""
    order = sorted(sizes, key=lambda s: -sizes[s])
    while True:
        level = delta / (len(order) + 1)
        rest = total - sum(sizes[s] for s in order)
        if not order or (certified(0, sizes[order[-1]], alpha, level) and (not rest or certified(0, rest, alpha, level))):
            return order, level
        order.pop()


def first_step(paths: dict[tuple[bool, str | None], list[Stage]]):
    """Number of the step of its stratum's path that first rejects a row (columns own, s, bins); null where none does."""
    out = F.lit(None).cast("int")
    for (own, s), path in paths.items():
        hits = [F.when(F.col("bins")[p.rule] >= p.strict, p.first + p.lax - F.least(F.col("bins")[p.rule], F.lit(p.lax))) for p in path]
        if hits:
            here = (F.col("own") == F.lit(own)) & F.col("s").eqNullSafe(F.lit(s).cast("string"))
            out = F.when(here, F.least(*hits, F.lit(None).cast("int"))).otherwise(out)
    return out


def fit(
    measures: DataFrame,
    labels: DataFrame,
    shares: str,
    key: str,
    id_col: str = "doc_id",
    stratum: str = "lang",
    label: str = "quality",
    alpha: float = 0.02,
    delta: float = 0.05,
    worth: float = 20.0,
    most_stages: int = 8,
) -> Cutoffs:
    """Cutoffs from all labelled rows. measures: (id, stratum, key of the text, COUNTS, array of measures); labels: (id, label),
    1 for good.

    worth: how many bad documents a cutoff has to reject for each good one that it loses on the fit half. most_stages: how often
    a rule is added to a path, so the number of its steps is bounded too."""
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("_good"))
    joined = measures.where(~base_failed(COUNTS[0], COUNTS[4])).join(own, F.col(id_col) == F.col("_id")).select(F.col(stratum).cast("string").alias("s"), F.col(key).alias("k"), "_good", F.transform(shares, lambda x: F.least(F.floor(x * BINS), F.lit(BINS)).cast("int")).alias("bins"))
    texts_ = joined.groupBy("s", "k").agg(F.max("_good").alias("good"), F.first("bins").alias("bins"))  # equal texts have equal bins
    rows = materialize(texts_.withColumn("hold", F.pmod(F.xxhash64("k", F.lit("half")), F.lit(2)) == 1), "labelled")
    least = math.ceil(math.log(delta) / math.log1p(-alpha))
    good = rows.where("good = 1 AND hold")
    sizes = good.groupBy("s").count().where(F.col("count") >= least).collect()
    large, level = own_strata({r.s: r["count"] for r in sizes}, good.count(), alpha, delta)
    known = F.lit(False)
    for s in large:
        known = known | F.col("s").eqNullSafe(F.lit(s))
    dealt = rows.withColumn("own", known).withColumn("s", F.when(F.col("own"), F.col("s")))
    paths: dict[tuple[bool, str | None], list[Stage]] = {(False, None): [], **{(True, s): [] for s in large}}
    open_ = set(paths)
    for _ in range(most_stages):
        counts = {k: np.zeros((2, len(RULES), BINS + 1), dtype=np.int64) for k in open_}
        left = dealt.where(~F.col("hold")).withColumn("at", first_step(paths)).where("at IS NULL")
        for r in left.select("own", "s", "good", F.posexplode("bins").alias("rule", "bin")).groupBy("own", "s", "good", "rule", "bin").count().collect():
            if (r.own, r.s) in open_:
                counts[r.own, r.s][r.good, r.rule, r.bin] = r["count"]
        for k in list(open_):
            found = propose(counts[k][1], counts[k][0], worth)
            if found is None:
                open_.discard(k)
            else:
                paths[k].append(Stage(*found, steps(paths[k])))
        if not open_:
            break
    losses = {k: np.zeros(steps(p), dtype=np.int64) for k, p in paths.items()}
    n = dict.fromkeys(paths, 0)
    for r in dealt.where("hold AND good = 1").withColumn("at", first_step(paths)).groupBy("own", "s", "at").count().collect():
        n[r.own, r.s] += r["count"]
        if r.at is not None:
            losses[r.own, r.s][r.at] += r["count"]
    drop_materialized(rows)
    passed = {k: cutoffs_after(p, walk(losses[k], n[k], alpha, level)) for k, p in paths.items()}
    return Cutoffs({s: passed[True, s] for s in large}, passed[False, None])


def base_failed(n_words: str, n_repeat: str):
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat) > 50 * F.col(n_words))


def verdict(found: Cutoffs, shares: str, stratum: str):
    """True where no rule of the row's stratum rejects it."""

    def passes(cuts: list[int]):
        out = F.lit(True)
        for i, c in enumerate(cuts):
            if c <= BINS:
                out = out & (F.floor(F.col(shares)[i] * BINS) < c)
        return out

    cases = passes(found.pooled)
    for s, cuts in found.by_stratum.items():
        cases = F.when(F.col(stratum).cast("string").eqNullSafe(F.lit(s)), passes(cuts)).otherwise(cases)
    return cases


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum: str, **how) -> tuple[DataFrame, list[str], str, str, Cutoffs]:
    """The measures of all docs as a narrow table (some tens of bytes a row), names of its columns, and the cutoffs."""
    names = {"id": F.col(id_col), "stratum": F.col(stratum), "text": F.col(text_col), "text_key": F.xxhash64(text_col)}
    made, counts, shares = add_measures(docs.select(*(c.alias(n) for n, c in names.items())), "text")
    held = materialize(made.drop("text"), "measures")
    own = labels.select(F.col(id_col).alias("id"), F.col(how.get("label", "quality")))
    found = fit(held, own, shares, "text_key", "id", "stratum", **how)
    return held, counts, shares, "stratum", found


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for each row. The measures are made once and kept in a table: some tens of bytes a row."""
    held, counts, shares, own, found = _fitted(docs, labels, id_col, text_col, stratum, **how)
    failed = base_failed(counts[0], counts[4])
    return held.select(F.col("id").alias(id_col), *counts, failed.alias("base_failed"), (~failed & verdict(found, shares, own)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", **how) -> DataFrame:
    """The rows of docs that the rules keep, without a shuffle of texts: measured once for the cutoffs and once as they stream by."""
    held, _, _, _, found = _fitted(docs, labels, id_col, text_col, stratum, **how)
    drop_materialized(held)
    again, counts, shares = add_measures(docs, text_col)
    return again.where(~base_failed(counts[0], counts[4]) & verdict(found, shares, stratum)).select(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Quality rules as weak supervision.

Each rule looks at a few counts of a text and votes good, votes bad or abstains. Expectation-maximisation over the counts of
vote patterns estimates how often each rule votes which way on good and on bad texts; a text's posterior probability of
being good decides. Patterns number 3^rules at most, whatever the corpus size, so the fit itself is a driver-side loop
over a bounded table. All texts of ten words or more count in it; shorter ones fail whatever it says (see base_failed), and
their few votes would only blur the estimates for the texts that it judges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read, slices, texts_of

SYMBOLS = b"#*$%&|<>"
MARKS = (b"!!", b"##", b"**", b"$$", b"%%", b"&&", b" |", b"<<", b">>")  # doubled or lone marks
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
GOOD, BAD, NONE = 1, 2, 0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters", "n_distinct"]


@dataclass(frozen=True)
class Rule:
    """Votes bad where counts[over] > bad * counts[base], good where it is <= good * counts[base]; abstains between and where
    base is below ``least``. ``flip``: a low share is the bad one."""

    name: str
    over: str
    base: str
    good: float
    bad: float
    least: int = 1
    flip: bool = False

    def votes(self, c: dict[str, np.ndarray]) -> np.ndarray:
        a, b = c[self.over].astype(float), c[self.base].astype(float)
        sign = -1.0 if self.flip else 1.0
        out = np.where(sign * a > sign * self.bad * b, BAD, np.where(sign * a <= sign * self.good * b, GOOD, NONE))
        return np.where(b < self.least, NONE, out)


RULES = (
    Rule("repeated_windows", "n_repeat_words", "n_words", 0.08, 0.20, 10),
    Rule("symbols", "n_symbols", "n_words", 0.03, 0.10),
    Rule("symbol_density", "n_symbols", "word_chars", 0.01, 0.04),
    Rule("marks", "n_marks", "n_words", 0.03, 0.10),
    Rule("capitals", "n_upper", "n_letters", 0.15, 0.35, 10),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.10, 0.30),
    Rule("word_variety", "n_distinct", "n_words", 0.25, 0.12, 10, flip=True),
    Rule("long_words", "word_chars", "n_words", 9.0, 14.0),
    Rule("short_words", "word_chars", "n_words", 3.0, 2.0, flip=True),
)


def text_counts(raw: bytes) -> tuple[int, ...]:
    """COUNTS of one text; words are runs without space, tab, LF, VT, FF, CR, which is what bytes.split() gives."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    chars = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = 0
    if n > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(first := set(grams)) < len(grams):
            del first
            seen: dict[tuple, int] = {}
            twice = set()
            for i, g in enumerate(grams):
                if (k := seen.setdefault(g, i)) != i:
                    twice.add(k)
                    twice.add(i)
            repeats = len(set(chain.from_iterable(range(i, i + 5) for i in twice)))
    return (
        n, chars - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats,
        len(lines), sum(map(raw.count, MARKS)), len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LETTERS)), len(set(words)),
    )


@dataclass
class RuleModel:
    """prior: share of good texts; like[r, vote, class]: class 0 good, 1 bad."""

    rules: tuple[Rule, ...]
    prior: float
    like: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log([self.prior, 1 - self.prior]) + sum(np.log(self.like[r, votes[:, r]]) for r in range(votes.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -700, 700)))


def fit(patterns: np.ndarray, weights: np.ndarray, rules: tuple[Rule, ...] = RULES, rounds: int = 200, smooth: float = 1.0) -> RuleModel:
    """EM from the majority of votes (ties: good). patterns: one row of votes each, weights: how many texts show it."""
    good = (patterns == GOOD).sum(1)
    bad = (patterns == BAD).sum(1)
    # one clear vote against a text outweighs rules that merely see nothing wrong
    q = np.where(bad > 0, np.where(bad * 3 >= good, 0.1, 0.45), 0.95).astype(float)
    model = RuleModel(rules, 0.5, np.full((len(rules), 3, 2), 1 / 3))
    for _ in range(rounds if len(patterns) else 0):
        mass = np.stack([q * weights, (1 - q) * weights], 1)
        total = mass.sum(0)
        like = np.empty((len(rules), 3, 2))
        for r in range(len(rules)):
            for v in range(3):
                like[r, v] = mass[patterns[:, r] == v].sum(0) + smooth
        like /= like.sum(1, keepdims=True)
        model = RuleModel(rules, float((total[0] + smooth) / (total.sum() + 2 * smooth)), like)
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id, _cs_key (hash of the text), all counts, and the vote pattern as a number in base 3. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            table = np.array([text_counts(t) for t in texts_of(batch)], np.int64)
            c = dict(zip(COUNTS, table.T, strict=True))
            pattern = sum(r.votes(c) * 3**i for i, r in enumerate(rules)) + np.zeros(len(table), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, table.T.copy()), pa.array(pattern)], [id_col, "_cs_key", *COUNTS, "_cs_pattern"])

    return docs.select(id_col, text, F.xxhash64(text).alias("_cs_key")).mapInArrow(work, f"`{id_col}` {kind}, _cs_key long, {', '.join(f'{c} long' for c in COUNTS)}, _cs_pattern long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> tuple[DataFrame, RuleModel]:
    """Every row with its counts, base_failed, posterior and kept; and the fitted model.

    base_failed: fewer than 10 words, or over 20 % of the words lie in 5-word windows that occur twice. kept: not
    base_failed and a posterior of ``threshold`` at least. Null and empty texts have no words and fail. An empty table gives
    no rows. Rows that are equal get equal results.
    """
    counts = checkpoint(quality_counts(docs, id_col, text, rules))
    seen = counts.where("n_words >= 10").groupBy("_cs_pattern").count().collect()  # 3^rules rows at most
    codes = np.array([r[0] for r in seen], np.int64)
    digits = codes[:, None] // 3 ** np.arange(len(rules)) % 3
    model = fit(digits, np.array([r[1] for r in seen], float), rules)
    log = F.lit(float(np.log((1 - model.prior) / model.prior)))
    for r in range(len(rules)):  # log odds of bad as a sum over rules: a plain expression, no join
        odds = np.log(model.like[r, :, 1] / model.like[r, :, 0])
        log = log + F.element_at(F.array(*map(F.lit, odds.tolist())), (F.floor(F.col("_cs_pattern") / 3**r) % 3 + 1).cast("int"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = counts.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(F.least(F.greatest(log, F.lit(-700.0)), F.lit(700.0)))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)), model


def drop_low_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, all columns as they were."""
    kept = quality_rules(docs, id_col, text)[0].where("kept").select(F.col(id_col).alias("_cs_id"), "_cs_key").distinct()
    return docs.join(kept, F.col("_cs_id").eqNullSafe(docs[id_col]) & (F.col("_cs_key") == F.xxhash64(docs[text])), "left_semi")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")

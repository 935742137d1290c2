"""Quality rules: a table of thresholds compiled into one projection.

Every metric is a column expression over the words and lines of one text, so a document is
read once, judged in its own row and never shuffled. Long or frequent texts need no care
beyond their own row: all steps are linear, or sort the hashes of the windows of one text.
The stop-word rule speaks of the languages listed; for others, pass rules without it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from deltascope.llm.common import WORD, keep_where, let

# fixed values of the base rule
SYMBOLS = r"[#*$%&|<>]"
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50

#: Frequent short words of ten languages: English, German, French, Spanish, Italian, Portuguese, Dutch, Polish, Turkish, Russian.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be by this from at or an have not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que est pour dans sur avec par au il qui "
    "el los las del y que se por con para su al lo como más una o así "
    "il di che non per sono della gli nel alla anche questo "
    "não uma dos das os ao mais foi pelo isso "
    "het een van op te niet zijn voor maar ook naar "
    "nie się jest jak ale czy tym przez tylko był "
    "ve bir bu çok gibi daha ama kadar olarak sonra "
    "и в не на что он как это но по из за так от для же"
).split()


@dataclass(frozen=True)
class Rule:
    """`metric` must lie within `low` and `high`, both included; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self, value: Column) -> Column:
        bounds = []
        if self.low is not None:
            bounds.append(value >= F.lit(self.low))
        if self.high is not None:
            bounds.append(value <= F.lit(self.high))
        return reduce(lambda a, b: a & b, bounds, F.lit(True))


#: Length, symbol, stop-word and line ratios. A document must pass all of them.
RULES = (
    Rule("mean_word_length", 2.0, 16.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_share", 0.02, None),
    Rule("duplicate_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
)


def _same_window(words: Column, x: Column, y: Column) -> Column:
    """Equal hashes first; the words themselves decide."""
    same = [F.get(words, x["p"] + k) == F.get(words, y["p"] + k) for k in range(3)]
    return F.when(x["g"] == y["g"], same[0] & same[1] & same[2]).otherwise(False)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the same text."""
    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("p"))

    def repeated(windows: Column) -> Column:
        found = F.filter(windows, lambda x, k: _same_window(words, x, F.get(windows, k - 1)) | _same_window(words, x, F.get(windows, k + 1)))
        return F.sort_array(F.transform(found, lambda x: x["p"]))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window))
    return F.when(F.size(words) >= 3, let(let(windows, repeated), covered)).otherwise(F.lit(0).cast("long"))


def _metrics(text: Column) -> Column:
    """All counts and ratios of a text as one struct; every list in it is worked out once."""
    def of_lists(words: Column, lines: Column) -> Column:
        def number(array: Column) -> Column:
            return F.size(array).cast("long")

        return F.struct(
            number(words).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            number(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).alias("n_stop_words"),
            number(lines).alias("n_lines"),
            number(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).alias("n_bullet_lines"),
            number(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipsis_lines"),
        )

    def with_ratios(counts: Column) -> Column:
        words, lines = (F.greatest(counts[n], F.lit(1)).cast("double") for n in ("n_words", "n_lines"))
        ratios = {
            "mean_word_length": counts["word_chars"] / words, "symbols_per_word": counts["n_symbols"] / words,
            "stop_word_share": counts["n_stop_words"] / words, "duplicate_line_share": counts["n_dup_lines"] / lines,
            "bullet_line_share": counts["n_bullet_lines"] / lines, "ellipsis_line_share": counts["n_ellipsis_lines"] / lines,
        }
        return F.struct(*[counts[n].alias(n) for n in COUNTS], *[r.alias(n) for n, r in ratios.items()])

    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: let(worded, lambda lines: of_lists(words, lines)))
    return let(found, with_ratios)


COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines",
)


def _verdict(metrics: Column, rules: tuple[Rule, ...]) -> Column:
    base = (metrics["n_words"] < BASE_MIN_WORDS) | (100 * metrics["n_repeat_words"] > BASE_MAX_REPEAT_PERCENT * metrics["n_words"])
    failed = F.array_compact(F.array(*[F.when(~r.holds(metrics[r.metric]), F.lit(r.metric)) for r in rules]))
    return F.struct(
        *[metrics[n].alias(n) for n in (*COUNTS, *RATIOS)], base.alias("base_failed"), failed.alias("failed"), (~base & (F.size(failed) == 0)).alias("kept")
    )


RATIOS = (
    "mean_word_length", "symbols_per_word", "stop_word_share", "duplicate_line_share", "bullet_line_share", "ellipsis_line_share",
)


def quality(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge every document: one row per row of `docs`, its columns in the struct `_doc`.

    Added columns: the base counts n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (words in three-word windows found twice or more, the first included),
    the ratios the rules name, `failed` (names of the rules that failed), `base_failed`
    (under 50 words, or over half of them in repeated windows) and `kept`.

    Null text counts as empty: no words, every count 0, base_failed. A text without a line
    or word divides by 1. Rows are judged one by one, so repeated rows get equal verdicts;
    extra columns stay inside the struct and can't clash. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    judged = let(_metrics(text), lambda metrics: _verdict(metrics, rules))
    # one generated row: a filter on the verdict stays above it and does not work it out again
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.inline(F.array(judged)))


def keep_good(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents the rules keep, with their own columns only."""
    return keep_where(quality(docs, text_column, rules), "kept").select("_doc.*")

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base counts of a text (words, symbols, repeated lines, words in repeated runs of three) are needed for every row; the rules of
the cascade stand on them or on measures of their own. On a bounded sample each rule is run alone, a few times: the least seconds a
row, less those of a job without a rule, are its cost, its share of rejected rows its selectivity. The rules then run in order of rejection per cost inside one CASE, which stops at the
first that rejects, so a costly measure is taken only of rows that every rule before it let pass. A row is kept if the base test and
all rules let it pass; so the order, which may change with the timings, never changes a verdict.

Defined cases: a null or empty text has no words and fails the base test; very long texts are measured whole, in the memory of their
row; repeated rows are judged each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelake.llm.shared import BLANKS, words, written

MIN_WORDS, MOST_REPEATED, RUN = 50, 50, 3
#: Rows on average of the sample on which rules are costed, twice as many at most, and runs of which the fastest counts.
SAMPLE_ROWS, SEED, RUNS = 2000, 3, 3
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """rejects: true where a row is rejected, over the base columns and `text`, `w` (its words) and `lines`."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    """Gentle bounds in the manner of published web-text filters; prose of any language passes them."""
    w, lines, n = F.col("w"), F.col("lines"), F.col("n_words")
    share = lambda test, of: F.size(F.filter(of, test)) / F.greatest(F.size(of), F.lit(1))
    return [
        Rule("symbols", F.col("n_symbols") > 0.25 * n),
        Rule("mean_word", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(lines)),
        Rule("no_letters", share(lambda x: ~F.rlike(x, F.lit("\\p{L}")), w) > 0.4),
        Rule("ellipses", share(lambda x: F.rlike(x, F.lit("(\\.\\.\\.|…)\\s*$")), lines) > 0.5),
        Rule("bullets", share(lambda x: F.rlike(x, F.lit("^\\s*[-*•]")), lines) > 0.9),
        Rule("shouting", share(lambda x: F.rlike(x, F.lit("^[^\\p{Ll}]*\\p{Lu}{2}[^\\p{Ll}]*$")), w) > 0.8),
    ]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column, run: int = RUN) -> Column:
    """Words that lie in a run of so many words found twice or more in the array w, its first place included."""
    n = F.size(w)
    windows = F.transform(F.slice(w, 1, F.greatest(n - (run - 1), F.lit(0))), lambda x, i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(run)]).alias("h"), i.alias("i")))
    # Sorted by hash; runs of one hash are compared word by word, so a collision of hashes counts nothing.
    same = lambda p, q: F.forall(F.sequence(F.lit(0), F.lit(run - 1)), lambda k: F.get(w, p["i"] + k) == F.get(w, q["i"] + k))

    def marked(s: Column) -> Column:
        like = lambda x, j: F.when(F.get(s, j)["h"] == x["h"], same(x, F.get(s, j))).otherwise(False)
        return F.transform(F.filter(s, lambda x, j: F.coalesce(like(x, j - 1), F.lit(False)) | F.coalesce(like(x, j + 1), F.lit(False))), lambda x: x["i"])

    starts = F.sort_array(_let(F.sort_array(windows), marked))
    # The next start, or the end, bounds what each window adds to the union.
    adds = lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.coalesce(F.get(s, j + 1), x + run) - x, F.lit(run))), F.lit(0), lambda a, b: a + b)
    return _let(starts, adds)


def _measures(text: Column) -> Column:
    """Struct of w, lines and the base counts. Words and lines are bound once, so no plan, whatever it pushes down, splits the text for each element."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")

    def counted(w: Column) -> Column:
        return _let(lines, lambda lines: F.struct(
            w.alias("w"), lines.alias("lines"), F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ))

    return _let(words(text), counted)


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the base counts, w and lines."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", text.alias("text")).select("doc_id", "text", _measures(F.col("text")).alias("m")).select("doc_id", "text", "m.*")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def ordered(docs: DataFrame, given: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected), best first by rejection per cost."""
    share = SAMPLE_ROWS / max(docs.count(), 1)
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 40)) < F.lit(int(min(1, share) * (1 << 40)))
    # Written, so that each rule's time is its own.
    sample = written(measured(docs.where(drawn).limit(2 * SAMPLE_ROWS)).drop("doc_id")).where(~F.col("base_failed"))
    rows = max(sample.count(), 1)

    def timed(rejects: Column) -> tuple[float, int]:
        """Least seconds of a few runs, the first of which compiles, and the rows rejected."""
        took, rejected = [], 0
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = sample.agg(F.count(F.when(F.coalesce(rejects, F.lit(False)), 1)), F.max(F.size("w")), F.max(F.size("lines"))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), rejected

    idle, _ = timed(F.lit(False))  # what any job takes that reads these columns
    out = [(rule, max(took - idle, 1e-6) / rows, rejected / rows) for rule, (took, rejected) in ((rule, timed(rule.rejects)) for rule in given)]
    return sorted(out, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(docs: DataFrame, given: list[Rule] | None = None) -> DataFrame:
    """(doc_id, base counts, base_failed, failed_rule, kept) of each row of docs (doc_id, text). failed_rule: the first of the cascade that rejects."""
    given = rules() if given is None else given
    order = [rule for rule, _, _ in ordered(docs, given)] if given else []
    first = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        first = first.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    out = measured(docs).withColumn("failed_rule", first)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", F.col("failed_rule").isNull().alias("kept"))

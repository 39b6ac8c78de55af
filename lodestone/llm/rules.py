"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a predicate that rejects a text. The cost of each is clocked, and its rejection rate counted, on a
random sample of documented size, the rules are put in the order of rejections per cost, and one CASE expression
evaluates them in this order, so a rule's expression is not computed for rows that an earlier rule rejects.
The words, which most rules read, are split once a row. The order changes the cost alone, never the verdict: a
text is kept if no rule rejects it.

Defined results: a null text has no words (all counts 0, base_failed true); an empty text likewise. Texts
of any length are taken whole. Repeated rows give repeated results. Extra columns of the input are ignored
unless named in `keep`; working columns live in one struct, so their names can't clash.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import keep

#: Blanks between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows, in the mean, on which cost and selectivity are estimated; partitions that hold them; least cost of a rule in seconds.
SAMPLE_ROWS, SAMPLE_PARTS, LEAST = 1000, 4, 1e-3


def let(value: Column, body) -> Column:
    """body(value), where value is computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The maximal runs of other characters than BLANKS."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words in a window of three that is found twice or more in the text.

    Windows are sorted as (64-bit hash, position); equal neighbours mark the positions of repeated windows.
    The words that these cover are counted from the gaps between the sorted positions.
    """

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        tail = lambda k: F.slice(w, k, n)
        # words hold no blank, so a blank between them keeps windows apart
        pairs = F.zip_with(tail(1), tail(2), lambda a, b: F.concat(a, F.lit(" "), b))
        hashes = F.zip_with(pairs, tail(3), lambda a, b: F.xxhash64(a, b))
        return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: a["h"] == b["h"])
        return F.when(n < 2, F.lit(0)).otherwise(let(same, lambda e: F.when(F.exists(e, lambda x: x), marked(s, e)).otherwise(F.lit(0))))

    def marked(s: Column, same: Column) -> Column:
        no = F.array(F.lit(False))
        hit = F.zip_with(F.concat(no, same), F.concat(same, no), lambda a, b: a | b)
        at = F.filter(F.zip_with(s, hit, lambda x, y: F.when(y, x["i"])), lambda i: i.isNotNull())
        return let(F.array_sort(at), gaps)

    def gaps(p: Column) -> Column:
        step = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(step, F.lit(3), lambda n, x: n + x)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), covered)).cast("long")


@dataclass(frozen=True)
class Rule:
    """rejects takes the measures and gives a condition; inputs names the measures that it reads."""

    name: str
    rejects: object
    inputs: tuple[str, ...]


#: Measures of a text; each is an expression of (text, words).
MEASURES = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: F.length(F.translate(text, BLANKS, "")).cast("long"),
    "n_symbols": lambda text, words: (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    "n_dup_lines": lambda text, words: n_dup_lines(text),
    "n_repeat_words": lambda text, words: n_repeat_words(words),
}

#: A text fails the base if it is short or if over half of it repeats.
BASE = (
    Rule("short", lambda m: m["n_words"] < 50, ("n_words",)),
    Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], ("n_words", "n_repeat_words")),
)
#: Beyond the base: texts made of symbols, of words with under 2 or over 16 characters in the mean, or of one line again and again.
FURTHER = (
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"], ("n_words", "n_symbols")),
    Rule("word_length", lambda m: F.abs(m["word_chars"] - 9 * m["n_words"]) > 7 * m["n_words"], ("n_words", "word_chars")),
    Rule("lines", lambda m: 10 * m["n_dup_lines"] > m["n_words"], ("n_words", "n_dup_lines")),
)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the struct of all measures, each computed once a row."""
    t = F.coalesce(F.col(text), F.lit(""))
    both = let(words_of(t), lambda w: F.struct(*[f(t, w).alias(k) for k, f in MEASURES.items()]))
    return docs.select(*keep, both.alias("_m"))


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """(seconds, rejection rate) of each rule on a random sample of about `rows` rows; figures alone reach the driver.

    A measure's seconds are the shorter of two runs over the sample, less those of splitting words, which all rules share.
    """
    sample = keep(docs.select(F.col(text).alias("text")).sample(min(1.0, rows / max(1, docs.count())), 7).coalesce(SAMPLE_PARTS))
    m = F.col("_m")
    rates = measure(sample, "text", ()).select(*[F.avg(r.rejects(m).cast("double")).alias(r.name) for r in rules]).first()
    t = F.coalesce(F.col("text"), F.lit(""))

    def seconds(name: str) -> float:
        value = sample.select(let(words_of(t), lambda w: F.size(w) + MEASURES[name](t, w)).alias("v")).agg(F.sum("v"))
        return min(clocked(value), clocked(value))

    took = {name: seconds(name) for name in dict.fromkeys(("n_words", *(i for r in rules for i in r.inputs)))}
    split = took["n_words"]
    return {r.name: (sum(max(LEAST, took[i] - split) for i in r.inputs), float(rates[r.name] or 0)) for r in rules}


def clocked(df: DataFrame) -> float:
    began = time.perf_counter()
    df.collect()  # one row
    return time.perf_counter() - began


def ordered(rules: tuple[Rule, ...], figures: dict[str, tuple[float, float]]) -> list[Rule]:
    """By rejections per cost, the cheaper first among equals."""
    return sorted(rules, key=lambda r: (-figures[r.name][1] / figures[r.name][0], figures[r.name][0], r.name))


def cascade(rules: list[Rule], m: Column) -> Column:
    """The name of the first rule, in this order, that rejects; null if none does."""
    out = None
    for r in rules:
        out = F.when(r.rejects(m), F.lit(r.name)) if out is None else out.when(r.rejects(m), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns. A rule's measures are computed when it is reached."""
    rules = ordered(BASE + FURTHER, estimate(docs, BASE + FURTHER, text))
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.filter(let(words_of(t), lambda w: cascade(rules, {k: f(t, w) for k, f in MEASURES.items()})).isNull())


def quality_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by for every row."""
    rules = ordered(BASE + FURTHER, estimate(docs, BASE + FURTHER, text))
    m = F.col("_m")
    failed = BASE[0].rejects(m) | BASE[1].rejects(m)
    by = cascade(rules, m)
    return measure(docs, text, (key,)).select(key, "_m.*", failed.alias("base_failed"), by.isNull().alias("kept"), by.alias("rejected_by"))

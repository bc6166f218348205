"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Nothing is shuffled and no user function runs; each text is judged where it lies.
Null and empty texts have no words: all counts are 0 and the text fails. Repeated rows are judged alike, each on its
own. Other columns pass through untouched by ``apply_rules``; its own columns replace columns of the same name.
"""
from pyspark.sql import functions as F

from ..operators.common import all_of, col
from .common import SPACES, WORD, ascii_lower, text_of

SYMBOLS = "#*$%&|<>"

# Frequent short words of the corpus languages.
STOP_WORDS = {
    "en": "the be to of and that have with in is it for on as was by this are not from",
    "fr": "le la les de des un une et en est que qui dans pour pas sur avec du au ce",
    "de": "der die das und ist von zu mit den ein eine nicht auf im für dem des sich auch als",
    "es": "el la los las de un una y en es que por con para no se del al su como",
}

# (measure, least allowed, most allowed); None leaves a side open.
RULES = (
    ("n_words", 50, None),
    ("word_length", 2.0, 20.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.005, None),
    ("duplicate_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.3),
)


def count_chars(value, chars):
    """How many characters of ``value`` are among ``chars``."""
    return (F.length(value) - F.length(F.translate(value, chars, ""))).cast("long")


def word_windows(words):
    """All 3-word windows with their positions, sorted, so that equal windows are neighbours."""
    at = lambda i: F.element_at(words, i)
    return F.when(F.size(words) >= 3, F.sort_array(F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.struct(
        at(i).alias("a"), at(i + 1).alias("b"), at(i + 2).alias("c"), i.alias("at")))))


def words_in_repeats(windows):
    """How many word positions lie in a window that equals a neighbour in the sorted array."""
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    repeated = F.filter(windows, lambda x, i: same(x, F.get(windows, i + 1)) | same(x, F.get(windows, i - 1)))
    covered = F.flatten(F.transform(repeated, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    return F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long")


def measures(docs, text="text"):
    """``docs`` with one column per measure. Ratios of texts without words or lines are 0."""
    value = text_of(text)
    # Working columns get names that no column of the table has.
    tail = "_" * max([0, *(len(c) for c in docs.columns)])
    t, words, rows, windows = (f"_{n}{tail}" for n in ("t", "words", "lines", "windows"))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    stop = sorted(set(" ".join(STOP_WORDS.values()).split()))
    first = docs.withColumn(t, value).withColumns({
        words: F.regexp_extract_all(F.col(t), F.lit(f"({WORD})"), 1), rows: lines})
    counts = first.withColumn(windows, word_windows(F.col(words))).withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(t) - count_chars(F.col(t), SPACES)).cast("long"),
        "n_symbols": count_chars(F.col(t), SYMBOLS),
        "n_lines": F.size(rows).cast("long"),
        "n_dup_lines": (F.size(rows) - F.size(F.array_distinct(rows))).cast("long"),
        "n_repeat_words": words_in_repeats(F.col(windows)),
        "n_stop_words": F.size(F.filter(words, lambda w: F.regexp_replace(ascii_lower(w), r"[.,;:!?]+$", "").isin(stop))).cast("long"),
        "n_bullet_lines": F.size(F.filter(rows, lambda x: x.rlike(r"^[ \t]*[-*•]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(rows, lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))).cast("long"),
    })
    return counts.withColumns({
        "word_length": ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_word_ratio": ratio(F.col("n_stop_words"), F.col("n_words")),
        "duplicate_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_ratio": ratio(F.col("n_bullet_lines"), F.col("n_lines")),
        "ellipsis_line_ratio": ratio(F.col("n_ellipsis_lines"), F.col("n_lines")),
    }).drop(t, words, rows, windows)


def compiled(rules=RULES):
    """One boolean expression from the table of thresholds."""
    sides = []
    for measure, least, most in rules:
        sides += [col(measure) >= F.lit(least)] if least is not None else []
        sides += [col(measure) <= F.lit(most)] if most is not None else []
    return all_of(sides)


def apply_rules(docs, text="text", rules=RULES, max_repeat_percent=50, least_words=50):
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measures(docs, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))

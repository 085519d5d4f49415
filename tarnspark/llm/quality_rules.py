"""Quality rules: a threshold table compiled into one projection, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.columns import keeps_names, without

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"#*$%&|<>"

# Common function words of the corpus languages.
STOP_WORDS = (
    "the of and to in that is was for with as on be by at this from or an are "
    "der die das und ist von mit den für ein zu sich nicht im auf "
    "de la le les et des en un une du est que pour dans qui pas par au avec "
    "el los las que del por con una para se su no al es y a"
).split()

#: (rule, part, relation, percent, whole): ``100 * part relation percent * whole`` must hold.
RULES = (
    ("enough_letters", "n_letters", ">=", 60, "word_chars"),
    ("few_symbols", "n_symbols", "<=", 10, "n_words"),
    ("few_shouts", "n_shouts", "<=", 20, "n_words"),
    ("few_capitals", "n_capitals", "<=", 30, "n_letters"),
    ("long_words", "word_chars", ">=", 200, "n_words"),
    ("short_words", "word_chars", "<=", 1500, "n_words"),
    ("stop_words", "n_stop_words", ">=", 2, "n_words"),
    ("few_repeated_lines", "n_dup_lines", "<=", 60, "n_lines"),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compiled(rules: tuple[tuple[str, str, str, int, str], ...], table: dict[str, Column]) -> Column:
    """The conjunction of the table's rules as one expression over whole numbers."""
    verdict = F.lit(True)
    for _, part, relation, percent, whole in rules:
        left, right = table[part] * 100, table[whole] * percent
        verdict = verdict & (left >= right if relation == ">=" else left <= right)
    return verdict


def _repeated_words(words: Column, keyed: Column) -> Column:
    """Words in a three-word window that occurs twice: windows sorted by hash, each compared with its neighbours."""
    same = lambda s, k: F.coalesce(F.get(keyed, k)["h"] == s["h"], F.lit(False))
    hits = F.filter(
        F.transform(keyed, lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s["i"])), lambda p: p.isNotNull()
    )
    covered = F.flatten(F.transform(hits, lambda p: F.array(p, p + 1, p + 2)))
    return F.when(keyed.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))


@keeps_names
def score_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add the base counts, base_failed and kept to every row, and what else the rules count.

    The base counts are n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; the rules also count n_letters,
    n_shouts, n_capitals, n_stop_words and n_lines (those with a word). Columns of all these names are replaced, others stay.

    A null or empty text has no words: every count is 0, base_failed is true and kept is false. Rows are judged
    one by one, so repeated rows get equal verdicts and no shuffle takes place.
    """
    kept_cols = without(docs, *BASE, "base_failed", "kept", "n_letters", "n_shouts", "n_capitals", "n_stop_words", "n_lines")
    plain = [F.col(f"`{c}`") for c in kept_cols.columns]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    split = kept_cols.select(
        *plain,
        F.filter(F.split(body, GAP, -1), lambda w: w != "").alias("__words"),
        lines.alias("__lines"),
        F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).alias("__symbols"),
        F.length(F.regexp_replace(body, r"[^!]+", "")).alias("__shouts"),
        F.length(F.regexp_replace(body, r"[^\p{L}]+", "")).alias("__letters"),
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")).alias("__capitals"),
    )
    words = F.col("__words")
    grams = F.when(
        F.size(words) >= 3,
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        ),
    )
    wide = [F.col(c) for c in ("__symbols", "__shouts", "__letters", "__capitals")]
    split = split.select(
        *plain, *wide, words,
        F.length(F.array_join(words, "")).alias("__chars"),
        F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS, *[s.capitalize() for s in STOP_WORDS]))).alias("__stops"),
        F.size("__lines").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("__dups"),
        grams.alias("__grams"),
    )
    split = split.withColumn(
        "__keyed",
        F.when(
            F.size(F.array_distinct("__grams")) < F.size("__grams"),
            F.array_sort(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    counts = split.select(
        *plain,
        F.size(words).cast("long").alias("n_words"),
        F.col("__chars").cast("long").alias("word_chars"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        F.col("__dups").cast("long").alias("n_dup_lines"),
        _repeated_words(words, F.col("__keyed")).cast("long").alias("n_repeat_words"),
        F.col("__letters").cast("long").alias("n_letters"),
        F.col("__shouts").cast("long").alias("n_shouts"),
        F.col("__capitals").cast("long").alias("n_capitals"),
        F.col("__stops").cast("long").alias("n_stop_words"),
        F.col("__n_lines").cast("long").alias("n_lines"),
        # Not deterministic, so that a filter on the verdict is not pushed below the counts and does not repeat them.
        F.monotonically_increasing_id().alias("__row"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    table = {c: F.col(c) for c in counts.columns}
    kept = ~failed & compiled(rules, table) & (F.col("__row") >= 0)
    return counts.withColumn("base_failed", failed).withColumn("kept", kept).drop("__row")

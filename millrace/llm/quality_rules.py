"""Quality rules: a table of thresholds compiled into one projection, no user function."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from millrace.llm.text import WHITE, utf8_bytes, whole, word_array

SYMBOLS = "#*$%&|<>"

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in is that it for on with as was at by "
    "der die das und ein in den von zu mit "
    "le la les de des et un une du en que "
    "el los las y se por con del no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range it must lie in; an open end is None."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


# Base rules are those a text of too few words or of repetitions fails.
BASE_RULES = (
    Rule("too_short", "n_words", least=50),
    Rule("repetitive", "100 * n_repeat_words - 50 * n_words", most=0),
)

RULES = (
    Rule("word_length", "word_chars / greatest(n_words, 1)", least=2.0, most=14.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", most=0.1),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", most=0.5),
    Rule("bullet_lines", "n_bullet_lines / greatest(n_lines, 1)", most=0.9),
    Rule("open_lines", "n_open_lines / greatest(n_lines, 1)", most=0.3),
)


def broken(rule):
    """True where the rule's measure is outside its range; never null."""
    measure = F.expr(rule.measure)
    low = F.lit(False) if rule.least is None else measure < rule.least
    high = F.lit(False) if rule.most is None else measure > rule.most
    return F.coalesce(low | high, F.lit(False))


def _length_without(text, characters):
    return F.length(F.translate(text, characters, ""))


def _repeat_keys(words):
    """A 64-bit key of every window of three consecutive words, in order."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    triples = F.arrays_zip(
        F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"),
        F.slice(words, 3, n).alias("c"),
    )
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(triples, lambda t: F.xxhash64(t["a"], t["b"], t["c"]))
    )


def _shifted(array, missing):
    """Each element's successor; the last one's is ``missing``."""
    return F.concat(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), F.array(missing))


def measured(docs):
    """doc_id and the measures the rules speak of, one row per input row.

    Null texts count as empty; an empty text has zero of everything.  Rows are
    judged alone, so repeated rows and ids give repeated results; columns other
    than doc_id and text are ignored.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    split = docs.select("doc_id", whole(text).alias("text")).select(
        "doc_id", "text", word_array(text).alias("words"), lines.alias("lines")
    )
    keyed = split.select("*", _repeat_keys(F.col("words")).alias("keys"))
    # Only texts with a repeated window pay for sorting their windows.
    keys = F.col("keys")
    ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    sorted_keys = keyed.withColumn(
        "ordered", F.when(F.size(F.array_distinct(keys)) < F.size(keys), ordered)
    ).drop("keys")
    order = F.col("ordered")
    none = F.lit(None).cast("struct<k:bigint,i:int>")
    # A window is marked by its successor's key and marks its successor: each pair of
    # neighbours with one key gives both positions.
    pairs = F.filter(
        F.zip_with(order, _shifted(order, none), lambda a, b: F.struct(
            a["i"].alias("a"), b["i"].alias("b"), (a["k"] == b["k"]).alias("same"))),
        lambda p: p["same"],
    )
    marked = sorted_keys.withColumn("pairs", pairs).drop("ordered")
    pair = F.col("pairs")
    starts = F.array_sort(F.array_distinct(F.concat(
        F.transform(pair, lambda p: p["a"]), F.transform(pair, lambda p: p["b"]))))
    placed = marked.withColumn("starts", starts).drop("pairs")
    start = F.col("starts")
    covered = F.aggregate(
        F.zip_with(start, _shifted(start, F.lit(None).cast("int")),
                   lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0).cast("bigint"), lambda total, x: total + x,
    )
    words, lines = F.col("words"), F.col("lines")
    return placed.select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_words"),
        _length_without(text, WHITE).cast("bigint").alias("word_chars"),
        (F.length(text) - _length_without(text, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        utf8_bytes(text).alias("n_bytes"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint")
        .alias("n_stop_words"),
        F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(WHITE)).rlike(r"^[-*•]")))
        .cast("bigint").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))
        .cast("bigint").alias("n_open_lines"),
    )


def judged(docs, rules=RULES, base=BASE_RULES):
    """The measures with base_failed, the names of the broken rules, and kept."""
    names = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in (*base, *rules)]))
    failed = F.lit(False)
    for rule in base:
        failed = failed | broken(rule)
    return measured(docs).select(
        "*", failed.alias("base_failed"), names.alias("broken_rules"),
    ).select("*", (F.size("broken_rules") == 0).alias("kept"))

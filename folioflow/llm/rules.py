"""Quality rules: every rule is evaluated once, its verdict is a bit of a ledger, and policies are masks over that ledger.

Native: column expressions only. Nothing is shuffled to build the ledger; each document is judged alone.

Defined cases: a null text counts as an empty one; an empty text has no words and fails the rule on length; ties and repeated
rows are judged row by row; other columns pass through untouched only where `keep` names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` holds. `bit` is fixed for good: old ledgers stay readable."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic on the measurements, so that every engine agrees.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule(3, "long_words", "word_chars > 15 * n_words"),
    Rule(4, "symbols", "10 * n_symbols > n_words"),
    Rule(5, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(6, "shouting", "n_words > 0 AND 3 * n_bangs > n_words"),
)

#: Versioned policies: a document is kept where none of these bits is set.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "shouting"),
}


def mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[n] for n in names)


def _repeat_words(words: str) -> list[tuple[str, Column]]:
    """Steps that count the words in 3-word windows found twice or more.

    A window is packed into one long: hash bits above, its place below, so that a sort of plain longs brings equal windows
    together. Neighbours of equal hash are compared word by word; on a true collision the document is counted by its strings.
    """
    n = F.size(words)
    w = lambda i: F.get(F.col(words), i)
    same = lambda i, j: (w(i) == w(j)) & (w(i + 1) == w(j + 1)) & (w(i + 2) == w(j + 2))
    high = lambda j: F.call_function("shiftright", F.get("_sorted", j), F.col("_low"))
    place = lambda j: F.get("_sorted", j).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_low")) - 1).cast("int")
    packed = lambda i: F.call_function("shiftleft", F.xxhash64(w(i), w(i + 1), w(i + 2)), F.col("_low")).bitwiseOR(i.cast("long"))
    none = F.array().cast("array<int>")
    by_text = F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", w(i), w(i + 1), w(i + 2)).alias("t"), i.alias("i"))))
    pairs = lambda js, at: F.array_distinct(F.flatten(F.transform(js, lambda j: F.array(at(j), at(j - 1)))))
    steps = F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1)))
    return [
        ("_low", F.length(F.bin(n.cast("long")))),
        ("_packed", F.when(n > 3, F.transform(F.sequence(F.lit(0), n - 3), packed)).otherwise(F.array().cast("array<bigint>"))),
        ("_sorted", F.sort_array("_packed")),
        ("_again", F.when(n > 3, F.filter(steps, lambda j: high(j) == high(j - 1))).otherwise(none)),
        ("_clash", F.exists("_again", lambda j: ~same(place(j), place(j - 1)))),
        ("_text", F.when(F.col("_clash"), by_text)),
        (
            "_places",
            F.when(F.size("_again") == 0, none)
            .when(F.col("_clash"), pairs(F.filter(steps, lambda j: F.get("_text", j)["t"] == F.get("_text", j - 1)["t"]), lambda j: F.get("_text", j)["i"]))
            .otherwise(pairs(F.col("_again"), place)),
        ),
        ("_marked", F.sort_array("_places")),
        (
            "n_repeat_words",
            F.when(F.size("_marked") == 0, F.lit(0).cast("long")).otherwise(
                F.aggregate(F.sequence(F.lit(0), F.size("_marked") - 1), F.lit(0).cast("long"), lambda a, j: a + F.when(j == 0, 3).otherwise(F.least(F.lit(3), F.get("_marked", j) - F.get("_marked", F.greatest(j - 1, F.lit(0))))))
            ),
        ),
    ]


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_bangs, n_repeat_words (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(F.col("_t"), F.lit(BLANKS))
    out = df.select(*keep, t.alias("_t"))
    out = out.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+")))
    out = out.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    long = lambda c: c.cast("long")
    out = out.select(
        *keep,
        "_words",
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.translate("_t", BLANKS, ""))).alias("word_chars"),
        long(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).alias("n_symbols"),
        long(F.length("_t") - F.length(F.translate("_t", "!", ""))).alias("n_bangs"),
        long(F.size("_lines")).alias("n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
    )
    for name, step in _repeat_words("_words"):
        out = out.withColumn(name, step)
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")


def ledger(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """measure() and fail_bits: bit r.bit is set where rule r fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(df, text, keep).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with base_failed and kept; no text is read again."""
    hit = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p, rules)).cast("long")) != 0
    return entries.withColumns({"base_failed": hit("base"), "kept": ~hit("base") & ~hit(policy)})


def ablations(entries: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that would be kept without it; also how many rules co-fail.

    The ledger shrinks to one row for each pattern of bits before anything else, so the work after it does not grow with the corpus.
    """
    full = mask(policy, rules)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(full).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    one = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in names]))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    b, bit = F.col("bits"), F.col("r.bit")
    rest = b.bitwiseAND(F.bitwise_not(bit))
    return (
        patterns.select("bits", "n", one.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            n(b.bitwiseAND(bit) != 0).alias("failed"),
            n((b.bitwiseAND(bit) != 0) & (rest == 0)).alias("only_this"),
            n(b == 0).alias("kept"),
            n(rest == 0).alias("kept_without"),
            F.bit_or(F.when(b.bitwiseAND(bit) != 0, rest)).alias("seen_with_bits"),
        )
    )

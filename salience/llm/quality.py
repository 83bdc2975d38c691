"""A ledger of quality rules: measurements and failure bits first, policies later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salience.llm.words import spare

SPACE = "[\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """A named condition, in SQL over the measurements, that a bad text meets."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "stutter", "10 * n_stutter > 3 * n_words"),
    Rule(4, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(5, "short_words", "2 * word_chars < 5 * n_words"),
    Rule(6, "long_words", "word_chars > 15 * n_words"),
)
#: Policies by version: the rules whose failure rejects a text.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "stutter"),
    "strict": tuple(r.name for r in RULES),
}
BASE = POLICIES["base"]


def mask_of(names: tuple[str, ...]) -> int:
    """The bitmask of the named rules."""
    return sum(1 << r.bit for r in RULES if r.name in names)


def _repeat_words(grams: str) -> Column:
    """Words covered by windows of five words that occur twice or more.

    Texts whose windows all differ are told apart by one distinct count.  In
    the others equal windows become neighbours by sorting (window, position),
    and the covered words are summed over the sorted positions.
    """
    pairs = f"sort_array(transform({grams}, (g, i) -> struct(g AS g, i AS i)))"
    places = F.expr(
        f"""aggregate(array({pairs}), array(0), (none, s) ->
            sort_array(transform(filter(s, (x, i) ->
                (i > 0 AND s[greatest(i - 1, 0)].g = x.g)
                OR (i + 1 < size(s) AND s[least(i + 1, size(s) - 1)].g = x.g)), x -> x.i)))"""
    )
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).cast("int").alias("last")),
        lambda a, p: F.struct(
            (a.n + F.least(F.lit(5), p - a.last)).alias("n"), p.alias("last")
        ),
        lambda a: a.n,
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(covered)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its measurements and ``failed``, a bit for each failed rule.

    Adds n_words, word_chars (code points in words), n_symbols, n_lines (lines
    with a word), n_dup_lines, n_repeat_words, n_stutter (words equal to the one
    before) and ``failed``.  A null text is an empty one: it has no words and
    fails ``few_words``.  Columns of the input with these names are replaced;
    all others, repeated rows included, are kept.  No step shuffles.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_stutter", "failed"]
    kept = [c for c in docs.columns if c.lower() not in made]
    words, lines, codes, grams, told = spare([*kept, *made], "words", "lines", "codes", "grams", "entry")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.array_remove(F.split(content, f"{SPACE}+"), "").alias(words),
        F.filter(F.split(content, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias(lines),
        (F.char_length(content) - F.char_length(
            F.regexp_replace(content, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    coded = split.select(
        *[F.col(f"`{c}`") for c in kept], "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias(codes),
    )
    windowed = coded.withColumns({
        grams: F.expr(
            f"""CASE WHEN n_words < 5 THEN array() ELSE
               transform(slice({codes}, 1, size({codes}) - 4), (c, i) ->
                   xxhash64(c, {codes}[i + 1], {codes}[i + 2], {codes}[i + 3], {codes}[i + 4])) END"""
        ),
        "n_stutter": F.expr(
            f"""cast(size(filter({codes}, (c, i) -> i > 0 AND c = {codes}[greatest(i - 1, 0)]))
               AS long)"""
        ),
    }).drop(codes)
    measured = windowed.withColumn("n_repeat_words", _repeat_words(grams)).drop(grams)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    # Exploding an array of one keeps a later filter on the bits from being pushed
    # down, which would copy the measurements into it again and again.
    entry = F.struct(*made[:-1], failed.alias("failed"))
    return measured.select(
        *[F.col(f"`{c}`") for c in kept], F.explode(F.array(entry)).alias(told)
    ).select(*[F.col(f"`{c}`") for c in kept], f"{told}.*")


def verdict(policy: str) -> Column:
    """True for a ledger row that a policy keeps."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it rejects, rows kept without it.

    One aggregate over the stored bits; the rules are not evaluated again.  An
    empty ledger gives zeros.
    """
    mask = mask_of(POLICIES[policy])
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [F.count(F.when(hit == 0, 1)).alias("kept")]
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    for r in rules:
        bit = F.lit(1 << r.bit)
        sums += [
            F.count(F.when(hit.bitwiseAND(bit) != 0, 1)).alias(f"f{r.bit}"),
            F.count(F.when(hit == bit, 1)).alias(f"o{r.bit}"),
        ]
    one = entries.agg(*sums)
    rows = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"),
            F.col(f"o{r.bit}").alias("n_only"),
            (F.col("kept") + F.col(f"o{r.bit}")).alias("n_kept_without"),
        )
        for r in rules
    ])
    return one.select(F.inline(rows))

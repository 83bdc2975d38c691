"""Grouping of spelling variants by neighbourhoods of words in a reduced alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salience.session import cut_lineage, parallelism

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of runs besides A-Z: all code points from U+00C0 to U+00FF.
FIRST, LAST = 0xC0, 0xFF
#: Symbols that letters are hashed to, one digit each.
SYMBOLS = 4
#: Least code points and occurrences of a word.
LENGTH, OCCURRENCES = 6, 5
#: A run loses a code point if this number divides its hash.
THINNED = 199
#: How many times as frequent a form must be.
FACTOR = 5


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n``: the words of at least ``LENGTH`` code points and ``OCCURRENCES`` occurrences.

    Runs of letters with A-Z lower-cased; a run of which ``THINNED`` divides the
    crc32 of ``<doc_id>:<run>`` loses one code point.  Shorter runs cannot become
    words and are not matched.  Counts are combined before the shuffle, so a hot
    word costs one row a task.
    """
    letters = f"[a-z\\u{FIRST:04X}-\\u{LAST:04X}]{{{LENGTH},}}"
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(
            F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(letters), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = hashed.select(F.when(F.col("h") % THINNED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LENGTH).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= OCCURRENCES)


def reduced(word: Column) -> Column:
    """A word with each letter hashed to one of ``SYMBOLS`` digits."""
    letters = LOWER + "".join(chr(c) for c in range(FIRST, LAST + 1))
    digits = "".join(str((ord(c) * 0x9E3779B1 >> 16) % SYMBOLS) for c in letters)
    return F.translate(word, letters, digits)


def _half(size: str) -> str:
    """Code points of the exact half of a word of so many: no edit reaches both halves."""
    return f"int(({size} - 2) div 2)"


def _neighbours() -> Column:
    """All words of the reduced alphabet one edit away from ``code``, with a side no edit touched.

    An edit at or behind the half leaves the front as it is, any other one the
    back; an edit within one symbol leaves the code as it is and may be anywhere.
    """
    digits = ", ".join(f"'{d}'" for d in range(SYMBOLS))
    side = "if(i >= {half}, 'f', 'b')"
    same, less, more = (side.format(half=_half(s)) for s in ("size", "(size - 1)", "(size + 1)"))
    return F.expr(f"""array_distinct(flatten(array(
        array(struct('f' AS side, code AS near), struct('b' AS side, code AS near)),
        transform(sequence(0, size - 1), i -> struct({less} AS side,
            concat(substr(code, 1, i), substr(code, i + 2)) AS near)),
        flatten(transform(sequence(0, size - 1), i -> transform(array({digits}), d -> struct({same} AS side,
            concat(substr(code, 1, i), d, substr(code, i + 2)) AS near)))),
        flatten(transform(sequence(0, size), i -> transform(array({digits}), d -> struct({more} AS side,
            concat(substr(code, 1, i), d, substr(code, i + 1)) AS near)))))))""")


def _key(side: str, word: str, size: str, near: str) -> Column:
    """A key of the side, its exact half for a word of ``size`` code points, and the reduced word."""
    half = _half(size)
    return F.expr(f"xxhash64({side}, if({side} = 'f', left({word}, {half}), right({word}, {half})), {near})")


def near_words(words: DataFrame) -> DataFrame:
    """For each word with near ones: ``n_near`` and ``best``, the near word of largest n.

    Two words are near if one inserted, deleted or replaced code point makes one
    the other.  Then the reduced form of one is in the reduced neighbourhood of
    the other, and a half of both is equal.  Neighbourhoods are joined to the
    reduced vocabulary by that form and the exact half, which splits the words of
    a frequent reduced form, and each match is verified on the original strings.
    A pair with equal fronts counts by its front alone, hence once.
    """
    # A small table of words gives large neighbourhoods: all tasks take part.
    spread = words.repartition(parallelism(words.sparkSession), "word")
    coded = spread.select("word", "n", F.char_length("word").alias("size"), reduced(F.col("word")).alias("code"))
    asked = coded.select("word", "size", F.explode(_neighbours()).alias("e")).select(
        "word", "size", F.col("e.side").alias("side"), F.col("e.near").alias("near")
    ).where(F.char_length("near") >= LENGTH).select(
        "word", _key("side", "word", "length(near)", "near").alias("key"))
    held = coded.select(
        F.col("word").alias("other"), F.col("n").alias("other_n"), "size", "code",
        F.explode(F.array(F.lit("f"), F.lit("b"))).alias("side")
    ).select("other", "other_n", "side", _key("side", "other", "size", "code").alias("key"))
    half = _half("length(other)")
    once = F.expr(f"side = 'f' OR left(word, {half}) <> left(other, {half})")
    met = asked.hint("merge").join(held, "key").where(once & (F.levenshtein("word", "other", 1) == 1))
    return met.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of the chain of forms that starts at each word with a form.

    Pointers double until none moves.  Counts grow by ``FACTOR`` at each step, so
    there are few rounds: at most five for any 64-bit counts.
    """
    now = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = cut_lineage(now.join(after, "root", "left"))
        now = moved.select("word", F.coalesce("beyond", "root").alias("root"))
        if moved.where("beyond IS NOT NULL").isEmpty():
            return now


def variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """The words of all texts with their more frequent spellings.

    Gives word, form (the near word of largest n, the smallest on ties, if it is
    ``FACTOR`` times as frequent; else null), root (the end of the chain of forms;
    the word itself without one), n, n_near and form_n.  Null texts have no
    words; a null id counts as an empty one in the hash; repeated rows count
    each; no rows give no rows; columns besides doc_id and the text are not read.
    """
    words = cut_lineage(vocabulary(docs, text))
    found = words.join(near_words(words), "word", "left")
    chosen = F.when(-F.col("best.less") >= FACTOR * F.col("n"), F.col("best"))
    told = cut_lineage(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), chosen.alias("form")
    ).select("word", "n", "n_near", F.col("form.other").alias("form"),
             (-F.col("form.less")).alias("form_n")))
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

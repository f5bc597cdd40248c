"""Line dedup across documents: a line goes when the same or nearly the same line stands earlier.

Lines are trimmed of spaces, tabs and carriage returns; blank ones stay. Lines of
``min_words`` words or more also match within one word inserted, deleted or
replaced; shorter ones only when equal. A line stays if it is the earliest
(by doc_id, then line number) among its equals and none of its near lines begins
earlier; matches are judged on the input.

Near lines meet in a deletion neighbourhood: every line emits the hash of itself
and of itself without each word. Two lines within one edit share such a variant,
at the same word for a replacement, or one of them whole. To emit variants only
where they can meet, a line must first share a half: of two lines one edit apart,
the first or the last half of the words is the same. Shared keys are reduced to
their earliest line; what a line matched is verified on the words.

DataFrame functions only. Null texts count as empty, a null doc_id comes after all
others, equal rows keep the same lines, columns beyond ``text`` pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import freeze
from .rows import packed, unpacked

LAST = (1 << 63) - 1


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _with_halves(lines: DataFrame, min_words: int) -> DataFrame:
    """Adds ``halves``: keys of the first and last half, for this length and for one word less; null for short lines.

    Each step is a projection of its own, so that a half is cut out once; for an even number of words both lengths have the same.
    """
    own = lines.columns
    counted = lines.withColumn("n", _words(F.col("line")))
    cuts = [F.floor((F.col("n") - less) / 2).cast("int").alias(f"m{less}") for less in (1, 2)]

    def half(side: int, m: Column) -> Column:
        return F.xxhash64(F.lit(side), F.call_function("substring_index", F.col("line"), F.lit(" "), -m if side else m))

    longer = counted.select(*own, "n", *cuts)
    first = longer.select(*own, "n", "m1", "m2", *[F.when(F.col("n") >= min_words, half(s, F.col("m1"))).alias(f"half{s}") for s in (0, 1)])
    less = [F.when(F.col("m2") == F.col("m1"), F.col(f"half{s}")).otherwise(half(s, F.col("m2"))) for s in (0, 1)]
    keys = [F.xxhash64("n", F.col(f"half{s}")) for s in (0, 1)] + [F.xxhash64(F.col("n") - 1, x) for x in less]
    return first.select(*own, F.when(F.col("n") >= min_words, F.array(*keys)).alias("halves"))


def _running_xor(values: Column) -> Column:
    """Inclusive running XOR of an array, in log n passes at doubling distance."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)).cast("double"))).cast("int"))
    return F.aggregate(rounds, values, lambda acc, k: F.transform(acc, lambda x, i: x.bitwiseXOR(
        F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), k).cast("int")), F.lit(0).cast("long")))))


def _located(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"),
                       F.xxhash64(text).alias("txt"), text.alias("text"))


def distinct_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per different line: two hashes, its first place, and the half hashes of those long enough."""
    each = _located(docs).select("doc", "txt", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    each = each.select("doc", "txt", "no", _trim(F.col("raw")).alias("line")).where("line <> ''")
    keyed = _with_halves(each, min_words).select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"),
                                                 F.struct("doc", "no", "txt", "halves").alias("at"))
    return keyed.groupBy("h", "h2").agg(F.min("at").alias("at")).select("h", "h2", "at.*")


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Hashes of the lines that have an earlier near line."""
    halves = lines.where("halves IS NOT NULL").select("h", "doc", "no", "txt", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    maybe = halves.join(shared, "half", "left_semi").select("h", "doc", "no", "txt").distinct()

    wanted = maybe.groupBy("doc", "txt").agg(F.collect_list("no").alias("nos"))  # no more than the lines of a text
    found = _located(docs).join(wanted, ["doc", "txt"]).select("doc", "text", F.explode("nos").alias("no"), "txt")
    found = found.select("doc", "no", _trim(F.get(F.split("text", "\n"), F.col("no"))).alias("line")).distinct()
    words = F.split("line", " ")
    found = freeze(found.select(F.xxhash64("line").alias("h"), F.struct("doc", "no").alias("at"), words.alias("words")))

    # a word's hash at its own place, and at the place before it, where it is when an earlier word is gone
    own = F.transform("words", lambda w, j: F.xxhash64(w, j))
    moved = F.transform("words", lambda w, j: F.xxhash64(w, j - 1))
    sums = found.select("h", "at", F.size("words").alias("n"), _running_xor(own).alias("own"), _running_xor(moved).alias("moved"))
    rest = F.get("moved", F.col("n") - 1)
    without = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.xxhash64(
        F.coalesce(F.get("own", i - 1), F.lit(0).cast("long")).bitwiseXOR(rest.bitwiseXOR(F.get("moved", i))),
        F.col("n") - 1).alias("key")))
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.xxhash64(F.get("own", F.col("n") - 1), F.col("n")).alias("key")))
    variants = freeze(sums.select("h", "at", F.explode(F.concat(without, whole)).alias("v")).select("h", "at", "v.i", "v.key"))

    # the earliest line per (variant, place) and per variant, and the line that is the variant itself
    places = freeze(variants.groupBy("key", "i").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    keys = places.groupBy("key").agg(
        F.min("first").alias("any_first"), F.min(F.when(F.col("i") == -1, F.col("first"))).alias("whole_first"),
        F.sum("n").alias("n")).where("n > 1")
    met = places.join(keys.drop("n"), "key").select(
        "key", "i", F.when(F.col("i") == -1, F.col("any_first")).otherwise(
            F.least("first", F.coalesce("whole_first", F.col("first")))).alias("best"))
    pairs = variants.join(met, ["key", "i"]).where(F.col("best") < F.col("at")).select("h", "at", "best").distinct()

    mine = pairs.join(found.select("h", "at", F.col("words").alias("a")), ["h", "at"])
    both = mine.join(found.select(F.col("at").alias("best"), F.col("words").alias("b")), "best")
    return both.where(within_one_word(F.col("a"), F.col("b"))).select("h").distinct()


def within_one_word(a: Column, b: Column) -> Column:
    """Whether two word lists differ by at most one word inserted, deleted or replaced."""
    longer = F.greatest(F.size(a), F.size(b))
    differ = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), F.lit(True)) - 1,
                                     F.lit(0))
    head = F.when(a == b, longer).otherwise(F.greatest(differ(a, b), F.lit(0)))
    tail = F.when(a == b, longer).otherwise(F.greatest(differ(F.reverse(a), F.reverse(b)), F.lit(0)))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (head + tail >= longer - 1)


def _kept_text(text: Column, keep: Column) -> Column:
    """The blank lines and those numbered in ``keep``, found by sorting numbers and lines together."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("no"), F.lit(1).alias("is_line"), x.alias("line")))
    marks = F.transform(keep, lambda k: F.struct(k.alias("no"), F.lit(0).alias("is_line"), F.lit("").alias("line")))
    merged = F.array(F.array_sort(F.concat(lines, marks)))  # bound once
    chosen = F.get(F.transform(merged, lambda m: F.filter(m, lambda s, i: (s["is_line"] == 1) & (
        (_trim(s["line"]) == "") | ((i > 0) & (F.get(m, i - 1)["is_line"] == 0))))), F.lit(0))
    return F.array_join(F.transform(chosen, lambda s: s["line"]), "\n")


def dedup(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs`` with every later equal or near line taken out of ``text``; a text may become empty.

    Adds ``n_lines``, ``n_removed`` (lines that are not blank) at the end, replacing columns of these names.
    """
    lines = freeze(distinct_lines(docs, min_words))
    near = freeze(near_lines(docs, lines))
    kept = lines.join(near, "h", "left_anti").groupBy("doc", "txt").agg(F.collect_list("no").alias("_keep")).select(
        F.col("doc").alias("of_doc"), F.col("txt").alias("of_txt"), "_keep")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop("n_lines", "n_removed")
    rows = packed(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("txt"), apart=("text",))
    joined = rows.join(kept, (F.col("doc") == F.col("of_doc")) & (F.col("txt") == F.col("of_txt")), "left")
    keep = F.coalesce(F.col("_keep"), F.array().cast("array<int>"))
    full = F.size(F.filter(F.split(text, "\n"), lambda x: _trim(x) != "")).cast("long")
    out = joined.withColumn("n_lines", full).withColumn("n_removed", full - F.size(keep))
    left = F.when(F.col("n_removed") == 0, text).otherwise(_kept_text(text, keep))
    return out.select(*unpacked(docs.columns, {"text": left}), "n_lines", "n_removed")

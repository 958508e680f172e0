"""Lines that repeat earlier ones up to one word, by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegauge.functions.columns import quoted
from framegauge.llm.native import NO_SPACE, let, measured, words_of
from framegauge.session import checkpointed, written

# From FUZZY_WORDS on one edited word is allowed.
FUZZY_WORDS = 10
# Words at either end of which a line within the bound keeps one side: half a line at
# most, so an edited word lies in one end or in neither.  Lengths go up by doubling.
END_WORDS = 5
END_DOUBLINGS = 20


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def _row_key(doc_id: str, text: str) -> list[Column]:
    """What stands for a row: its id and its text.  Rows equal in both are one."""
    return [F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(_text(text)).alias("t1"), F.xxhash64(F.lit(1), _text(text)).alias("t2")]


def _lines(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    """One row per line of enough words: where it stands, hashes of its words, and those
    of its first and of its last ones.  ``at`` orders lines; null ids come last."""
    line = docs.select(*_row_key(doc_id, text), F.posexplode(F.split(_text(text), "\n")).alias("pos", "line"))
    # Asked of the line itself, or its words would be made twice.
    words = line.where(F.col("line").rlike(NO_SPACE)).select("doc", "t1", "t2", "pos", _words(F.col("line")).alias("words"))
    if min_words > 1:
        words = words.where(F.size("words") >= min_words)
    at = F.struct(F.col("doc").isNull().alias("last"), "doc", "t1", "t2", "pos")
    n = F.size("words")
    return words.select(
        at.alias("at"), F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"),
        F.when(n >= FUZZY_WORDS, _ends(F.col("words"), end_words(n))).alias("ends"),
        # A line of one word less may be of a shorter kind.
        F.when((n > FUZZY_WORDS) & (end_words(n) != end_words(n - 1)), _ends(F.col("words"), end_words(n - 1))).alias("shorter"))


def _words(line: Column) -> Column:
    """``words_of`` a line; where there is no space but the common one, by the faster split at a single character."""
    return F.when(line.rlike(r"[\x09\x0B-\x0D]"), words_of(line)).otherwise(F.filter(F.split(line, " "), lambda w: w != ""))


def end_words(n: Column) -> Column:
    """The longest of 5, 10, 20, ... words that is no more than half of ``n``."""
    doublings = F.least(F.floor(F.log2(n / (2 * END_WORDS)) + 1e-9), F.lit(END_DOUBLINGS)).cast("int")
    return F.lit(END_WORDS) * F.pow(F.lit(2), doublings).cast("int")


def _ends(words: Column, size: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(0), size, F.slice(words, 1, size)).alias("head"),
                    F.xxhash64(F.lit(1), size, F.slice(words, -size, size)).alias("tail"))


def _candidates(classes: DataFrame) -> DataFrame:
    """Positions of lines that may be within one word of another one.

    Two such lines share their first words or their last ones, half of a line or
    nearly.  All others need no variants.
    """
    ends = classes.where("ends is not null").select("first", F.explode(
        F.array_compact(F.array(F.col("ends.head"), F.col("ends.tail"), F.col("shorter.head"), F.col("shorter.tail")))).alias("key"))
    shared = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return ends.join(measured(shared, F.lit(8)), "key", "left_semi").select("first").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """(first, key, i): the hash of every line, i = -1, and of the line without its word i.

    The hash of a word sequence is the exclusive or of its words' hashes with their
    places.  Without word i, the words before keep their place and those behind move
    up by one, so running values give all variants in time linear in the line.
    """
    word = lines.select("first", F.posexplode("words").alias("i", "word"))
    here, moved = F.xxhash64("word", "i"), F.xxhash64("word", F.col("i") - 1)
    line = Window.partitionBy("first")
    running = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = word.select("first", "i", here.alias("z"),
                      F.bit_xor(here).over(running).alias("before"), F.bit_xor(moved).over(running).alias("moved"),
                      F.bit_xor(moved).over(line).alias("all_moved"), F.max("i").over(line).alias("end"))
    without = F.col("before").bitwiseXOR(F.col("z")).bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("moved"))
    both = F.array(F.struct(without.alias("key"), F.col("i").alias("i")),
                   F.when(F.col("i") == F.col("end"), F.struct(F.col("before").alias("key"), F.lit(-1).alias("i"))))
    return row.select("first", F.explode(both).alias("v")).where("v is not null").select("first", "v.*")


def within_one_word(a: Column, b: Column) -> Column:
    """Word edit distance of at most one: behind the first difference all is equal."""
    def same(long: Column, short: Column) -> Column:
        def rest(p: Column) -> Column:
            behind = F.slice(long, p + 1, F.size(long))
            return F.when(p == 0, F.lit(True)).when(
                F.size(long) == F.size(short), behind == F.slice(short, p + 1, F.size(short))).otherwise(
                behind == F.slice(short, p, F.size(short)))
        return let(F.array_position(F.zip_with(long, short, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int"), rest)

    return F.when(F.abs(F.size(a) - F.size(b)) > 1, F.lit(False)).when(F.size(a) >= F.size(b), same(a, b)).otherwise(same(b, a))


def _near(lines: DataFrame) -> DataFrame:
    """Lines with an earlier one exactly one word away: (first).

    Lines that are equal without their word i differ in that word only, whichever two
    of them one takes: each but the earliest has the earliest as its partner, and no
    pairs are made.  A line that equals another one without a word is its partner.
    """
    every = written(_variants(lines), "variants")
    # Most variants are met by no other one: bare hashes find out, before any line moves.
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    variants = checkpointed(every.join(measured(shared, F.lit(8)), "key", "left_semi"))
    deleted, whole = variants.where("i >= 0"), variants.where("i < 0")
    same_place = deleted.groupBy("key", "i").agg(F.min("first").alias("partner"))
    replaced = deleted.join(checkpointed(same_place), ["key", "i"]).where("partner < first").select("first", "partner")
    inserted = deleted.alias("d").join(whole.alias("w"), F.col("d.key") == F.col("w.key")).select(
        F.greatest("d.first", "w.first").alias("first"), F.least("d.first", "w.first").alias("partner"))
    partners = replaced.union(inserted).groupBy("first").agg(F.min("partner").alias("partner"))
    # Hashes may collide: the words decide.
    checked = partners.join(lines.select("first", F.col("words").alias("a")), "first").join(
        lines.select(F.col("first").alias("partner"), F.col("words").alias("b")), "partner")
    return checked.where(within_one_word(F.col("a"), F.col("b"))).select("first")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """(doc, t1, t2, dropped): for every row that loses lines, their positions.

    (t1, t2) is a 128-bit hash of the row's text."""
    lines = written(_lines(docs, doc_id, text, min_words), "lines")
    classes = written(lines.groupBy("h1", "h2").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("ends").alias("ends"),
        F.min("shorter").alias("shorter")), "classes")
    wanted = _candidates(classes).groupBy("first.doc", "first.t1", "first.t2").agg(F.collect_list("first").alias("firsts"))
    wanted = measured(wanted, F.size("firsts") * 64)
    found = docs.select(*_row_key(doc_id, text), _text(text).alias("text")).join(
        wanted.withColumnsRenamed({"doc": "w", "t1": "w1", "t2": "w2"}),
        F.col("doc").eqNullSafe(F.col("w")) & (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")))
    chosen = found.select(F.split("text", "\n").alias("lines"), "firsts").select(
        F.inline(let(F.col("lines"), lambda all_: F.transform("firsts", lambda f: F.struct(
            f.alias("first"), F.get(all_, f["pos"]).alias("line"))))))
    # Repeated rows give a line several times.
    words = checkpointed(chosen.groupBy("first").agg(F.any_value("line").alias("line")).select(
        "first", _words(F.col("line")).alias("words")))
    near = _near(words).select("first", F.lit(True).alias("near"))
    verdicts = classes.join(near, "first", "left").where("copies > 1 or near").select(
        "h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("h1", "h2", "at").join(measured(verdicts, F.lit(96)), ["h1", "h2"]).where("near or at > first")
    return gone.groupBy("at.doc", "at.t1", "at.t2").agg(F.array_sort(F.collect_set("at.pos")).alias("dropped"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, and n_lines, n_dropped (long).

    Lines are compared as sequences of words.  A line goes if an equal one stands earlier,
    by id and then by position; from FUZZY_WORDS words on also if an earlier line, kept
    or not, is one replaced, inserted or deleted word away.  The earliest of equal lines
    stays unless it has such an earlier neighbour.

    Every line that has a word is compared, also headings, menus and text without
    spaces; with ``min_words``, shorter lines stay.  Lines without words always stay.
    A null text stays null (no lines), a text whose lines all go becomes empty.  Null ids come after all others.  Rows equal in id and text
    keep the same lines, so a repeated row is not emptied by its copy; rows of one id
    with different texts are ordered by a hash.  Columns called n_lines or n_dropped
    are replaced.

    Built-in expressions only.  Lines travel as hashes; texts move once, where the
    positions to drop are joined back.
    """
    gone = checkpointed(dropped_lines(docs, doc_id, text, min_words)).withColumnsRenamed({"doc": "d", "t1": "h1", "t2": "h2"})
    # Columns are known by position, so that none can clash with those made here.
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    source = docs.select(*_row_key(doc_id, text), *[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)])
    joined = source.join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")), "left")
    at = f"c{kept.index(text)}"
    all_lines = F.split(_text(at), "\n")

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    shortened = F.when(F.col("dropped").isNull(), F.col(at)).otherwise(let(all_lines, rest))
    lines = F.when(F.col(at).isNull(), F.lit(0)).otherwise(F.size(all_lines))
    return joined.select(*[(shortened if f"c{i}" == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(kept)],
                         lines.cast("bigint").alias("n_lines"), F.greatest(F.coalesce(F.size("dropped"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_dropped"))

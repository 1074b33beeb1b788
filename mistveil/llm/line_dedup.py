"""Line deduplication: an exact set-similarity self-join of lines, in DataFrame functions only.

Tokens of a line are ordered by rarity over the whole corpus. Lines that reach the similarity share a token among the first
few (prefix filter); of a pair's lines, what follows the first shared token must still be long enough (positional filter, which
bounds the lengths too), and a parity sketch must not show too many differing tokens, before token sets are compared.

Only the earliest match of a line is asked for. So lines are first compared with one early line for each of two token hashes;
those that match look through the lists of their prefix tokens only for lines before that one. A group of near copies
therefore makes about as many candidate pairs as it has lines, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .shared import Scratch, fresh, shuffles_freed, small

#: Jaccard similarity of token sets, as a fraction, from which lines match.
SIMILARITY = (4, 5)
#: Cells of the rarity table: tokens share a cell by hash, and the cell's count (in 3 steps for each doubling) orders them. Any
#: order of the tokens gives the same matches, so the table's size is fixed, one byte for each cell.
RARITY_CELLS = 1 << 20
_HASH_BITS, _SINGLE = 56, 1
#: Classes of copies, or lists, with at least this part of all rows are joined by broadcast (there are this many at most).
HOT_PARTS = 10_000
_NULL_ID = -(1 << 63)
#: Tokens from which a line's sketch has a second half.
_MANY = 64


def _lines(text: Column) -> Column:
    """Lines of a text, lower-cased, with a blank for each other ASCII white space."""
    text = F.lower(text)
    for space in "\t\x0b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    """Words of a line of `_lines`: runs without white space."""
    return F.array_remove(F.split(line, " "), "")


def _hashed(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """doc, at, k1, k2, hashes of every line with a word: its set of words as sorted hashes (64 bits stand for a word), and two hashes of that set.

    All that follows works on these, so texts are split and words hashed once.
    """
    lines = rows.select("doc", "copy", F.posexplode(_lines(F.col("text"))).alias("line_no", "line"))
    hashes = F.array_distinct(F.transform(F.split("line", " "), lambda x: F.xxhash64(x)))
    hashes = F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))  # what stands between two blanks
    lines = lines.where("trim(LEADING ' ' FROM line) <> ''").select("doc", _place("copy", "line_no").alias("at"), hashes.alias("hashes"))
    return scratch.cut(lines.select("doc", "at", F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(1), "hashes").alias("k2"), "hashes"), "line-hashes", dictionary=False)


def _rarity(scratch: Scratch, lines: DataFrame) -> Column:
    """The rarity table of all words of all `lines` (of `_hashed`), an array of RARITY_CELLS numbers: 0 for an empty cell, _SINGLE for one word of one line, or more.

    It is built natively, in two steps, written, and read as a scalar subquery.
    """
    spark, step = lines.sparkSession, 2048
    counts = lines.select(F.explode("hashes").alias("h")).groupBy(_cell(F.col("h")).alias("cell")).agg(F.count("*").alias("n"))
    value = F.least(F.lit(127), F.ceil(3 * F.log2(F.col("n"))) + _SINGLE)
    every = spark.range(RARITY_CELLS).select(F.col("id").cast("int").alias("cell"), F.lit(0).cast("byte").alias("value"))
    cells = counts.select("cell", value.cast("byte").alias("value")).unionByName(every).groupBy("cell").agg(F.max("value").alias("value"))
    ordered = lambda *columns: F.transform(F.sort_array(F.collect_list(F.struct(*columns))), lambda x: x[columns[1]])
    blocks = cells.groupBy(F.floor(F.col("cell") / step).alias("block")).agg(ordered("cell", "value").alias("values"))
    return scratch.cut(blocks.agg(F.flatten(ordered("block", "values")).alias("cells")), "rarity").scalar()


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(RARITY_CELLS - 1)).cast("int")


def _least_overlap(n: Column, num: int, den: int) -> Column:
    return F.ceil(n * num / F.lit(float(den)) - F.lit(1e-9)).cast("int")


def _numbered(scratch: Scratch, docs: DataFrame, doc: str, copy: str) -> DataFrame:
    """docs with `doc` (doc_id as long, nulls as the smallest) and `copy`: 0, or the row's number among those of a repeated doc_id, by text.

    Rows of equal doc_id and text may change places between two uses, which changes no line. Rows that share a doc_id are numbered in
    one task for each doc_id.
    """
    out = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)))
    again = scratch.cut(out.groupBy(doc).count().where("count > 1").select(F.col(doc).alias("__again")), "repeated-ids")
    if not (n := again.count()):
        return out.withColumn(copy, F.lit(0).cast("long"))
    again = small(scratch.keep(again), n)  # the result reads it
    same = F.col(doc) == F.col("__again")
    order = Window.partitionBy(doc).orderBy(F.col("text").cast("string"))
    repeated = out.join(again, same, "left_semi").withColumn(copy, (F.row_number().over(order) - 1).cast("long"))
    return out.join(again, same, "left_anti").withColumn(copy, F.lit(0).cast("long")).unionByName(repeated)


def _join_copies(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """left joined with right (unique keys, and `copies`: how many rows of left have the key).

    Where right isn't small, keys with more than a HOT_PARTS-th of all rows are joined by broadcast, so no task gets all their rows.
    """
    if right.count() <= shared.SMALL_ROWS:
        return left.join(F.broadcast(right), keys)
    hot = F.broadcast(right.where(F.col("copies") * HOT_PARTS >= rows))
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(right, keys))


def _odd(n: Column, m: Column, sketch: Column, other: Column, half: Column, other_half: Column) -> Column:
    """A bound from below for the tokens that only one of two lines has: cells in which their parities differ.

    A sketch has 64 cells for all tokens; lines of more than _MANY also have that of half of them (which leaves the other half's,
    so two such lines compare 128 cells).
    """
    all_, own = sketch.bitwiseXOR(other), half.bitwiseXOR(other_half)
    return F.when((n > _MANY) & (m > _MANY), F.bit_count(own) + F.bit_count(all_.bitwiseXOR(own))).otherwise(F.bit_count(all_))


_LINE, _FIRST = ["doc", "at"], ["first_doc", "first_at"]


def _verified(scratch: Scratch, pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """doc, at, first_doc, first_at: the earliest of each line's partners in `pairs` whose token set is as similar as asked.

    The lines are read from the texts again, only those that are in a pair.
    """
    ends = scratch.cut(pairs.select(*_LINE).unionByName(pairs.select(*[F.col(f).alias(c) for f, c in zip(_FIRST, _LINE, strict=True)])).distinct(), "line-ends")
    wanted = ends.groupBy("doc", F.shiftrightunsigned("at", 32).alias("copy")).agg(F.collect_list(F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("wanted"))
    texts = rows.join(small(wanted, ends.count()), ["doc", "copy"]).select("doc", "copy", "wanted", _lines(F.col("text")).alias("lines"))
    texts = texts.select("doc", "copy", F.explode(F.transform("wanted", lambda k: F.struct(k.alias("line_no"), F.get(F.col("lines"), k).alias("line")))).alias("x")).select("doc", "copy", "x.*")
    hashes = F.array_distinct(F.transform(_words(F.col("line")), lambda x: F.xxhash64(x)))  # 64 bits stand for a word
    words = scratch.cut(texts.select("doc", _place("copy", "line_no").alias("at"), hashes.alias("words")), "line-words")
    first = words.select(F.col("doc").alias("first_doc"), F.col("at").alias("first_at"), F.col("words").alias("first_words"))
    common = F.size(F.array_intersect("words", "first_words"))
    found = pairs.join(words, _LINE).join(first, _FIRST).where(common * (num + den) >= (F.size("words") + F.size("first_words")) * num)
    out = scratch.cut(found.groupBy(*_LINE).agg(F.min(F.struct(*_FIRST)).alias("f")).select(*_LINE, "f.first_doc", "f.first_at"), "similar-lines")
    scratch.drop(words, ends)
    return out


def _place(copy: str, line_no: str) -> Column:
    return F.shiftleft(F.col(copy), 32).bitwiseOR(F.col(line_no).cast("long"))


def _coded(lines: DataFrame, rarity: Column, num: int, den: int) -> DataFrame:
    """What is compared of `lines` (doc, at, hashes): doc, at, n, skipped, sketch, half, lo, hi, prefix. skipped >= 0: those that may be similar to another; the rest is null elsewhere.

    Plain projections, without a generator between them: Spark compiles what is no higher-order function only there.
    """

    def code(h: Column) -> Column:
        """The cell's value, then 56 bits of the token's hash. By its type it is never null, so Spark sorts codes as plain numbers."""
        return F.coalesce(F.shiftleft(F.get(F.col("cells"), h.bitwiseAND(F.lit(RARITY_CELLS - 1))).cast("long"), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS)), F.lit(0).cast("long"))

    coded = lines.select(*_LINE, "hashes", rarity.alias("cells")).select(*_LINE, F.sort_array(F.transform("hashes", code)).alias("codes"))
    n = F.size("codes")
    # words of one line only come first, and aren't shared; where there are more of them than may differ, and for the shortest lines, only the same set matches
    prefix = F.when(n * (den - num) >= num, F.slice("codes", F.lit(1), n - _least_overlap(n, num, den) + 1))
    single = F.array_position(F.transform("prefix", lambda x: x >= F.lit((_SINGLE + 1) << _HASH_BITS)), True)
    rarer = F.slice("codes", F.lit(1), F.shiftright(n + 1, 1))
    coded = coded.select(*_LINE, "codes", prefix.alias("prefix"), rarer.alias("rarer")).select(*_LINE, "codes", "prefix", "rarer", (single - 1).cast("int").alias("skipped"))
    met = lambda c: F.when(F.col("skipped") >= 0, c)
    rare = F.transform("rarer", lambda x: x.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))
    parity = lambda codes: F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))
    half = F.when(n > _MANY, parity(F.filter("codes", lambda x: x.bitwiseAND(F.lit(64)) == 0))).otherwise(F.lit(0).cast("long"))
    shared_prefix = F.slice("prefix", F.col("skipped") + 1, F.size("prefix"))
    out = coded.select(*_LINE, n.alias("n"), "skipped", met(parity("codes")).alias("sketch"), met(half).alias("half"), met(rare).alias("rare"), met(shared_prefix).alias("prefix"))
    return out.select(*_LINE, "n", "skipped", "sketch", "half", F.array_min("rare").alias("lo"), F.array_max("rare").alias("hi"), "prefix")


def _matches(scratch: Scratch, rows: DataFrame, num: int, den: int) -> DataFrame:
    """doc, at, kind, first_doc, first_at of the lines that match an earlier one; rows: doc, copy, text."""
    rows = rows.where("text is not null")
    hashed = _hashed(scratch, rows)
    total = hashed.count()

    # lines with the same token set: all but the first of each set are repeats
    sets = ["k1", "k2"]
    copied = scratch.cut(hashed.groupBy(*sets).agg(F.count("*").alias("copies"), F.min("doc").alias("first_doc")).where("copies > 1"), "copied-sets")
    members = scratch.cut(_join_copies(hashed.select(*sets, "doc", "at"), copied, sets, total), "copied-lines")
    first = scratch.cut(members.where("doc = first_doc").groupBy(*sets).agg(F.min("at").alias("first_at"), F.min("copies").alias("copies")), "first-lines")
    repeats = _join_copies(members.drop("copies"), first, sets, total).where("doc <> first_doc or at <> first_at")
    repeats = scratch.cut(repeats.select(*_LINE, F.lit("repeat").alias("kind"), *_FIRST), "line-repeats")
    scratch.drop(copied, members, first)

    # only the first line of each set is counted and coded
    firsts = hashed.select(*_LINE, "hashes")
    n_repeats = repeats.count()
    if n_repeats:
        firsts = firsts.join(small(repeats.select(*_LINE), n_repeats), _LINE, "left_anti")
    if n_repeats > shared.SMALL_ROWS:
        firsts = scratch.cut(firsts, "first-lines")
        scratch.drop(hashed)
    lines = scratch.cut(_coded(firsts, _rarity(scratch, firsts), num, den), "lines")
    kept = lines.where("skipped >= 0")
    scratch.drop(hashed, firsts)

    # one early line for each of two token hashes
    keyed = kept.select("doc", "at", "n", "sketch", "half", F.explode(F.array("lo", "hi")).alias("key"))
    heads = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc").alias("first_doc"), *[F.min_by(c, "doc").alias(f"first_{c}") for c in ("at", "n", "sketch", "half")]).where("copies > 1")
    heads = scratch.cut(heads, "line-heads")
    earlier = (F.col("first_doc") < F.col("doc")) | ((F.col("first_doc") == F.col("doc")) & (F.col("first_at") < F.col("at")))
    lengths = (F.least("n", "first_n") * den >= F.greatest("n", "first_n") * num)
    few = _odd(*[F.col(f"{side}{c}") for c in ("n", "sketch", "half") for side in ("", "first_")]) * (num + den) <= (F.col("n") + F.col("first_n")) * (den - num)
    tried = scratch.cut(_join_copies(keyed, heads, ["key"], 2 * total).where(earlier & lengths & few).select(*_LINE, *_FIRST).distinct(), "early-pairs")
    early = _verified(scratch, tried, rows, num, den)
    scratch.drop(heads, tried)

    # what is left: earlier matches through the lists of prefix tokens, only those before the match that a line has already.
    # A posting: the token, the line, its count and place in it, the sketch, and the line up to which matches are looked for
    until = early.select(*_LINE, F.col("first_doc").alias("until_doc"), F.col("first_at").alias("until_at"))
    left = kept.join(small(until, early.count()), _LINE, "left").select("doc", "at", "n", "skipped", "sketch", "half", "prefix", *[F.coalesce(f"until_{c}", c).alias(f"until_{c}") for c in _LINE])
    place = F.shiftleft(F.col("n").cast("long"), 31).bitwiseOR((F.col("i") + F.col("skipped")).cast("long"))
    postings = left.select("doc", "at", "n", "skipped", "sketch", "half", "until_doc", "until_at", F.posexplode("prefix").alias("i", "token")).select("token", "doc", "at", "until_doc", "until_at", place.alias("place"), "sketch", "half")
    x, y = postings.alias("x"), postings.alias("y")
    n_of = lambda side: F.shiftrightunsigned(F.col(f"{side}.place"), 31)
    after = lambda side: n_of(side) - F.col(f"{side}.place").bitwiseAND(F.lit((1 << 31) - 1))  # noqa: E731  the shared token and those behind it
    both = n_of("x") + n_of("y")
    match = (
        (F.col("x.token") == F.col("y.token"))
        & ((F.col("y.doc") < F.col("x.until_doc")) | ((F.col("y.doc") == F.col("x.until_doc")) & (F.col("y.at") < F.col("x.until_at"))))
        & (F.least("x.at", "y.until_at") + F.least("x.place", "y.until_doc") >= F.lit(_NULL_ID))  # always so; both sides read the same columns, so they are one exchange
        & (F.least(after("x"), after("y")) * (num + den) >= both * num)
        & (_odd(n_of("x"), n_of("y"), *[F.col(f"{side}.{c}") for c in ("sketch", "half") for side in "xy"]) * (num + den) <= both * (den - num))
    )
    pairs = scratch.cut(x.join(y, match).select("x.doc", "x.at", F.col("y.doc").alias("first_doc"), F.col("y.at").alias("first_at")).distinct(), "line-pairs")
    scratch.drop(lines)
    late = _verified(scratch, pairs, rows, num, den)
    similar = early.unionByName(late).groupBy(*_LINE).agg(F.min(F.struct(*_FIRST)).alias("f")).select(*_LINE, F.lit("similar").alias("kind"), "f.first_doc", "f.first_at")
    return repeats.unionByName(similar)


def repeated_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, line_no, kind, first_doc_id, first_line_no: the lines that match an earlier one, and an earlier one they match.

    Lines (split at newlines, counted from 0) are ordered by doc_id and line_no. Two match if the Jaccard similarity of their
    sets of lower-cased words is at least `similarity`; kind: `repeat` if some earlier line has the same set (the first line
    of the set is named), else `similar` (the earliest line that matches is). A line goes if any earlier line matches, whether or not that one goes too. Lines
    without a word never match; null texts have no lines; rows that repeat a doc_id are taken as one after another, by text
    (equal line numbers: the one that comes first stays where both are alike); a null doc_id counts as the smallest; an empty
    table gives no rows; other columns are ignored.
    """
    num, den = similarity
    with Scratch(docs.sparkSession) as scratch:
        rows = _numbered(scratch, docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc", "copy")
        found = scratch.keep(scratch.cut(_matches(scratch, rows, num, den), "matching-lines"))
    number = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    known = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return found.select(known("doc").alias("doc_id"), number("at").alias("line_no"), "kind", known("first_doc").alias("first_doc_id"), number("first_at").alias("first_line_no"))


def remove_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with the lines of `repeated_lines` taken out of `text`; all columns and rows stay.

    A text whose lines all go becomes empty; null texts stay null. Rows that share a doc_id lose only their own lines.
    """
    num, den = similarity
    doc, copy, gone = (fresh(docs, x) for x in ("__doc", "__copy", "__gone"))
    with Scratch(docs.sparkSession) as scratch:
        rows = _numbered(scratch, docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc", "copy")
        found = _matches(scratch, rows, num, den)
        n = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        by_row = found.select(F.col("doc").alias(doc), F.shiftrightunsigned("at", 32).alias(copy), n.alias("n")).groupBy(doc, copy).agg(F.collect_list("n").alias(gone), F.count("*").alias("many"))
        removed = scratch.keep(scratch.cut(by_row, "removed-lines"))
        numbered = _numbered(scratch, docs, doc, copy)
    many = removed.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    joined = numbered.join(small(removed.drop("many"), many), [doc, copy], "left")
    left = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])

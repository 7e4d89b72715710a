"""Line dedup by exact set-similarity join (operator 9); DataFrame operations only.

A line is the set of its words, ordered by rarity, rarest first. All words of all texts are counted exactly; tasks hold the
counts' logarithms in an array as long as the vocabulary (up to a bound), which only orders words and decides nothing.

Two sets x and y, y not longer, of Jaccard similarity t share a word among the first floor((1-t)/(1+t)·|y|) + 1 words of y
and the first floor((1-t)·|x|) + 1 of x. Postings of these prefixes meet by word and by class of length, under the length
filter, the positional filter and a signature of parities (a word that only one of them has changes one bit at most). What
passes is verified on the lines' words. A line that is similar to an earlier one goes.

Groups of copies never meet pair by pair: equal lines count once; then each set meets the earliest sets that have one of
its words, and what these settle meets, by common words, only sets that they don't settle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, positional, restored, same_key, table, text_key, written
from .urls import blocked_bloom, filter_blocks, mark, may_contain

#: Least Jaccard similarity, in percent.
SIMILAR_PCT = 80
#: Places of the array that orders words by rarity, at most: 8 MB. With more words, some share a place, and the most frequent of them counts.
MAX_PLACES = 1 << 23
#: Bits of a word's hash that its code keeps below its rarity.
HASH_BITS = 56
#: Sets of more words have a signature of 128 bits, others one of 64.
WIDE = 64
#: Sets of more words are compared by their prefixes, too, before their words are read.
LONG = 128
#: Words of a set by which it meets the earliest sets, at even distances in its prefix: the rarest ones tell two copies apart, the later ones are what a large group of them shares.
LEAD_WORDS = 5
#: Rarity from which on a word is common: 256 occurrences.
COMMON = 24
#: Parts of the postings that meet one after the other, so that shuffles take less disk at a time.
PARTS = 3


def _clean(text: Column) -> Column:
    """Lower case; white space but line feeds (space, tab, VT, FF, CR) as spaces."""
    low, rare = F.lower(text), [F.lit(c) for c in "\t\x0b\f\r"]
    return F.when(reduce(or_, (F.contains(low, c) for c in rare)), reduce(lambda x, c: F.replace(x, c, F.lit(" ")), rare, low)).otherwise(low)


def words(clean: Column) -> Column:
    """Runs of anything but spaces."""
    return F.array_remove(F.split(clean, " "), "")


def _shift(x: Column, by) -> Column:
    return F.call_function("shiftleft", x, F.lit(by) if isinstance(by, int) else by)


def rarity(docs: DataFrame) -> DataFrame:
    """One row: steps, an array of bytes. A word's place is its hash's lowest bits; there is 0 if no word of that place occurs twice, else three steps for each doubling of the count of the most frequent."""
    lines = docs.select(F.explode(F.split(_clean(F.col("text")), "\n")).alias("line"))
    seen = lines.select(F.explode(F.split("line", " ")).alias("w")).select(F.xxhash64("w").alias("h"))
    counts = written(seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
    places = min(MAX_PLACES, max(1 << 12, 4 << counts.count().bit_length()))
    step = F.least(F.lit(127), F.floor(3 * F.log2("n")).cast("int")).cast("tinyint")
    at = F.col("h").bitwiseAND(places - 1)
    none = docs.sparkSession.range(places).select(F.col("id").alias("at"), F.lit(0).cast("tinyint").alias("step"))
    each = counts.select(at.alias("at"), step.alias("step")).unionByName(none).groupBy("at").agg(F.max("step").alias("step"))
    rows = each.groupBy(F.shiftright("at", 12).alias("part")).agg(F.sort_array(F.collect_list(F.struct("at", "step"))).alias("x")).select("part", F.col("x.step").alias("steps"))
    out = written(rows.agg(F.sort_array(F.collect_list(F.struct("part", "steps"))).alias("x")).select(F.flatten("x.steps").alias("steps")), "rarity")
    discard(counts)
    out._places = places
    return out


def _codes(line: Column, steps: Column, places: int) -> Column:
    """The distinct words of a line as numbers, rarest first: rarity above, hash below, so equal words have equal codes."""
    code = lambda h: _shift(F.get(steps, h.bitwiseAND(places - 1).cast("int")).cast("bigint"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))
    hashes = F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return F.sort_array(F.transform(hashes, code))


def _parity(codes: Column, half: int | None = None) -> Column:
    """64 bits: which of 64 kinds of words are odd in number; with `half`, of those words with that bit above."""
    one = lambda w: F.lit(1).cast("bigint") if half is None else F.shiftright(w, 6).bitwiseAND(1).bitwiseXOR(1 - half)
    bit = lambda w: _shift(one(w), w.bitwiseAND(63).cast("int"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, w: a.bitwiseXOR(bit(w)))


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with their documents' ids and keys, and their places from 0 on."""
    own = docs.select("id", text_key(F.col("text")).alias("th"), _clean(F.col("text")).alias("text"))
    return own.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _place() -> Column:
    """Before: by document id (null last), then the key of its text, then the place in it."""
    return F.struct(F.col("id").isNull().alias("last"), "id", "th", "pos")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, pct: int) -> DataFrame:
    """Of pairs (x, y) of numbers of sets, the y of similar ones. Only documents and lines that pairs name are read whole: filters of bounded size find them, without a shuffle of texts."""
    named = pairs.select(F.explode(F.array("x", "y")).alias("r")).distinct().join(sets.select("r", "p"), "r")
    named = written(named.select("r", "p", F.xxhash64("p.id", "p.th", "p.pos").alias("line_key"), F.xxhash64("p.id", "p.th").alias("doc_key")), "named")
    blocks = filter_blocks(named.count())
    by_doc = written(blocked_bloom(named.select("doc_key").distinct(), "doc_key", blocks), "bloom")
    by_line = written(blocked_bloom(named, "line_key", blocks), "bloom")
    some = may_contain(docs.withColumn("key", F.xxhash64("id", text_key(F.col("text")))), "key", by_doc, blocks).select("id", "text")
    keyed = may_contain(_lines(some).withColumn("key", F.xxhash64("id", "th", "pos")), "key", by_line, blocks)
    whole = keyed.select(_place().alias("p"), F.array_distinct(words(F.col("line"))).alias("s")).join(named.select("p", "r"), "p").dropDuplicates(["r"])
    whole = written(whole.select("r", "s"), "sets")
    both = F.size(F.array_intersect("sx", "sy"))
    met = pairs.join(whole.select(F.col("r").alias("x"), F.col("s").alias("sx")), "x").join(whole.select(F.col("r").alias("y"), F.col("s").alias("sy")), "y")
    out = written(met.where(100 * both >= pct * (F.size("sx") + F.size("sy") - both)).select("y").distinct(), "similar")
    for t in (named, by_doc, by_line, whole):
        discard(t)
    return out


def _alike(pct: int, x: str, y: str) -> Column:
    """Whether lengths and signatures of two sets allow that they are similar: of n words together, at most (100 - pct) / (100 + pct) n belong to one only. Columns xn, xs, xt, yn, ys, yt."""
    n = lambda k: F.col(f"{k}n")
    s, t = (F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}")) for k in "st")
    apart = F.when(F.least(n(x), n(y)) > WIDE, F.bit_count(s) + F.bit_count(t)).otherwise(F.bit_count(s.bitwiseXOR(t)))
    return (100 * F.least(n(x), n(y)) >= pct * F.greatest(n(x), n(y))) & ((100 + pct) * apart <= (100 - pct) * (n(x) + n(y)))


def _narrowed(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (x, y) without those of long sets whose prefixes, as far as both reach, differ in more words than similar sets can."""
    long = sets.where(F.col("n") > LONG).select("r", "n", "head")
    x, y = (long.select(F.col("r").alias(k), F.col("n").alias(f"{k}n"), F.col("head").alias(f"{k}head")) for k in "xy")
    both = pairs.join(x, "x", "left").join(y, "y", "left")
    end = F.least(F.element_at("xhead", -1), F.element_at("yhead", -1))
    upto = lambda head: F.size(F.filter(head, lambda w: w <= end))
    apart = upto("xhead") + upto("yhead") - 2 * F.size(F.array_intersect("xhead", "yhead"))
    return both.where(F.coalesce((100 + pct) * apart <= (100 - pct) * (F.col("xn") + F.col("yn")), F.lit(True))).select("x", "y")


def _led(sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (x, y): each set y, and of those that have one of its words (some of its prefix's that occur twice) the earliest of even and of odd number and the one of most copies, if they are before it."""
    shared = F.filter("head", lambda w: w >= 1 << HASH_BITS)
    shared = F.array_distinct(F.transform(F.array(*map(F.lit, range(1, LEAD_WORDS + 1))), lambda i: F.get(shared, F.ceil(i * F.size(shared) / LEAD_WORDS).cast("int") - 1)))
    rows = sets.select(F.explode(shared).alias("w"), F.col("r").alias("yr"), F.col("n").alias("yn"), F.col("s").alias("ys"), F.col("t").alias("yt"), "copies").where("w is not null")
    one = F.struct("yr", "yn", "ys", "yt")
    firsts = rows.groupBy("w").agg(*(F.min(F.when(F.col("yr") % 2 == k, one)).alias(f"x{k}") for k in (0, 1)), F.max(F.struct("copies", (-F.col("yr")).alias("back"), one.alias("x"))).alias("most"))
    met = rows.join(firsts, "w").select("yr", "yn", "ys", "yt", F.explode(F.array("x0", "x1", "most.x")).alias("x"))
    met = met.select("yr", "yn", "ys", "yt", *(F.col(f"x.y{k}").alias(f"x{k}") for k in "rnst"))
    return met.where((F.col("xr") < F.col("yr")) & _alike(pct, "x", "y")).select(F.col("xr").alias("x"), F.col("yr").alias("y")).distinct()


def _met(sets: DataFrame, pct: int, part: int) -> DataFrame:
    """Pairs (x, y), x before y, y not settled, that share a word of their prefixes which falls to a part."""
    rows = sets.select("r", "n", "s", "t", "settled", F.posexplode("head").alias("at", "w")).where(F.col("w") >= 1 << HASH_BITS)
    common = F.col("w") >= COMMON << HASH_BITS
    # Similar sets' classes are equal or follow each other; classes are a little wider than similarity asks, so that rounding doesn't matter.
    length = F.floor(F.log("n") / F.log(F.lit(100 / pct * 1.0001))).cast("bigint")
    key = lambda c: F.col("w").bitwiseXOR(_shift(c, 48))
    apart = F.lit(1 << 47)
    mine = rows.where((100 + pct) * F.col("at") <= (100 - pct) * F.col("n")).withColumn("key", F.explode(F.array(key(length), key(length + 1))))
    mine = mine.withColumn("key", F.when(common & F.col("settled"), F.col("key").bitwiseXOR(apart)).otherwise(F.col("key")))
    other = rows.withColumn("key", F.explode(F.when(common & ~F.col("settled"), F.array(key(length), key(length).bitwiseXOR(apart))).otherwise(F.array(key(length)))))

    def side(df: DataFrame, name: str) -> DataFrame:
        left = _shift(F.col("n").cast("bigint"), 33).bitwiseOR(_shift((F.col("n") - F.col("at")).cast("bigint"), 1)).bitwiseOR(F.col("settled").cast("bigint"))
        return df.where(F.pmod("key", F.lit(PARTS)) == part).select("key", F.col("r").alias(f"{name}r"), left.alias(f"{name}l"), F.col("s").alias(f"{name}s"), F.col("t").alias(f"{name}t"))

    n = lambda k: F.shiftright(f"{k}l", 33)
    left = lambda k: F.shiftright(F.col(f"{k}l"), 1).bitwiseAND((1 << 32) - 1)
    done = lambda k: F.col(f"{k}l").bitwiseAND(1) == 1
    pairs = side(mine, "x").join(side(other, "y"), "key").withColumns({"xn": n("x"), "yn": n("y")})
    ordered = (F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xr") < F.col("yr")))
    later = F.when(F.col("xr") < F.col("yr"), done("y")).otherwise(done("x"))
    reach = (100 + pct) * F.least(left("x"), left("y")) >= pct * (F.col("xn") + F.col("yn"))
    found = pairs.where(ordered & ~later & reach & _alike(pct, "x", "y"))
    return found.select(F.least("xr", "yr").alias("x"), F.greatest("xr", "yr").alias("y")).distinct()


def repeated(docs: DataFrame, pct: int = SIMILAR_PCT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The places (id, th: key of the text, pos) of lines that are similar to an earlier line, of any document.

    Lines are split at \\n. Lines without words are never repeated. Earlier: the smaller id (null ids last), then the
    smaller key of the text, then the earlier place; lines are judged on the input, so a line that goes still counts as
    an earlier one. Rows that share id and text are one document; texts and lines are known by keys of 128 bits, similar
    lines are verified by their words. Null texts have no lines. Texts and lines may have any length; a line's set must fit
    a task. Other columns aren't read; an empty table has no places.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    order = rarity(docs)
    coded = _lines(docs).where(F.col("line").rlike("[^ ]")).withColumn("steps", order.scalar())
    coded = coded.select("id", "th", "pos", text_key(F.col("line")).alias("lk"), _codes(F.col("line"), F.col("steps"), order._places).alias("c"))
    n = F.size("c")
    signs = [F.when(n > WIDE, _parity(F.col("c"), 0)).otherwise(_parity(F.col("c"))).alias("s"), F.when(n > WIDE, _parity(F.col("c"), 1)).otherwise(F.lit(0)).alias("t")]
    head = F.slice("c", 1, (n * (100 - pct) / 100 + 1e-9).cast("int") + 1)
    lines = written(coded.select("id", "th", "pos", "lk", n.alias("n"), *signs, head.alias("head")), "lines")

    # Equal lines are one, in the place of the earliest; sets are numbered in the order of their places.
    sets = lines.groupBy("lk").agg(F.min(_place()).alias("p"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("n", "s", "t", "head")))
    by = ["p.last", "p.id", "p.th", "p.pos"]
    sets = written(sets.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()), "numbered")
    slim = written(lines.select("lk", "id", "th", "pos"), "places")
    discard(lines)

    settled = _verified(docs, sets, written(_narrowed(_led(sets, pct), sets, pct), "led"), pct)
    known = written(sets.join(settled.select(F.col("y").alias("r"), F.lit(True).alias("settled")), "r", "left").withColumn("settled", F.coalesce("settled", F.lit(False))), "flagged")
    discard(sets)
    parts = [written(_met(known, pct, k), "met") for k in range(PARTS)]
    pairs = written(_narrowed(reduce(DataFrame.unionByName, parts).distinct(), known, pct), "pairs")
    similar = settled.unionByName(_verified(docs, known, pairs, pct)).select(F.col("y").alias("r")).distinct()

    # A set that goes, goes in all its copies; of another, all copies but the first.
    marked = known.select("r", "lk", "p", "copies").join(similar.withColumn("all", F.lit(True)), "r", "left").where("all or copies > 1").select("lk", F.col("p").alias("first"), "all")
    out = slim.join(marked, "lk").where(F.col("all").isNotNull() | (_place() != F.col("first")))
    return out.select("id", "th", "pos").distinct()


def dedup_lines(docs: DataFrame, pct: int = SIMILAR_PCT, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """`docs`, their texts without repeated lines (see repeated()); with `counts` also n_lines and n_removed.

    A text that loses all its lines is empty; null stays null. Other columns stay as they are, whatever their names, and so
    do rows without repeated lines, which don't move. Rows that share id and text lose the same lines. An empty table gives
    an empty table.
    """
    gone = written(repeated(docs, pct, id_col, text_col).groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    blocks = filter_blocks(gone.count())
    bloom = written(blocked_bloom(gone.select(F.xxhash64("id", "th").alias("key")), "key", blocks), "bloom")
    own = positional(docs, id=F.col(f"`{id_col}`"), text=F.col(f"`{text_col}`")).withColumn("th", text_key(F.col("text")))
    keyed = mark(own.withColumn("key", F.xxhash64("id", "th")), "key", bloom, blocks)
    some = keyed.where("may")
    met = some.join(gone, same_key(some, gone, "id", "th"), "left").drop(gone["id"], gone["th"])
    both = keyed.where("not may").withColumn("gone", F.lit(None).cast("array<int>")).unionByName(met)
    lines = F.split(F.col("text"), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    extra = {"n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"), "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")} if counts else {}
    return restored(both, docs.columns, {text_col: text}, **extra)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_lines": op9_lines}

"""Fuzzy line dedup in DataFrame operations alone.

Each distinct line's character shingles are hashed and cut into bins by value;
the least hash of each bin is its MinHash signature (one permutation), and an
empty bin takes the value of another one, the same for all lines. Lines that
agree in all bins of a band meet in its bucket. Two bits of each bin make a
sketch, by which each line is compared with the nearest one of its buckets' hubs,
the lines that meet most others, and a distributed union-find joins what is similar
by exact Jaccard similarity. Buckets that still have lines of several components
then meet the hubs of the largest of these, and what is left of them is compared in
all pairs across components, each in the first bucket that has both lines, those of
large buckets in blocks that many tasks share. What turns a pair away there is a bound that holds for every similar pair: the number
of bits in which the parities of two sets' hashes differ is never larger than the
number of shingles that only one of them has. So no similar pair that meets is left
out. One line of each component stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.storage import BROADCAST_ROWS, fits, stage, with_places

#: White space that doesn't count at the ends of a line.
BLANK = " \t\r\x0b\x0c"
#: Characters of a shingle and least similarity.
SHINGLE, LEAST = 5, 0.8
#: Characters of the longer shingles that signatures are made of: unrelated lines share few of them, so that bands can be short.
#: A pair at LEAST over shingles of 5 is at 0.7 over these where its differences are single characters, and higher otherwise.
SIGNED = 8
#: Bands and bins of a band: a pair at 0.7 shares a bucket with probability 0.985, one at 0.8 with 0.999.
BANDS, ROWS = 10, 3
BINS = BANDS * ROWS
#: Values a bin that a long line's least ones are sought among, on average.
KEPT = 2
#: Empty bins look for a value in bins j * TURNS mod BINS + 1, one after another.
TURNS = (7, 11, 13, 17, 19, 23)
#: Bins in which a line's sketch differs from that of its hub at most: at 0.7 they are 6.8 on average with a deviation of 2.3. What has more meets others later.
DIFFER = 13
#: Words of 64 bits of the parities of a set's hashes.
PARITY = 16
#: Lines of a bucket, or of a block of a larger one, that one task compares in pairs, about.
SMALL = 1024
#: Components of a bucket whose hubs its lines meet before all its pairs are compared, and rounds of that.
HUBS, ROUNDS = 4, 1
#: Numbers of lines to be cut that are broadcast at most; with more, the texts are shuffled, since a broadcast goes through the driver.
CUTS = 10_000


def _lines(placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_file, _row, id, pos, line, h, g) of each line with a visible character."""
    lines = placed.select("_file", "_row", F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("pos", "line"))
    lines = lines.select("_file", "_row", "id", "pos", F.btrim("line", F.lit(BLANK)).alias("line")).filter("line <> ''")
    lines = lines.withColumn("line", F.lower("line"))
    return lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(7), "line"))


def _or(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def _signed(lines: DataFrame) -> DataFrame:
    """(h, g, lid, n, keys, lo, hi) of each distinct line: a number, how often it is there, its bands' keys and its sketch.

    A shingle's hash names a bin and a value; the least value of each bin is the
    signature. Of long lines only values low enough to be a least one count, KEPT
    a bin on average. Numbers are only the same once the rows are written.
    """
    wide = lines.withColumn("wide", F.encode("line", "UTF-16BE"))  # two bytes a character of the basic plane, so a shingle is a slice
    last = F.greatest(F.shiftright(F.octet_length("wide"), 1) - SIGNED, F.lit(0))
    most = (F.least(F.lit(1.0), KEPT * BINS / (last + 1)) * float((1 << 31) - 1)).cast("int")
    places = wide.withColumn("last", last).withColumn("most", most).select("h", "g", "wide", "most", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    hashed = places.select("h", "g", "i", "most", F.xxhash64(F.substring("wide", F.col("i") * 2 + 1, F.lit(2 * SIGNED))).alias("s"))
    hashed = hashed.select("h", "g", "i", "most", F.shiftrightunsigned("s", 33).cast("int").alias("v"), (F.col("s").bitwiseAND(0xFFFF) % BINS).cast("int").alias("b"))
    low = hashed.filter((F.col("v") <= F.col("most")) | (F.col("i") == 0))  # the first one of each line counts the line
    low = low.select("h", "g", F.when(F.col("i") == 0, 1).otherwise(0).alias("one"), F.when(F.col("v") <= F.col("most"), F.col("b")).otherwise(-1).alias("b"), "v")
    # with a filter a row writes only the value of its own bin, not all of them
    signed = low.groupBy("h", "g").agg(F.sum("one").alias("n"), *[F.expr(f"min(v) FILTER (WHERE b = {j})").alias(f"m{j}") for j in range(BINS)])
    full = [F.coalesce(*[f"m{k}" for k in (j, *((j * t + 1) % BINS for t in TURNS))]).alias(f"m{j}") for j in range(BINS)]
    signed = signed.select("h", "g", "n", *full)
    keys = []
    for k in range(BANDS):
        own = [F.col(f"m{j}") for j in range(k * ROWS, (k + 1) * ROWS)]
        keys.append(F.when(F.coalesce(*own).isNotNull(), F.xxhash64(F.lit(k), *(F.coalesce(m, F.lit(-1)) for m in own))))
    bits = [_or([F.shiftleft(F.shiftright(F.coalesce(f"m{j}", F.lit(-1)), at).bitwiseAND(1).cast("long"), j) for j in range(BINS)]) for at in (0, 1)]
    # a lambda keeps this out of the method that the aggregate's rows go through, which would be too long to be compiled (over 8000 bytes)
    own = F.transform(F.array(*keys), lambda key: key)
    return signed.select("h", "g", F.monotonically_increasing_id().alias("lid"), "n", own.alias("keys"), bits[0].alias("lo"), bits[1].alias("hi"))


def _differ(a: str, b: str) -> Column:
    """The number of bins in which the sketches in columns lo, hi with these endings differ."""
    return F.bit_count(F.col(f"lo{a}").bitwiseXOR(F.col(f"lo{b}")).bitwiseOR(F.col(f"hi{a}").bitwiseXOR(F.col(f"hi{b}"))))


def _near(a: str, b: str) -> Column:
    return _differ(a, b) <= DIFFER


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _shingles(line: Column, size: int) -> Column:
    """The 64-bit hashes of a line's shingles, repeats included."""
    # bound as a lambda's variable the bytes aren't copied for each shingle
    last = lambda w: F.greatest(F.octet_length(w) - 2 * size, F.lit(0)) + 1
    return _once(F.encode(line, "UTF-16BE"), lambda w: F.transform(F.sequence(F.lit(1), last(w), F.lit(2)), lambda i: F.xxhash64(F.substring(w, i, F.lit(2 * size)))))


def _similar(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Those of the pairs (u, v) of line numbers whose shingle sets have Jaccard similarity of ``least`` or more; ``texts`` has (lid, line).

    Shingles are told apart by 64-bit hashes of all their characters.
    """
    both = pairs.join(texts.toDF("u", "a"), "u").join(texts.toDF("v", "b"), "v")
    sets = F.struct(_shingles(F.col("a"), size).alias("a"), _shingles(F.col("b"), size).alias("b"))
    both = both.select("u", "v", F.explode(F.array(sets)).alias("s"))  # a filter isn't moved below an explode, so the sets are made once
    return both.filter(F.size(F.array_intersect("s.a", "s.b")) >= least * F.size(F.array_union("s.a", "s.b"))).select("u", "v")


def parities(sets: DataFrame) -> DataFrame:
    """(lid, size, p0, p1, ...) of sets (lid, hashes), which have no repeats: their sizes, and for each value of the hashes' low bits whether an odd number has it."""
    each = sets.select("lid", F.explode("hashes").alias("s"))
    each = each.select("lid", F.shiftrightunsigned("s", 6).bitwiseAND(PARITY - 1).alias("word"), F.expr("shiftleft(1L, cast(s & 63 AS int))").alias("bit"))
    return each.groupBy("lid").agg(F.count(F.lit(1)).alias("size"), *[F.expr(f"coalesce(bit_xor(bit) FILTER (WHERE word = {k}), 0L)").alias(f"p{k}") for k in range(PARITY)])


def _bound(least: float) -> Column:
    """Whether the sets of rows a and b, of which the columns of :func:`parities` are there, can be similar; true of all that are."""
    only = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(PARITY)])  # in one of the sets, at least
    # half a shingle for the rounding of what is compared
    sizes = F.greatest("size_a", "size_b") * least <= F.least("size_a", "size_b") + 0.5
    return sizes & (only * (1 + least) <= (F.col("size_a") + F.col("size_b")) * (1 - least) + 0.5)


def _ordered(u: str, v: str) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _open(rows: DataFrame, named: DataFrame, purpose: str) -> DataFrame:
    """(key, lid, lo, hi, c, n) of the buckets with lines of several components; ``n`` is how many lines a bucket has."""
    c = named.select(F.col("node").alias("lid"), F.col("component").alias("c"))
    rows = rows.join(fits(c), "lid", "left").withColumn("c", F.coalesce("c", "lid"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    return stage(rows.join(mixed, "key"), purpose)


def _met(rows: DataFrame, on: list[str], least: float, apart: str = "true") -> DataFrame:
    """Pairs of rows that agree in ``on``, of different components, without those that parities, if there are any, show not to be similar; ``apart`` is a further condition on columns with _a and _b."""
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)  # shuffled once for both sides
    a, b = (rows.select(*on, *[F.col(x).alias(f"{x}_{end}") for x in rows.columns if x not in on]) for end in "ab")
    meet = (F.col("lid_a") > F.col("lid_b")) & (F.col("c_a") != F.col("c_b")) & F.expr(apart)
    if "size" in rows.columns:
        meet &= _bound(least)
    if "keys" in rows.columns:  # a pair is taken in the first bucket that it shares
        meet &= F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    return a.join(b, on).filter(meet).select(F.col("lid_a").alias("u"), F.col("lid_b").alias("v"))


def _across(large: DataFrame, least: float) -> DataFrame:
    """Pairs of lines of different components in the same bucket as of :func:`_met`, by blocks of about SMALL lines.

    Every two blocks of a bucket meet under a key of their own. A component of
    more lines has blocks for itself, which don't meet each other.
    """
    groups = large.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > SMALL)
    dealt = large.join(fits(groups), ["key", "c"], "left").withColumn("own", F.when(F.col("m").isNotNull(), F.col("c")))
    part = F.when(F.col("m").isNull(), F.pmod(F.xxhash64("c"), F.expr(f"n div {SMALL} + 1"))).otherwise(F.pmod(F.xxhash64("lid"), F.expr(f"m div {SMALL} + 1")))
    held = [x for x in large.columns if x not in ("key", "n")]
    dealt = stage(dealt.select("key", *held, "own", F.xxhash64(F.coalesce("own", F.lit(-1)), part).alias("block")), "line-blocks")
    blocks = dealt.select("key", "block", "own").distinct()
    meet = blocks.toDF("key", "x", "own_x").join(blocks.toDF("key", "y", "own_y"), "key").filter("x <= y AND (own_x IS NULL OR own_y IS NULL OR own_x <> own_y)").select("key", "x", "y")
    sides = meet.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return _met(dealt.drop("own").join(sides, ["key", "block"]), ["key", "x", "y"], least, "(x = y OR block_a <> block_b)")


def _nearest(rows: DataFrame, hubs: DataFrame, *by: str) -> DataFrame:
    """Pairs of each line, and each value of ``by``, with the one of the nearest sketch among the hubs (key, hub, c_h, lo_h, hi_h) of its buckets that are of other components."""
    own = rows.withColumnsRenamed({"lo": "lo_l", "hi": "hi_l"}).join(hubs, "key")
    nearest = own.filter((F.col("c") != F.col("c_h")) & _near("_l", "_h")).groupBy("lid", *by).agg(F.min(F.struct(_differ("_l", "_h").alias("differ"), "hub")).alias("least"))
    return nearest.select(*_ordered("lid", "least.hub"))


def _with_hub(rows: DataFrame) -> DataFrame:
    """Pairs of each line with the nearest one of its buckets' hubs; a bucket's hub is the line that meets most others."""
    hubs = rows.groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("x"), "lid", "c", "lo", "hi")).alias("hub"))
    return _nearest(rows, hubs.select("key", F.col("hub.lid").alias("hub"), F.col("hub.c").alias("c_h"), F.col("hub.lo").alias("lo_h"), F.col("hub.hi").alias("hi_h")))


def _with_hubs(rows: DataFrame) -> DataFrame:
    """Pairs of each line with a hub of each of the HUBS largest components of its buckets: of several for a place, the nearest one."""
    groups = rows.groupBy("key", "c").agg((-F.count(F.lit(1))).alias("m"), F.min(F.struct((-F.col("met")).alias("x"), "lid", "lo", "hi")).alias("hub"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("m", "hub.x", "hub.lid"))
    hubs = groups.withColumn("place", place).filter(F.col("place") <= HUBS)
    return _nearest(rows, hubs.select("key", "place", F.col("hub.lid").alias("hub"), F.col("c").alias("c_h"), F.col("hub.lo").alias("lo_h"), F.col("hub.hi").alias("hi_h")), "place")


def buckets(distinct: DataFrame) -> DataFrame:
    """(key, n, lid, lo, hi, met) of the buckets with several members of ``distinct`` (lid, keys, lo, hi); ``n`` is how many, ``met`` the sum over a member's buckets."""
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = distinct.select("lid", F.explode("keys").alias("key")).filter("key IS NOT NULL").repartition(partitions, "key")
    shared = every.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
    met = F.sum("n").over(Window.partitionBy("lid"))
    return stage(shared.withColumn("met", met).join(distinct.select("lid", "lo", "hi"), "lid").select("key", "n", "lid", "lo", "hi", "met"), "line-buckets")


def linked(
    shared: DataFrame, similar: Callable[[DataFrame], DataFrame], further: DataFrame | None = None, sets: Callable[[DataFrame], DataFrame] | None = None, least: float = LEAST
) -> DataFrame:
    """(node, component) of the members of buckets that are similar to others; ``shared`` is from :func:`buckets`.

    ``similar`` keeps the similar ones of pairs (u, v), u > v. ``further`` are such
    pairs to be looked at too. Members of a bucket end in one component or have
    been compared, however large the bucket is. ``sets`` has for members (lid) what
    :func:`parities` has, which spares ``similar`` the pairs whose Jaccard similarity
    can't be ``least``; without it, all pairs across components are given to it.
    """
    pairs = _with_hub(shared.withColumn("c", F.col("lid")))
    pairs = stage((pairs.unionByName(further) if further is not None else pairs).distinct(), "line-pairs")
    named = components(stage(similar(pairs), "line-links"), "line-components")
    rows = _open(shared, named, "line-open")

    def meet(more: DataFrame) -> bool:
        nonlocal pairs, named
        more = stage(more.distinct().join(pairs, ["u", "v"], "left_anti"), "line-pairs")
        if not more.limit(1).count():
            return False
        pairs = pairs.unionByName(more)
        found = stage(similar(more), "line-links")
        if not found.limit(1).count():
            return False
        named = components(named.toDF("u", "v").unionByName(found), "line-components")
        return True

    for _ in range(ROUNDS):  # a line that isn't similar to a hub may be to another one, which spares its pairs with all others
        if not meet(_with_hubs(rows)):
            break
        rows = _open(rows.drop("c"), named, "line-open")
    large = rows.filter(F.col("n") > SMALL)
    crowd = large.limit(1).count() > 0
    small = rows.filter(F.col("n") <= SMALL)
    held = shared.join(rows.select("key").distinct(), "key").groupBy("lid").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    if sets is not None:
        held = held.join(sets(rows.select("lid").distinct()), "lid")
    held = fits(stage(held, "line-parities"), BROADCAST_ROWS // 20)  # rows of up to twenty numbers
    small, large = small.join(held, "lid"), large.join(held, "lid")
    every = _met(small.drop("n", "lo", "hi", "met"), ["key"], least)
    meet(every.unionByName(_across(large.drop("lo", "hi", "met"), least)) if crowd else every)
    return named


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, size: int = SHINGLE) -> DataFrame:
    """(_file, _row, id, pos, component, kept) of each line that has a similar or equal one.

    ``_file`` and ``_row`` are the place of a row of ``docs``, see
    :func:`with_places`; ``pos`` numbers the lines of a row from 0. Of a component
    the line with the smallest id (null last), then position, then place stays.
    """
    return _components(with_places(docs, "line-docs"), f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}", least, size)


def _components(placed: DataFrame, id_col: str, text_col: str, least: float, size: int) -> DataFrame:
    lines = _lines(placed, id_col, text_col)
    distinct = stage(_signed(lines), "lines")
    shared = buckets(distinct)
    # of the other lines nothing is needed any more
    members = shared.select("lid").distinct().withColumn("meets", F.lit(True))
    wanted = stage(distinct.select("h", "g", "n", "lid").join(members, "lid", "left").filter("n > 1 OR meets").select("h", "g", "lid", "n", "meets"), "line-wanted")
    held = stage(lines.join(fits(wanted), ["h", "g"]).drop("h", "g"), "line-held")
    texts = stage(held.filter("meets").groupBy("lid").agg(F.first("line").alias("line")), "line-texts")  # equal hashes of 128 bits, equal lines

    def similar(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("u", "v")).alias("lid")).distinct()
        return _similar(pairs, texts.join(fits(ends), "lid"), size, least)

    def sets(lids: DataFrame) -> DataFrame:
        return parities(texts.join(fits(lids), "lid").select("lid", F.array_distinct(_shingles(F.col("line"), size)).alias("hashes")))

    named = linked(shared, similar, sets=sets, least=least)
    grouped = held.drop("line", "meets").join(fits(named), F.col("lid") == F.col("node"), "left").filter("n > 1 OR component IS NOT NULL")
    grouped = stage(grouped.select("_file", "_row", "id", "pos", F.coalesce("component", "lid").alias("component")), "line-groups")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "pos", "_file", "_row")
    best = grouped.groupBy("component").agg(F.min(place).alias("best"))
    stays = best.select("best._file", "best._row", "best.pos", F.lit(True).alias("stays"))  # joined by place, since a component may be a third of all lines
    return grouped.join(stays, ["_file", "_row", "pos"], "left").select("_file", "_row", "id", "pos", "component", F.coalesce("stays", F.lit(False)).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, size: int = SHINGLE) -> DataFrame:
    """``docs`` with ``text`` rid of all but one line of each component, and n_lines, n_dropped.

    Lines end at a line feed and are compared in lower case and without outer
    white space (ASCII) by the Jaccard similarity of their character shingles (a
    shorter line is one shingle); equal lines are similar. Lines without a
    visible character are never dropped. A null text stays null with no lines; an
    empty one has one line. Repeated rows are rows of their own, so all but one
    lose their lines. An empty table gives no rows. Other columns are unchanged;
    n_lines and n_dropped replace columns of those names.
    """
    placed = with_places(docs, "line-docs")
    names = placed.columns[:-2]
    at = docs.columns.index(text_col)
    lines = _components(placed, names[docs.columns.index(id_col)], names[at], least, size)
    cut = stage(lines.filter(~F.col("kept")).groupBy("_file", "_row").agg(F.collect_list("pos").alias("cut")), "line-cuts")
    few = (cut.agg(F.sum(F.size("cut") + 5)).first()[0] or 0) <= CUTS  # numbers, so what is broadcast is bounded by bytes
    rows = placed.join(F.broadcast(cut) if few else cut.hint("merge"), ["_file", "_row"], "left")
    text = F.col(names[at]).cast("string")
    split = F.split(text, "\n")
    stay = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("cut"))
    left = _once(split, lambda own: F.array_join(F.transform(stay(own), lambda i: F.get(own, i)), "\n"))
    out = rows.select(
        *[F.when(F.col("cut").isNull(), text).otherwise(left).alias(c) if c == names[at] else F.col(c) for c in names],
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.greatest(F.size("cut"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    renamed = out.toDF(*docs.columns, "_n_lines", "_n_dropped")
    return renamed.drop("n_lines", "n_dropped").withColumnsRenamed({"_n_lines": "n_lines", "_n_dropped": "n_dropped"})

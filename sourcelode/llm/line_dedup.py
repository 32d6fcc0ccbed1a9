"""Line dedup by a segment-partition edit join.

Lines that are equal are one. Two different lines within ``edits`` edits share a segment: if one of
them is cut into edits + 1 segments of nearly equal length, one segment is untouched by the edits and
stands in the other line, shifted by their difference at most. Every distinct line is indexed under
(length, segment number, segment) and probes, for each length that a partner may have, the substrings
that can match a segment: those starting within the shifts that leave enough edits on both sides
(multi-match-aware). Candidates are verified by edit distance in a diagonal band, bit-parallel: the
differences between neighbouring cells of the band are the bits of two integers, which take in one
character at a time.

Groups are handled without their square: first each key ties its probes to one indexed line; only
lines that then stand in different components are compared with each other, pair by pair under keys of
``CROWD`` rows at most. Pairs of which too many characters differ in the parity of their number are
never verified, nor do they leave the join.

Lines under fuller keys are put in groups and not paired (for up to two edits; for more they are). A
group has a pivot for beginnings and one for ends, and each line a place where it leaves either. Two
lines that leave the first pivot at different places, or there with different characters, first differ
at the earlier place, where the line that stays has the pivot's character; so it is with ends. What is
left of two near lines without their common beginning and end starts and ends with an edit, so one edit
at each of the two places makes them equal: copies of every line with an edit at its own places, towards
the pivots, meet by equality, and one tie to the copy's least line serves for all. Lines that leave a
pivot at one place with one character are a group of their own in the next round, and the pivot is in
none of these; groups of ``GROUP`` lines at most, which have no more pairs than copies, are compared pair
by pair where their texts are.

A line is dropped when it is not the first of its component, in the order of document and line number.

Cases: lines of white space only are always kept, and lines below ``least_chars`` are compared for
equality alone; a null text stays null; a document whose every line is dropped is dropped from
``dedup_lines`` (its lines stand elsewhere), and one that has only blank lines is kept; rows with one
id and one text are one document and share their decisions; other columns are passed on. Lines end at
line feeds. A line is known by a 64-bit hash and its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.components import components
from sourcelode.llm.store import free_name, settled
from sourcelode.session import broadcast_if_small

EDITS = 2
LEAST_CHARS = 20
#: Rows of a key that are compared pair by pair, at most; an indexed line probes under the key as well and counts twice.
CROWD = 16
#: Lines of a group that are compared pair by pair, at most; a line has 27 copies at most, so these groups have fewer pairs.
GROUP = 54
#: Lines of a group among which its pivots are chosen.
CHOICE = 8
#: Edits for which lines under fuller keys meet by copies.
COPY_EDITS = 2


def segment(n: Column, number: int, edits: int) -> tuple[Column, Column]:
    """(start from 1, length) of a segment; the last ones are longer by one when n does not divide."""
    short = F.floor(n / (edits + 1)).cast("int")
    longer = n - short * (edits + 1)
    first_long = F.lit(edits + 1) - longer
    start = F.lit(number) * short + F.greatest(F.lit(number) - first_long, F.lit(0)) + 1
    return start.cast("int"), (short + (F.lit(number) >= first_long).cast("int")).cast("int")


def _key(length: Column, number: int, start: Column, size: Column) -> Column:
    """Hash of a segment's bytes. In a line of single-byte characters it is cut out without a walk to its start."""
    part = F.when(F.col("single"), F.substring("data", start, size)).otherwise(F.substring("line", start, size).cast("binary"))
    return F.xxhash64(length.cast("int"), F.lit(number), part)


def index_keys(edits: int) -> list[Column]:
    """The keys under which a line (line, n) stands in the index."""
    n = F.col("n")
    return [_key(n, i, *segment(n, i, edits)) for i in range(edits + 1)]


def probe_keys(edits: int) -> list[Column]:
    """The keys of possible partners of the line's length or shorter, but its own index keys; null where there is none.

    A partner shorter by d has its segment i where the line has it, moved by s: i edits at most lie
    before the segment and edits - i after it, and the moves on both sides, |s| and |d - s|, cost as
    much.
    """
    keys = []
    for d in range(edits + 1):
        length = F.col("n") - d
        for i in range(edits + 1):
            start, size = segment(length, i, edits)
            for move in range(-edits, edits + 1):
                if (d or move) and abs(move) <= i and abs(d - move) <= edits - i:
                    at = start + move
                    fits = (at >= 1) & (at + size - 1 <= F.col("n")) & (size >= 1)
                    keys.append(F.when(fits, _key(length, i, at, size)))
    return keys


def within_edits(edits: int) -> str:
    """SQL: whether the edit distance of columns ``longer`` and ``shorter`` is ``edits`` at most.

    Column i of the band holds rows i - edits - 1 to i + edits; bit k of x says whether the character
    of row k equals that of the column. The distance is followed along the lowest row of the band down
    to the last row, and then along the last row.

    The characters are bound as the fields of ``p``: an expression over columns would be computed anew
    for every character.
    """
    width = 2 * edits + 2
    mask = (1 << width) - 1
    begin = mask & ~((1 << (width - edits - 1)) - 1)
    bits = " | ".join(f"if(get(p.l, i - {edits + 1} + {k}) = get(p.r, i), {1 << k}, 0)" for k in range(width))
    hp = f"((s.vn | ~(d0 | s.vp)) & {mask})"
    row = f"shiftright({1 << (width - 2)}, c.i - p.last)"
    walk = f"""
        aggregate(
            transform(sequence(0, size(p.r) - 1), i -> named_struct('i', i, 'x', {bits})),
            named_struct('vp', {begin}, 'vn', 0, 'd', {edits}),
            (s, c) -> element_at(transform(
                array(((((c.x & s.vp) + s.vp) ^ s.vp) | c.x | s.vn) & {mask}),
                d0 -> named_struct(
                    'vp', ((d0 & s.vp) | ~(shiftright(d0, 1) | {hp})) & {mask},
                    'vn', shiftright(d0, 1) & {hp},
                    'd', s.d + if(c.i < p.last, if((d0 & {1 << (width - 1)}) = 0, 1, 0),
                                  if(({hp} & {row}) != 0, 1, 0) - if((d0 & s.vp & {row}) != 0, 1, 0))
                )), 1)
        ).d"""
    bound = f"array(named_struct('l', split(longer, ''), 'r', split(shorter, ''), 'last', char_length(longer) - {edits}))"
    return (
        f"char_length(longer) - char_length(shorter) <= {edits}"
        f" and element_at(transform({bound}, p -> {walk}), 1) <= {edits}"
    )


def _lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, n, lid) of the lines that are not blank."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"\S"))
    return lines.select("*", F.char_length("line").alias("n"), F.xxhash64("line").alias("lid"))


def _postings(documents: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """(key, lid, indexed) of every distinct line that is long enough."""
    index, probe = index_keys(edits), probe_keys(edits)
    names = [f"k{i}" for i in range(len(index) + len(probe))]
    lines = _lines(documents).where(F.col("n") >= max(least_chars, edits + 1))
    lines = lines.withColumn("data", F.col("line").cast("binary")).withColumn("single", F.octet_length("line") == F.col("n"))
    keyed = lines.select("lid", *(k.alias(name) for k, name in zip(index + probe, names, strict=True)))
    distinct = keyed.groupBy("lid").agg(*(F.first(name).alias(name) for name in names))
    pairs = F.array(*(F.struct(F.col(name).alias("key"), F.lit(i < len(index)).alias("indexed")) for i, name in enumerate(names)))
    return distinct.select("lid", F.explode(pairs).alias("p")).where("p.key is not null").select("p.key", "lid", "p.indexed")


def _live(postings: DataFrame) -> DataFrame:
    """The postings of keys that an indexed line shares with another line."""
    dealt = postings.repartition("key")
    shared = dealt.groupBy("key").agg(
        F.min(F.when(F.col("indexed"), F.col("lid"))).alias("pivot"), F.min("lid").alias("x"), F.max("lid").alias("y")
    )
    shared = shared.where("pivot is not null and x != y").select("key", "pivot")
    return settled(dealt.join(shared.hint("shuffle_hash"), "key"), "live")


def parities(line: str) -> Column:
    """Bit k of ``chars`` says whether the characters with a code of k modulo 64 are odd in number, ``twos`` the
    same of neighbouring characters."""
    return F.expr(f"""
        aggregate(
            split({line}, ''), named_struct('last', 0, 'chars', 0L, 'twos', 0L),
            (s, c) -> named_struct(
                'last', ascii(c), 'chars', s.chars ^ shiftleft(1L, pmod(ascii(c), 64)),
                'twos', s.twos ^ shiftleft(1L, pmod(37 * s.last + ascii(c), 64))
            ),
            s -> named_struct('chars', s.chars, 'twos', s.twos)
        )""")


def perhaps_near(x: Column, y: Column, edits: int) -> Column:
    """False for lines that cannot be within ``edits`` by their parities: an edit turns two bits at most, and four of neighbours."""
    chars = F.bit_count(x["chars"].bitwiseXOR(y["chars"])) <= 2 * edits
    return chars & (F.bit_count(x["twos"].bitwiseXOR(y["twos"])) <= 4 * edits)


def _texts(p: str, q: str) -> list[Column]:
    """Two texts as ``longer`` and ``shorter``."""
    first, p, q = F.char_length(p) >= F.char_length(q), F.col(p), F.col(q)
    return [F.when(first, p).otherwise(q).alias("longer"), F.when(first, q).otherwise(p).alias("shorter")]


def _verify(pairs: DataFrame, contents: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) whose lines are within ``edits``."""
    left = contents.select(F.col("lid").alias("a"), F.col("line").alias("p"), F.col("odd").alias("odd_p"))
    right = contents.select(F.col("lid").alias("b"), F.col("line").alias("q"), F.col("odd").alias("odd_q"))
    close = pairs.join(left.select("a", "odd_p"), "a").join(right.select("b", "odd_q"), "b")
    close = close.where(perhaps_near(F.col("odd_p"), F.col("odd_q"), edits)).select("a", "b")
    both = close.join(left, "a").join(right, "b")
    both = both.select("a", "b", *_texts("p", "q"))
    return settled(both.where(F.expr(within_edits(edits))).select("a", "b"), "links")


def shared(x: str, y: str) -> str:
    """SQL: the number of characters that two strings share from the start on, in steps of halves."""
    step = f"at + step <= least(char_length({x}), char_length({y}))"
    same = f"substring({x}, at + 1, step) = substring({y}, at + 1, step)"
    steps = "transform(sequence(0, 29), k -> shiftleft(1, 29 - k))"
    return f"aggregate({steps}, 0, (at, step) -> if({step} and {same}, at + step, at))"


def _pivots(rows: DataFrame) -> DataFrame:
    """(grp, first, last): per group, of some of its lines the one that shares most with the others, from its start and from its end."""
    some = F.array(*(F.min_by("text", F.xxhash64("lid", F.lit(i))) for i in range(CHOICE)))
    chosen = rows.groupBy("grp").agg(F.array_distinct(some).alias("some"))

    def most_shared(texts: str) -> Column:
        score = f"aggregate({texts}, 0, (sum, u) -> sum + {shared('t', 'u')})"
        return F.expr(f"array_max(transform({texts}, t -> struct({score}, t))).t")

    first, last = most_shared("some"), F.reverse(most_shared("transform(some, t -> reverse(t))"))
    return chosen.select("grp", first.alias("first"), last.alias("last"))


def _placed(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """``rows`` with the numbers of characters shared with the pivots (``at``, ``until``), the pivots' characters
    there (``ahead``: two), and whether a row is a pivot."""
    both = rows.join(pivots, "grp")
    both = both.withColumns({"at": F.expr(shared("text", "first")), "until": F.expr(shared("reverse(text)", "reverse(last)"))})
    left = F.char_length("last") - F.col("until")
    return both.withColumns({
        "ahead": F.expr("substring(first, at + 1, 2)"),
        "behind": F.when(left > 0, F.substring("last", left, F.lit(1))).otherwise(""),
        "is_first": F.col("text") == F.col("first"), "is_last": F.col("text") == F.col("last"),
    }).drop("first", "last")


def _copies(placed: DataFrame) -> DataFrame:
    """(code, lid, part, spent, free): per line, codes of its copies with an edit at its places or none.

    Equal copies have equal codes. An edit towards a pivot replaces, deletes or inserts a character and is
    ``spent``; or a character is left open, which costs one edit for all lines that have the copy (``free``).
    """
    left = "char_length(text) - until"
    ends = {
        "": "text",
        "replace": f"concat(substring(text, 1, {left} - 1), behind, substring(text, {left} + 1))",
        "delete": f"concat(substring(text, 1, {left} - 1), substring(text, {left} + 1))",
        "insert": f"concat(substring(text, 1, {left}), behind, substring(text, {left} + 1))",
        "open": f"concat(substring(text, 1, {left} - 1), '\\0', substring(text, {left} + 1))",
    }
    starts = {
        "": "t",
        "replace": "concat(substring(t, 1, at), substring(ahead, 1, 1), substring(t, at + 2))",
        "delete": "concat(substring(t, 1, at), substring(t, at + 2))",
        "insert": "concat(substring(t, 1, at), substring(ahead, 1, 1), substring(t, at + 1))",
        "open": "concat(substring(t, 1, at), '\\0', substring(t, at + 2))",
    }

    def copy(text: str, spent: int, start: str = "", end: str = "") -> str:
        places = f"{'at' if start == 'open' else -1}, {'until' if end == 'open' else -1}"
        free = (start == "open") + (end == "open")
        return f"struct(xxhash64(grp, {places}, {text}) as code, {spent} as spent, {free} as free)"

    def edited(start: str, end: str, text: str) -> str:
        return copy(starts[start].replace("t,", f"{text},") if start else text, (start not in ("", "open")) + (end not in ("", "open")), start, end)

    single = [edited("", "", "text"), *(edited(s, "", "text") for s in starts if s), *(edited("", e, ends[e]) for e in ends if e)]
    single.append(copy("concat(substring(text, 1, at), substring(text, at + 3))", 2))
    single.append(copy("concat(substring(text, 1, at), ahead, substring(text, at + 1))", 2))
    double = [edited(s, e, ends[e]) for s in starts if s for e in ends if e]
    copies = f"concat(array({', '.join(single)}), if(at + until < char_length(text), array({', '.join(double)}), array()))"
    return placed.select("lid", "part", F.explode(F.expr(copies)).alias("c")).select("c.code", "lid", "part", "c.spent", "c.free")


def _crowd_pairs(crowd: DataFrame, contents: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) that tie together the lines which share keys in ``crowd`` (key, lid, part), stand in
    different parts and are near; other pairs may be among them."""
    hubs = broadcast_if_small(settled(crowd.groupBy("key").agg(F.min("lid").alias("a")), "hubs"))
    homes = components(crowd.join(hubs, "key").select("a", F.col("lid").alias("b")))
    lines = contents.select("lid", "odd", F.col("line").alias("text"))
    rows = homes.select(F.col("component").alias("grp"), F.col("node").alias("lid"))
    rows = settled(rows.join(crowd.select("lid", "part").distinct(), "lid").join(lines, "lid"), "crowd")
    few, copies = [], []
    while True:
        sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("x"), F.max("part").alias("y"))
        sizes = settled(sizes.where("x != y").select("grp", (F.col("n") > GROUP).alias("large")), "sizes")
        n = sizes.agg(F.count_if(F.col("large")).alias("large"), F.count(F.lit(1)).alias("all")).first()
        if n["all"] > n["large"]:
            small = broadcast_if_small(sizes.where("not large").select("grp"))
            few.append(rows.join(small, "grp", "left_semi").select("*", F.char_length("text").alias("n")))
        if not n["large"]:
            break
        many = rows.join(broadcast_if_small(sizes.where("large").select("grp")), "grp", "left_semi")
        pivots = broadcast_if_small(settled(_pivots(many), "pivots"))
        placed = settled(_placed(rows, pivots), "placed")
        copies.append(_copies(placed))
        start = F.xxhash64("grp", F.lit(0), "at", F.expr("substring(text, at + 1, 1)"))
        end = F.xxhash64("grp", F.lit(1), "until", F.expr("substring(reverse(text), until + 1, 1)"))
        rows = placed.where("not is_first").withColumn("grp", start).unionByName(placed.where("not is_last").withColumn("grp", end))
        rows = rows.select("grp", "lid", "part", "odd", "text")
    found = []
    if few:
        few = settled(reduce(DataFrame.unionByName, few), "few")
        i, p = few.alias("i"), few.alias("p")
        apart = F.expr(f"i.lid < p.lid and i.part != p.part and abs(i.n - p.n) <= {edits}")
        apart = apart & perhaps_near(F.col("i.odd"), F.col("p.odd"), edits)
        both = i.join(p, F.expr("i.grp = p.grp") & apart)
        both = both.select(F.col("i.lid").alias("a"), F.col("p.lid").alias("b"), apart.alias("perhaps"), *_texts("i.text", "p.text"))
        # Spark may put this filter before the join's other conditions, so it has them within.
        found.append(both.where(F.when(F.col("perhaps"), F.expr(within_edits(edits))).otherwise(False)).select("a", "b"))
    if copies:
        codes = settled(reduce(DataFrame.unionByName, copies), "codes")
        ties = codes.groupBy("code").agg(F.min(F.struct("spent", "lid", "part")).alias("hub"), F.min("part").alias("x"), F.max("part").alias("y"))
        ties = settled(ties.where("x != y").select("code", "hub.*").toDF("code", "before", "a", "home"), "ties")
        near = F.expr(f"spent + before + free <= {edits} and part != home")
        found.append(codes.join(broadcast_if_small(ties), "code").where(near).select("a", F.col("lid").alias("b")))
    return _pairs(reduce(DataFrame.unionByName, found)) if found else _pairs(crowd.selectExpr("lid as a", "lid as b"))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def line_groups(documents: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(lid, component): distinct lines that have another one within ``edits``, by chains."""
    live = _live(_postings(documents, edits, least_chars))
    wanted = broadcast_if_small(settled(live.select("lid").distinct(), "wanted"))
    contents = _lines(documents).select("lid", "line").join(wanted, "lid", "left_semi")
    contents = contents.groupBy("lid").agg(F.first("line").alias("line")).withColumn("odd", parities("line"))
    contents = settled(contents, "contents")
    near = settled(_pairs(live.select(F.col("pivot").alias("a"), F.col("lid").alias("b"))), "pairs")
    links = _verify(near, contents, edits)
    found = components(links)
    marked = live.join(found.withColumnRenamed("node", "lid"), "lid", "left").select(
        "key", "lid", "indexed", F.coalesce("component", "lid").alias("part")
    )
    roles = F.sum(F.when(F.col("indexed"), 2).otherwise(1))
    sizes = F.min("part").alias("x"), F.max("part").alias("y"), (roles > CROWD).alias("crowded")
    mixed = marked.groupBy("key").agg(*sizes).where("x != y")
    open_ = marked.join(mixed.select("key", "crowded"), "key")
    open_ = settled(open_.join(contents.select("lid", "odd"), "lid"), "open")
    few = open_.where("not crowded") if edits <= COPY_EDITS else open_
    i, p = few.where("indexed").alias("i"), few.alias("p")
    apart = F.expr("i.key = p.key and i.part != p.part") & perhaps_near(F.col("i.odd"), F.col("p.odd"), edits)
    far = i.join(p, apart).select(F.col("i.lid").alias("a"), F.col("p.lid").alias("b"))
    crowd = open_.where("crowded").select("key", "lid", "part").distinct()
    if edits <= COPY_EDITS and not crowd.isEmpty():
        far = far.unionByName(_crowd_pairs(crowd, contents, edits))
    far = settled(_pairs(far).join(near, ["a", "b"], "left_anti"), "pairs")
    more = _verify(far, contents, edits)
    return components(links.unionByName(more)).withColumnRenamed("node", "lid")


def dropped_lines(documents: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, codes): per document with repeated lines, hashes of (line number, line hash) to drop."""
    lines = _lines(documents).select("doc_id", "line_no", "lid", "n")
    firsts = settled(
        lines.groupBy("lid", "n").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("times")),
        "firsts",
    )
    groups = line_groups(documents, edits, least_chars)
    grouped = firsts.join(groups, "lid", "left")
    chosen = grouped.where("component is not null").groupBy("component").agg(F.min("first").alias("keeper"))
    alike = grouped.where("component is not null").join(chosen, "component").select("lid", "n", "keeper")
    equal = grouped.where("component is null and times > 1").select("lid", "n", F.col("first").alias("keeper"))
    repeated = settled(alike.unionByName(equal), "repeated")
    drop = lines.join(repeated, ["lid", "n"]).where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("keeper")))
    codes = drop.select("doc_id", F.xxhash64("line_no", "lid").alias("code"))
    return codes.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))


def dedup_lines(
    documents: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, counts: bool = False
) -> DataFrame:
    """``documents`` (doc_id, text, ...) without repeated lines; ``counts`` adds n_lines and n_dropped."""
    plain = documents.select("doc_id", "text")
    drop = broadcast_if_small(settled(dropped_lines(plain, edits, least_chars), "dropped"))
    codes, key, kept = (free_name(documents.columns, x) for x in ("_codes", "_key", "_kept"))
    drop = drop.select(F.col("doc_id").alias(key), F.col("codes").alias(codes))
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda line, i: ~F.array_contains(F.col(codes), F.xxhash64(i, F.xxhash64(line))))
    joined = documents.join(drop, documents["doc_id"].eqNullSafe(drop[key]), "left")
    joined = joined.withColumn(kept, F.when(F.col(codes).isNull(), lines).otherwise(left))
    if counts:
        joined = joined.withColumns({"n_lines": F.size(lines), "n_dropped": F.size(lines) - F.size(kept)})
    joined = joined.where(F.col(codes).isNull() | (F.size(kept) > 0))
    names = [*documents.columns, *(["n_lines", "n_dropped"] if counts else [])]
    text = F.when(F.col(codes).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*names)

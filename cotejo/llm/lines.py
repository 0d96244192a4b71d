"""Operator 8, line dedup: remove lines whose shingles are nearly those of an earlier line.

Method: an exact set-similarity join. A line's tokens are its distinct 5-word shingles, or all its words
as one if they are fewer. Two lines
at Jaccard `percent` or more share a token among their first n - ceil(percent * n) + 1, in any
common order; such prefixes meet in equi-joins, with length and positional bounds, and the full
sets decide.

1. Which lines have company at all? In an order of shingles by their first word (long ones first,
   then by hash) a prefix is cut at a first word, so only the shingles of prefixes are hashed,
   straight from the scan. Lines whose prefix tokens are all their own leave here: most of them.
   Lines that share a token of at most COLD rows are pairs, if their lengths allow a match.
2. Lines of those pairs and of tokens with more rows are tokenized whole. The latter are ordered by
   rarity (a count of their shingles in 65,536 hash places, a table of fixed size; ties by hash), and
   their rarity prefixes are joined: a match whose first common token is such a one is found there.

Equal lines count once, at their first place. A line goes if any earlier line matches, so not all
pairs of a group are needed: first each prefix token proposes only its earliest line, of which a
line tries the two it shares most with, and lines found so leave. The others then meet the
earlier lines of a token, where of each pair the shorter one must hold it among its first
n - ceil(2 * percent / (100 + percent) * n) + 1 tokens: a passage that many different lines share
stands further back in them and makes no pairs.

All of it is array functions, joins and groups. Texts are shuffled twice by id (for the sets of lines
with company, and for the result); all else is hashes. Large joins don't broadcast at any size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, drop, id_in, let

PLACES = 1 << 16
LOW48 = (1 << 48) - 1
#: Earliest lines of its tokens that a line tries first.
PIVOTS = 2
#: Lines of a token up to here are paired at once.
COLD = 64
#: Bits of a line's hash that name it beside a token; below them are its number of windows (12 bits) and how many
#: fewer first words it has (12), each up to the most that fits.
ID = -(1 << 24)
#: A line's place, with a hash of its bytes (rows may repeat an id), and a second hash.
AT, ALL = ["doc_id", "line_no", "h"], ["doc_id", "line_no", "h", "g"]


def _words(line: Column, short: bool) -> Column:
    if short:
        other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
        line = F.when(other, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line)
    return F.array_remove(F.split(line, " "), "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(words, at + j) for j in range(size)))


def _prefix_size(n: Column, percent: int) -> Column:
    return n - F.floor((percent * n + 99) / 100).cast("int") + 1


def _lines(texts: DataFrame, size: int, short: bool) -> DataFrame:
    """ALL for each line that has a token."""
    lines = texts.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.filter(F.col("line").rlike(r"[^\t\x0b-\r ]" if short else rf"(?:[^ ]++ ++){{{size - 1}}}+[^ ]"))
    return rows.select("doc_id", "line_no", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"))


def _order(word: Column) -> Column:
    """A hash by which long words, which are mostly rare ones, come first."""
    return F.shiftrightunsigned(F.xxhash64(word), 5) - F.shiftleft(F.least(F.octet_length(word), F.lit(15)).cast("long"), 59)


def _first_prefixes(texts: DataFrame, percent: int, size: int, short: bool) -> DataFrame:
    """token and p (see ID) for each token of each line's prefix in the order of first words. The prefix
    holds as many first words as it needs tokens were all windows different, so never too few."""
    # outer explodes and null-safe tests: else the optimizer copies the arrays' expressions into filters below
    lines = texts.select(F.explode_outer(F.split("text", "\n")).alias("line"))
    rows = lines.select(F.xxhash64("line").alias("h"), F.transform(_words(F.col("line"), short), _order).alias("w"))
    n = F.size("w")
    few = (n > 0) & (n < size) if short else F.lit(False)
    starts = F.slice("w", F.lit(1), F.when(few, 1).otherwise(F.greatest(n - size + 1, F.lit(0))))
    rows = rows.withColumn("first_words", F.sort_array(F.array_distinct(starts)))
    windows = F.greatest(n - size + 1, F.lit(1))
    last = F.get("first_words", F.least(F.size("first_words"), _prefix_size(windows, percent)) - 1).alias("last")
    fewer = F.least(windows - F.size("first_words"), F.lit(4095))
    line = F.col("h").bitwiseAND(F.lit(ID)) + F.least(windows, F.lit(4095)) * 4096 + fewer
    rows = rows.select(line.alias("p"), "w", last, F.posexplode_outer(starts).alias("i", "own")).filter(F.coalesce(F.col("own") <= F.col("last"), few))
    token = _shingle(F.col("w"), F.col("i"), size)
    if short:
        token = F.when(few, F.xxhash64(F.col("w"), F.lit(size))).otherwise(token)
    return rows.select(token.alias("token"), "p")


def _id(p: Column) -> Column:
    return p.bitwiseAND(F.lit(ID))


def _may_match(p: Column, q: Column, percent: int) -> Column:
    """Whether lines can match by their lengths: a line has as many tokens as first words at least, as windows at most."""

    def test(p: Column, q: Column) -> Column:
        most, windows = (F.shiftright(x, 12).bitwiseAND(F.lit(4095)) for x in (p, q))
        return (most == 4095) | (windows == 4095) | (100 * most >= percent * (windows - q.bitwiseAND(F.lit(4095))))

    return (_id(p) != _id(q)) & test(p, q) & test(q, p)


def _few_pairs(several: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """a and b, the ids of lines that share a token of at most COLD rows and may match."""
    two = several.filter("c = 2").select("lo", "hi")
    cold = shared.filter(F.col("c") <= COLD)
    more = cold.select("token", F.col("p").alias("lo")).join(cold.select("token", F.col("p").alias("hi")).hint("shuffle_hash"), "token").filter("lo < hi").select("lo", "hi")
    return two.union(more).filter(_may_match(F.col("lo"), F.col("hi"), percent)).select(_id(F.col("lo")).alias("a"), _id(F.col("hi")).alias("b")).distinct()


def _sets(texts: DataFrame, company: DataFrame, size: int, short: bool) -> DataFrame:
    """at, its id, hot and the n distinct shingles of the lines in company."""
    asked = company.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "hot")).alias("nos"))
    found = texts.join(asked.hint("shuffle_hash"), "doc_id")
    lines = let(F.split("text", "\n"), lambda p: F.transform("nos", lambda k: F.struct(k.line_no.alias("line_no"), k.hot.alias("hot"), F.get(p, k.line_no).alias("line"))))
    line = F.col("one.line")
    rows = found.select("doc_id", F.explode_outer(lines).alias("one")).select("doc_id", "one.line_no", "one.hot", F.xxhash64(line).alias("h"), F.transform(_words(line, short), lambda w: F.xxhash64(w)).alias("w"))
    tokens = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: _shingle(F.col("w"), i, size)))
    if short:
        tokens = F.when(F.size("w").between(1, size - 1), F.array(F.xxhash64(F.col("w"), F.lit(size)))).otherwise(tokens)
    # rows may repeat an id with the same line; they are where the join has dealt them
    rows = rows.groupBy(*AT).agg(F.first("hot").alias("hot"), F.first(F.array_distinct(tokens)).alias("tokens"))
    return rows.select(F.struct(*AT).alias("at"), _id(F.col("h")).alias("id"), "hot", F.size("tokens").alias("n"), "tokens").filter("tokens is not null")


def _rarity(sets: DataFrame) -> Column:
    """For each hash place of shingles its rank by count, from 0 to 32767, as an array."""
    places = sets.select(F.explode_outer("tokens").alias("t")).select(F.col("t").bitwiseAND(F.lit(PLACES - 1)).alias("place"))
    n = {r.place: r.n for r in places.groupBy("place").agg(F.count("*").alias("n")).collect()}  # PLACES rows at most
    rank = [0] * PLACES
    for k, place in enumerate(sorted(range(PLACES), key=lambda p: n.get(p, 0))):
        rank[place] = k // 2
    return F.from_json(F.lit(json.dumps(rank)), "array<bigint>")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """at, the number n of its tokens, and token and pos of those in its rarity prefix."""
    rarity = _rarity(sets)
    key = F.transform("tokens", lambda t: F.shiftleft(F.get(rarity, t.bitwiseAND(F.lit(PLACES - 1))), 48).bitwiseOR(t.bitwiseAND(F.lit(LOW48))))
    n = F.size("tokens")
    return sets.select("at", n.alias("n"), F.posexplode_outer(F.slice(F.sort_array(key), F.lit(1), _prefix_size(n, percent))).alias("pos", "token"))


def _shorter(percent: int) -> Column:
    """A token that the shorter line of a pair can have as its first common one."""
    return (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")


def _meet(rows: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """at, other (earlier) and whether both have tokens enough from here on, for each prefix token that
    lines of both share, if their lengths allow a match."""
    b = others.select("token", F.col("at").alias("other"), F.col("n").alias("m"), F.col("pos").alias("q"))
    n, m = F.col("n"), F.col("m")
    met = rows.join(b, "token").filter((F.col("other") < F.col("at")) & (percent * n <= 100 * m) & (percent * m <= 100 * n))
    return met.select("at", "other", ((100 + percent) * F.least(n - F.col("pos"), m - F.col("q")) >= percent * (n + m)).alias("enough"))


def _pairs(met: DataFrame) -> DataFrame:
    """at, other and the number c of prefix tokens met, if the places of the first common token,
    which has most tokens behind it in both, allow a match."""
    return met.groupBy("at", "other").agg(F.count("*").alias("c"), F.bool_or("enough").alias("enough")).filter("enough").select("at", "other", "c")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(_id(F.col("at.h")).alias("a"), _id(F.col("other.h")).alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The later lines `at` of the pairs of ids whose sets are as near as percent."""
    a, b = sets.select(F.col("id").alias("a"), "at", F.col("tokens").alias("x")), sets.select(F.col("id").alias("b"), F.col("at").alias("other"), F.col("tokens").alias("y"))
    sizes = sets.select(F.col("id").alias("b"), F.col("n").alias("m"))
    sized = pairs.hint("merge").join(sizes.hint("merge"), "b").join(a.hint("merge"), "a")
    near = sized.filter((percent * F.size("x") <= 100 * F.col("m")) & (percent * F.col("m") <= 100 * F.size("x"))).select("b", "at", "x")
    both = near.join(b.hint("merge"), "b").filter("at != other")
    both = both.select(F.greatest("at", "other").alias("at"), F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("sum"))
    return both.filter((100 + percent) * F.col("o") >= percent * F.col("sum")).select("at").distinct()


def removed_lines(docs: DataFrame, percent: int = 80, size: int = 5, short: bool = True) -> DataFrame:
    """doc_id (NULL_ID for null) and removed, the sorted numbers of the lines that go, from 0, for
    the ids with such lines.

    Lines end at line feeds, words at blanks; order is by doc_id, then by place. A line of fewer
    words than `size` stays, or with `short` has one shingle of all its words, so that it goes if an
    earlier line has the same words (a blank line stays); words end at \\x09-\\x0D too then. Matches
    are judged on the input, not on what is left. A null text has no lines, an empty one has one. A
    null doc_id sorts before all others; rows that repeat a doc_id are one document, with different
    lines of one place in the order of their hashes, whose removed lines go from each row. Other
    columns are ignored; an empty table gives an empty result."""
    texts = docs.select(id_in(), F.col("text").cast("string").alias("text"))
    # a line may be there more than once, as rows may repeat a document
    lines = cut(_lines(texts, size, short), "lines")
    firsts = cut(lines.groupBy("h", "g").agg(F.min(F.struct(*AT)).alias("first"), F.count("*").alias("c")), "firsts")
    tokens = cut(_first_prefixes(texts, percent, size, short), "tokens", dictionary=False)
    several = cut(tokens.groupBy("token").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("c")).filter("lo < hi"), "several")
    # few of the tokens: hashed on that side, while the other one streams by and is split where it is hot
    members = cut(tokens.join(several.filter("c > 2").select("token", "c").hint("shuffle_hash"), "token"), "members")
    few = cut(_few_pairs(several, members, percent), "few")
    hot = cut(members.filter(F.col("c") > COLD).select(_id(F.col("p")).alias("id")).distinct(), "hot")
    drop(tokens, several, members)
    company = few.select(F.explode(F.array("a", "b")).alias("id"), F.lit(False).alias("hot")).union(hot.select("id", F.lit(True))).groupBy("id").agg(F.max("hot").alias("hot"))
    asked = firsts.withColumn("id", _id(F.col("h"))).hint("merge").join(company.hint("merge"), "id").select("first.doc_id", "first.line_no", "hot")
    sets = cut(_sets(texts, asked, size, short), "sets", dictionary=False)
    prefixes = cut(_prefixes(sets.filter("hot"), percent), "prefixes")
    several = prefixes.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    shared = cut(prefixes.join(cut(several, "several").hint("shuffle_hash"), "token"), "shared")
    drop(hot, prefixes)

    pivot = shared.groupBy("token").agg(F.min(F.struct("at", "n", "pos")).alias("e")).select("token", "e.*")
    order = Window.partitionBy("at").orderBy(F.desc("c"), "other")
    tried = _pairs(_meet(shared, pivot, percent)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS).select("at", "other")
    tried = cut(tried, "tried")
    first_gone = cut(_verified(_ids(tried), sets, percent), "gone")
    rest = cut(shared.join(first_gone.hint("merge"), "at", "left_anti"), "rest")
    met = _meet(rest, shared.filter(_shorter(percent)), percent).union(_meet(rest.filter(_shorter(percent)), shared, percent))
    # only counts need the other rows of a pair: here they leave inside the join
    pairs = cut(_ids(met.filter("enough").select("at", "other").distinct()).union(few), "pairs")
    drop(shared, rest, tried, few)
    gone = cut(first_gone.union(_verified(pairs, sets, percent)).distinct(), "gone")
    drop(sets, pairs, first_gone)

    verdict = firsts.join(gone.select(F.col("at").alias("first"), F.lit(True).alias("gone")), "first", "left").filter("c > 1 or gone")
    removed = lines.hint("merge").join(cut(verdict, "verdict").hint("merge"), ["h", "g"]).filter(F.col("gone").isNotNull() | (F.col("first") != F.struct(*AT)))
    out = cut(removed.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "removed")
    drop(lines, firsts, gone)
    return out


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """A struct `row` of each row's columns but text, n_lines, removed and kept (the other lines, joined by
    line feeds; null for a null text)."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), id_in(), F.col("text").cast("string").alias("text"))
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = rows.join(removed.hint("shuffle_hash"), "doc_id", "left").withColumn("feeds", feeds)

    def left(p: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "removed"), lambda i: F.get(p, i)), "\n")

    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), left))
    none = F.expr("cast(array() as array<int>)")
    # of rows that repeat an id, one may have fewer lines, or no text
    own = F.when(F.array_max("removed") <= F.col("feeds"), F.col("removed")).otherwise(F.filter("removed", lambda k: k <= F.col("feeds")))
    return rows.select("row", F.coalesce(F.col("feeds") + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(own, none).alias("removed"), kept.alias("kept"))


def line_dedup(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_lines, removed and kept for every row of docs; see removed_lines."""
    own = docs.select("doc_id", "text")
    return without_lines(own, removed_lines(own, percent, size)).select("row.doc_id", "n_lines", "removed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)),
u AS (SELECT line, min((doc_id, i)) AS fst FROM l GROUP BY line),
w AS (SELECT line, fst, list_filter(regexp_split_to_array(line, '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM u),
s AS (SELECT DISTINCT line, fst, array_to_string(w[k:k + 4], ' ') AS t FROM (SELECT line, fst, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT line, count(*) AS n FROM s GROUP BY line),
o AS (SELECT a.line, b.line AS other, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND b.fst < a.fst GROUP BY ALL),
g AS (SELECT DISTINCT o.line FROM o JOIN n x ON x.line = o.line JOIN n y ON y.line = o.other WHERE 180 * o.o >= 80 * (x.n + y.n)),
r AS (SELECT l.doc_id, l.i, (n.line IS NOT NULL AND (g.line IS NOT NULL OR u.fst <> (l.doc_id, l.i))) AS gone, l.line
      FROM l JOIN u USING (line) LEFT JOIN n USING (line) LEFT JOIN g USING (line)),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.parts), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

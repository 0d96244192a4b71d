"""Batch fuzzy search (SIM14-15, JN7, TK6, N15, N17).

Relevance depends on the texts of a query part and a field: it is computed once for each distinct
pair of them. Pairs come from an index that loses none: equality, substrings and word prefixes share the
first three letters of each of the query's words somewhere in the field, so the rarest of them is looked
up; queries of short words are looked up by one or two letters. The fuzzy part needs two like words,
which are found once over the distinct vocabulary by bounds of their Jaro.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as sim
from ..functions import text as tx
from ..functions.jaro import add_jaro_winkler
from ..functions.jaro_join import jaro_candidates

FLOOR, LIMIT = 0.55, 8
#: Like words have a Jaro-Winkler of 0.86; with four equal letters first that is this Jaro.
LIKE_JARO = (0.86 - 0.4) / 0.6


def _grams(text: Column, *sizes: int) -> Column:
    """The distinct pieces of these sizes, without blanks."""

    def pieces(size: int) -> Column:
        last = F.length(text) - (size - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.expr("cast(array() as array<string>)"))

    return F.array_distinct(F.filter(F.concat(*map(pieces, sizes)), lambda p: F.instr(p, " ") == 0))


def like_words(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (qt, ft) of strong words of queries and fields (column w of both) that are evidence:
    the same four letters first and Jaro-Winkler 0.86, or 0.90."""
    pairs = jaro_candidates(asked.select("w"), held.select("w"), LIKE_JARO).toDF("qt", "ft")
    scored = add_jaro_winkler(pairs, {"jw": ("qt", "ft")})
    return scored.filter((F.col("jw") >= 0.90) | ((F.col("jw") >= 0.86) & (F.left("qt", F.lit(4)) == F.left("ft", F.lit(4))))).select("qt", "ft")


def _direct(asked: DataFrame, held: DataFrame) -> DataFrame:
    """q, f: pairs of which f may equal or hold q, or all words of q begin words of f. Such an f holds the
    first three letters of each word of q: it is looked up by the rarest, or if q has short words only by
    the rarest of these. A beginning that no f holds rules q out."""
    words = F.filter(F.split("q", " "), lambda w: w != "")
    q = asked.select("q", F.explode(F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(3))))).alias("k"))
    long = F.max(F.length("k")).over(Window.partitionBy("q")) == 3
    q = q.withColumn("long", long).filter(~F.col("long") | (F.length("k") == 3))
    out = []
    for part, sizes in ((q.filter("long"), (3,)), (q.filter("not long"), (1, 2))):
        f = held.select("f", F.explode(_grams(F.col("f"), *sizes)).alias("k"))
        counts = f.groupBy("k").agg(F.count("*").alias("n"))
        ranked = part.join(counts, "k", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k")).alias("best"))
        out.append(ranked.select("q", F.col("best.k").alias("k")).join(f, "k").select("q", "f"))
    return out[0].union(out[1])


def relevance(asked: DataFrame, held: DataFrame) -> DataFrame:
    """SIM14: asked(q) and held(f), distinct normalised texts, to q, f, rel over 0."""
    asked, held = asked.filter("q <> ''"), held.filter("f <> ''")
    qw = asked.select("q", F.explode(F.array_distinct(tx.strong_tokens(F.col("q")))).alias("w"))
    fw = held.select("f", F.explode(F.array_distinct(tx.strong_tokens(F.col("f")))).alias("w"))
    evidence = like_words(qw, fw)
    fuzzy = qw.join(evidence, F.col("w") == F.col("qt")).select("q", "ft").join(fw.select("f", F.col("w").alias("ft")), "ft").select("q", "f").distinct()
    pairs = _direct(asked, held).distinct().join(fuzzy.withColumn("evidence", F.lit(True)), ["q", "f"], "full")

    qs, fs = F.split("q", " "), F.split("f", " ")
    all_prefix = F.forall(qs, lambda a: F.exists(fs, lambda b: b.startswith(a)))
    fixed = F.when(F.col("q") == F.col("f"), 1.0).when(F.instr("f", F.col("q")) == 1, 0.97).when(F.instr("f", F.col("q")) > 1, 0.90).when(all_prefix, 0.86)
    staged = pairs.withColumn("fixed", fixed).filter(F.col("fixed").isNotNull() | F.col("evidence"))
    need = F.col("fixed").isNull()

    def bare(c: str) -> Column:
        return F.when(need, tx.strip_subtitle(tx.strip_article(F.col(c))))

    jac = sim.token_jaccard(tx.search_tokens(F.col("q")), tx.search_tokens(F.col("f")))
    staged = add_jaro_winkler(staged.select("q", "f", "fixed", F.when(need, jac).alias("jac"), bare("q").alias("x"), bare("f").alias("y")), {"jw": ("x", "y")})
    best = F.greatest(F.when(F.col("jac") >= 0.85, 0.84).otherwise(0.0), "jw")
    best = F.when((F.col("jac") > 0.5) & (best < 0.8), F.greatest(best, 0.6 + F.col("jac") * 0.2)).otherwise(best)
    return staged.select("q", "f", F.coalesce("fixed", best).alias("rel")).filter("rel > 0")


def rank(queries: DataFrame, items: DataFrame, floor: float = FLOOR, limit: int = LIMIT) -> DataFrame:
    """JN7, SIM15, TK6: queries(query_id, query) and items(item_id, ord, titulo, autor) to the best
    `limit` items of each query: query_id, rank, item_id, titulo, autor, score, title_rel, author_rel."""
    title, author = tx.query_parts(F.col("query"))
    q = queries.select("query_id", tx.normalize_search(title).alias("tq"), tx.normalize_search(author).alias("aq")).filter("tq <> '' or aq <> ''")
    it = items.select("item_id", "ord", "titulo", "autor", tx.normalize_search(F.col("titulo")).alias("tf"), tx.normalize_search(F.col("autor")).alias("af"))
    titles, authors = it.select(F.col("tf").alias("f")).distinct(), it.select(F.col("af").alias("f")).distinct()
    on_title = relevance(q.select(F.col("tq").alias("q")).distinct(), titles)
    on_author = relevance(q.select(F.when(F.col("aq") != "", F.col("aq")).otherwise(F.col("tq")).alias("q")).distinct(), authors)
    asked = q.withColumn("wq", F.when(F.col("aq") != "", F.col("aq")).otherwise(F.col("tq")))
    t = asked.join(on_title.toDF("tq", "tf", "title_rel"), "tq").join(it.select("item_id", "tf"), "tf").select("query_id", "item_id", "title_rel")
    a = asked.join(on_author.toDF("wq", "af", "author_rel"), "wq").join(it.select("item_id", "af"), "af").select("query_id", "item_id", "author_rel")
    both = t.join(a, ["query_id", "item_id"], "full").na.fill(0.0, ["title_rel", "author_rel"]).join(q.select("query_id", "aq"), "query_id")
    barred = F.col("aq") != ""
    combo = (F.col("title_rel") * 0.6 + F.col("author_rel") * 0.4 >= floor) & (F.col("title_rel") >= 0.4)
    score = F.when(barred, F.col("title_rel") * 0.7 + F.col("author_rel") * 0.3).otherwise(F.greatest("title_rel", "author_rel"))
    passes = F.when(barred, (F.col("title_rel") >= floor) | combo).otherwise(F.greatest("title_rel", "author_rel") >= floor)
    hits = both.withColumn("score", score).filter(passes).join(it.select("item_id", "ord", "titulo", "autor"), "item_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length(F.coalesce("titulo", F.lit(""))), "ord")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "item_id", "titulo", "autor", "score", "title_rel", "author_rel")


def highlight(text: Column, query: Column) -> Column:
    """The escaped text with its first accent-blind hit of the query's title part marked. The text is
    folded letter by letter, a letter to none, one or more, so that a hit in the folded text leads back to
    the letters it came from: combining marks inside it are marked, one behind its last letter isn't."""
    plain = F.coalesce(text, F.lit(""))
    q = tx.normalize_search(tx.query_parts(query)[0])
    letters = F.when(F.length(plain) > 0, F.transform(F.sequence(F.lit(1), F.length(plain)), lambda i: F.substring(plain, i, F.lit(1)))).otherwise(F.expr("cast(array() as array<string>)"))

    def marked(folds: Column) -> Column:
        at = F.instr(F.array_join(folds, ""), q)
        none = F.lit(0)

        def step(s: Column, piece: Column) -> Column:
            done, k = s["done"] + F.length(piece), s["k"] + 1
            first = F.when((s["first"] == 0) & (done >= at), k).otherwise(s["first"])
            last = F.when((s["last"] == 0) & (done >= at + F.length(q) - 1), k).otherwise(s["last"])
            return F.struct(done.alias("done"), k.alias("k"), first.alias("first"), last.alias("last"))

        start = F.struct(none.alias("done"), none.alias("k"), none.alias("first"), none.alias("last"))

        def cut(x: Column) -> Column:
            before, inside, after = F.substring(plain, F.lit(1), x["first"] - 1), F.substring(plain, x["first"], x["last"] - x["first"] + 1), F.substring(plain, x["last"] + 1, F.length(plain))
            return F.concat(tx.escape_html(before), F.lit("<mark>"), tx.escape_html(inside), F.lit("</mark>"), tx.escape_html(after))

        return F.when((q != "") & (at > 0), tx.let(F.aggregate(folds, start, step), cut)).otherwise(tx.escape_html(plain))

    return tx.let(F.transform(letters, lambda c: F.lower(tx.fold(c))), marked)

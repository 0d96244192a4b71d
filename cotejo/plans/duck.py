"""SQL for the DuckDB twins: the text rules and the exact Jaro-Winkler as expressions."""

from __future__ import annotations

from ..functions import text as tx


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _re(pattern: str) -> str:
    return quoted(pattern)


def fold(x: str, dashes: bool = True) -> str:
    source = tx.SINGLE_QUOTES + tx.DOUBLE_QUOTES + tx.SPACES + (tx.DASHES if dashes else "")
    target = "'" * len(tx.SINGLE_QUOTES) + '"' * len(tx.DOUBLE_QUOTES) + " " * len(tx.SPACES) + ("-" * len(tx.DASHES) if dashes else "")
    return f"translate(strip_accents(coalesce({x}, '')), {quoted(source)}, {quoted(target)})"


def strip_edges(x: str) -> str:
    return f"regexp_replace({x}, {_re(f'^[{tx.EDGE_CLASS}]+|[{tx.EDGE_CLASS}]+$')}, '', 'g')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {_re(f'^[{tx.SPACE_CLASS}]+|[{tx.SPACE_CLASS}]+$')}, '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {_re(f'[{tx.SPACE_CLASS}]+')}, ' ', 'g'))"


def normalize(x: str) -> str:
    return collapse(strip_edges(f"lower({fold(x)})"))


def normalize_verify(x: str) -> str:
    return collapse(strip_edges(f"lower({fold(x, False)})"))


def normalize_search(x: str) -> str:
    return strip_edges(collapse(f"lower({fold(x)})"))


def strip_article(x: str, articles: tuple[str, ...] = tx.ARTICLES) -> str:
    return f"regexp_replace({x}, '^({'|'.join(articles)}) ', '')"


def strip_subtitle(x: str) -> str:
    at = f"least(nullif(instr({x}, ':'), 0), nullif(instr({x}, ' - '), 0))"
    return f"CASE WHEN {at} > 1 THEN trim({x}[1:{at} - 1]) ELSE {x} END"


def strip_subtitle_verify(x: str) -> str:
    at = "coalesce(" + ", ".join(f"CASE WHEN instr({x}, '{s}') > 1 THEN instr({x}, '{s}') END" for s in (":", " - ", " — ", ". ", " / ")) + ")"
    return f"CASE WHEN {at} IS NOT NULL THEN trim({x}[1:{at} - 1]) ELSE {x} END"


def words_in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(quoted(w) for w in names) + ")"


def search_tokens(x: str) -> str:
    """x: a bare form."""
    return f"list_filter(string_split({x}, ' '), lambda w: (length(w) >= 2 OR regexp_full_match(w, '[0-9]+')) AND w NOT IN {words_in(tx.STOP_WORDS)})"


def stem(w: str) -> str:
    return (
        f"CASE WHEN length({w}) < 4 THEN {w} WHEN suffix({w}, 'mente') THEN {w}[1:-6] WHEN suffix({w}, 'ciones') THEN {w}[1:-7] || 'cion' "
        f"WHEN suffix({w}, 'iones') THEN {w}[1:-6] || 'ion' WHEN suffix({w}, 'ies') THEN {w}[1:-4] || 'y' "
        f"WHEN suffix({w}, 'es') AND length({w}) > 4 THEN {w}[1:-3] WHEN suffix({w}, 's') AND length({w}) > 4 THEN {w}[1:-2] ELSE {w} END"
    )


def stem_sentence(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {stem('w')}), ' ')"


def number_word(w: str) -> str:
    return f"CASE {w} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.NUMBER_WORDS.items()) + f" ELSE {w} END"


def jaccard_tokens(bare: str) -> str:
    return f"list_transform(list_transform({search_tokens(bare)}, lambda w: {number_word('w')}), lambda w: {stem('w')})"


def variants(n: str, article: str, sub: str, both: str) -> str:
    return f"list_filter([{n}] || (CASE WHEN {article} <> {n} THEN [{article}] ELSE [] END) || (CASE WHEN {sub} NOT IN ({n}, {article}) THEN [{sub}] ELSE [] END) || (CASE WHEN {both} NOT IN ({n}, {article}, {sub}) THEN [{both}] ELSE [] END), lambda v: v <> '')"


def author_tokens(n: str) -> str:
    parts = f"list_transform(string_split({n}, ','), lambda p: trim(p))"
    flipped = f"(CASE WHEN instr({n}, ',') > 0 THEN trim({parts}[2] || ' ' || {parts}[1]) ELSE {n} END)"
    plain = f"trim(regexp_replace(regexp_replace({flipped}, '\\b[a-z]\\.', '', 'g'), ' +', ' ', 'g'))"
    return f"list_filter(string_split(trim(regexp_split_to_array({plain}, ' +& +| +and +| +y +')[1]), ' '), lambda w: length(w) >= 2)"


def phonetic(w: str) -> str:
    x = f"regexp_replace(lower(strip_accents({w})), '[^a-z]', '', 'g')"
    for c in "bcdfghjklmnpqrstvwxz":
        x = f"replace({x}, '{c}{c}', '{c}')"
    for a, b in (("ph", "f"), ("^kn", "n"), ("^wr", "r"), ("^ps", "s"), ("^x", "s"), ("qu", "k"), ("sh", "x"), ("sch", "x"), ("ch", "x"), ("th", "t"), ("wh", "w"), ("ck", "k"), ("ll", "l"), ("rr", "r"), ("s$", ""), ("c([eiy])", "S\\1"), ("c", "k"), ("g([eiy])", "H\\1")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    x = f"list_transform([{x}], lambda q: q[1:1] || replace(q[2:], 'h', ''))[1]"
    for a, b in (("v", "b"), ("z", "s"), ("j", "H"), ("w", "W"), ("[aeiouy]+", "a"), ("S", "s"), ("H", "h"), ("W", "u")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


def phonetic_sentence(tokens: str) -> str:
    return f"array_to_string(list_filter(list_transform({tokens}, lambda t: {phonetic('t')}), lambda c: c <> ''), ' ')"


def token_jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {both}::DOUBLE / (len(list_distinct({a})) + len(list_distinct({b})) - {both}) END"


def jaro_ctes(pairs: str, out: str, least_window: int = 0, boost: bool = True) -> str:
    """CTEs from a table `pairs`(a, b) to `out`(a, b, jw), over distinct pairs."""
    md = f"greatest(length(a), length(b)) // 2 - 1"
    if least_window:
        md = f"greatest({least_window}, {md})"
    score = "CASE WHEN j < 0.7 THEN j ELSE j + p * 0.1 * (1 - j) END" if boost else "j"
    return f"""
{out}_p AS (SELECT DISTINCT a, b, {md} AS md FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL),
{out}_m AS (SELECT a, b, list_filter(list_reduce(list_transform(range(1, length(a) + 1), lambda i: [i]), lambda acc, e: list_append(acc, coalesce(list_min(list_filter(range(greatest(1, e[1] - md), least(e[1] + md, length(b)) + 1), lambda k: b[k] = a[e[1]] AND NOT list_contains(acc, k))), 0)), []::BIGINT[]), lambda v: v > 0) AS nz FROM {out}_p),
{out}_t AS (SELECT a, b, len(nz)::DOUBLE AS m, len(list_filter(range(1, len(nz) + 1), lambda k: b[nz[k]] <> b[list_sort(nz)[k]])) / 2.0::DOUBLE AS t FROM {out}_m),
{out}_j AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE WHEN coalesce(m, 0) = 0 THEN 0.0::DOUBLE ELSE (m / length(a) + m / length(b) + (m - t) / m) / 3 END AS j,
  CASE WHEN a[1] <> b[1] OR length(a) = 0 OR length(b) = 0 THEN 0 WHEN length(a) < 2 OR length(b) < 2 OR a[2] <> b[2] THEN 1 WHEN length(a) < 3 OR length(b) < 3 OR a[3] <> b[3] THEN 2 WHEN length(a) < 4 OR length(b) < 4 OR a[4] <> b[4] THEN 3 ELSE 4 END AS p FROM {out}_t),
{out} AS (SELECT a, b, {score} AS jw FROM {out}_j)"""


def dice(a: str, b: str) -> str:
    """Bigram Dice of two expressions, on numbered bigrams."""

    def bag(x: str) -> str:
        return f"list_transform(range(1, length({x})), lambda i: {x}[i:i + 1] || len(list_filter(range(1, i + 1), lambda k: {x}[k:k + 1] = {x}[i:i + 1])))"

    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({bag(a)}, {bag(b)})) / (length({a}) + length({b}) - 2) END"


def word_pair(a: str, b: str) -> str:
    """Best word pair of two lists."""
    own, other = f"list_filter({a}, lambda w: length(w) >= 3)", f"list_filter({b}, lambda w: length(w) >= 3)"
    return f"CASE WHEN len({own}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform({own}, lambda p1: coalesce(list_max(list_transform({other}, lambda p2: {dice('p1', 'p2')})), 0.0))) / len({own}) END"


def percent(x: str) -> str:
    return f"CAST(floor(({x}) * 100 + 0.5) AS INTEGER)"

"""Line-first quality rules, as DataFrame expressions only.

Each line with a word is judged alone: navigation (many bars), noise (many
symbols), shouting (capitals only), stuttering (a word four times in a row, in
documents of which a fifth repeats), boilerplate phrases, a missing end of
sentence on a short line, and repetition of an earlier line.  Failing lines are removed; a document that loses more than
half of its word characters is rejected, as is one that fails the base rules.

A null text has no words and fails the base rules.  Every row gives one row.
Runs of three words are compared by 64-bit hashes of which the low bits, as
many as the number of words needs, hold the position.  Where equal hashes turn
out to be of different words, the text's runs are sorted by their words
instead, so the counts are exact for texts of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ENDS = tuple(".!?:;,\"')]…。！？")
PHRASES = ("cookie", "privacy policy", "terms of", "rights reserved", "subscribe", "click here", "javascript", "powered by")
BOILERPLATE = "(?i)" + "|".join(PHRASES)
#: Largest share of a document's word characters that may be lost.
MOST_LOST = 0.5


def count_of(text: Column, signs: str) -> Column:
    """How often the ASCII characters ``signs`` occur.  Replacing one that is absent costs little."""
    rest = text
    for sign in signs:
        rest = F.replace(rest, F.lit(sign), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def characters(text: Column) -> Column:
    """Code points that aren't ASCII white space."""
    return F.length(text) - count_of(text, BLANKS)


def words_of(text: Column) -> Column:
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]"))


def _shift(value: Column, bits: Column, right: bool = True) -> Column:
    return F.call_function("shiftright" if right else "shiftleft", value, bits)


def _good(line: Column, symbols: Column, repeats: Column, phrases: Column) -> Column:
    """Whether a line with a word passes the rules that look at it alone.

    ``symbols``: whether the document has any; ``repeats``: whether a fifth of
    its words are in repeated windows; ``phrases``: whether it holds a phrase of
    boilerplate.  Where not, the rules concerned can't fail.
    """
    size = F.length(line)
    navigation = symbols & (2 * 16 * count_of(line, "|") > size)
    noise = symbols & (30 * count_of(line, SYMBOLS) > size)
    shouting = (size > 12) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}.*\p{Lu}.*\p{Lu}")
    stutter = repeats & line.rlike(r"(?:^|\s)(\S+)(?:\s+\1){3}(?:\s|$)")
    unended = (size < 20) & ~F.substring(F.btrim(line, F.lit(BLANKS)), -1, 1).isin(*ENDS)
    return ~(navigation | noise | shouting | stutter | unended | (phrases & line.rlike(BOILERPLATE)))


def _phrases(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for phrase in PHRASES:
        found = found | F.contains(low, F.lit(phrase))
    return found


#: Hash of three words.
HASH = F.xxhash64


def _exact(ws: Column, many: Column) -> Column:
    """Positions of the runs of three words that are found twice or more, from the words themselves."""
    runs = F.sort_array(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(*[F.get(ws, i + k).alias(f"w{k}") for k in range(3)], i.cast("long").alias("i"))))
    pairs = F.arrays_zip(F.slice(runs, 1, many - 1).alias("x"), F.slice(runs, 2, many - 1).alias("y"))
    same = F.filter(pairs, lambda z: (z["x"]["w0"] == z["y"]["w0"]) & (z["x"]["w1"] == z["y"]["w1"]) & (z["x"]["w2"] == z["y"]["w2"]))
    return F.flatten(F.transform(same, lambda z: F.array(z["x"]["i"], z["y"]["i"])))


def _judged(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns``, and text, ls (lines with a word), left (those that pass, without
    repetitions), n_words, word_chars, n_symbols, n_once and n_repeat_words.

    Each step reads its arrays more than once, which keeps the optimiser from
    moving them into the functions that run for each element.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"_{c}") for c in columns], text.alias("text"), F.lit(1).cast("long").alias("one"))
    keep = [f"_{c}" for c in columns] + ["text"]
    rows = rows.select(*keep, "one", words_of(F.col("text")).alias("ws"), lines_of(F.col("text")).alias("ls"), F.col("text").rlike(f"[{SYMBOLS}]").alias("symbols"), _phrases(F.col("text")).alias("phrases"))
    keep += ["ls", "symbols", "phrases"]
    ws, n = F.col("ws"), F.size("ws")
    many = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice(ws, k, many).alias(f"w{k}") for k in (1, 2, 3)])
    rows = rows.select(*keep, "one", "ws", n.cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), windows.alias("windows"), F.length(F.bin(n)).cast("int").alias("bits"))
    keep += ["n_words", "word_chars"]
    # windows' hashes, each with its position in the low bits: sorted, equal ones are neighbours
    packed = F.transform("windows", lambda z, i: _shift(_shift(HASH(z), F.col("bits")), F.col("bits"), right=False).bitwiseOR(i))
    rows = rows.select(*keep, "one", "ws", "bits", F.sort_array(packed).alias("p"))
    p, pairs = F.col("p"), F.greatest(F.size("p") - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice(p, 1, pairs).alias("x"), F.slice(p, 2, pairs).alias("y"))
    equal = F.filter(zipped, lambda z: _shift(z["x"].bitwiseXOR(z["y"]), F.col("bits")) == 0)
    rows = rows.select(*keep, "ws", (_shift(F.col("one"), F.col("bits"), right=False) - 1).alias("mask"), F.col("bits"), equal.alias("equal"))
    at = F.transform("equal", lambda z: F.struct(*[z[c].bitwiseAND(F.col("mask")).cast("int").alias(c) for c in "xy"]))
    rows = rows.select(*keep, "ws", at.alias("at"))
    ws = F.col("ws")
    other = F.exists("at", lambda z: (F.get(ws, z["x"]) != F.get(ws, z["y"])) | (F.get(ws, z["x"] + 1) != F.get(ws, z["y"] + 1)) | (F.get(ws, z["x"] + 2) != F.get(ws, z["y"] + 2)))
    at = F.when(other, _exact(ws, F.size(ws) - 2)).otherwise(F.flatten(F.transform("at", lambda z: F.array(z["x"].cast("long"), z["y"].cast("long")))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    repeated = F.aggregate(F.sort_array(F.array_distinct(at)), start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3).cast("long"), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    symbols = F.when(F.col("symbols"), count_of(F.col("text"), SYMBOLS).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.select(*keep, repeated.alias("n_repeat_words"), symbols.alias("n_symbols"), F.array_distinct("ls").alias("once"))
    keep += ["n_repeat_words", "n_symbols", "once"]
    rows = rows.select(*keep, (5 * F.col("n_repeat_words") >= F.col("n_words")).alias("repeats"))
    left = F.filter("once", lambda x: _good(x, F.col("symbols"), F.col("repeats"), F.col("phrases")))
    rows = rows.select(*keep, "repeats", left.alias("left"))
    return rows.select(*[F.col(f"_{c}").alias(c) for c in columns], *[c for c in rows.columns if c[0] != "_"])


def _kept_chars() -> Column:
    added = F.aggregate("left", F.lit(0).cast("long"), lambda n, x: n + characters(x))
    return F.when(F.size("left") == F.size("ls"), F.col("word_chars")).otherwise(added)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and verdicts, and the characters that the line rules keep."""
    rows = _judged(docs, "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("ls") - F.size("once")).cast("long").alias("n_dup_lines"), "n_repeat_words", _kept_chars().alias("kept_chars"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("kept_chars") >= (1 - MOST_LOST) * F.col("word_chars"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "kept_chars")


def clean(docs: DataFrame) -> DataFrame:
    """The documents, without failing and repeated lines; those that lose too much are left out."""
    rest = F.struct(*[F.col(c) for c in docs.columns]).alias("rest")
    rows = _judged(docs.select(rest, "text"), "rest").select("rest", "word_chars", "left", _kept_chars().alias("kept_chars"))
    enough = (F.col("kept_chars") > 0) & (F.col("kept_chars") >= (1 - MOST_LOST) * F.col("word_chars"))
    # no filter: the optimiser would move it below all steps and write them out for each use
    rows = rows.select("rest", F.explode(F.when(enough, F.array(F.array_join("left", "\n"))).otherwise(F.array().cast("array<string>"))).alias("cleaned"))
    return rows.select(*[(F.col("cleaned") if c == "text" else F.col(f"rest.{c}")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '[^ \x09-\x0D]+') AS ws FROM t),
p AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
q AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM q WHERE c IS NOT NULL),
e AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, unnest(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^ \x09-\x0D]'))) AS l FROM w),
m AS (SELECT r, l, count(*) AS times FROM l GROUP BY r, l),
s AS (SELECT w.r, w.doc_id, w.x, len(ws) AS n_words, coalesce(e.n, 0) AS rep FROM w LEFT JOIN e ON e.r = w.r),
g AS (SELECT m.r, l, times, length(l) AS z, NOT (
        32 * len(regexp_extract_all(l, '[|]')) > length(l)
        OR 30 * len(regexp_extract_all(l, '[#*$%&|<>]')) > length(l)
        OR (length(l) > 12 AND NOT regexp_matches(l, '\p{Ll}') AND regexp_matches(l, '\p{Lu}.*\p{Lu}.*\p{Lu}'))
        OR (5 * rep >= n_words AND EXISTS (SELECT 1 FROM (SELECT unnest(y) AS a, generate_subscripts(y, 1) AS i FROM (SELECT regexp_extract_all(l, '[^ \x09-\x0D]+') AS y)) QUALIFY a = lead(a) OVER (ORDER BY i) AND a = lead(a, 2) OVER (ORDER BY i) AND a = lead(a, 3) OVER (ORDER BY i)))
        OR (length(l) < 20 AND NOT regexp_matches(l, '[.!?:;,"'')\]\x{2026}\x{3002}\x{ff01}\x{ff1f}][ \x09-\x0D]*$'))
        OR regexp_matches(l, '(?i)cookie|privacy policy|terms of|rights reserved|subscribe|click here|javascript|powered by')) AS good
      FROM m JOIN s ON s.r = m.r),
k AS (SELECT r, sum(times) - count(*) AS dup, sum(CASE WHEN good THEN length(regexp_replace(l, '[ \x09-\x0D]', '', 'g')) ELSE 0 END) AS kept FROM g GROUP BY r),
f AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[ \x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
             CAST(rep AS BIGINT) AS n_repeat_words, CAST(coalesce(kept, 0) AS BIGINT) AS kept_chars FROM s LEFT JOIN k ON k.r = s.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND kept_chars >= 0.5 * word_chars AS kept, kept_chars FROM b
"""

"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts and items become sequences of words: white space splits, signs go, letters are lower-cased. Numbers, names (a
capital inside a sentence) and units (behind a number) become typed placeholders, so that a question asked again
with other values keeps its template. Windows of ``WIDTH`` template words are hashed and joined with those of the
benchmark; a bitmap of its hashes lets only those windows of a text become rows that may meet one. Where a window has placeholders, the words in its slots are compared too: along one alignment, equal
slots of the item must hold equal words in the text and different ones different words. Windows without slots need no
such check and count whatever the others of their alignment hold.

A window with fewer literal words than ``LITERAL_EIGHTHS`` of its width says too little as a template: it is hashed with its own
words instead, on both sides, so it still meets its verbatim copies. Items shorter than ``WIDTH`` words are one window of
their own length, which needs ``LITERAL_LEAST`` literal words to be a template. All windows of an item can be met, so all
count. One pass over the texts makes the windows of all widths that the benchmark has.

A text is contaminated by an item if its matched windows cover at least ``COVERAGE`` of the item's windows, or
``RUN`` windows at least. Items below ``SHORTEST`` words (a parameter) match nothing: at 1, an item of one word
would meet each text with that word.

Null and empty texts and items match nothing. A null doc_id or item_id is a value like others. Repeated rows of the
benchmark are repeated items with one id: they count once; of different texts with one item_id all windows count. Repeated
doc_ids count as one document. Empty tables give an empty result. Texts may be of any length: their windows are rows. Columns other
than doc_id, item_id and text are not read, and ``drop_contaminated`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequora.llm.store import cut

WIDTH, SHORTEST, COVERAGE, RUN = 8, 4, 0.5, 6
#: A template needs so many words that are no placeholders, in eighths of its width; that of a whole short item, so many.
LITERAL_EIGHTHS, LITERAL_LEAST = 5, 3
#: Rows of benchmark windows, or of contaminated documents, up to which they are broadcast; beyond, both sides shuffle.
BROADCAST_ROWS = 200_000
#: Number words and units.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "feet", "miles", "mg", "g", "kg", "pounds", "ounces", "ml", "l", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent", "dollars", "euros", "cents", "degrees")
BLANKS = " \\t\\x0B\\f\\r"
SPACE = f"[{BLANKS}]+"
#: A character that is neither a letter nor a sign of a sentence: it goes before each name, where a text has none of its own.
MARK, OTHER = "\x01", "\x02"
SIGNS = f"[^\\p{{L}}\\p{{N}}{MARK}{BLANKS}]+"
#: Blanks and signs before a capital and a small letter, where the word before does not end a sentence.
BEFORE_NAME = f"([{BLANKS}](?<![.!?:;|{BLANKS}][{BLANKS}])[{BLANKS}]*+[^\\p{{L}}\\p{{N}}{BLANKS}]*+)(?=\\p{{Lu}}\\p{{Ll}})"
NUMBER = "^[0-9]+[a-z]{0,2}$"
#: Placeholders of numbers, names and units, in the place of a hash: the least values there are, so that one comparison finds them.
NUM, NAME, UNIT, PLACEHOLDERS = -(1 << 63), -(1 << 63) + 1, -(1 << 63) + 2, -(1 << 63) + 2


# What looks at single words or windows is dear in a lambda, which is not compiled, so words are found by expressions over whole texts, one lambda makes
# their hashes, and windows are rows before they are hashed. Up to their filter no step has a lambda: then one compiled loop makes and drops them. ``words`` is read twice by the next step: the optimizer then keeps the steps apart.


def with_words(rows: DataFrame) -> DataFrame:
    """Adds ``words``, array of strings: the words in lower case; ``MARK`` is the first character of those that a capital inside a sentence marks as names."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" | ")), F.lit(MARK), F.lit(OTHER))
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, BEFORE_NAME, f"$1{MARK}"), SIGNS, ""))
    return rows.withColumn("words", F.array_remove(F.split(plain, SPACE), ""))


def _raw(word: Column) -> Column:
    return F.replace(word, F.lit(MARK))


def _digit(word: Column) -> Column:
    """Whether a word begins with a digit, that is, stands between "0" and ":" in the order of bytes."""
    return (word >= "0") & (word < ":")


def placeholder(w: Column, before: Column) -> Column:
    """The placeholder of a word, or null; ``before`` is the word before it."""
    named = w.startswith(MARK)
    number = F.when(_digit(w), w.rlike(NUMBER)).otherwise(_raw(w).isin(*NUMBER_WORDS))
    unit = F.when(_raw(w).isin(*UNITS), F.coalesce(_digit(before), F.lit(False))).otherwise(False)
    return F.when(number, F.lit(NUM)).when(named, F.lit(NAME)).when(unit, F.lit(UNIT))


def _sequences(rows: DataFrame, key: str) -> DataFrame:
    """(key, words, t): the words and, of each, its hash or its placeholder."""

    def template(w: Column, i: Column) -> Column:
        # only marks and digits stand before ":", as words have no signs
        likely = (w < ":") | w.isin(*NUMBER_WORDS, *UNITS)
        return F.when(likely, F.coalesce(placeholder(w, F.when(i > 0, F.get("words", i - 1))), F.xxhash64(w))).otherwise(F.xxhash64(w))

    return with_words(rows).select(key, "words", F.transform("words", template).alias("t"))


def _windows(seq: DataFrame, key: str, widths: list[int], longest: int, kept: DataFrame | None = None) -> DataFrame:
    """(key, width, at, h, slots): the windows of some widths; slots is null where a window has none, or is no template.

    Only windows of the longest width come from anywhere in a text; shorter ones belong to short items. With ``kept`` (one row, a bitmap of hashes), windows whose
    hash is not in it go at once, and only those that stay get their slots.
    """
    width, at = F.col("width"), F.col("at")
    own = lambda name: F.slice(name, at + 1, width)
    least = F.when(width == longest, F.lit(-(-LITERAL_EIGHTHS * longest // 8))).otherwise(F.least(width, F.lit(LITERAL_LEAST)))
    literal = F.when(F.col("literals").isNull(), width).otherwise(F.size(F.array_remove(own("literals"), 0)))
    # few windows are met by their own words
    h = F.when(literal >= least, F.xxhash64(own("t"))).otherwise(F.xxhash64(_raw(F.array_join(own("words"), " ")), F.lit("exact")))

    # a text without any slot needs no look at them
    slotted = F.exists("t", lambda x: x <= PLACEHOLDERS)
    held = seq.select(key, "words", "t", F.when(slotted, F.transform("t", lambda x: (x > PLACEHOLDERS).cast("int"))).alias("literals"))
    if kept is not None:
        held = held.join(F.broadcast(kept))  # one row
    places = held.select("*", F.posexplode_outer("t").alias("at", "first")).select("*", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width"))
    hashed = F.struct(F.when(at + width <= F.size("t"), h).alias("h"), ((literal >= least) & (literal < width)).alias("slotted"))
    rows = places.select("*", F.explode(F.array(hashed)).alias("x")).select("*", "x.*").where("h is not null")  # an array of one, so that a hash is not made once for each use
    if kept is not None:
        word = F.get("bits", F.shiftrightunsigned("h", 6).bitwiseAND(F.size("bits") - 1).cast("int"))
        rows = rows.where(F.getbit(word, F.col("h").bitwiseAND(63).cast("int")) == 1)
    # a row that stays takes its own words along, not those of the text
    few = rows.select(key, "width", "at", "h", F.explode(F.array(F.struct("slotted", own("words").alias("words"), own("t").alias("t")))).alias("own"))
    slots = F.transform("own.words", lambda x, i: F.when(F.get("own.t", i) <= PLACEHOLDERS, F.xxhash64(_raw(x))))
    return few.select(key, "width", "at", "h", F.when(F.col("own.slotted"), slots).alias("slots"))


#: Bits of the bitmap of benchmark hashes for each of its windows, and the most words of 64 bits it has (1 MB); with more windows it keeps more of the texts', none is lost.
BITS_PER_WINDOW, MOST_WORDS = 64, 1 << 17


def _bitmap(asked: DataFrame, rows: int) -> DataFrame:
    """(bits): one row, an array of words with the bits of all hashes set; its length is a power of two."""
    words = min(MOST_WORDS, max(64, 1 << max(0, (rows * BITS_PER_WINDOW // 64 - 1).bit_length())))
    word = F.shiftrightunsigned("h", 6).bitwiseAND(words - 1)
    said = asked.select(word.alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    every = asked.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    one = said.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return cut(one.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("bits")), "bitmap")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, run: int = RUN, shortest: int = SHORTEST) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, matched, windows, coverage, verbatim."""
    items = _sequences(benchmark.select("item_id", "text"), "item_id").withColumn("width", F.least(F.size("t"), F.lit(width))).where(F.col("width") >= shortest)
    items = cut(items.dropDuplicates(["item_id", "words"]), "items")
    sizes = sorted(r.width for r in items.select("width").distinct().collect()) or [width]  # at most ``width`` values
    asked = None
    for size in sizes:
        part = _windows(items.where(F.col("width") == size).drop("width"), "item_id", [size], width)
        asked = part if asked is None else asked.unionByName(part)
    asked = cut(asked.withColumnsRenamed({"at": "j", "slots": "wanted"}), "windows")
    rows = asked.count()
    kept = _bitmap(asked, rows)
    if rows <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    texts = _windows(_sequences(docs.select("doc_id", "text"), "doc_id"), "doc_id", sizes, width, kept)
    hits = cut(texts.join(asked, ["width", "h"]).select("doc_id", "item_id", "width", "at", "j", "slots", "wanted"), "hits")

    lane = ["doc_id", "item_id", "width", (F.col("at") - F.col("j")).alias("lane")]
    # slots of one alignment: an item's word must always meet the same word, and that word no other
    pairs = hits.where("wanted is not null").select(*lane, F.explode(F.arrays_zip("wanted", "slots")).alias("p")).select("doc_id", "item_id", "width", "lane", F.col("p.wanted").alias("b"), F.col("p.slots").alias("d")).where("b is not null").distinct()
    keys = ["doc_id", "item_id", "width", "lane"]
    bad = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("b").alias("nb"), F.countDistinct("d").alias("nd"), F.max(F.col("b") != F.col("d")).alias("changed"))
    bad = bad.withColumnsRenamed({k: f"bad_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"bad_{k}")) for k in ("doc_id", "item_id")] + [F.col(k) == F.col(f"bad_{k}") for k in ("width", "lane")]
    lanes = hits.select(*lane, "j", F.col("wanted").isNull().alias("literal")).join(bad, same, "left").where("literal or (n = nb and n = nd)")
    whole = items.groupBy(F.col("item_id").alias("whole_id")).agg(F.max(F.size("t") - F.col("width") + 1).cast("long").alias("windows"))
    matched = lanes.groupBy("doc_id", "item_id").agg(F.countDistinct("j").alias("matched"), (~F.max(~F.col("literal") & F.coalesce("changed", F.lit(False)))).alias("verbatim"))
    share = F.col("matched") / F.col("windows")
    return matched.join(whole, F.col("item_id").eqNullSafe(F.col("whole_id"))).where((share >= coverage) | (F.col("matched") >= run)).select("doc_id", "item_id", "matched", "windows", F.round(share, 6).alias("coverage"), "verbatim")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """The input without the documents that hold a benchmark item."""
    ids = cut(contaminated(docs, benchmark, width, coverage, run).select("doc_id").distinct(), "contaminated")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_anti")


_NUM = ", ".join(f"'{w}'" for w in NUMBER_WORDS)
_UNIT = ", ".join(f"'{w}'" for w in UNITS)
ORACLE = f"""
WITH src AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
 p AS (SELECT k, id, regexp_split_to_array(replace(coalesce(text, ''), chr(10), ' | '), '[ \\t\\x0B\\f\\r]+') AS parts FROM src),
 e AS (SELECT k, id, i, parts[i] AS x, i > 1 AND NOT regexp_matches(parts[i - 1], '[.!?:;|]$') AS inside
       FROM p, unnest(range(1, len(parts) + 1)) AS u(i)),
 w AS (SELECT k, id, i, lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS raw, inside AND regexp_matches(x, '^[^\\p{{L}}\\p{{N}}]*\\p{{Lu}}\\p{{Ll}}+') AS named FROM e),
 v AS (SELECT k, id, raw, named, row_number() OVER (PARTITION BY k, id ORDER BY i) - 1 AS n, lag(raw) OVER (PARTITION BY k, id ORDER BY i) AS prev FROM w WHERE raw <> ''),
 t AS (SELECT k, id, n, raw, CASE WHEN regexp_matches(raw, '^[0-9]+[a-z]{{0,2}}$') OR raw IN ({_NUM}) THEN '<num>' WHEN named THEN '<name>'
       WHEN raw IN ({_UNIT}) AND regexp_matches(prev, '^[0-9]') THEN '<unit>' END AS kind FROM v),
 s AS (SELECT k, id, list(coalesce(kind, raw) ORDER BY n) AS t, list(raw ORDER BY n) AS w, list(CASE WHEN kind IS NOT NULL THEN raw END ORDER BY n) AS r FROM t GROUP BY ALL),
 items AS (SELECT id AS item_id, t, w, r, least(len(t), {WIDTH}) AS width FROM s WHERE k = 'b' AND len(t) >= {SHORTEST}),
 sizes AS (SELECT DISTINCT width, CASE WHEN width = {WIDTH} THEN ceil({LITERAL_EIGHTHS} * width / 8) ELSE least(width, {LITERAL_LEAST}) END AS least FROM items),
 win AS (SELECT k, id, width, i, least, r[i + 1:i + width] AS held, t[i + 1:i + width] AS tt, w[i + 1:i + width] AS ww, len(list_filter(r[i + 1:i + width], lambda y: y IS NULL)) AS literal
         FROM (SELECT s.*, z.width, z.least FROM s, sizes z WHERE k = 'd' UNION ALL SELECT s.*, z.width, z.least FROM s JOIN sizes z ON z.width = least(len(t), {WIDTH}) WHERE k = 'b'), unnest(range(0, len(t) - width + 1)) AS u(i)),
 wh AS (SELECT k, id, width, i, CASE WHEN literal >= least THEN array_to_string(tt, ' ') ELSE '=' || array_to_string(ww, ' ') END AS h, CASE WHEN literal >= least AND literal < width THEN held END AS slots FROM win),
 hits AS (SELECT d.id AS doc_id, b.id AS item_id, width, d.i - b.i AS lane, b.i AS j, b.slots AS wanted, d.slots FROM wh d JOIN wh b USING (width, h) WHERE d.k = 'd' AND b.k = 'b'),
 pairs AS (SELECT DISTINCT doc_id, item_id, width, lane, wanted[q] AS b, slots[q] AS d FROM hits, unnest(range(1, width + 1)) AS u(q) WHERE wanted[q] IS NOT NULL),
 bad AS (SELECT doc_id, item_id, width, lane, count(*) AS n, count(DISTINCT b) AS nb, count(DISTINCT d) AS nd, bool_or(b <> d) AS changed FROM pairs GROUP BY ALL),
 ok AS (SELECT h.*, wanted IS NOT NULL AND coalesce(b.changed, false) AS changed FROM hits h LEFT JOIN bad b USING (doc_id, item_id, width, lane) WHERE wanted IS NULL OR (b.n = b.nb AND b.n = b.nd)),
 m AS (SELECT doc_id, item_id, count(DISTINCT j) AS matched, NOT bool_or(changed) AS verbatim FROM ok GROUP BY ALL),
 whole AS (SELECT item_id, max(len(t) - width + 1) AS windows FROM items GROUP BY ALL)
SELECT doc_id, item_id, matched, windows, round(matched / windows, 6) AS coverage, verbatim
FROM m JOIN whole USING (item_id) WHERE matched / windows >= {COVERAGE} OR matched >= {RUN}
"""

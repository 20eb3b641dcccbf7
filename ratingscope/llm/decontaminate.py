"""Benchmark decontamination by template windows (operator 7), in Spark's own functions only.

A text becomes a template: numbers, units after a number, and names (capitalised words inside a sentence) become
typed placeholders, all else lower-case words. Every window of ``window`` template words of the benchmark items
is joined on its hash with the windows of all texts; a window that is mostly slots is taken word for word. Windows whose
diagonals (text position less item position) lie in one band of ``BAND`` make an occurrence, so inserted and deleted words don't
split it. It is a leak when its windows cover enough of the item's words and the slots that they cover are
consistent: one value of the item always stands opposite one value of the text. So a question with other
names and numbers is caught, and so is the question itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingscope.llm.common import if_small, written

#: Units that count as such right after a number.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|ml|l|h|min|s|ms|mph|kmh|ft|in|usd|eur|gbp|percent|dollars|euros|pounds|miles|hours|minutes|seconds|days|weeks|years"
#: Characters that begin a slot in a marked text: a name (which ends with \\x04), a unit, a number.
NAME, UNIT, NUMBER, END = "\x01", "\x02", "\x03", "\x04"
#: Possessive, as java.util.regex recurses on repeated groups and long runs would overflow its stack; nothing that follows
#: a group could make it give back what it took.
_NUMBER = r"(\p{N}++(?:[.,:/]\p{N}++)*+)"
_NAME = r"([\p{Ll}\p{N},;:] )(\p{Lu}\p{L}*+(?: \p{Lu}\p{L}*+)*+)"
_TOKEN = r"\x01[^\x04]*+\x04|\x02[\p{L}%$€£°]++|\x03\p{N}++(?:[.,:/]\p{N}++)*+|[\p{L}\p{M}]++"
#: Diagonals of one occurrence. Bands overlap by half, so diagonals up to half a band apart are always in one.
BAND = 16
#: Most benchmark windows that are broadcast (some 40 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000


def tokens(text: Column) -> Column:
    """The words of a text, slots marked by their first character."""
    text = F.regexp_replace(text, _NAME, f"$1{NAME}$2{END}")
    numbers = F.regexp_replace(F.regexp_replace(text, rf"(?i)(\p{{N}}) ?({UNITS}|[%$€£°])([^\p{{L}}]|$)", f"$1 {UNIT}$2$3"), _NUMBER, f"{NUMBER}$1")
    text = F.when(text.rlike(r"\p{N}"), numbers).otherwise(text)
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def template(found: Column) -> Column:
    """The template of marked words: of a slot, only its kind."""
    return F.when(F.exists(found, lambda t: t < "\x05"), F.transform(found, lambda t: F.when(t < "\x05", F.substring(t, 1, 1)).otherwise(t))).otherwise(found)


def _slots(found: Column) -> Column:
    return F.size(F.filter(found, lambda t: t < "\x05"))


def _windows(words: Column, marked: Column, size: int, verbatim: bool) -> Column:
    """The windows of a text: by template, and word for word where more than half are slots (of a text with enough of them)."""
    n = F.size(words)
    every = F.sequence(F.lit(1), n - size + 1)
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    out = F.when(n >= size, F.transform(every, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(size), F.slice(words, i, size)).alias("hash")))).otherwise(none)
    if not verbatim:
        return out
    heavy = F.filter(F.transform(every, lambda i: F.struct(i.alias("at"), F.slice(marked, i, size).alias("part"))), lambda w: _slots(w["part"]) * 2 > size)
    raw = F.transform(heavy, lambda w: F.struct(w["at"].alias("at"), F.xxhash64(F.lit(-size), w["part"]).alias("hash")))
    return F.concat(out, F.when((n >= size) & (_slots(words) * 2 > size), raw).otherwise(none))


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, text_key long, size, length, at, verbatim boolean, hash): the windows of each item, shorter ones for an item
    of fewer words. A window of which more than half are slots is hashed word for word. Items that differ in text are different."""
    t = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("item"), F.xxhash64(text_col).alias("text_key"), tokens(F.col(text_col)).alias("marked")).distinct()
    t = t.withColumns({"words": template(F.col("marked")), "length": F.size("marked")}).withColumn("size", F.least(F.lit(window), "length")).where("length > 0")
    t = t.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
    t = t.withColumns({"part": F.expr("slice(words, at, size)"), "raw": F.expr("slice(marked, at, size)")}).withColumn("verbatim", _slots(F.col("part")) * 2 > F.col("size"))
    return t.select("item", "text_key", "size", "length", "at", "verbatim", F.when(F.col("verbatim"), F.xxhash64(-F.col("size"), "raw")).otherwise(F.xxhash64("size", "part")).alias("hash"))


def find_leaks(df: DataFrame, items: DataFrame, window: int = 6, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, n_words long, n_covered long, slots_consistent boolean, _key long): each text with each item that it
    leaks; _key is xxhash64(id, text).

    An item is leaked when windows in one band of diagonals cover ``coverage`` of its words or more and the slots that they
    cover are consistent, in any of its occurrences; n_covered is the most words of such a one. Null and empty texts and
    items leak nothing; repeated rows give one row. A null id is an id of its
    own. An item id with several texts is treated as several items. Only the named columns are read."""
    spark = df.sparkSession
    bench = written(item_windows(items, window, item_id, item_text), "windows")
    sizes = sorted((r[0], r[1]) for r in bench.groupBy("size").agg(F.max("verbatim")).collect())  # window at most
    docs = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("text"))
    if not sizes:
        return spark.createDataFrame([], f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, n_words long, n_covered long, slots_consistent boolean, _key long")
    words = docs.select("id", "_key", tokens(F.col("text")).alias("marked")).select("id", "_key", "marked", template(F.col("marked")).alias("words"))
    each = words.select("id", "_key", F.explode(F.concat(*(_windows(F.col("words"), F.col("marked"), s, v) for s, v in sizes))).alias("w")).select("id", "_key", F.col("w.at").alias("doc_at"), F.col("w.hash").alias("hash"))
    small = bench.select("hash", "item", "text_key", "length", "size", "at")
    hits = each.join(F.broadcast(small) if bench.count() <= BROADCAST_WINDOWS else small, "hash")
    one = ["id", "_key", "item", "text_key", "length", "size"]
    lines = hits.groupBy(*one, (F.col("doc_at") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))  # at most the item's windows
    halves = F.array(*(F.floor((F.col("diagonal") + s) / BAND) * 2 + k for k, s in enumerate((0, BAND // 2))))
    bands = lines.withColumn("band", F.explode(halves)).groupBy(*one, "band").agg(F.sort_array(F.collect_list(F.struct((-F.size("ats")).alias("less"), "diagonal", "ats"))).alias("lines"))
    reach = F.expr("flatten(transform(lines, l -> flatten(transform(l.ats, a -> sequence(a, a + size - 1)))))")
    bands = bands.withColumn("covered", F.array_sort(F.array_distinct(reach))).where(F.size("covered") >= F.col("length") * coverage)
    found = written(bands, "leaks")
    good = _consistent(found, docs, items, item_id, item_text).where("slots_consistent")
    best = good.groupBy("id", "_key", "item", "text_key", "length").agg(F.max("n_covered").alias("n_covered"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), F.col("length").cast("long").alias("n_words"), "n_covered", F.lit(True).alias("slots_consistent"), "_key")


def _consistent(found: DataFrame, docs: DataFrame, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Adds slots_consistent and n_covered: over the covered slots, equal values of the item have equal values opposite. A word of
    the item lies on the diagonal with the most windows of those that cover it, the least of equal ones."""
    marked = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item"), F.xxhash64(item_text).alias("text_key"), tokens(F.col(item_text)).alias("ours")).distinct()
    slotted = marked.where(F.exists("ours", lambda t: t < "\x05"))
    found = found.withColumn("n_covered", F.size("covered").cast("long"))
    by = ["item", "text_key"]
    with_slots = found.join(slotted, by)
    without = found.join(slotted.select(*by).distinct(), by, "left_anti").withColumn("slots_consistent", F.lit(True))
    # only texts that match an item with slots are needed again
    theirs = docs.join(with_slots.select(F.col("_key").alias("k")).distinct(), F.col("_key") == F.col("k"), "left_semi").select("_key", "text").distinct().select("_key", tokens(F.col("text")).alias("theirs"))
    placed = "filter(lines, l -> exists(l.ats, a -> a <= i and i < a + size))[0].diagonal"
    pairs = with_slots.join(theirs, "_key").withColumn("slots", F.expr("filter(covered, i -> ours[i - 1] < '\u0005')"))
    pairs = pairs.withColumn("pairs", F.expr(f"array_distinct(transform(slots, i -> struct(ours[i - 1] AS a, get(theirs, int(i - 1 + {placed})) AS b)))"))
    one_to_one = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    checked = pairs.withColumn("slots_consistent", one_to_one)
    cols = [*found.columns, "slots_consistent"]
    return without.select(cols).unionByName(checked.select(cols))


def decontaminate(df: DataFrame, items: DataFrame, window: int = 6, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text leaks no item, with their columns as they are; rows with null text stay."""
    leaks = find_leaks(df, items, window, coverage, id_col, text_col).select(F.col("_key").alias("_leaked")).distinct()
    leaks = if_small(leaks, "leaked")
    return df.join(leaks, F.xxhash64(df[id_col], df[text_col]) == F.col("_leaked"), "left_anti")


def leaks_sql(window: int = 6, coverage: float = 0.5) -> str:
    """DuckDB SQL for ``find_leaks`` over the tables documents and benchmark."""
    plain = lambda p: p.replace("++", "+").replace("*+", "*").replace("'", "''")
    unit = rf"(\p{{N}}) ?({UNITS}|[%$€£°])([^\p{{L}}]|$)"
    named = f"regexp_replace(text, '{plain(_NAME)}', '\\1' || chr(1) || '\\2' || chr(4), 'g')"
    marked = f"regexp_replace(regexp_replace({named}, '{unit}', '\\1 ' || chr(2) || '\\2\\3', 'gi'), '{plain(_NUMBER)}', chr(3) || '\\1', 'g')"
    words = f"regexp_extract_all(lower({marked}), '{plain(_TOKEN)}')"
    kinds = "list_transform(w, lambda t: CASE WHEN t < chr(5) THEN t[1] ELSE t END)"
    size = f"least({window}, len(k))"
    part = "CASE WHEN len(list_filter(k[pos:pos + size - 1], lambda x: x < chr(5))) * 2 > size THEN '!' || array_to_string(w[pos:pos + size - 1], ' ') ELSE array_to_string(k[pos:pos + size - 1], ' ') END AS part"
    return f"""
WITH b0 AS (SELECT DISTINCT item_id, text AS item, {words} AS w FROM benchmark WHERE text IS NOT NULL),
b1 AS (SELECT *, {kinds} AS k FROM b0 WHERE len(w) > 0),
b2 AS (SELECT *, {size} AS size, unnest(range(1, len(k) - {size} + 2)) AS pos FROM b1),
b3 AS (SELECT item_id, item, w, size, pos, {part} FROM b2),
d0 AS (SELECT DISTINCT doc_id, text, {words} AS w FROM documents WHERE text IS NOT NULL),
d1 AS (SELECT doc_id, text, w, {kinds} AS k FROM d0),
d2 AS (SELECT doc_id, text, w, k, s.size, unnest(range(1, len(k) - s.size + 2)) AS pos FROM d1, (SELECT DISTINCT size FROM b3) s WHERE len(k) >= s.size),
d3 AS (SELECT doc_id, text, w, size, pos, {part} FROM d2),
h AS (SELECT DISTINCT d3.doc_id, d3.text, d3.w AS dw, b3.item_id, b3.item, b3.w AS bw, size, d3.pos - b3.pos AS diagonal, b3.pos FROM d3 JOIN b3 USING (size, part)),
l AS (SELECT doc_id, text, dw, item_id, item, bw, size, diagonal, list(pos) AS ats FROM h GROUP BY ALL),
s AS (SELECT *, unnest([(floor(diagonal / {BAND}.0) * 2)::BIGINT, (floor((diagonal + {BAND // 2}) / {BAND}.0) * 2 + 1)::BIGINT]) AS band FROM l),
g AS (SELECT doc_id, text, dw, item_id, item, bw, size, band, list({{'less': -len(ats), 'diagonal': diagonal, 'ats': ats}} ORDER BY -len(ats), diagonal) AS lines FROM s GROUP BY ALL),
c AS (SELECT *, list_distinct(flatten(list_transform(lines, lambda l: flatten(list_transform(l.ats, lambda a: range(a, a + size)))))) AS covered FROM g),
p AS (SELECT *, list_distinct(list_transform(list_filter(covered, lambda i: bw[i] < chr(5)), lambda i: {{'a': bw[i], 'b': dw[i + list_filter(lines, lambda l: len(list_filter(l.ats, lambda a: a <= i AND i < a + size)) > 0)[1].diagonal]}})) AS pairs FROM c WHERE len(covered) >= len(bw) * {coverage})
SELECT doc_id, item_id, len(bw)::BIGINT AS n_words, max(len(covered))::BIGINT AS n_covered, true AS slots_consistent FROM p
WHERE len(list_distinct(list_transform(pairs, lambda x: x.a))) = len(pairs) GROUP BY doc_id, text, item_id, item, bw
"""

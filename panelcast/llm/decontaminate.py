"""Benchmark decontamination by template windows.

Words are lower-cased; numbers, units behind numbers and names become typed placeholders.  A text has
three forms: its own words, one with the capitalised words inside sentences as names, one with all
capitalised words as names (a name may begin a sentence, and so may any other word).  Every window of
eight words of a document, in each form, is looked up by hash among the windows of every item's forms (of a
document in which no window at every ``need``-th word is found, only those: it can hold no run); what is found is compared word by word:

* a window is *verbatim* if its own words, values included, are the item's; letter case, white space
  and line breaks do not matter;
* else it is a *re-parameterised* one if, over all windows of one form at the same place of the same
  item, equal values of the item always became equal values of the document (slot consistency).

A document is contaminated by an item if a run of six good windows at consecutive words (13 words), or of
all but one windows of an item with fewer, has at least half of its words, rounded down, literal.
Each (document, item) is reported.  Items under eight words cannot be told from chance and are not searched.

Only DataFrame functions.  Defined cases: null or short text is clean; a null ``doc_id`` is a document
like others; null items and repeated items count once; repeated rows are reported once; a very long
text is read whole, by the words of one row; where several forms of a window hold, a verbatim one counts, then the one with
more literal words; other columns are ignored, whatever their names; an empty documents or benchmark table finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import drop_rows, text_key
from panelcast.sources.staging import stage

WIDTH = 8
RUN = 6
NAME, NUMBER, UNIT, POINT = "", "", "", ""
#: Benchmark windows, and places of documents where any of them stands, up to this many are broadcast (eight bytes each); more
#: are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
# Unit names and symbols that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yards mi mile miles mg g kg t lb lbs oz ml cl l liter liters litre litres gal s sec second seconds min minute minutes "
    "h hr hrs hour hours day days week weeks month months year years hz khz mhz ghz kb mb gb tb w kw kwh v mv j kj cal kcal k c f pa kpa bar mph kmh "
    "usd eur gbp dollar dollars cent cents euro euros percent pct degree degrees"
)


def spelled(text: Column) -> Column:
    """Text in which a number is one word, a unit is a word of its own and white space is one blank."""
    units = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
    text = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{NAME}-{POINT}\s\p{{Z}}]+", " ")
    # patterns begin with what is rare, and look behind only there: a look-behind at every character is most of the time
    text = F.regexp_replace(text, r"[.,](?<=\p{N}[.,])(?=\p{N})", POINT)
    return F.regexp_replace(text, rf"(?i)[\p{{N}}&&[\x{{0}}-\x{{FFFF}}]](?=(?:{units})(?![\p{{L}}\p{{N}}]))", "$0 ")


def forms(spelled_text: Column) -> list[Column]:
    """The text itself; with placeholders for values and names inside sentences; with one for every capitalised word."""
    units = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
    text = F.regexp_replace(spelled_text, rf"\p{{N}}+(?:{POINT}\p{{N}}+)*", NUMBER)
    text = F.regexp_replace(text, rf"(?i){NUMBER} (?:{units})(?![\p{{L}}{NUMBER}])", f"{NUMBER} {UNIT}")
    name = rf"\p{{Lu}}\p{{Ll}}+(?![\p{{L}}{NUMBER}])"
    inside = F.regexp_replace(text, rf"(?=\p{{Lu}})(?<=[\p{{Ll}}{NUMBER}{UNIT},;:] ){name}", NAME)
    return [spelled_text, inside, F.regexp_replace(inside, rf"(?=\p{{Lu}})(?<![\p{{L}}{NUMBER}]){name}", NAME)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}{NAME}-{POINT}]+"), "")


def window_hash(form: str, start: Column) -> Column:
    """Hash of the eight words of ``form`` from ``start`` (from 0) on; of single elements, as a slice of a long array reads all of it."""
    return F.xxhash64(*(F.get(form, start + j) for j in range(WIDTH)))


def words_of_forms(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and the words of ``rows``' text in each form: _0, _1, _2."""
    return rows.select(*keys, spelled(F.col("text")).alias("_s")).select(*keys, *(words(f).alias(f"_{k}") for k, f in enumerate(forms(F.col("_s")))))


def windows(rows: DataFrame, *keys: str, at: str | None = None) -> DataFrame:
    """keys, n_words, pos, raw, form, hash, canon (eight words each, joined by blanks) of windows of ``rows``' text in each form: all, or those at the positions ``at``."""
    parts = words_of_forms(rows, *keys, *([at] if at else []))
    joined = lambda k, i: F.concat_ws(" ", *(F.get(f"_{k}", i - 1 + j) for j in range(WIDTH)))
    form = lambda k, i: F.struct(joined(k, i).alias("canon"), window_hash(f"_{k}", i - 1).alias("hash"))
    places = F.col(at) if at else F.sequence(F.lit(1), F.size("_0") - WIDTH + 1)
    each = F.transform(F.when(F.size("_0") >= WIDTH, places), lambda i: F.struct(i.alias("pos"), F.array(*(form(k, i) for k in range(3))).alias("forms")))
    long = parts.select(*keys, F.size("_0").alias("n_words"), F.explode(each).alias("w"))
    long = long.select(*keys, "n_words", "w.pos", F.col("w.forms")[0]["canon"].alias("raw"), F.posexplode("w.forms").alias("form", "f"))
    return long.select(*keys, "n_words", "pos", "raw", "form", "f.hash", "f.canon")


def hits(docs: DataFrame, benchmark_hashes: DataFrame, step: int = 1) -> DataFrame:
    """doc_id, text_key, at (positions of windows among the benchmark's in some form) of documents with any; every ``step``-th window is looked up."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    rows = words_of_forms(rows, "doc_id", "text_key")
    starts = F.when(F.size("_0") >= WIDTH, F.sequence(F.lit(0), F.size("_0") - WIDTH, F.lit(step)))
    of = lambda form: lambda i: window_hash(form, i)
    hashed = [F.transform(starts, of(f"_{k}")) for k in range(3)]
    n = F.floor((F.size("_0") - WIDTH) / step).cast("int") + 1
    each = rows.select("doc_id", "text_key", n.alias("n"), F.posexplode(F.concat(*hashed)).alias("k", "hash"))
    return each.join(benchmark_hashes, "hash", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set(F.col("k") % F.col("n") * step + 1).alias("at"))


def bounded(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to a fixed number of rows, else joined by shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_WINDOWS else table


def texts_of(docs: DataFrame, named: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text_key, text of the rows of ``docs`` named by ``named`` (doc_id, text_key), and ``columns`` of it."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key"))
    return keyed.alias("d").join(named.alias("f"), same, "inner").select("d.doc_id", "d.text_key", "d.text", *(f"f.{c}" for c in columns))


def is_slot(word: Column) -> Column:
    return word.rlike(f"[{NAME}-{UNIT}]")


def templates_of(items: DataFrame) -> DataFrame:
    """item_id, need, form, hash, canon, item_pos, item_raw of the items' windows.

    A window that an item repeats word by word counts once, and one of placeholders only once for
    each way in which its values are equal: an item of numbers meets a table of numbers in few rows.
    """
    known = windows(items, "item_id").where("form = 0 OR canon <> raw")  # without a placeholder the forms are the same
    need = F.greatest(F.lit(1), F.least(F.lit(RUN), F.col("n_words") - WIDTH))  # n_words - WIDTH is one window less than all
    values = F.split("raw", " ")
    equal = F.array_join(F.transform(values, lambda w: F.array_position(values, w).cast("string")), " ")
    alike = F.when(F.forall(F.split("canon", " "), is_slot), equal).otherwise(F.col("raw"))
    first = F.min(F.struct("pos", "raw")).alias("first")
    once = known.groupBy("item_id", "form", "hash", "canon", alike.alias("alike")).agg(first, F.min(need).alias("need"))
    return once.select("item_id", "need", "form", "hash", "canon", F.col("first.pos").alias("item_pos"), F.col("first.raw").alias("item_raw"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Action, stages: doc_id, text_key, item_id, n_windows (longest run), kind of every contaminated document and item."""
    items = benchmark.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    templates = stage(templates_of(items))
    hashes = templates.select("hash").distinct()
    size = templates.agg(F.countDistinct("hash").alias("hashes"), F.min("need").alias("need")).first()
    hashes = bounded(hashes, size.hashes)
    # a reported run has at least ``need`` windows at consecutive words, so one of them is a ``need``-th window of the text:
    # those alone decide which texts are searched whole
    maybe = stage(hits(docs, hashes, size.need or 1).select("doc_id", "text_key"))
    candidates = stage(texts_of(docs, bounded(maybe, maybe.count())))
    found_docs = stage(hits(candidates, hashes))
    size = found_docs.agg(F.count("*").alias("docs"), F.sum(F.size("at")).alias("places")).first()
    texts = texts_of(candidates, bounded(found_docs, size.docs + (size.places or 0)), "at")
    of_docs = windows(texts, "doc_id", "text_key", at="at").where("form = 0 OR canon <> raw").select("doc_id", "text_key", "pos", "raw", "hash", "canon")
    matched = stage(of_docs.join(hashes, "hash", "left_semi").distinct().join(templates, ["hash", "canon"]))
    return runs(good_windows(matched))


def good_windows(matched: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, pos, need, verbatim, literals and last (is the last word literal) of windows that hold."""
    keys = ["doc_id", "text_key", "item_id", "pos"]
    canon = F.split("canon", " ")
    verbatim = matched.where("raw = item_raw").select(*keys, "need", F.struct(F.lit(True).alias("verbatim"), F.lit(WIDTH).alias("literals"), F.lit(1).alias("last")).alias("how"))
    literals = F.size(F.filter(canon, lambda w: ~is_slot(w))).alias("literals")
    last = F.when(is_slot(F.element_at(canon, -1)), 0).otherwise(1).alias("last")
    other = reparameterised(matched).select(*keys, "need", F.struct(F.lit(False).alias("verbatim"), literals, last).alias("how"))
    return verbatim.unionByName(other).groupBy(*keys).agg(F.min("need").alias("need"), F.max("how").alias("how")).select(*keys, "need", "how.*")


def reparameterised(matched: DataFrame) -> DataFrame:
    """Windows that differ from the item's in slot values only, consistently over the item's place in the document in one form."""
    place = ["doc_id", "text_key", "item_id", "form", "shift"]
    other = matched.where("raw <> item_raw").withColumn("shift", F.col("pos") - F.col("item_pos"))
    slots = other.select(*place, F.explode(F.arrays_zip(F.split("canon", " ").alias("c"), F.split("item_raw", " ").alias("i"), F.split("raw", " ").alias("d"))).alias("w"))
    slots = slots.where(is_slot(F.col("w.c"))).select(*place, F.col("w.i").alias("of_item"), F.col("w.d").alias("of_doc"))
    broken = slots.groupBy(*place, "of_item").agg(F.min("of_doc").alias("a"), F.max("of_doc").alias("b")).where("a <> b").select(*place).distinct()
    same = F.lit(True)
    for c in place:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}"))
    return other.alias("o").join(broken.alias("b"), same, "left_anti")


def runs(good: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, n_windows, kind of runs of ``need`` windows of which half of the words are literal."""
    keys = ["doc_id", "text_key", "item_id"]
    numbered = good.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    in_run = Window.partitionBy(*keys, "run").orderBy("pos")
    counted = numbered.withColumn("upto", F.sum("last").over(in_run.rowsBetween(Window.unboundedPreceding, 0)))
    # windows s..p span p - s + 8 words, of which literals(s) - upto(s) + upto(p) are literal; twice that is at least the span, rounded down
    counted = counted.withColumn("begin", 2 * F.col("literals") - 2 * F.col("upto") + F.col("pos")).withColumn("v", F.col("verbatim").cast("int"))
    needs = range(1, RUN + 1)
    best = F.coalesce(*(F.when(F.col("need") == k, F.max("begin").over(in_run.rowsBetween(Window.unboundedPreceding, 1 - k))) for k in needs))
    copied = F.coalesce(*(F.when(F.col("need") == k, F.sum("v").over(in_run.rowsBetween(1 - k, 0))) for k in needs)) >= F.col("need")
    judged = counted.withColumn("enough", F.coalesce(best + 2 * F.col("upto") - F.col("pos") >= WIDTH - 1, F.lit(False))).withColumn("copied", copied)
    whole = judged.groupBy(*keys, "run").agg(F.count("*").alias("n_windows"), F.bool_or("enough").alias("enough"), F.bool_or("copied").alias("copied")).where("enough")
    kind = F.when(F.bool_or("copied"), "verbatim").otherwise("reparameterised")
    return whole.groupBy(*keys).agg(F.max("n_windows").alias("n_windows"), kind.alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are clean; columns unchanged."""
    return drop_rows(docs, contaminated(docs, benchmark))

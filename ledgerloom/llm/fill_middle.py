"""Fill-in-the-middle transformation by relational units.

1. Each text is matched into units, a row for each with its ordinal (posexplode); a window sums their lengths along the document.
2. Each document asks for two cuts, as ordinals of units drawn from a hash of its id. They are joined with the units, and the running
   lengths found there are aggregated to the document's two offsets.
3. The offsets are joined with the texts, which substring cuts and puts together anew.

Texts are shuffled once, by a number of their own for each row, so that no id is hot; all joins, windows and groups use that partitioning. The three
readers of the shuffled rows use the same columns, so Spark shuffles once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A run of white space with the word after it, or white space at the end of the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draw(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th group of eight hex digits of the sha256 of seed:doc_id, as a number; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _form(doc_id: Column, text: Column, seed: int, percent: int, suffix_first: int) -> Column:
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(m)
    plain = (text == "") | marked | (_draw(doc_id, seed, 2) % 100 >= percent)
    return F.when(plain, "plain").when(_draw(doc_id, seed, 3) % 100 < suffix_first, "spm").otherwise("psm")


def unit_ends(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, unit, end): each unit of text by its ordinal from 1, with the code points of the text up to its end. A null text has no units."""
    units = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).alias("_at", "_unit"))
    sizes = units.select(key, (F.col("_at") + 1).cast("long").alias("unit"), F.char_length("_unit").cast("long").alias("_size"))
    upto = F.sum("_size").over(Window.partitionBy(key).orderBy("unit").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select(key, "unit", upto.alias("end"))


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output, the transformed text.

    percent of the texts are cut, suffix_first percent of those with the suffix in front (spm); both draws and both cuts follow from a hash of seed and id.
    The prefix ends after the smaller of two drawn numbers of units, the middle after the larger. Output: psm is <P>prefix<S>suffix<M>middle, spm is
    <S>suffix<P>prefix<M>middle, plain the text.

    A null text counts as empty and stays plain, as does one that holds a mark. White space alone is one unit. A null id is drawn for like an empty
    text. Rows with the same id get the same draws, repeated rows the same result, a row each. A very long text is cut like any other; its units are
    rows that a sort can spill. Other columns of docs are ignored, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).repartition("_row")
    doc_id, text = F.col("_id"), F.col("_text")
    form = _form(doc_id, text, seed, percent, suffix_first)
    ends = unit_ends(rows, "_row", F.when(form != "plain", text)).alias("u")
    counted = rows.select("_row", _draw(doc_id, seed, 0).alias("_h1"), _draw(doc_id, seed, 1).alias("_h2"), F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"))
    one, two = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    cuts = counted.select("_row", "n", F.least(one, two).alias("_a"), F.greatest(one, two).alias("_b")).alias("c")
    wanted = (F.col("u._row") == F.col("c._row")) & ((F.col("unit") == F.col("_a")) | (F.col("unit") == F.col("_b")))
    at = lambda cut: F.coalesce(F.max(F.when(F.col("unit") == F.col(cut), F.col("end"))), F.lit(0))
    offsets = cuts.join(ends.hint("merge"), wanted, "left").groupBy(F.col("c._row").alias("_row")).agg(F.max("n").alias("n"), at("_a").alias("_p"), at("_b").alias("_m"))
    cut = rows.join(offsets.hint("merge"), "_row").select("_id", "n", form.alias("form"), "_text", F.col("_p").cast("int").alias("_p"), F.col("_m").cast("int").alias("_m"))
    prefix, middle, suffix = F.expr("substring(_text, 1, _p)"), F.expr("substring(_text, _p + 1, _m - _p)"), F.expr("substring(_text, _m + 1)")
    first = F.concat(F.lit(PREFIX), prefix)
    last = F.concat(F.lit(SUFFIX), suffix)
    output = F.when(F.col("form") == "psm", F.concat(first, last, F.lit(MIDDLE), middle)).when(F.col("form") == "spm", F.concat(last, first, F.lit(MIDDLE), middle)).otherwise(F.col("_text"))
    known = F.col("form") != "plain"
    return cut.select(
        F.col("_id").alias(id_col),
        "n",
        "form",
        F.when(known, F.col("_p").cast("long")).alias("prefix_chars"),
        F.when(known, (F.col("_m") - F.col("_p")).cast("long")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made from. A text that holds a mark is plain, so the first of each mark is the one put in."""
    body = F.substring_index(output, MIDDLE, 1)
    middle = F.substr(output, F.char_length(body) + len(MIDDLE) + 1)
    mark = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    at = F.instr(body, mark)
    lead, trail = F.substr(body, F.lit(len(PREFIX) + 1), at - len(PREFIX) - 1), F.substr(body, at + len(PREFIX))
    return F.when(form == "psm", F.concat(lead, middle, trail)).when(form == "spm", F.concat(trail, middle, lead)).otherwise(output)

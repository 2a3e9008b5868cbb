"""Joins by substring: which texts hold which names, through an inverted index of q-grams instead of a nested loop.

A text is posted under each of its distinct q-grams. A name is looked for under one of its own grams alone, the one that
fewest texts hold: a text that holds the name holds that gram, so nothing is lost, and a name with a gram that no text
holds drops out at once. What is found there is checked with `contains`. A name shorter than a gram is looked for among
grams of its own length, which is the check itself. A gram that many texts hold is cut into blocks of texts, and the names
that are looked for there go to each of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4
#: Texts of a block of one gram.
BLOCK = 4096
DAY = 86_400_000_000


def _grams(text: Column, size: Column) -> Column:
    """The distinct grams of `size` characters of a text, none if it is shorter."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(names: DataFrame, texts: DataFrame, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """The pairs (name, text) of the distinct, not empty names and texts in which the text holds the name; case counts."""
    name = names.select("name").filter("name <> ''").distinct()
    text = texts.select("text").filter("text <> ''").distinct()
    # only gram lengths that some name asks for are posted
    size = F.least(F.length("name"), F.lit(gram))
    sizes = name.agg(F.sort_array(F.collect_set(size)).alias("sizes"))  # one row of `gram` numbers at most
    asked = name.withColumn("gram", F.explode(_grams(F.col("name"), size)))
    lengths = sizes.select(F.explode("sizes").alias("size"))
    posted = text.join(F.broadcast(lengths), F.length("text") >= F.col("size")).select("text", F.explode(_grams(F.col("text"), F.col("size"))).alias("gram"))
    wanted = asked.select("gram").distinct()
    counts = posted.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    # a gram that no text holds counts as the rarest and ends the search
    rarest = asked.join(counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("g")).select("name", "g.*").filter("texts > 0")
    blocks = F.ceil(F.col("texts") / block).cast("int")
    places = rarest.select("gram", blocks.alias("blocks")).distinct()
    held = posted.join(places, "gram").select("gram", "text", F.pmod(F.xxhash64("text"), F.col("blocks")).cast("int").alias("block"))
    looked = rarest.select("name", "gram", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return looked.join(held, ["gram", "block"]).filter(F.contains("text", "name")).select("name", "text")


# Events that tell of files, by what they tell of
EVENT_KINDS = {4688: "process", 4689: "process", 4697: "task", 4698: "task", 4699: "task", 4700: "task", 4702: "task", 4656: "object", 4663: "object", 4659: "object", 4660: "object"}
RELEVANT = (4656, 4663, 4688, 4696, 4697, 4698, 4699, 4700, 4702, 5140, 5145)


def event_paths(data: DataFrame) -> DataFrame:
    """The paths (path) in rows' named data (data): values with a slash and over 10 characters that are no account's id."""
    values = data.select(*(c for c in data.columns if c != "data"), F.explode(F.map_values("data")).alias("value"))
    good = F.col("value").rlike(r"[\\/]") & (F.length("value") > 10) & ~F.col("value").startswith("S-1-")
    return values.filter(good).withColumn("path", F.lower("value")).drop("value")


def file_events(files: DataFrame, events: DataFrame, most: int = 10, late_us: int = 300_000_000) -> DataFrame:
    """Events (event_id, us, path) whose path holds the name of a file (record, name, created_us), with the time by which the
    file's creation is later; over `late_us` it is an anomaly. Of a file's paths the `most` that were seen first count.
    """
    named = files.withColumn("_name", F.lower("name"))
    seen = events.groupBy(F.lower("path").alias("text")).agg(F.min("us").alias("seen_us"))
    pairs = contained(named.select(F.col("_name").alias("name")), seen).join(seen, "text")
    first = pairs.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct("seen_us", "text"))), 1, most).alias("p")) if most else None
    kept = first.select("name", F.explode("p").alias("p")).select("name", F.col("p.text").alias("text")) if most else pairs.select("name", "text")
    relevant = events.filter(F.col("event_id").isin(*RELEVANT)).withColumn("text", F.lower("path")).drop("path")
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for p in EVENT_KINDS.items() for v in p)), F.col("event_id")), F.lit("file"))
    late = F.col("created_us") - F.col("us")
    out = named.join(kept, named["_name"] == kept["name"]).select("record", "created_us", "text").join(relevant, "text")
    return out.select("record", F.col("text").alias("path"), "event_id", kind.alias("kind"), "us", late.alias("late_us"), (late > late_us).alias("anomaly"))


def journal_evidence(files: DataFrame, journal: DataFrame) -> DataFrame:
    """Files (record, name, created_us, modified_us) that were changed before they were made, with what the journal (name, us,
    reasons) says of names that hold theirs: `copied` without a write, `forged` with a first write between the two times,
    else `odd` over 365 days apart; `quiet` else, and `unknown` if no such name is there.
    """
    early = files.filter("modified_us < created_us").withColumn("_name", F.lower("name"))
    rows = journal.select(F.lower("name").alias("text"), "us", "reasons")
    of = rows.groupBy("text").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("rows"), F.max(F.array_contains("reasons", "FILE_CREATE")).alias("made"),
        F.max(F.arrays_overlap("reasons", F.array(*map(F.lit, ("DATA_OVERWRITE", "DATA_EXTEND", "NAMED_DATA_OVERWRITE", "NAMED_DATA_EXTEND"))))).alias("written"),
    )
    pairs = contained(early.select(F.col("_name").alias("name")), of).join(of, "text")
    found = pairs.groupBy("name").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("rows").alias("rows"), F.max("made").alias("made"), F.max("written").alias("written"))
    out = early.join(found, early["_name"] == found["name"], "left")
    days = F.expr(f"(created_us - modified_us) div {DAY}")
    between = F.col("first_us").between(F.least("created_us", "modified_us") + 1, F.greatest("created_us", "modified_us") - 1)
    verdict = F.when(F.col("rows").isNull(), "unknown").when(F.col("made") & ~F.col("written"), "copied").when(F.col("written") & between, "forged").when(days > 365, "odd").otherwise("quiet")
    return out.select("record", F.coalesce("rows", F.lit(0)).alias("rows"), "first_us", "last_us", days.alias("days"), verdict.alias("verdict"))

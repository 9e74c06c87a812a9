"""Features of large GeoJSON documents, read by many tasks.

A FeatureCollection is one JSON value, often one line, so a JSON reader gives it to one task. Here a file
is read in pieces that end at ``}``, which the text source deals to tasks by byte ranges. Whether a
brace counts depends on what stands before it in the file: whether a string is open, and how deep the braces
are. Both are prefix sums, taken in two levels: within a block (the byte range of one task) for either string state
at its start, then over the blocks of a file, of which there are few. A feature ends where the depth
falls from two to one; its pieces, which may lie in several blocks, meet by its number in the file.

Objects of depth two that are no features (``metadata``, ``crs``, another array) are told apart by the key before
them. Documents have an object as their root; a file is one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Two characters for two: an escape, so that a quote in it is none.
_ESCAPE = r"(?s)\\."
#: What stands before an object: a key and the bracket of its array (and nulls or numbers), a key alone, or
#: (no match) a comma.
_ARRAY_OF = r'(?s)"((?:[^"\\]|\\.)*)"\s*:\s*\[[^\[\]{}"]*$'
_MEMBER = r'(?s)"(?:[^"\\]|\\.)*"\s*:\s*$'


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _outside(parts: Column, inside_first: int) -> Column:
    """Text outside strings, out of a text split at its quotes."""
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == inside_first), "")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with their place and, for either string state at the start of their block, the state and the
    number of open braces before them in the block (state0, depth0; state1, depth1) and the braces they open."""
    text = spark.read.option("lineSep", "}").text(path)
    text = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("seq"))
    plain = F.regexp_replace("value", _ESCAPE, "__")
    text = text.withColumn("quotes", _count(plain, '"') % 2).withColumn("parts", F.split(plain, '"'))
    text = text.withColumn("out0", _count(_outside(F.col("parts"), 0), "{")).withColumn("out1", _count(_outside(F.col("parts"), 1), "{")).drop("parts")
    before = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    text = text.withColumn("parity", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    for start in (0, 1):
        state = (F.col("parity") + start) % 2
        opened = F.when(state == 0, F.col("out0")).otherwise(F.col("out1"))
        closes = F.when((state + F.col("quotes")) % 2 == 0, 1).otherwise(0)
        text = text.withColumn(f"state{start}", state).withColumn(f"open{start}", opened).withColumn(f"net{start}", opened - closes)
        text = text.withColumn(f"depth{start}", F.coalesce(F.sum(f"net{start}").over(before), F.lit(0)))
    return text


def _blocks(pieces: DataFrame) -> DataFrame:
    """(file, block, state, depth) at the start of every block: the prefix over a file's blocks."""
    ends = pieces.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("flips"), F.sum("net0").alias("net0"), F.sum("net1").alias("net1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("state", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    net = F.when(F.col("state") == 0, F.col("net0")).otherwise(F.col("net1"))
    return ends.select("file", "block", "state", F.coalesce(F.sum(net).over(before), F.lit(0)).alias("depth"))


def _object_start(text: Column, first: Column) -> Column:
    """Place (from 1) of the brace that opens the object at the end of ``text``: the first one outside strings, but
    of a file's first object the second, after the root's."""
    wanted = F.when(first, 2).otherwise(1)

    def look(at: Column, part: Column) -> Column:
        braces = F.when(at["number"] % 2 == 0, _count(part, "{")).otherwise(0)
        left = wanted - at["seen"]
        here = (at["hit"] == 0) & (braces >= left)
        place = at["pos"] + F.length(F.when(left == 1, F.substring_index(part, "{", 1)).otherwise(F.substring_index(part, "{", 2))) + 1
        return F.struct((at["pos"] + F.length(part) + 1).alias("pos"), (at["number"] + 1).alias("number"), (at["seen"] + braces).alias("seen"),
                        F.when(here, place).otherwise(at["hit"]).alias("hit"))

    zero = F.struct(*[F.lit(0).alias(n) for n in ("pos", "number", "seen", "hit")])
    return F.aggregate(F.split(F.regexp_replace(text, _ESCAPE, "__"), '"'), zero, look, lambda at: at["hit"])


def read_features(spark: SparkSession, path: str, key: str = "features") -> DataFrame:
    """(file, feature, value): the JSON text of every object in the root's array ``key``, and its place among them.

    Pieces, with the state at their start, are written once to the shared folder, the objects put together from
    them once more: either is read several times. A task holds one block's states or some features, never a document.
    """
    def stored(df: DataFrame) -> DataFrame:
        stage = scratch_path(spark, f"json-{uuid.uuid4().hex}")
        df.write.parquet(stage)
        return spark.read.schema(df.schema).parquet(stage)

    pieces = _pieces(spark, path)
    states = [f"{name}{start}" for name in ("state", "open", "net", "depth") for start in (0, 1)]
    pieces = stored(pieces.select("file", "block", "seq", "value", "quotes", *states))
    blocks = _blocks(pieces).withColumnRenamed("state", "block_state").withColumnRenamed("depth", "block_depth")

    def chosen(name: str) -> Column:
        return F.when(F.col("block_state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    outside = (chosen("state") + F.col("quotes")) % 2 == 0
    ends = outside & (F.col("block_depth") + chosen("depth") + chosen("open") == 2)
    placed = pieces.join(blocks, ["file", "block"]).select("file", "block", "seq", "value", ends.cast("int").alias("ends"))

    counts = placed.groupBy("file", "block").agg(F.sum("ends").alias("ends"))
    over_blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "block", F.coalesce(F.sum("ends").over(over_blocks), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("here", F.coalesce(F.sum("ends").over(within), F.lit(0))).join(counts, ["file", "block"])
    numbered = numbered.withColumn("number", F.col("earlier") + F.col("here"))
    # all pieces up to an end; what follows the last end of a file is no object
    together = numbered.groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"), F.max("ends").alias("whole")).where("whole = 1")
    objects = together.select("file", "number", F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}")).alias("text"))
    objects = objects.withColumn("start", _object_start(F.col("text"), F.col("number") == 0))
    lead = F.substring(F.col("text"), F.lit(1), F.col("start") - 1)
    kind = F.when(F.regexp_like(lead, F.lit(_ARRAY_OF)), F.regexp_extract(lead, _ARRAY_OF, 1)).when(F.regexp_like(lead, F.lit(_MEMBER)), F.lit(""))
    objects = stored(objects.select("file", "number", kind.alias("kind"), F.substring(F.col("text"), F.col("start"), F.length("text")).alias("value")))

    # the array's objects: from its bracket to the next object that another key leads to; few rows per file
    marks = objects.where("kind IS NOT NULL").select("file", "number", "kind")
    first = marks.where(F.col("kind") == key).groupBy("file").agg(F.min("number").alias("first"))
    after = marks.join(first, "file").where("number > first").groupBy("file").agg(F.min("number").alias("after"))
    span = first.join(after, "file", "left")
    kept = objects.join(span, "file").where((F.col("number") >= F.col("first")) & (F.col("after").isNull() | (F.col("number") < F.col("after"))))
    return kept.select("file", (F.col("number") - F.col("first")).cast("int").alias("feature"), "value")

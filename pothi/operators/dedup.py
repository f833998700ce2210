"""Greedy near-duplicate elimination on weighted word vectors.

Kept rows drop every later row whose cosine reaches the threshold; dropped rows
drop nothing.  Distributed, that is the lexicographic maximal independent set
of the graph of similar pairs, found in rounds.

Pairs come from an exact prefix join: with words in one global order, rarest
first, two unit vectors can only reach the threshold when they share a word of
both prefixes, where a prefix ends as soon as what remains is shorter than the
threshold.  A frequent prefix word is split into cells of pairs, and a pair only
leaves its cell when bit maps of the words allow the threshold: a word that one
vector lacks takes its square from what the other can bring in.  Both tests are
exact.  Rows with equal vectors are one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pothi.functions.text import tokens
from pothi.plans.store import materialise


def word_vectors(df: DataFrame, key: str, text: str, words: Column | None = None) -> DataFrame:
    """Rows (id, term, tf, weight) of unit term-frequency vectors; rows without words have none."""
    t = words if words is not None else tokens(F.col(f"`{text}`"))
    tf = df.select(F.col(f"`{key}`").alias("id"), F.explode(t).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    # The sum of squares of counts is exact, so equal vectors get equal weights.
    length = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("id")))
    return tf.withColumn("weight", F.col("tf") / length)


#: Bit maps of a vector, and members of a word of which one cell of pairs holds about so many.
MAPS, CELL = 4, 256


def _maps() -> list[Column]:
    """Bit maps of the words of a group."""
    h = F.xxhash64("term")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    return [F.bit_or(F.when(F.shiftright(h, 6).bitwiseAND(MAPS - 1) == j, bit).otherwise(F.lit(0).cast("long"))).alias(f"map{j}") for j in range(MAPS)]


def _cell_pairs(prefix: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, that share a prefix word (term, id, square, maps) and may reach the threshold."""
    shared = prefix.groupBy("term").agg(F.count("*").alias("m")).where("m > 1").select("term", F.ceil(F.col("m") / CELL).alias("cells"))
    rows = prefix.join(shared, "term").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")))
    left = rows.withColumn("other", F.explode(F.sequence("cell", F.col("cells") - 1))).drop("cells")
    right = rows.drop("cells").withColumnsRenamed({"cell": "other", "id": "id2", "square": "square2"} | {f"map{j}": f"other{j}" for j in range(MAPS)})

    def lacking(one: str, two: str) -> Column:
        return sum((F.bit_count(F.col(f"{one}{j}").bitwiseAND(F.bitwise_not(f"{two}{j}"))) for j in range(MAPS)), F.lit(0))

    most = (F.col("square") - lacking("map", "other")) * (F.col("square2") - lacking("other", "map"))
    return (
        left.join(right, ["term", "other"])
        .where((F.col("cell") < F.col("other")) | (F.col("id") < F.col("id2")))
        .where(most >= threshold * threshold * F.col("square") * F.col("square2") - 1e-6)
        .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        .distinct()
    )


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b, similarity), a < b, of nodes (id, term, tf, weight) with cosine of at least ``threshold``, by prefix join."""
    df_count = vectors.groupBy("term").agg(F.count("*").alias("df"))
    ordered = vectors.join(df_count, "term").select("id", "weight", F.struct("df", "term").alias("place"))
    # What remains from this word on; a word belongs to the prefix while that can still reach the threshold.
    rest = F.sum(F.col("weight") * F.col("weight")).over(
        Window.partitionBy("id").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    prefix = ordered.withColumn("rest", rest).where(F.col("rest") >= threshold * threshold - 1e-9)
    sketch = vectors.groupBy("id").agg(F.round(1 / F.min(F.col("weight") * F.col("weight") / (F.col("tf") * F.col("tf")))).alias("square"), *_maps())
    prefix = materialise(prefix.select("id", F.col("place.term").alias("term")).join(sketch, "id"), "prefix")
    candidates = materialise(_cell_pairs(prefix, threshold), "candidates")
    packed = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v"))
    scored = candidates.join(packed.withColumnsRenamed({"id": "a", "v": "va"}), "a").join(packed.withColumnsRenamed({"id": "b", "v": "vb"}), "b")
    similarity = F.aggregate(
        F.array_intersect(F.map_keys("va"), F.map_keys("vb")), F.lit(0.0), lambda s, t: s + F.col("va")[t] * F.col("vb")[t]
    )
    return scored.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def greedy_kept(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of ``nodes`` (id) that a scan in the order of ids keeps; ``edges`` are (a, b) with a < b.

    Each round keeps the nodes without an earlier undecided neighbour and drops
    their neighbours; rounds follow the longest chain of decisions.
    """
    open_edges = materialise(edges.select("a", "b").distinct(), "edges")
    touched = open_edges.select(F.col("a").alias("id")).union(open_edges.select("b")).distinct()
    undecided = materialise(touched, "undecided")
    dropped, rounds = None, 0
    while True:
        blocked = open_edges.select(F.col("b").alias("id")).distinct()
        keep = undecided.join(blocked, "id", "left_anti")
        drop = materialise(open_edges.join(keep.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "drop")
        if drop.isEmpty():
            break
        dropped = drop if dropped is None else dropped.union(drop)
        rounds += 1
        if rounds % 8 == 0:
            # The plan stays short, however many rounds follow.
            dropped = materialise(dropped, "dropped")
        gone = drop.union(keep)
        open_edges = materialise(
            open_edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(drop.withColumnRenamed("id", "b"), "b", "left_anti"), "edges"
        )
        undecided = materialise(undecided.join(gone, "id", "left_anti"), "undecided")
    return nodes.select("id") if dropped is None else nodes.select("id").join(dropped, "id", "left_anti")


def greedy_dedup(df: DataFrame, key: str, text: str, threshold: float = 0.97, words: Column | None = None) -> DataFrame:
    """Rows (key, kept) of the distinct keys: whether a scan in the order of keys keeps each; rows without words are kept."""
    ids = df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(F.min(F.col(f"`{text}`")).alias("text"))
    t = words if words is not None else tokens(F.col("text"))
    # Equal bags are one node, named by its least key: a scan keeps that one if any.
    bag = F.sha2(F.concat_ws("\u0001", F.array_sort(t)), 256)
    rows = materialise(ids.withColumn("n", F.coalesce(F.size(t), F.lit(0))).withColumn("bag", F.when(F.col("n") > 0, bag).otherwise(F.col("id").cast("string"))), "rows")
    node = rows.where("n > 0").groupBy("bag").agg(F.min_by(F.struct("id", "text"), "id").alias("r")).select("r.id", "r.text")
    vectors = materialise(word_vectors(node, "id", "text", words), "vectors")
    kept = greedy_kept(node, similar_pairs(vectors, threshold)).withColumn("kept", F.lit(True))
    return rows.join(kept, "id", "left").select(F.col("id").alias(key), (F.coalesce("kept", F.lit(False)) | (F.col("n") == 0)).alias("kept"))

"""Connected components of a link table by alternating star contractions."""

from pyspark.sql import functions as F

from millrace.llm.text import written


def _star(links, larger):
    """One contraction of links (a, b): every node's neighbours point to its smallest one.

    ``larger``: only neighbours above the node move; otherwise only those below it and itself.
    A hub's smallest neighbour is found by a grouping that combines in the tasks, and written:
    the join that takes it back to the links may then split a hub's.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    if larger:
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")), "least")
        moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        below = both.where(F.col("b") < F.col("a"))
        least = written(below.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = below.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _state(links):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links):
    """node and root (the smallest node of its component), for every node that has a link.

    ``links`` has integer columns a and b; either order, repeats and loops are fine.  The
    rounds grow with the logarithm of a component's size; each is a written table.
    """
    current = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b")).distinct(),
        "links",
    )
    state = _state(current)
    while True:
        current = written(_star(_star(current, larger=True), larger=False), "links")
        before, state = state, _state(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

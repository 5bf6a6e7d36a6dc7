"""Problem 1: pairwise matches into groups, by deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators import skew
from mosaiq.operators.skew import skew_join
from mosaiq.runtime import Scratch, dense_ids


def _crowded(degrees: DataFrame, key: str, edges: int) -> dict[tuple, int]:
    """Ends of so many edges that joins on them are cut into blocks; each edge has two ends, so that there are fewer than twice the partitions."""
    limit = skew.hot_limit(edges, int(degrees.sparkSession.conf.get("spark.sql.shuffle.partitions")), skew.HOT_ROWS)
    return {(r[key],): r["degree"] for r in degrees.filter(F.col("degree") > limit).select(key, "degree").collect()} if edges > limit else {}


def connected_groups(links: DataFrame, a: str, b: str, *, scratch: Scratch | None = None) -> DataFrame:
    """One row (id, group_id) for each id with a link to another id; group_id is the smallest id it is connected with.

    links: any DataFrame with id columns a and b of one type. Pairs with a null, pairs of an id with itself and
    repeated pairs, in either order, add nothing; other columns are ignored. No pair left: an empty result.

    A round of Boruvka's algorithm: each component takes its smallest outgoing edge, where edges are ordered by (smaller
    end, larger end). That order is total, so the chosen edges form trees whose only cycle is one edge taken from both
    sides; its smaller end becomes the root. Pointer doubling brings every component to its root, edges are relabelled
    with the roots, and those within a component or repeated drop out. The number of components with edges at least
    halves in a round, a tree of depth d takes log2(d) doublings. With this order the root is always the smallest id.

    Ids are first replaced by their rank, so that rounds move 8-byte numbers. A round's map (component -> root) holds
    only components that still have edges; the maps are composed at the end, last first. Each step is a table in the
    shared folder. Joins on roots use skew_join, as one root may hold most of the rows; the ends of most edges are known
    from the choice of each component's edge.
    """
    s = scratch or Scratch(links.sparkSession, "groups")
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    named = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    named = s.save(named.select(lo.alias("lo"), hi.alias("hi")).distinct(), "named")
    ids = dense_ids(s, named.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")), ["id"], "ids")
    hot, ids = _crowded(ids, "id", named.count()), ids.drop("degree")
    edges = skew_join(named, ids.select(F.col("id").alias("lo"), F.col("n").alias("l")), ["lo"], unique=True, hot_left=hot).select("l", "hi")
    edges = skew_join(s.save(edges, "half"), ids.select(F.col("id").alias("hi"), F.col("n").alias("h")), ["hi"], unique=True, hot_left=hot).select("l", "h")
    edges = s.save(edges, "edges-0")
    s.drop("half", "named")

    maps: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(maps)
        few = edges.count() <= skew.HOT_ROWS
        roots, hot = _hook(s, edges, k, few)
        maps.append(roots)
        end = roots.select(F.col("v").alias("l"), F.col("p").alias("rl"))
        step = edges.join(end, "l") if few else s.save(skew_join(edges, end, ["l"], unique=True, hot_left=hot).select("rl", "h"), f"relabel-{k}")
        end = roots.select(F.col("v").alias("h"), F.col("p").alias("rh"))
        step = (step.join(end, "h") if few else skew_join(step, end, ["h"], unique=True, hot_left=hot)).filter("rl <> rh")
        edges = s.save(step.select(F.least("rl", "rh").alias("l"), F.greatest("rl", "rh").alias("h")).distinct(), f"edges-{k + 1}")
        s.drop(f"relabel-{k}", f"edges-{k}")

    if not maps:
        return ids.select("id", F.col("id").alias("group_id"))
    final = maps[-1]
    for k in range(len(maps) - 2, -1, -1):
        later = final.select(F.col("v").alias("p"), F.col("p").alias("q"))
        final = s.save(skew_join(maps[k], later, ["p"], "left", unique=True).select("v", F.coalesce("q", "p").alias("p")), f"map-{k}")
    named_roots = skew_join(final, ids.select(F.col("n").alias("p"), F.col("id").alias("group_id")), ["p"], unique=True)
    return named_roots.join(ids.withColumnRenamed("n", "v"), "v").select("id", "group_id")


def _hook(s: Scratch, edges: DataFrame, k: int, few: bool) -> tuple[DataFrame, dict[tuple, int]]:
    """(v, p): the root p of each component v after one round; and the components of so many edges that joins on them are cut.

    few: there are so few edges that no key can be hot; then a table is written for every second doubling only.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("l").alias("v"), F.col("h").alias("u")), F.struct(F.col("h").alias("v"), F.col("l").alias("u")))).alias("e"))
    # the smallest edge (smaller end, larger end) at v is the one to its smallest neighbour, on whichever side that lies
    chosen = s.save(both.groupBy("e.v").agg(F.min("e.u").alias("p"), F.count(F.lit(1)).alias("degree")), f"chosen-{k}")
    hot, chosen = _crowded(chosen, "v", edges.count()), chosen.select("v", "p")
    back = chosen.select(F.col("v").alias("p"), F.col("p").alias("g"))
    mutual = (F.col("g") == F.col("v")) & (F.col("v") < F.col("p"))
    at = s.save(skew_join(chosen, back, ["p"], unique=True).select("v", F.when(mutual, F.col("v")).otherwise(F.col("p")).alias("p"), F.lit(True).alias("moved")), f"up-{k}-0")
    s.drop(f"chosen-{k}")
    turn = 0
    while not at.filter("moved").isEmpty():
        up = at.select(F.col("v").alias("p"), F.col("p").alias("g"))
        step = skew_join(at.select("v", "p"), up, ["p"], unique=True)
        if few:
            twice = step.select("v", "p", F.col("g").alias("q")).join(step.select(F.col("v").alias("q"), "g"), "q")
            step = twice.select("v", "p", "g")
        at = s.save(step.select("v", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved")), f"up-{k}-{turn + 1}")
        s.drop(f"up-{k}-{turn}")
        turn += 1
    return at.select("v", "p"), hot

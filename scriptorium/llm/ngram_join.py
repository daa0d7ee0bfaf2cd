"""N-gram Jaccard join with set-relation skipping.

Two documents are linked if their sets of five-word shingles have a Jaccard
similarity of 0.75 or more.  ``join_components`` names the component of each
document, so that copies are never expanded into pairs.  The join is that of
:mod:`set_join`; components need connecting links only: a set that is linked
with a pivot has, through it, what the pivot has, and only sets outside the
component of their list's pivot meet other sets.

``join_pairs`` gives every link and ``link_counts`` their number for each
document.  There the pivots are answered on the whole sets, and their answers
give those of similar sets by the differences alone.  With ``less`` = A - X and
``more`` = X - A for each answer X of a pivot A, two answers B and C share
|A| - |less(B) + less(C)| + |more(B) & more(C)| shingles.  Candidates without a
common pivot are compared whole.

Defined results: null and empty texts, and texts without words, have an empty
set and are linked with nothing; texts of fewer than five words have one
shingle, the whole run; equal sets are linked; repeated rows give repeated
results; a null id never names a component if the component has another id;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .set_join import PART, WHOLE, SetTable, pivot_pairs, pivots, rest_pairs
from .shared import materialize

#: Pivots of a list that are asked before its unsettled sets meet all others.
PIVOTS = 3


def links(table: SetTable) -> tuple[DataFrame, DataFrame]:
    """Verified links that connect whatever similar sets there are, and the
    components (``node``, ``root``) that they make."""
    lists = table.lists()
    first = materialize(pivots(lists), "pivots")
    found = materialize(table.verified(pivot_pairs(lists, first)), "links")
    roots = materialize(components(found), "roots")
    ask = first
    for k in range(1, PIVOTS + 1):
        last = k == PIVOTS
        here = lists.join(roots, lists["sid"] == roots["node"], "left").select(*lists.columns, F.coalesce("root", "sid").alias("root"))
        home = first.join(roots, first["p.sid"] == roots["node"], "left").select("h", F.coalesce("root", "p.sid").alias("home"))
        outside = here.join(home, "h").where(F.col("root") != F.col("home")).drop("home")
        outside = materialize(outside, "outside")
        if outside.isEmpty():
            break
        if last:
            mine = here.join(outside.select("h").distinct(), "h", "left_semi")
            pairs = rest_pairs(outside, mine, lambda x, y: x != y, "root")
        else:
            ask = materialize(pivots(lists.join(outside.select("h").distinct(), "h", "left_semi"), ask), "pivots")
            pairs = pivot_pairs(outside.drop("root"), ask)
        found = materialize(found.unionByName(table.verified(pairs)), "links")
        roots = materialize(components(found), "roots")
    return found, roots


def all_links(table: SetTable) -> DataFrame:
    """Every pair ``a < b`` of different similar sets, with the ``shared`` shingles."""
    lists = table.lists()
    first = materialize(pivots(lists), "pivots")
    answers = materialize(_with_differences(table, pivot_pairs(lists, first)), "answers")
    near = rest_pairs(lists.withColumn("k", F.col("sid")), lists.withColumn("k", F.col("sid")), lambda x, y: x < y, "k")
    near = materialize(near, "candidates")
    # One common pivot for each candidate, the smallest; a pivot is an answer of itself, without differences.
    own = answers.select("p", F.col("p").alias("x"), "n", F.col("n").alias("nx"), F.array().cast("array<bigint>").alias("less"), F.array().cast("array<bigint>").alias("more")).dropDuplicates(["p"])
    known = materialize(answers.unionByName(own), "known")
    of = known.select("p", "x")
    common = near.join(of.withColumnRenamed("x", "a"), "a").join(of.withColumnRenamed("x", "b"), ["b", "p"]).groupBy("a", "b").agg(F.min("p").alias("p"))
    common = materialize(common, "common")
    side = lambda c: known.select("p", F.col("x").alias(c), F.col("n").alias(f"n_{c}"), *[F.col(d).alias(f"{d}_{c}") for d in ("nx", "less", "more")])
    both = common.join(side("a"), ["p", "a"]).join(side("b").drop("n_b"), ["p", "b"])
    shared = F.col("n_a") - F.size(F.array_union("less_a", "less_b")) + F.size(F.array_intersect("more_a", "more_b"))
    derived = both.select("a", "b", "nx_a", "nx_b", shared.alias("shared")).where(WHOLE * F.col("shared") >= PART * (F.col("nx_a") + F.col("nx_b") - F.col("shared"))).select("a", "b", "shared")
    rest = _with_differences(table, near.join(common, ["a", "b"], "left_anti"))
    rest = rest.select(F.col("p").alias("a"), F.col("x").alias("b"), (F.col("n") - F.size("less")).alias("shared"))
    return derived.unionByName(rest)


def _with_differences(table: SetTable, pairs: DataFrame) -> DataFrame:
    """The similar ones of the pairs as ``p, x`` with sizes and differences."""
    found = table.verified(pairs)
    sets = table.sets.select("sid", F.col("n").alias("size"), "hashes")
    one = sets.select(F.col("sid").alias("a"), F.col("size").alias("n"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("sid").alias("b"), F.col("size").alias("nx"), F.col("hashes").alias("hb"))
    return found.join(one, "a").join(two, "b").select(F.col("a").alias("p"), F.col("b").alias("x"), "n", "nx", F.array_except("ha", "hb").alias("less"), F.array_except("hb", "ha").alias("more"))


def join_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``left, right, shared, jaccard`` of every pair of similar documents.

    A pair stands once, the smaller id left; a document has no pair with a row
    of its own id.  Null ids have no pairs.
    """
    table = SetTable(docs, False, id_col, text_col)
    found = materialize(all_links(table), "all-links")
    rows = table.members.where("n > 0 and id is not null").select("id", "sid", "n").distinct()
    mine = rows.select(F.col("id").alias("i"), F.col("sid").alias("a"), F.col("n").alias("ni"))
    yours = rows.select(F.col("id").alias("j"), F.col("sid").alias("b"), F.col("n").alias("nj"))
    equal = mine.join(yours, F.col("a") == F.col("b")).select("i", "j", "ni", "nj", F.col("ni").alias("shared"))
    other = found.join(mine, "a").join(yours, "b").select("i", "j", "ni", "nj", "shared")
    out = equal.where("i < j").unionByName(other.where("i <> j"))
    jaccard = F.col("shared") / (F.col("ni") + F.col("nj") - F.col("shared"))
    out = out.select(F.least("i", "j").alias("left"), F.greatest("i", "j").alias("right"), F.col("shared").cast("long").alias("shared"), jaccard.alias("jaccard"))
    return out.groupBy("left", "right").agg(F.max(F.struct("jaccard", "shared")).alias("m")).select("left", "right", "m.shared", "m.jaccard")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_links`` for every row: the other rows that it is similar to.

    Rows of equal sets are counted without being paired.
    """
    table = SetTable(docs, False, id_col, text_col)
    found = materialize(all_links(table), "all-links")
    copies = table.first.select("sid", "copies")
    ends = found.select(F.col("a").alias("x"), F.col("b").alias("sid")).unionByName(found.select(F.col("b").alias("x"), F.col("a").alias("sid")))
    others = ends.join(copies, "sid").groupBy(F.col("x").alias("sid")).agg(F.sum("copies").alias("others"))
    by_set = copies.join(others, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return table.members.join(by_set, "sid", "left").select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``."""
    table = SetTable(docs, False, id_col, text_col)
    _, roots = links(table)
    first = table.first.select("sid", F.col("okey.id").alias("first_id"), "copies")
    named = first.join(roots, first["sid"] == roots["node"], "left").select("sid", "first_id", "copies", "root")
    least = named.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least"))
    named = named.where("root is not null or copies > 1").join(least, "root", "left").select("sid", F.coalesce("least", "first_id").alias("component"))
    out = table.members.join(named, "sid", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that another one of their component stands for.

    The one with the smallest id stays; documents with null ids and rows with
    the id of their component stay.
    """
    joined = join_components(docs, id_col, text_col)
    gone = joined.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

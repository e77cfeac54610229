"""Document fingerprints by invertible Bloom look-up sketches, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import RID, Workspace, partitions, settled, text_rows

#: Subtables of a fingerprint and cells in each; subtables of a pair's own sketch and cells for each key in them, at least (only cells in use are rows, so more cost nothing, and one pass peels nearly all), and how much larger the next one is once that has failed.
TABLES, CELLS, OWN_TABLES, ROOM, LARGER = 3, 8, 2, 32, 4
#: A paragraph ends with its line, and within a long line after a sentence.
_END = r"\n|(?<=[.!?])\s+"


def paragraphs(text: Column) -> Column:
    """64-bit digests of the paragraphs of a text, blank ones left out, repeated ones kept."""
    return F.transform(F.filter(F.split(text, _END), lambda p: F.trim(p) != ""), lambda p: F.xxhash64(p))


def neighbours(rows: DataFrame, work: Workspace) -> DataFrame:
    """(RID, next, previous, asked): the next and previous row in descending doc_id order, as a ring, and n_chars / 3 of the previous.

    Ids are dealt by range; within a part the next row is a window's lead, and a table of the
    parts' first rows joins the parts. Rows of one id follow each other by RID, null ids come
    last.
    """
    spark = rows.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col(RID)]
    ids = rows.select(RID, "doc_id", F.length("text").cast("long").alias("n_chars"))
    dealt = work.put(ids.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "order")
    first = dealt.groupBy("part").agg(F.max(F.struct("doc_id", (-F.col(RID)).alias("r"))).alias("f")).select("part", (-F.col("f.r")).alias("first"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = first.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(whole)).alias("after"))
    ring = dealt.withColumn("next", F.lead(RID).over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(first), "part").select(RID, F.coalesce("next", "after").alias("next"), F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    back = ring.select(F.col("next").alias(RID), F.col(RID).alias("previous"), F.col("third").alias("asked"))
    return ring.join(back, RID)


def versions(docs: DataFrame, work: Workspace) -> DataFrame:
    """(RID, doc_id, n_chars, next, next_doc_id, edited_sha256, and the different paragraph digests a of the text and b of its edited text).

    Texts are shuffled once, to meet their place in the ring; what a text lends to the one
    before is shuffled again.
    """
    rows = text_rows(docs)
    base = rows.join(neighbours(rows, work), RID)
    lent = base.select(F.col("previous").alias(RID), F.col("doc_id").alias("next_doc_id"), F.expr("substring(text, 1, asked)").alias("lent"))
    both = base.join(lent, RID).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - third as int))"), F.col("lent")))
    digests = {x: F.array_distinct(paragraphs(F.col(c))).alias(x) for x, c in (("a", "text"), ("b", "edited"))}
    return work.put(both.select(RID, "doc_id", "n_chars", "next", "next_doc_id", F.sha2("edited", 256).alias("edited_sha256"), *digests.values()), "versions")


def _cell(key: Column, table: int, cells: Column) -> Column:
    return (F.pmod(F.xxhash64(key, cells * 4 + table), cells) + cells * table).cast("long")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-7))


def sketches(keys: DataFrame, tables: int, *by: str) -> DataFrame:
    """(*by, cells, cell, n, key, check) of keys (*by, cells, n, key): by place the counts, and the exclusive-ors of the keys and of their check sums, of the cells in use.

    Each key has a cell in each of the subtables of so many cells. Keys with n = -1 take a
    sketch away from another of the same size, cell by cell.
    """
    placed = keys.select(*by, "cells", "n", "key", _check(F.col("key")).alias("check"), F.explode(F.array(*(_cell(F.col("key"), t, F.col("cells")) for t in range(tables)))).alias("cell"))
    cells = placed.groupBy(*by, "cells", "cell").agg(F.sum("n").alias("n"), F.expr("bit_xor(key)").alias("key"), F.expr("bit_xor(check)").alias("check"))
    return cells.where("n != 0 or key != 0 or check != 0")


def peel(difference: DataFrame, tables: int) -> DataFrame:
    """(RID, pair, left, differ): by pair the keys recovered from a subtracted sketch, counted, and the cells that did not give theirs.

    A cell that holds one key gives it away: n is 1 or -1 and the check sum agrees. Each key has
    one cell in each subtable. So a subtable gives what is alone in it, its other cells are done
    with, and its keys leave the later subtables. If in the end every cell of the last one holds
    one key, all keys are known. All steps work on one pair's cells within one partition.
    """
    at, cells = difference, F.col("cells")
    row = lambda cell, n, key, check: F.struct(cell.cast("long").alias("cell"), n.cast("long").alias("n"), key.alias("key"), check.alias("check"))
    zero = F.lit(0).cast("long")
    pure = lambda t: (F.abs("n") == 1) & (F.col("check") == _check(F.col("key"))) & (F.col("cell") == _cell(F.col("key"), t, cells))
    for t in range(tables - 1):
        own = row(F.col("cell"), F.col("n"), F.col("key"), F.col("check"))
        later = [row(_cell(F.col("key"), u, cells), -F.col("n"), F.col("key"), F.col("check")) for u in range(t + 1, tables)]
        steps = F.when((F.col("cell") < 0) | (F.col("cell") >= cells * (t + 1)), F.array(own)).when(pure(t), F.array(*later, row(F.lit(-1), F.lit(1), zero, zero)))
        at = at.select(RID, "pair", "cells", F.explode(steps).alias("s")).select(RID, "pair", "cells", "s.*")
        at = at.groupBy(RID, "pair", "cells", "cell").agg(F.sum("n").alias("n"), F.expr("bit_xor(key)").alias("key"), F.expr("bit_xor(check)").alias("check")).where("n != 0 or key != 0 or check != 0")
    last = pure(tables - 1)
    given = F.when(F.col("cell") < 0, F.col("n")).when(last, 1).otherwise(0)
    return at.groupBy(RID, "pair").agg(F.count(F.when((F.col("cell") >= 0) & ~last, 1)).alias("left"), F.sum(given).alias("differ"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(RID, fingerprint, edited_fingerprint) of versions: the cells in use as text, place, count, key and check sum of each."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("v"), F.col(x).alias("d")) for k, x in enumerate("ab"))))
    keys = rows.select(RID, "a", "b").repartition(partitions(rows.sparkSession), RID).select(RID, sides.alias("s")).select(RID, "s.v", F.lit(CELLS).cast("long").alias("cells"), F.lit(1).cast("long").alias("n"), F.explode("s.d").alias("key"))
    cell = F.struct("v", "cell", F.concat_ws("-", F.hex("cell"), F.hex("n"), F.hex("key"), F.hex("check")).alias("s"))
    text = lambda k: F.array_join(F.transform(F.filter("c", lambda c: c["v"] == k), lambda c: c["s"]), ".")
    found = sketches(keys, TABLES, RID, "v").groupBy(RID).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return found.select(RID, text(0).alias("fingerprint"), text(1).alias("edited_fingerprint"))


def differences(pending: DataFrame, rows: DataFrame, tables: int) -> DataFrame:
    """The subtracted sketches, (RID, pair, cells, cell, n, key, check), of pending pairs (RID, pair, other, cells): pair 1 is a text and its edited text, pair 2 a text and the other."""
    n = partitions(rows.sparkSession)
    one = rows.select(RID, F.col("a").alias("x"), F.col("b").alias("edited"))
    other = rows.select(F.col(RID).alias("other"), F.col("a").alias("next"))
    far = pending.where("pair = 2").join(other, "other").select(RID, "pair", "cells", F.col("next").alias("y"))
    near = pending.where("pair = 1").select(RID, "pair", "cells", F.lit(None).cast("array<bigint>").alias("y"))
    pairs = near.unionByName(far).repartition(n, RID).join(one.repartition(n, RID), RID)
    sides = F.array(F.struct(F.lit(1).cast("long").alias("n"), F.col("x").alias("d")), F.struct(F.lit(-1).cast("long").alias("n"), F.when(F.col("pair") == 1, F.col("edited")).otherwise(F.col("y")).alias("d")))
    keys = pairs.select(RID, "pair", "cells", F.explode(sides).alias("s")).select(RID, "pair", "cells", "s.n", F.explode("s.d").alias("key"))
    return sketches(keys, tables, RID, "pair")


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id).

    Likeness is the share of different paragraphs in common: those that differ come from
    peeling the difference of two sketches. All pairs begin with their fingerprints. Of pairs
    that don't peel, sketches are taken again, with two subtables of ROOM times as many cells as
    both have paragraphs, and LARGER times as many each time that fails, until all peel.
    Two texts without paragraphs are alike (1). A document alone is its own next.
    """
    work = Workspace(docs.sparkSession)
    rows = versions(settled(docs), work)
    size = rows.select(RID, F.col("next").alias("other"), F.size("a").alias("na"), F.size("b").alias("nb"))
    next_size = size.select(F.col(RID).alias("other"), F.col("na").alias("nc"))
    enough = lambda x, y: F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(2.0 * CELLS), (x + y) * float(ROOM))))).cast("long")
    pairs = F.array(F.struct(F.lit(1).alias("pair"), enough(F.col("na"), F.col("nb")).alias("next_cells")), F.struct(F.lit(2).alias("pair"), enough(F.col("na"), F.col("nc")).alias("next_cells")))
    known = work.put(size.join(next_size, "other"), "sizes")
    pending, solved, turn = known.select(RID, "other", F.explode(pairs).alias("p")).select(RID, "other", "p.*").withColumn("cells", F.lit(CELLS).cast("long")), [], 0
    while True:
        tables = OWN_TABLES if turn else TABLES
        done = work.put(peel(differences(pending.select(RID, "pair", "other", "cells"), rows, tables), tables), f"peeled-{turn}")
        solved.append(done.where("left = 0").select(RID, "pair", "differ"))
        failed = pending.join(done.where("left > 0").select(RID, "pair"), [RID, "pair"]).select(RID, "other", "pair", F.col("next_cells").alias("cells"), (F.col("next_cells") * LARGER).alias("next_cells"))
        pending, before = work.put(failed, f"pending-{turn}"), pending if turn else None
        if before is not None:
            work.drop(before)
        turn += 1
        if not pending.take(1):
            break
    found = reduce(DataFrame.unionByName, solved).groupBy(RID).agg(*(F.max(F.when(F.col("pair") == k, F.col("differ"))).alias(f"d{k}") for k in (1, 2)))

    def likeness(x: Column, y: Column, differ: Column) -> Column:
        d = F.coalesce(differ, F.lit(0))
        common = (x + y - d) / 2
        return F.when(x + y == 0, 1.0).otherwise(common / (common + d))

    out = rows.select(RID, "doc_id", "n_chars", "edited_sha256", "next_doc_id").join(known.select(RID, "na", "nb", "nc"), RID).join(fingerprint(rows), RID, "left").join(found, RID, "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("na"), F.col("nb"), F.col("d1")).alias("near_edited"), likeness(F.col("na"), F.col("nc"), F.col("d2")).alias("near_next"), "next_doc_id",
    )

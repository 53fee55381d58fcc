"""Exact duplicates by naming blocks.

Each text is cut into blocks of a fixed size. All blocks of the corpus are sorted and each distinct
block gets its rank as its name, a whole number. Adjacent names of a text are then paired, the pairs
sorted and named in the same way, and so on until each text has one name. Two texts with the same
number of rounds have the same last name exactly if they are equal: no hash takes part.

Blocks are sorted by a hash, then by themselves, and dealt out by range over (hash, row), so the rows of
one block, however many, spread over as many tasks as their share asks for. A task ranks the blocks it
has; those of its first and its last hash, which other tasks may have too, are ranked among all tasks'
by comparing the blocks themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import forget, kept, mapped, number_rows, scratch, small, without_rows, written

#: Bytes of a block.
BLOCK = 4096
#: What equal texts may differ in.
SPACES = r"[\x20\x09-\x0D]+"

_CARRIED = "uid long, pos long, blocks long, doc_id long, n_points long, text_sha256 string"


_RANKED = f"{_CARRIED}, rank long, task long, h long, key binary, is_first boolean"
#: Tasks whose offsets go to every executor, some 100 bytes each; more are joined by a shuffle.
BROADCAST_TASKS = 200_000


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the blocks of one task, sorted by (hash, block); last a row for each block of its first and last hash."""
    task, rank = TaskContext.get().partitionId(), -1
    first_h, first, h, of_h = None, [], None, []  # of_h: (rank, block) of the hash at hand
    last_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes, keys, n = batch.column(0), batch.column(1), batch.num_rows
        new_h = pc.not_equal(hashes[1:], hashes[:-1])
        new = pc.cast(pc.or_(new_h, pc.not_equal(keys[1:], keys[:-1])), pa.int64())
        begins = 0 if hashes[0].as_py() == h and keys[0].as_py() == last_key else 1
        ranks = pc.add(pc.cumulative_sum(pa.concat_arrays([pa.array([begins], pa.int64()), new])), rank)
        # Only the blocks of the hash that was at hand before, of the batch's first and of its last are looked at.
        where = pc.indices_nonzero(pc.fill_null(new_h, False)).to_pylist()
        runs = [(0, where[0] + 1), (where[-1] + 1, n)] if where else [(0, n)]
        for a, b in runs:
            here = hashes[a].as_py()
            if here != h:
                if h is not None and h == first_h:
                    first = of_h
                h, of_h, last_key = here, [], None
                first_h = here if first_h is None else first_h
            begun = pc.indices_nonzero(new[a : b - 1]).to_pylist() if b - a > 1 else []
            for k in [a, *(a + x + 1 for x in begun)]:
                if keys[k].as_py() != last_key:
                    last_key = keys[k].as_py()
                    of_h.append((ranks[k].as_py(), last_key))
        rank = ranks[-1].as_py()
        yield _rows(batch.columns[2:], ranks, [task] * n, None)
    if h is not None:
        ends = [(r, first_h, k, True) for r, k in (of_h if h == first_h else first)] + [(r, h, k, False) for r, k in (of_h if h != first_h else [])]
        # The last row has the number of ranks.
        yield _rows(None, pa.array([r for r, *_ in ends] + [rank + 1], pa.int64()), [task] * (len(ends) + 1), [*(x[1:] for x in ends), (None, None, None)])


def _rows(carried: list | None, ranks: pa.Array, task: list[int], ends: list | None) -> pa.RecordBatch:
    kinds, names = [pa.int64()] * 5 + [pa.string()], ["uid", "pos", "blocks", "doc_id", "n_points", "text_sha256"]
    n = len(ranks)
    carried = carried or [pa.nulls(n, k) for k in kinds]
    more = [pa.array(x, k) for x, k in zip(zip(*ends, strict=True) if ends else [[None] * n] * 3, (pa.int64(), pa.binary(), pa.bool_()), strict=True)]
    return pa.RecordBatch.from_arrays([*carried, ranks, pa.array(task, pa.int64()), *more], [*names, "rank", "task", "h", "key", "is_first"])


def _hash(key: str) -> Column:
    """What blocks are sorted by first; equal hashes of different blocks cost time, no more."""
    return F.xxhash64(key)


def _named(rows: DataFrame) -> DataFrame:
    """rows (key binary and the carried columns) with the rank of (hash, key) among all distinct ones as name, written out."""
    # Written once: the ranges are made from a sample, for which all would be computed twice.
    held = written(rows.select(_hash("key").alias("h"), "key", "uid", "pos", "blocks", "doc_id", "n_points", "text_sha256"), "blocks")
    ordered = held.repartitionByRange("h", "uid", "pos").sortWithinPartitions("h", "key")
    ranked = written(mapped(ordered, _ranked, _RANKED), "names")
    forget(held)
    ends = ranked.where("uid is null and h is not null").select("task", "rank", "h", "key", "is_first")
    inner = ranked.where("uid is null and h is null").select("task", F.col("rank").alias("n"))
    by_task = ends.groupBy("task").agg(F.count(F.when(F.col("is_first"), 1)).alias("n_first"), F.count(F.when(~F.col("is_first"), 1)).alias("n_last"), F.min(F.when(F.col("is_first"), F.col("h"))).alias("h"))
    by_task = inner.join(small(by_task), "task").withColumn("own", F.col("n") - F.col("n_first") - F.col("n_last"))
    # In order of hashes: the blocks of a border's hash, then what is within the task that begins with it.
    of_border = ends.select("h", "key").distinct().withColumn("at", F.row_number().over(Window.partitionBy("h").orderBy("key")) - 1)
    null = F.lit(None).cast("long")
    steps = of_border.groupBy("h").agg(F.count(F.lit(1)).alias("own")).select("h", F.lit(0).alias("kind"), null.alias("task"), "own")
    steps = steps.union(by_task.select("h", F.lit(1), "task", "own"))
    before = Window.orderBy("h", "kind", "task").rowsBetween(Window.unboundedPreceding, -1)
    steps = written(steps.withColumn("offset", F.coalesce(F.sum("own").over(before), F.lit(0))), "offsets")
    borders = steps.where("kind = 0").select("h", "offset")
    of_end = ends.join(small(of_border), ["h", "key"]).join(small(borders), "h").select("task", "is_first", "rank", (F.col("offset") + F.col("at")).alias("name"))
    of_end = of_end.groupBy("task").agg(*(F.transform(F.filter(listed_of, lambda x: x["name"].isNotNull()), lambda x: x["name"]).alias(c) for c, listed_of in (("first", _listed("is_first")), ("last", _listed("not is_first")))))
    offsets = by_task.select("task", "n", "n_first", "n_last").join(small(steps.where("kind = 1").select("task", "offset")), "task").join(small(of_end), "task")
    offsets = written(offsets, "tasks")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_TASKS else offsets
    r, from_last = F.col("rank"), F.col("rank") - F.col("n") + F.col("n_last")
    name = F.when(r < F.col("n_first"), F.get("first", r.cast("int"))).when(from_last >= 0, F.get("last", from_last.cast("int"))).otherwise(F.col("offset") + r - F.col("n_first"))
    return ranked.where("uid is not null").join(offsets, "task").select("uid", "pos", "blocks", "doc_id", "n_points", "text_sha256", name.alias("name"))


def _listed(which: str) -> Column:
    """Names in order of rank; those of other rows as null."""
    return F.sort_array(F.collect_list(F.struct("rank", F.when(F.expr(which), F.col("name")).alias("name"))))


def _eight(number: Column) -> Column:
    """A whole number as 8 bytes that sort as it does (from -1 on, which comes last)."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def name_texts(docs: DataFrame, uid: str, text: str = "text", doc_id: str = "doc_id", block: int | None = None) -> DataFrame:
    """uid, doc_id, n_points (code points of the text), text_sha256 (of the normalised text), level and name of each row.

    Rows have equal (level, name) exactly if their texts are equal without spaces. uid must tell rows apart.
    """
    block = block or BLOCK
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, "").cast("binary")
    # A lambda over a one-element array, so that the normalised text is made once for a row.
    cut = F.transform(
        F.array(bare),
        lambda b: F.struct(
            F.sha2(b, 256).alias("sha"),
            F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length(b) / block).cast("int") - 1)), lambda i: F.substring(b, i * block + 1, F.lit(block))).alias("parts"),
        ),
    )[0]
    one = docs.select(F.col(uid).alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"), cut.alias("c"))
    rows = one.select("uid", "doc_id", "n_points", F.col("c.sha").alias("text_sha256"), F.size("c.parts").cast("long").alias("blocks"), F.posexplode("c.parts").alias("pos", "key"))
    head = F.col("pos") == 0
    rows = rows.select("key", "uid", F.col("pos").cast("long").alias("pos"), "blocks", *(F.when(head, F.col(c)).alias(c) for c in ("doc_id", "n_points", "text_sha256")))
    named, level, done = _named(rows), 0, []
    most = named.agg(F.max("blocks")).first()[0] or 1
    for level in range(math.ceil(math.log2(most)) + 1):
        if level:
            pair = named.where(F.col("blocks") > 1).groupBy("uid", F.floor(F.col("pos") / 2).alias("pos"))
            odd = F.col("pos") % 2
            pairs = pair.agg(
                F.max(F.when(odd == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(odd == 1, F.col("name"))), F.lit(-1)).alias("b"),
                F.ceil(F.max("blocks") / 2).alias("blocks"),
                *(F.max(c).alias(c) for c in ("doc_id", "n_points", "text_sha256")),
            )
            named = _named(pairs.withColumn("key", F.concat(_eight(F.col("a")), _eight(F.col("b")))))
        ended = named.where(F.col("blocks") == 1)
        done.append(ended.select("uid", "doc_id", "n_points", "text_sha256", F.lit(level).alias("level"), "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", uid: str | None = None) -> DataFrame:
    """uid, doc_id, keep_id, group_size, kept and text_sha256 of each row; texts are equal without ASCII white space.

    Of equal texts the one with the most code points as given stays, then the smallest doc_id (a null
    one comes last), then any one of the rows left. A null text counts as empty; all empty texts are
    equal. Repeated rows are rows of their own. An empty table gives no rows. uid: a column that tells
    rows apart, if there is one.
    """
    if uid is None:
        docs, uid = number_rows(docs.select(doc_id, text))
    with scratch(docs.sparkSession):
        named = name_texts(docs, uid, text, doc_id)
        # Equal names meet after each task has summed up its own: no task gets the rows of a group.
        best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("d"), F.bitwise_not("uid").alias("u"))).alias("best")
        groups = named.groupBy("level", "name").agg(best, F.count(F.lit(1)).alias("group_size"))
        groups = groups.select("level", "name", "group_size", F.bitwise_not("best.d").alias("keep_id"), F.bitwise_not("best.u").alias("keep_uid"))
        out = named.join(groups, ["level", "name"]).select("uid", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")
        return kept(out, "duplicates")


def without_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that duplicate_groups() keeps, with all their columns."""
    held, uid = number_rows(docs)
    with scratch(docs.sparkSession):
        dropped = kept(duplicate_groups(held, text, doc_id, uid).where(~F.col("kept")).select("uid"), "dropped")
    return without_rows(held, uid, dropped, docs.columns)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept,
  text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

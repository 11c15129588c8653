"""The prefix trie of conversations: distributed MSD radix partitioning over turn ids, finished by multikey quicksort.

1. Turns are dictionary-encoded: a row's role and text are hashed (SHA-256), distinct
   hashes are numbered, and a conversation becomes its turns' numbers in order, with
   their code points beside them. Texts are never shuffled.
2. Conversations with equal turns become one sequence with its number of members
   and the digest of their ids, so a group of copies is one row from here on. Ids are
   sorted across the cluster and joined in pieces of PIECE characters; the task of a
   sequence only hashes pieces as they stream by (a SHA-256 has one order).
3. A bucket is all sequences below a node. Buckets of more than `local` turns are split by
   their next turn (the digit), after the turns that all of the bucket share are passed
   over in one step (they are what its least and its greatest sequence share). A round
   does so for all large buckets at once, and ends when none is left.
4. Small buckets go whole to tasks, where multikey quicksort (three-way partitions
   by the turn at the present depth) finishes them and emits a node for each middle part.
5. Leaves and saved tokens of the nodes above are summed from those below, round by
   round backwards.

A null role or text is empty. Turns are ordered by number, null first; turns of the
same number by the hash of role and text. Rows without a conv_id belong to no
conversation and are left out. A conversation without turns ends at the root; no
conversations at all give no nodes, not even a root. Other columns are not read. A
conversation's numbers (16 bytes a turn) stand in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tideline.llm.common import let_go, numbered, saved, text_of

LOCAL, PIECE, EMITTED = 1 << 14, 1 << 20, 1 << 15
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
MEMBER = ["round", "bucket", "parent", "depth", "last", "conv_id", "n", "sha", "ids", "chars"]


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, chars (of each turn, in order) of every conversation."""
    role, text = text_of("role"), text_of("text")
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.char_length(text).cast("long").alias("chars"))
    rows = saved(rows, "trie-turns")
    book = numbered(rows.select("mark").distinct(), ["mark"], "id")
    turns = rows.join(book, "mark").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("turns"))
    return turns.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))


def grafted(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first turns are those of the conversation at the last multiple of `every`.

    So many turns are replaced as the crc32 of the decimal conv_id leaves modulo
    `most`; what the other conversation hasn't isn't filled up.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("base_ids"), F.slice("chars", 1, most).alias("base_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    found = convs.withColumns({"base": base, "h": h}).join(heads, "base", "left")

    def both(name: str):
        head = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.array().cast("array<bigint>"))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.size(name))).alias(name)

    return found.select("conv_id", both("ids"), both("chars"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a sequence's sorted ids as texts of bounded length."""
    names, held, size, key = ["seq", "first", "n", "piece"], [], 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([held[0]]), pa.array([len(held)]), pa.array([",".join(map(str, held))])], names)

    for batch in batches:
        made = []
        for seq, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (seq != key or size > PIECE):
                made.append(out())
                held, size = [], 0
            key = seq
            held.append(conv)
            size += len(str(conv)) + 1
        if made:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    if held:
        yield out()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sequence's least conv_id, its number of members and the digest of their joined ids."""
    key, state, first, n = None, None, 0, 0
    for batch in batches:
        made = []
        for seq, start, count, piece in zip(*(batch.column(c).to_pylist() for c in ("seq", "first", "n", "piece")), strict=True):
            if seq != key:
                if key is not None:
                    made.append((first, n, state.hexdigest()))
                key, state, first, n = seq, hashlib.sha256(piece.encode()), start, count
            else:
                state.update(b"," + piece.encode())
                n += count
        if made:
            yield _rows(made)
    if key is not None:
        yield _rows([(first, n, state.hexdigest())])


def _rows(made: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*made, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["conv_id", "n", "sha"])


def distinct(convs: DataFrame) -> DataFrame:
    """One row for each sequence: conv_id (the least), n, sha (of all members' ids), ids, chars."""
    marked = saved(convs.withColumn("seq", F.unhex(F.sha2(F.array_join("ids", ","), 256))), "trie-convs")
    pieces = marked.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_pieces, "seq binary, first long, n long, piece string")
    digests = pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_digests, "conv_id long, n long, sha string")
    return saved(marked.drop("seq").join(digests, "conv_id").select("conv_id", "n", "sha", "ids", "chars"), "trie-sequences")


def finished(members: list[tuple], depth: int, parent: int | None, last: int) -> list[list]:
    """Nodes of a bucket by multikey quicksort; the first is the bucket's own.

    members: (conv_id, n, sha, ids, chars) with the turns after `depth`; last: code points
    of the bucket's last turn. A node: conv_id, depth, parent, n_convs, n_children, n_leaves, saved, sha.
    """
    nodes: list[list] = []
    above: list[int] = []

    def emit(group: list[tuple], at: int, over: int, chars: int) -> int:
        n = sum(m[1] for m in group)
        ends = next((m[2] for m in group if len(m[3]) == at), EMPTY)
        nodes.append([min(m[0] for m in group), depth + at, nodes[over][0] if over >= 0 else parent, n, 0, 0, (n - 1) * chars, ends])
        above.append(over)
        return len(nodes) - 1

    todo = [([m for m in members if m[3]], 0, emit(members, 0, -1, last))]
    while todo:
        group, at, node = todo.pop()
        while group:
            x, y, z = (group[i][3][at] for i in (0, len(group) // 2, -1))
            pivot = max(min(x, y), min(max(x, y), z))
            less, same, more = [], [], []
            for m in group:
                d = m[3][at]
                (same if d == pivot else less if d < pivot else more).append(m)
            if less:
                todo.append((less, at, node))
            if more:
                todo.append((more, at, node))
            node = emit(same, at + 1, node, same[0][4][at])
            at += 1
            group = [m for m in same if len(m[3]) > at]
    for i in range(len(nodes) - 1, -1, -1):
        nodes[i][5] = nodes[i][5] or 1
        if (over := above[i]) >= 0:
            nodes[over][4] += 1
            nodes[over][5] += nodes[i][5]
            nodes[over][6] += nodes[i][6]
    return nodes


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the small buckets that stream by, sorted by round and bucket."""
    let_go()
    key, members, nodes, rounds, top = None, [], [], [], []

    def close() -> None:
        if members:
            made = finished(members, key[2], key[3], key[4])
            nodes.extend(made)
            rounds.extend([key[0]] * len(made))
            top.extend([True] + [False] * (len(made) - 1))

    def out() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()]
        columns = [pa.array([x[i] for x in nodes], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(rounds, pa.int32()), pa.array(top, pa.bool_())], [*(x.split()[0] for x in NODE.split(", ")), "round", "top"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("round", "bucket", "depth", "parent", "last", "conv_id", "n", "sha", "ids", "chars")), strict=True):
            if key is None or row[:2] != key[:2]:
                close()
                key, members = row[:5], []
                if len(nodes) >= EMITTED:
                    yield out()
                    nodes, rounds, top = [], [], []
            members.append(row[5:])
    close()
    if nodes:
        yield out()


def trie(convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """All nodes of the trie of conversations (conv_id, ids, chars), which are equal in chars where they are equal in ids.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves
    (nodes without children in the subtree), saved_tokens (over the subtree, members beside
    the first times the code points of the last turn), ends_sha256 (of the ids that end here).
    """
    spark = convs.sparkSession
    now = distinct(convs)
    root = now.agg(F.min("conv_id"), F.sum("n"), F.count("*"), F.sum(F.size("ids"))).first()
    if not root[2]:
        return spark.createDataFrame([], NODE)
    at = {"bucket": F.lit(root[0]), "parent": F.lit(None).cast("long"), "depth": F.lit(0).cast("long"), "last": F.lit(0).cast("long")}
    now = now.withColumns({"round": F.lit(-1), **at}).select(MEMBER)
    tops = spark.createDataFrame([(root[0], None, 0, 0, root[1])], "bucket long, parent long, depth long, last long, n_convs long")
    small, steps, large = [], [], root[2] > 1 and root[3] > local
    if not large:
        small.append(now)
    while large:
        number = len(steps)
        span = now.groupBy("bucket").agg(F.min(F.struct("ids", "chars")).alias("lo"), F.max("ids").alias("hi"))
        differ = F.array_position(F.transform(F.arrays_zip(F.col("lo.ids").alias("x"), F.col("hi").alias("y")), lambda p: p["x"].eqNullSafe(p["y"])), False)
        span = saved(span.withColumn("skip", (F.coalesce(F.nullif(differ, F.lit(0)) - 1, F.size("lo.ids"))).cast("int")).select("bucket", "skip", F.slice("lo.chars", F.lit(1), F.col("skip")).alias("passed")), "trie-spans")
        split = now.join(span.select("bucket", "skip"), "bucket")
        going = split.where("size(ids) > skip").withColumns({"digit": F.get("ids", F.col("skip")), "next": F.get("chars", F.col("skip"))})
        subs = going.groupBy("bucket", "digit").agg(F.min("conv_id").alias("own"), F.sum("n").alias("n_convs"), F.max(F.col("depth") + F.col("skip") + 1).alias("deeper"), F.max("next").alias("next"), ((F.sum(F.size("ids") - F.col("skip")) > local) & (F.count("*") > 1)).alias("large"))
        subs = saved(subs, "trie-buckets")
        cut = lambda c: F.slice(c, F.col("skip") + 2, F.size(c)).alias(c)
        moved = going.drop("next").join(subs.select("bucket", "digit", "own", "deeper", "next", "large"), ["bucket", "digit"])
        moved = saved(moved.select(F.lit(number).alias("round"), F.col("own").alias("bucket"), F.col("bucket").alias("parent"), F.col("deeper").alias("depth"), F.col("next").alias("last"), "conv_id", "n", "sha", cut("ids"), cut("chars"), "large"), "trie-moved")
        ended = split.where("size(ids) = skip").select("bucket", "sha")
        steps.append((tops, span, ended))
        small.append(moved.where("not large").select(MEMBER))
        now = moved.where("large").select(MEMBER)
        tops = subs.where("large").select(F.col("own").alias("bucket"), F.col("bucket").alias("parent"), F.col("deeper").alias("depth"), F.col("next").alias("last"), "n_convs")
        large = bool(tops.take(1))
    todo = small[0]
    for more in small[1:]:
        todo = todo.unionAll(more)
    below = todo.repartition("round", "bucket").sortWithinPartitions("round", "bucket").mapInArrow(_finish, f"{NODE}, round int, top boolean")
    below = saved(below, "trie-nodes")
    names = [x.split()[0] for x in NODE.split(", ")]
    result, kids = below.select(names), None
    for number in range(len(steps) - 1, -1, -1):
        tops, span, ended = steps[number]
        own = below.where(F.col("top") & (F.col("round") == number)).select("parent_conv_id", "n_leaves", "saved_tokens")
        own = own if kids is None else own.unionAll(kids)
        sums = own.groupBy(F.col("parent_conv_id").alias("bucket")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"))
        chain = tops.join(span, "bucket").join(sums, "bucket").join(ended, "bucket", "left")
        chain = chain.select("*", F.posexplode(F.concat(F.array("last"), "passed")).alias("i", "here"))
        saving = F.sum((F.col("n_convs") - 1) * F.col("here")).over(Window.partitionBy("bucket").orderBy(F.desc("i")))
        end = F.col("i") == F.col("skip")
        chain = saved(chain.select(
            F.col("bucket").alias("conv_id"), (F.col("depth") + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"), "n_convs",
            F.when(end, F.col("children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("under") + saving).alias("saved_tokens"), F.when(end, F.coalesce("sha", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"), (F.col("i") == 0).alias("top"),
        ), "trie-chains")
        kids = chain.where("top").select("parent_conv_id", "n_leaves", "saved_tokens")
        result = result.unionAll(chain.select(names))
    return result

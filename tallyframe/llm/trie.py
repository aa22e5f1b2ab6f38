"""The prefix trie of conversations, by burst tries.

A conversation is a sequence of turns; each distinct sequence of first turns is a node. Turns
become ids (a digest of role and text). Copies of a sequence are counted first, so that a
conversation said a million times is one row from then on. Sequences stand in containers under
trie heads; a container with more turns than a task should hold is burst: the chain that all its
sequences share becomes nodes, and each next turn id a head with a container of its own. The
other containers are sorted by their ids and swept: two neighbours share as many nodes as they
share ids. What lies below a head is summed over the heads above it.

Conversations longer than a segment are cut into segments, each of which hangs below the digest of
those before it; so no row, task or container holds a conversation of any length. Segments of
the last level are swept first and give their sums to the ends of the level above.

Defined results: turns are ordered by turn, null first, then by role and the digest of role and
text; repeated rows are turns of their own. A null role or text is empty. Rows without a conv_id
belong to no conversation and are left out. No conversations, no nodes, not even a root; a
conversation without turns is a member of the root. Columns other than conv_id, turn, role and
text are not read. Ids are the first 16 bytes of SHA-256.

At scale: texts are read once and never shuffled. Each round of bursting is one aggregation by
head; rounds are as many as there are branchings on a path whose containers all are too large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import row_numbers
from .common import spread_join, written

#: Turns of a conversation in one row.
SEGMENT = 4096
#: Turns of a container from which it is burst, unless it has a single sequence.
CONTAINER = 20_000
#: Ids of conversations that are listed in one row.
LISTED = 4096
#: Heads (a key and two numbers each) that are broadcast at most.
BROADCAST_HEADS = 100_000
#: The most turns that a rebuilt conversation takes from another.
MOST_TAKEN = 5

TURN = "conv_id long, pos long, id binary, len int"


def _digest(of: Column) -> Column:
    return F.unhex(F.sha2(of, 256))


def _short(of: Column) -> Column:
    return F.substring(_digest(of), 1, 16)


def _own(ids: Column) -> Column:
    return _digest(F.array_join(F.transform(ids, F.hex), ""))


def _key(head: Column, own: Column) -> Column:
    """What names a segment: all that comes before it, and its own ids."""
    return _digest(F.concat(head, own))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, n (place among all turns), id, len; and conv_id, first (its first n), turns."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    id = _short(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), id.alias("id"), F.length(text).alias("len"))
    rows = row_numbers(rows, ["conv_id", "turn", "role", "id"], "n").select("conv_id", "n", "id", "len")
    return rows, written(rows.groupBy("conv_id").agg(F.min("n").alias("first"), F.count("*").alias("turns")), "conversations")


def turns_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: their turns (TURN) and their ids."""
    rows, convs = numbered_turns(conversations)
    placed = spread_join(rows, convs.select("conv_id", "first"), "conv_id", counts=convs.select("conv_id", F.col("turns").alias("n")))
    return placed.select("conv_id", (F.col("n") - F.col("first")).alias("pos"), "id", "len"), convs.select("conv_id")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As turns_of, where each conversation begins with h turns of its hundred's first one.

    Conversation c takes the first h turns of c - c % 100 (all if it has fewer, none if it is not
    there) in place of its own first h; h is crc32 of c's decimal text, modulo 6.
    """
    rows, convs = numbered_turns(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_TAKEN + 1)).cast("long")
    convs = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 100})
    of_base = convs.filter("conv_id = base").select("base", F.col("turns").alias("base_turns"), F.col("first").alias("base_first"))
    convs = convs.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = written(convs, "rebuilt")
    placed = spread_join(rows, convs.select("conv_id", "first", "h", "taken"), "conv_id", counts=convs.select("conv_id", F.col("turns").alias("n")))
    at = F.col("n") - F.col("first")
    own = placed.filter(at >= F.col("h")).select("conv_id", (at - F.col("h") + F.col("taken")).alias("pos"), "id", "len")
    # a first turn of a hundred's first conversation goes to the hundred conversations at most
    wanted = convs.filter("taken > 0").select(F.col("conv_id").alias("to"), F.explode(F.expr("sequence(0L, taken - 1)")).alias("pos"), "base_first").withColumn("n", F.col("base_first") + F.col("pos"))
    heads = placed.filter((F.col("conv_id") % 100 == 0) & (at < MOST_TAKEN)).select("n", "id", "len")
    taken = wanted.join(heads, "n").select(F.col("to").alias("conv_id"), "pos", "id", "len")
    return own.unionByName(taken), convs.select("conv_id")


def segments(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, level, head, ids, lens, last: runs of at most segment turns, below the digest of those before."""
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / segment).alias("level")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "len"))).alias("t"))
    cut = written(cut.select("conv_id", "level", F.col("t.id").alias("ids"), F.col("t.len").alias("lens")), "segments")
    none = convs.join(cut.filter("level = 0").select("conv_id"), "conv_id", "left_anti")
    empty = none.select("conv_id", F.lit(0).cast("long").alias("level"), F.array().cast("array<binary>").alias("ids"), F.array().cast("array<int>").alias("lens"))
    top = F.lit(b"").alias("head")
    many = cut.filter("level > 0").select("conv_id").distinct()
    if many.isEmpty():
        return cut.unionByName(empty).select("*", top, F.lit(True).alias("last"))
    chain = cut.join(many, "conv_id").select("conv_id", F.struct("level", _own(F.col("ids")).alias("own")).alias("s")).groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    step = lambda heads, s: F.concat(heads, F.array(_key(F.element_at(heads, -1), s["own"])))
    heads = chain.select("conv_id", F.posexplode(F.aggregate("s", F.array(F.lit(b"")), step)).alias("level", "head"))
    ends = chain.select("conv_id", (F.size("s") - 1).cast("long").alias("end"))
    long = cut.join(many, "conv_id").join(heads.withColumn("level", F.col("level").cast("long")), ["conv_id", "level"]).join(ends, "conv_id").withColumn("last", F.col("level") == F.col("end")).drop("end")
    return cut.join(many, "conv_id", "left_anti").unionByName(empty).select("*", top, F.lit(True).alias("last")).unionByName(long)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (key, conv_id) rows as texts of at most LISTED ids."""
    out: list[tuple] = []
    key, ids = None, []

    def done() -> None:
        if ids:
            out.append((key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "listed"])

    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key or len(ids) >= LISTED:
                done()
                key = k
            ids.append(c)
        if out:
            yield batch()
            out.clear()
    done()
    if out:
        yield batch()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key of sorted (key, first, listed) rows."""
    key, running = None, None
    for b in batches:
        keys, digests = [], []
        for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key:
                if running is not None:
                    keys.append(key)
                    digests.append(running.hexdigest())
                key, running = k, hashlib.sha256(text.encode())
            else:
                running.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
    if running is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: of the ids that end at a key, in order, comma-joined.

    Ids are sorted by range and joined to texts where they lie, so that the one task that must
    read all ids of a key reads few rows, and holds one at a time.
    """
    lists = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_lists, "key binary, first long, listed string")
    return lists.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, ends_sha256 string")


def sequences(segs: DataFrame) -> DataFrame:
    """Distinct segments below their heads: key, level, head, ids, lens, n, least, n_ends, ends_sha256.

    n conversations pass through the whole segment, least being the smallest; n_ends of them end with it.
    """
    keyed = written(segs.withColumn("key", _key(F.col("head"), _own(F.col("ids")))), "keyed")
    same = ["key", "level", "head", "ids", "lens"]
    rows = keyed.groupBy(*same).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.count_if("last").alias("n_ends"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end"))
    rows = written(rows, "sequences")
    shared = rows.filter("n_ends > 1").select("key", F.lit(True).alias("many"))
    counts = rows.filter("n_ends > 1").select("key", F.col("n_ends").alias("n"))
    ends = spread_join(keyed.filter("last").select("key", "conv_id"), shared, "key", counts=counts).select("key", "conv_id")
    one = F.when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string").cast("binary"), 256))
    return rows.join(ends_digests(ends), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", one)).drop("end")


def _burst(rows: DataFrame, container: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows in containers that fit (at: their head, depth, path of heads above, above: the least
    conversation there), and the burst heads with the chain of turns that their sequences share."""
    rows = rows.withColumns({"at": F.col("head"), "depth": F.lit(0), "path": F.array().cast("array<binary>"), "above": F.lit(None).cast("long")})
    fit, burst = [], []
    while True:
        of = rows.groupBy("level", "at", "depth").agg(
            F.sum(F.size("ids") - F.col("depth")).alias("turns"), F.count("*").alias("rows"), F.sum("n").alias("n_convs"), F.min("least").alias("conv"),
            F.min("ids").alias("low"), F.max("ids").alias("high"), F.min_by("lens", "ids").alias("lens"), F.max("path").alias("path"), F.max("above").alias("above"), F.max("head_conv").alias("head_conv"), F.min_by("ends_sha256", "ids").alias("low_ends"),
        )
        over = of.filter((F.col("rows") > 1) & (F.col("turns") > container))
        # the shared chain ends where the least and the greatest sequence part
        part = F.array_position(F.zip_with(F.slice("low", F.lit(1), F.least(F.size("low"), F.size("high"))), F.slice("high", F.lit(1), F.least(F.size("low"), F.size("high"))), lambda a, b: a == b), False)
        shared = F.when(part > 0, part - 1).otherwise(F.least(F.size("low"), F.size("high"))).cast("int")
        # a sequence that ends there is a start of all others, and so the least
        over = over.withColumn("shared", shared).withColumns({"lens": F.slice("lens", F.lit(1), F.col("shared")), "ends_sha256": F.when(F.size("low") == F.col("shared"), F.col("low_ends"))})
        over = over.drop("low", "high", "turns", "rows", "low_ends")
        over = written(over, "burst")
        n = over.count()
        if not n:
            fit.append(rows)
            break
        burst.append(over)
        mark = over.select("level", "at", F.col("shared").alias("to"), F.coalesce(F.when(F.col("shared") == 0, F.col("head_conv")), F.col("conv")).alias("conv"))
        # heads are at most turns / container; a hot head's rows stay where they are
        marked = rows.join(F.broadcast(mark) if n <= BROADCAST_HEADS else mark, ["level", "at"], "left")
        fit.append(marked.filter("to is null").drop("to", "conv"))
        deeper = marked.filter(F.col("to") < F.size("ids")).withColumns(
            {"path": F.concat("path", F.array("at")), "at": _digest(F.concat(F.hex("at"), F.lit("/"), F.hex(F.get("ids", F.col("to"))), F.lit("/"), F.col("to").cast("string"))), "depth": F.col("to") + 1, "above": F.col("conv")}
        )
        rows = written(deeper.drop("to", "conv"), "burst-rows")
    union = lambda many: many[0] if len(many) == 1 else union([many[0].unionByName(many[1]), *many[2:]])
    return union(fit), union(burst) if burst else None


NODE = "level long, at binary, path array<binary>, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"
_NODE_TYPES = [pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def swept(rows: list[dict]) -> list[tuple]:
    """The nodes (NODE) of one container's rows, sorted by ids; its head comes first."""
    first = rows[0]
    depth = first["depth"]
    # conv, depth, parent, n, children, leaves, saved, ends, length
    nodes: list[list] = [[first["least"], depth, -1, 0, 0, 0, 0, None, first["lens"][depth - 1] if depth else 0]]
    stack, before = [0], first["ids"]
    for r in rows:
        ids, same = r["ids"], depth
        while same < min(len(ids), len(before)) and ids[same] == before[same]:
            same += 1
        same = min(same, depth + len(stack) - 1)
        del stack[same - depth + 1 :]
        for d in range(same, len(ids)):
            nodes[stack[-1]][4] += 1
            nodes.append([r["least"], d + 1, stack[-1], 0, 0, 0, 0, None, r["lens"][d]])
            stack.append(len(nodes) - 1)
        for i in stack:
            nodes[i][0] = min(nodes[i][0], r["least"])
            nodes[i][3] += r["n"]
        end = nodes[stack[-1]]
        end[7] = r["ends_sha256"]
        end[4] += r["more_children"] or 0
        end[5] += r["more_leaves"] or 0
        end[6] += r["more_saved"] or 0
        before = ids
    for node in reversed(nodes):
        node[5] = node[5] if node[4] else 1
        node[6] += (node[3] - 1) * node[8]
        if node[2] >= 0:
            nodes[node[2]][5] += node[5]
            nodes[node[2]][6] += node[6]
    if not depth and first["head_conv"] is not None:
        nodes[0][0] = first["head_conv"]
    parent = lambda n: nodes[n[2]][0] if n[2] >= 0 else first["above"]
    return [(first["level"], first["at"], first["path"], n[0], n[1], parent(n), n[3], n[4], n[5], n[6], n[7], not i) for i, n in enumerate(nodes)]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps one container after the other: rows come sorted by level, head and ids."""
    held: list[dict] = []
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_NODE_TYPES)], names=[c.split()[0] for c in NODE.split(", ")])
        out.clear()
        return b

    for b in batches:
        for r in b.to_pylist():
            if held and (held[0]["level"], held[0]["at"]) != (r["level"], r["at"]):
                out += swept(held)
                held.clear()
                if len(out) >= CONTAINER:
                    yield batch()
            held.append(r)
    if held:
        out += swept(held)
    if out:
        yield batch()


def _heads(burst: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the burst heads' chains, given the heads of the containers below (NODE)."""
    up = lambda df, *cols: df.select("level", F.explode("path").alias("at"), *cols)
    # characters of the chain's turns from depth d on (the head of a level's first container has none)
    chars = lambda d: F.aggregate(F.slice("lens", F.greatest(d, F.lit(1)), F.greatest(F.col("shared") - F.greatest(d, F.lit(1)) + 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x) * (F.col("n_convs") - 1)
    burst = burst.withColumn("own", chars(F.col("depth")))
    sums = up(tops, "n_leaves", F.col("saved_tokens").alias("saved")).unionByName(up(burst, F.lit(0).cast("long").alias("n_leaves"), F.col("own").alias("saved"))).groupBy("level", "at").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
    last = F.element_at("path", -1).alias("at")
    children = tops.filter(F.size("path") > 0).select("level", last).unionByName(burst.filter(F.size("path") > 0).select("level", last)).groupBy("level", "at").agg(F.count("*").alias("branches"))
    ends = burst.join(sums, ["level", "at"]).join(children, ["level", "at"])
    chain = ends.withColumn("d", F.explode(F.sequence("depth", "shared")))
    conv = lambda d: F.coalesce(F.when(d == 0, F.col("head_conv")), F.col("conv"))
    return chain.select(
        "level", "at", "path", conv(F.col("d")).alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("above")).otherwise(conv(F.col("d") - 1)).alias("parent_conv_id"), "n_convs",
        F.when(F.col("d") == F.col("shared"), F.col("branches")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("below") + chars(F.col("d"))).alias("saved_tokens"), F.when(F.col("d") == F.col("shared"), F.col("ends_sha256")).alias("ends_sha256"), (F.col("d") == F.col("depth")).alias("top"),
    )


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, container: int = CONTAINER) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    seqs = written(sequences(segments(turns, convs, segment)), "distinct")
    above = seqs.select(F.col("key").alias("head"), F.col("least").alias("head_conv"))
    deepest = seqs.agg(F.max("level")).first()[0] or 0
    seqs = seqs.join(above, "head", "left") if deepest else seqs.withColumn("head_conv", F.lit(None).cast("long"))
    fit, burst = _burst(written(seqs, "rows") if deepest else seqs, container)
    fit = written(fit, "containers")
    more = None
    out = []
    for level in range(deepest, -1, -1):
        rows = fit.filter(F.col("level") == level)
        none = {c: F.lit(None).cast("long") for c in ("more_children", "more_leaves", "more_saved")}
        rows = rows.withColumns(none) if more is None else rows.join(more, "key", "left")
        nodes = written(rows.repartition("level", "at").sortWithinPartitions("level", "at", "ids").mapInArrow(_sweep, NODE), "nodes")
        if burst is not None:
            nodes = nodes.unionByName(_heads(burst.filter(F.col("level") == level), nodes.filter("top")))
        if level:
            more = nodes.filter("depth = 0").select(F.col("at").alias("key"), F.col("n_children").alias("more_children"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved"))
            more = written(more, "below")
            nodes = nodes.filter("depth > 0")
        out.append(nodes)
    all_nodes = out[0]
    for more_nodes in out[1:]:
        all_nodes = all_nodes.unionByName(more_nodes)
    return all_nodes.select(
        "conv_id", (F.col("level") * segment + F.col("depth")).alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )

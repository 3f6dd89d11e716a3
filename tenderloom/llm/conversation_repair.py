"""Repair of damaged conversations: the cheapest edits that give a legal order of roles.

The rows of a conversation, in the order of their turns, become the rows of a legal one, whose role initials match
`(s?(ua)+)?`. Every row is kept (0), gets the other role of user and assistant (3) or is deleted (4); a turn without text
may be inserted anywhere (3). Blank rows and repetitions of an earlier role and text have to be deleted, and every
truncated row that stays costs 3 more. Of all cheapest lists of edits the one with the least audit is taken, the audit
being the initials of its edits: Delete < Insert < Keep < Rerole.

1. Rows are reduced to what costs depend on: id, turn, a digest of role and text, flags. Equal rows of a turn become one
   with a number of copies. These thin rows are dealt by range of (conversation, turn, digest), so a conversation of any
   length lies in many tasks, and numbered there; `BLOCK_ROWS` consecutive rows make a block.
2. Cost dynamic programming over (row, state of the grammar), backwards. A block is a 4 x 4 matrix of costs between its
   states; only conversations that lie in several blocks need it: their matrices, one small row a block, are multiplied
   in order, which gives every block the costs behind it.
3. Arcs that lie on a cheapest path make a graph. Its nodes are ranked by their next one, two, four ... letters: the rank
   for twice the length is that of the pair (own rank, rank of the node that many letters on), so a block of n rows is
   ranked in log n whole-array steps. Every node takes the arc with the least letter and target rank, and the nodes of the
   path are read off the doubled pointers. Letters that leave a node lead to one state each, so equal audits are equal edits.
4. Edits and texts meet in a stream ordered by conversation and turn, the only shuffle of texts. Memory there does not grow
   with a conversation, but for its audit, which has a letter for every row.

Null roles and texts count as one space. Null turns come first; rows of one turn are ordered by the SHA-256 of role and
text; equal rows are repetitions. Rows with a null id are one conversation. A role without characters, or with another
initial than s, u or a, is never legal. Empty texts are blank. Texts are never cut; a long one passes through a task by
itself. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import BLANKS, bounded_batches
from tenderloom.session import frozen

BLOCK_ROWS = 4096
KEEP_TRUNCATED = REROLE = INSERT = 3
DELETE = 4

# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
STATES = 4
NEXT = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
FORCED = NEXT["u"] + NEXT["a"]  # where an inserted turn or a changed role leads
AT_END = [0, 2 * INSERT, INSERT, 0]  # the cost of the turns still missing
FAR = 1 << 40
DELETED, INSERTED, KEPT, REROLED = 1, 2, 3, 4  # letters in the order of their ASCII codes
LEGAL_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}
INITIALS = "sua"  # flags % 4 is a place in here, or 3
BLANK_ROW, TRUNCATED_ROW, REPEATED_ROW = 4, 8, 16


def damaged(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, turn, role, text with every twentieth row dropped, emptied, without sentence ends, repeated, or said by the user.

    What happens to a row depends on the crc32 of `conv_id:turn` alone.
    """
    def plain(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(plain(conv_column), F.lit(":"), plain(turn_column)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain(text_column), "[.!?]", "")).otherwise(plain(text_column))
    role = F.when(kind == 4, "user").otherwise(plain(role_column))
    times = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = turns.where(kind != 0).select(F.col(conv_column).alias("conv_id"), F.col(turn_column).alias("turn"),
                                         role.alias("role"), text.alias("text"), F.explode(times).alias("_time"))
    return rows.drop("_time")


def _groups(batches: Iterator[pa.RecordBatch], enough: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole (conversation, block) groups of a sorted stream, many at a time, with the places where groups begin."""
    held = []

    def cut(table: pa.Table) -> np.ndarray:
        block, conv = table["block"].to_numpy(), table["conv_id"]
        codes = conv.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if len(conv) else np.zeros(0)
        return np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (codes[1:] != codes[:-1])]) if len(conv) else np.zeros(0, dtype=int)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = cut(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, cut(table)


def _costs(flags: np.ndarray, copies: np.ndarray, starts: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Least cost from every (layer, state) to the end. Group g has a layer before each of its rows and one after the last."""
    ends = np.r_[starts[1:], len(flags)]
    cost = np.empty((len(flags) + len(starts), STATES), dtype=np.int64)
    of, extra = flags.tolist(), (DELETE * (copies - 1)).tolist()
    for g, (first, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        v0, v1, v2, v3 = behind[g].tolist()
        cost[end + g] = v0, v1, v2, v3
        for i in range(end - 1, first - 1, -1):
            flag, more = of[i], extra[i]
            gone = DELETE + more
            w0, w1, w2, w3 = gone + v0, gone + v1, gone + v2, gone + v3
            if not flag & (BLANK_ROW | REPEATED_ROW):
                stay = more + (KEEP_TRUNCATED if flag & TRUNCATED_ROW else 0)
                initial = flag & 3
                to_user = stay + v2 + (0 if initial == 1 else REROLE)
                w0, w1, w3 = min(w0, to_user), min(w1, to_user), min(w3, to_user)
                w2 = min(w2, stay + v3 + (0 if initial == 2 else REROLE))
                if initial == 0:
                    w0 = min(w0, stay + v1)
            v2, v3 = min(w2, INSERT + w3), min(w3, INSERT + w2)
            v0, v1 = min(w0, INSERT + v2), min(w1, INSERT + v2)
            cost[i + g] = v0, v1, v2, v3
    return cost


def _arcs(flags: np.ndarray, copies: np.ndarray, starts: np.ndarray, last: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source node, letter and target node of all arcs on cheapest paths; node = layer * 4 + state."""
    group = np.searchsorted(starts, np.arange(len(flags)), side="right") - 1
    layer = np.arange(len(flags)) + group
    more = DELETE * (copies - 1)
    free = (flags & (BLANK_ROW | REPEATED_ROW)) == 0
    stay = more + np.where(flags & TRUNCATED_ROW, KEEP_TRUNCATED, 0)
    found = []

    def add(at: np.ndarray, state: int, letter: int, price, to_layer: np.ndarray, to: int, allowed) -> None:
        best = allowed & (cost[at, state] == price + cost[to_layer, to])
        found.append((at[best] * STATES + state, np.full(int(best.sum()), letter), to_layer[best] * STATES + to))

    for state in range(STATES):
        add(layer, state, DELETED, DELETE + more, layer + 1, state, True)
    for place, initial in enumerate(INITIALS):
        for state, to in NEXT[initial]:
            add(layer, state, KEPT, stay, layer + 1, to, free & ((flags & 3) == place))
    for state, to in FORCED:
        add(layer, state, REROLED, stay + REROLE, layer + 1, to, free)
    ends = (np.r_[starts[1:], len(flags)] + np.arange(len(starts)))[last]
    open_layers = np.r_[layer, ends]
    for state, to in FORCED:
        add(open_layers, state, INSERTED, INSERT, open_layers, to, True)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _least_paths(arcs: tuple[np.ndarray, np.ndarray, np.ndarray], nodes: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Prefix doubling: the letter every node goes on with (0: none), its pointers over 1, 2, 4 ... letters, letters to the end."""
    source, letter, target = arcs
    rank = np.zeros(nodes, dtype=np.int64)

    def chosen() -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank[target], letter, source))
        first = order[np.r_[True, source[order][1:] != source[order][:-1]]] if len(order) else order
        letters, pointer = np.zeros(nodes, dtype=np.int64), np.arange(nodes)
        letters[source[first]], pointer[source[first]] = letter[first], target[first]
        return letters, pointer

    def doubled(pointer: np.ndarray) -> Iterator[np.ndarray]:
        while True:
            yield pointer
            if np.array_equal(ahead := pointer[pointer], pointer):
                return
            pointer = ahead

    letters, pointer = chosen()
    rank = letters.copy()
    for ahead in doubled(pointer):
        rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[ahead], return_inverse=True)[1].reshape(-1)
    letters, pointer = chosen()
    pointers, length = list(doubled(pointer)), (letters > 0).astype(np.int64)
    for ahead in pointers:
        length = length + length[ahead]
    return letters, pointers, length


def _frame(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """flags, copies, costs behind each group, state before each group, whether each group is its conversation's last block."""
    flags, copies = table["flags"].to_numpy(), table["copies"].to_numpy()
    behind = np.stack([table[f"behind_{s}"].to_numpy()[starts] for s in range(STATES)], axis=1)
    return flags, copies, behind, table["entry"].to_numpy()[starts], table["is_last"].to_numpy(zero_copy_only=False)[starts]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, costs: cost of getting from state s before the block to state t behind it, at s * 4 + t."""
    for table, starts in _groups(batches):
        flags, copies = table["flags"].to_numpy(), table["copies"].to_numpy()
        ends = np.r_[starts[1:], len(flags)]
        columns = []
        for to in range(STATES):
            behind = np.full((len(starts), STATES), FAR)
            behind[:, to] = 0
            columns.append(_costs(flags, copies, starts, behind)[starts + np.arange(len(starts))])
        costs = np.minimum(np.stack(columns, axis=2), FAR).reshape(len(starts), -1)
        heads = table.take(pa.array(ends - 1))
        yield pa.RecordBatch.from_arrays([heads["conv_id"].combine_chunks(), heads["block"].combine_chunks(), pa.array(list(costs), pa.list_(pa.int64()))],
                                         names=["conv_id", "block", "costs"])


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, behind, is_last from the matrices of a conversation, last block first."""
    current = None
    for batch in batches:
        rows = []
        for conv, block, costs in zip(*(c.to_pylist() for c in batch.columns)):
            is_last = current is None or current[0] != conv
            behind = AT_END if is_last else current[1]
            rows.append((conv, block, behind, is_last))
            current = conv, [min(costs[s * STATES + t] + behind[t] for t in range(STATES)) for s in range(STATES)]
        if rows:
            types = [batch.schema.field(0).type, pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "block", "behind", "is_last"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, exits: the state behind the block on the least path from each state before it."""
    for table, starts in _groups(batches):
        flags, copies, behind, _, last = _frame(table, starts)
        cost = _costs(flags, copies, starts, behind)
        _, pointers, _ = _least_paths(_arcs(flags, copies, starts, last, cost), len(cost) * STATES)
        entries = (starts + np.arange(len(starts)))[:, None] * STATES + np.arange(STATES)
        exits = pointers[-1][entries] % STATES
        heads = table.take(pa.array(starts))
        yield pa.RecordBatch.from_arrays([heads["conv_id"].combine_chunks(), heads["block"].combine_chunks(), pa.array(list(exits), pa.list_(pa.int64()))],
                                         names=["conv_id", "block", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, block, entry: the state before each block, first block first."""
    current = None
    for batch in batches:
        rows = []
        for conv, block, exits in zip(*(c.to_pylist() for c in batch.columns)):
            state = 0 if current is None or current[0] != conv else current[1]
            rows.append((conv, block, state))
            current = conv, exits[state]
        if rows:
            types = [batch.schema.field(0).type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "block", "entry"])


_SYMBOLS = {DELETED: "DDDD", KEPT: "KKKK", INSERTED: "UUAU", REROLED: "uuau"}


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The thin rows with their edits: U and A for an inserted turn, D, K, and u or a for a changed role."""
    symbol_of = np.array([[" "] * STATES] + [list(_SYMBOLS[k]) for k in (DELETED, INSERTED, KEPT, REROLED)])
    for table, starts in _groups(batches):
        flags, copies, behind, entry, last = _frame(table, starts)
        cost = _costs(flags, copies, starts, behind)
        letters, pointers, length = _least_paths(_arcs(flags, copies, starts, last, cost), len(cost) * STATES)
        first = (starts + np.arange(len(starts))) * STATES + entry
        steps = length[first]
        step = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
        node = np.repeat(first, steps)
        for k, ahead in enumerate(pointers):
            on = (step >> k) & 1 == 1
            node[on] = ahead[node[on]]
        group = np.repeat(np.arange(len(starts)), steps)
        # what is inserted behind the last row belongs to that row
        row = np.minimum(node // STATES - group, np.r_[starts[1:], len(flags)][group] - 1)
        symbols = symbol_of[letters[node], node % STATES].tolist()
        edits = [""] * len(flags)
        for i, symbol in zip(row.tolist(), symbols):
            edits[i] += symbol
        yield pa.RecordBatch.from_arrays(
            [table[c].combine_chunks() for c in ("conv_id", "turn", "digest", "flags", "copies")] + [pa.array(edits, pa.string())],
            names=["conv_id", "turn", "digest", "flags", "copies", "edits"])


def _with_digest(turns: DataFrame, conv_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_column, text_column))
    return turns.select(F.col(conv_column).alias("conv_id"), F.col(turn_column).alias("turn"), role.alias("role"), text.alias("text")).select(
        "*", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)).alias("digest"))


def cheapest_edits(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, turn, digest, flags, copies, edits: one row for all equal rows of a turn. `block_rows` is a power of two."""
    rows = _with_digest(turns, conv_column, turn_column, role_column, text_column)
    initial = F.coalesce(*[F.when(F.col("role").startswith(c), i) for i, c in enumerate(INITIALS)], F.lit(3))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    flags = initial + F.when(trimmed == "", BLANK_ROW).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED_ROW).otherwise(0)
    thin = rows.select("conv_id", "turn", "digest", flags.cast("long").alias("flags")).groupBy("conv_id", "turn", "digest", "flags").agg(F.count(F.lit(1)).alias("copies"))
    order = ["conv_id", "turn", "digest"]
    # the number of a row: its task in the high bits, its place there in the low 33
    placed = frozen(thin.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    marked = placed.join(firsts, placed["conv_id"].eqNullSafe(firsts["_conv"]) & (placed["digest"] == firsts["_digest"]), "left")
    repeated = F.when(F.col("place") > F.col("first"), REPEATED_ROW).otherwise(0)
    block = F.shiftright("place", block_rows.bit_length() - 1)
    marked = frozen(marked.select(*order, (F.col("flags") + repeated).alias("flags"), "copies", "place", block.alias("block")))

    conv = f"conv_id {marked.schema['conv_id'].dataType.simpleString()}"
    key = ["conv_id", "block"]

    def frames(framed: DataFrame) -> DataFrame:
        """Rows with the costs behind their block, the state before it and whether it is the last; alone in one block by default."""
        there = framed.columns
        behind = [(F.coalesce(F.col("behind")[s], F.lit(AT_END[s])) if "behind" in there else F.lit(AT_END[s])).cast("long").alias(f"behind_{s}") for s in range(STATES)]
        entry = F.coalesce(F.col("entry"), F.lit(0)) if "entry" in there else F.lit(0)
        is_last = F.coalesce(F.col("is_last"), F.lit(True)) if "is_last" in there else F.lit(True)
        return framed.select(*order, "flags", "copies", "place", "block", entry.cast("long").alias("entry"), is_last.alias("is_last"),
                             *behind)

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
        return left.join(right, left["conv_id"].eqNullSafe(right["_conv"]) & (left["block"] == right["_block"]), how).drop("_conv", "_block")

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition(*key).sortWithinPartitions(*key, "place")

    split = marked.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select(F.col("conv_id").alias("_conv"))
    long_ones = frozen(marked.join(split, marked["conv_id"].eqNullSafe(split["_conv"]), "left_semi"))
    matrices = by_block(long_ones).mapInArrow(_matrices, f"{conv}, block long, costs array<long>")
    behind = frozen(matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
                    .mapInArrow(_costs_behind, f"{conv}, block long, behind array<long>, is_last boolean"))
    exits = by_block(frames(joined(long_ones, behind, "inner"))).mapInArrow(_exits, f"{conv}, block long, exits array<long>")
    entries = exits.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_entries, f"{conv}, block long, entry long")
    frame = frozen(joined(behind, entries, "inner"))
    kinds = [marked.schema[c].dataType.simpleString() for c in order]
    schema = ", ".join(f"{c} {k}" for c, k in zip(order, kinds)) + ", flags long, copies long, edits string"
    return by_block(frames(joined(marked, frame, "left"))).mapInArrow(_edits, schema)


def _edit_rows(edits: str, copies: int, flags: int, role: str | None, text: str | None) -> Iterator[tuple]:
    """edit, copies, role, text, initial, fault, cost of one thin row; texts are null where a row is deleted."""
    initial = (INITIALS + "?")[flags & 3]
    fault = "blank" if flags & BLANK_ROW else "duplicate" if flags & REPEATED_ROW else "truncated" if flags & TRUNCATED_ROW else None
    again = "blank" if flags & BLANK_ROW else "duplicate"
    for symbol in edits:
        if symbol in "UA":
            yield "I", 1, "user" if symbol == "U" else "assistant", "", None, None, INSERT
            continue
        if symbol == "D":
            yield "D", 1, None, None, initial, fault, DELETE
        else:
            cost = KEEP_TRUNCATED if flags & TRUNCATED_ROW else 0
            if symbol == "K":
                yield "K", 1, role, text, initial, fault, cost
            else:
                yield "R", 1, "user" if symbol == "u" else "assistant", text, initial, fault, cost + REROLE
        if copies > 1:
            yield "D", copies - 1, None, None, initial, again, DELETE * (copies - 1)


EDIT_COLUMNS = "turn {turn}, edit string, copies long, role string, text string, initial string, fault string, cost long"


def repaired(turns: DataFrame, conversations: DataFrame | None = None, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
             text_column: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per edit, in order: conv_id, turn, edit (K, R, I, D), copies, role and text afterwards, initial before, fault, cost.

    A conversation lies in one task, its edits one after the other. Conversations of `conversations` (a column of ids)
    without rows give one row with a null edit.
    """
    bounded_batches(turns.sparkSession)
    edits = cheapest_edits(turns, conv_column, turn_column, role_column, text_column, block_rows)
    texts = _with_digest(turns, conv_column, turn_column, role_column, text_column)
    ids = (turns if conversations is None else conversations).select(F.col(conv_column).alias("conv_id")).distinct()
    kinds = {c: edits.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    null = F.lit(None)
    parts = [
        ids.select("conv_id", F.lit(0).alias("kind"), null.cast(kinds["turn"]).alias("turn"), null.cast("binary").alias("digest"),
                   null.cast("long").alias("flags"), null.cast("long").alias("copies"), null.cast("string").alias("edits"), null.cast("string").alias("role"), null.cast("string").alias("text")),
        edits.select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "flags", "copies", "edits", null.cast("string").alias("role"), null.cast("string").alias("text")),
        texts.select("conv_id", F.lit(2).alias("kind"), "turn", "digest", null.cast("long").alias("flags"), null.cast("long").alias("copies"), null.cast("string").alias("edits"), "role", "text"),
    ]
    stream = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition("conv_id").sortWithinPartitions("conv_id", F.col("kind") > 0, "turn", "digest", "kind")
    names = ["conv_id", "turn", "edit", "copies", "role", "text", "initial", "fault", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, empty = None, None  # an edit without its text yet; a conversation without rows yet
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(2).type, pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64()]
            out = []
            for conv, kind, turn, digest, flags, copies, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if empty is not None:
                        out.append((*empty, *[None] * 7))
                    empty = (conv, None)
                elif kind == 1:
                    empty = None
                    if any(s in "Kua" for s in edit):
                        waiting = digest, turn, edit, copies, flags
                    else:
                        out.extend((conv, turn, *row) for row in _edit_rows(edit, copies, flags, None, None))
                elif waiting is not None and waiting[0] == digest and waiting[1] == turn:
                    out.extend((conv, turn, *row) for row in _edit_rows(*waiting[2:], role, text))
                    waiting = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if empty is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*empty, *[None] * 7), types)], names=names)

    return stream.mapInArrow(run, f"conv_id {kinds['conv_id']}, " + EDIT_COLUMNS.format(turn=kinds["turn"]))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reported(edits: DataFrame) -> DataFrame:
    """Per conversation what was wrong and what was done, from the rows of `repaired` in the order they come."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[c.split()[0] for c in REPORT.split(", ")]]

    class Report:
        def __init__(self, conv) -> None:
            self.conv, self.faults, self.cost, self.illegal, self.audit = conv, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, []
            self.initial, self.first_turn, self.last_turn, self.turns, self.hash, self.said = None, None, None, 0, hashlib.sha256(), False

        def add(self, turn, edit, copies, role, text, initial, fault, cost) -> None:
            if edit is None:
                return
            self.audit.append(edit * copies)
            self.cost += cost
            if initial is not None:
                if fault:
                    self.faults[fault] += copies
                self.illegal += copies - 1 + (self.initial is not None and (self.initial, initial) not in LEGAL_PAIRS)
                self.initial = initial
                if turn is not None and turn != self.last_turn:
                    self.turns += 1
                    self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
            if edit != "D":
                self.hash.update((("\n" if self.said else "") + f"{role}:{text}").encode())
                self.said = True

        def row(self) -> tuple:
            gaps = 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.turns
            return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, types = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
            done = []
            for conv, *edit in zip(*(c.to_pylist() for c in batch.columns)):
                if report is None or report.conv != conv:
                    if report is not None:
                        done.append(report.row())
                    report = Report(conv)
                report.add(*edit)
            if done:
                yield batch_of(done)
        if report is not None:
            yield batch_of([report.row()])

    return edits.mapInArrow(run, f"conv_id {kind}, {REPORT}")

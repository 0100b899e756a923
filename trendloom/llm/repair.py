"""Conversation structure repair: a bidirectional Dijkstra search over the edit lattice.

Repaired role initials follow `(s?(ua)+)?`. Its states are 0 (nothing yet), 1 (after s), 2 (after u)
and 3 (after a); 0 and 3 may end a conversation. A node of the lattice is (rows read, state). Its
edges are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of an empty turn (2); a
truncated row that stays costs 1 more, and blank and duplicate rows can only be deleted. From a node
an edit's initial leads to one node at most, so an audit names one repaired conversation.

Rows are numbered in their order and cut into blocks by number. A block has a search for each state
in which it can be entered and left, in parallel over all blocks; the few costs per block are then
chained by conversation. An Insert stands before a row of its block, and only the last block may end
with one, so no audit of a block begins another one and the least choice by block is the least whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import ids_of, map_arrow, written

_INFINITE = 1 << 60
#: Rows of a block, as bits of their number.
BLOCK_BITS = 10
_SPACE = " \t\n\x0b\x0c\r"
_KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
_INITIALS = ("", "s", "u", "a")
_ROLE_OF = {2: "user", 3: "assistant"}


def _added(state: int) -> int:
    """The state after a user or assistant turn that is inserted or gets its role here."""
    return 3 if state == 2 else 2


def code(initial: str, fault: int) -> str:
    """What the search knows of a row, as one letter: its role's initial and its fault."""
    return chr(65 + 4 * (_INITIALS.index(initial) if initial in _INITIALS else 0) + fault)


def _row(letter: str) -> tuple[str, int]:
    value = ord(letter) - 65
    return _INITIALS[value >> 2], value & 3


class Lattice:
    """The edits of one block of rows, forwards and backwards."""

    def __init__(self, codes: str, last: bool):
        self.n, self.last = len(codes), last
        self.rows = [_row(c) for c in codes]

    def onward(self, at: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial, cost, next place, next state) of the edits at a node, least initial first."""
        found = []
        if at < self.n:
            initial, fault = self.rows[at]
            found.append(("D", 3, at + 1, state))
        if at < self.n or self.last:
            found.append(("I", 2, at, _added(state)))
        if at < self.n and fault not in (1, 2):
            more = int(fault == 3)
            kept = _KEEPS[initial].get(state)
            if kept is not None:
                found.append(("K", more, at + 1, kept))
            found.append(("R", 2 + more, at + 1, _added(state)))
        return found

    def backward(self, at: int, state: int) -> list[tuple[int, int, int]]:
        """(cost, place, state) of the nodes from which an edit leads to a node."""
        before = {2: (0, 1, 3), 3: (2,)}.get(state, ())
        found = [(2, at, s) for s in before] if at < self.n or self.last else []
        if at:
            initial, fault = self.rows[at - 1]
            found.append((3, at - 1, state))
            if fault not in (1, 2):
                more = int(fault == 3)
                found += [(more, at - 1, s) for s, kept in _KEEPS[initial].items() if kept == state]
                found += [(2 + more, at - 1, s) for s in before]
        return found

    def cheapest(self, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
        """Cost and least audit of the cheapest ways from a state before the rows to states after them.

        Both heaps grow until their least costs add up to more than the best crossing, so every
        cheapest way is cut by an edge from a node settled forwards to one settled backwards.
        Heaps order equal costs by place: edges without cost lead from settled to later nodes.
        """
        n, size = self.n, 4 * (self.n + 1)
        ahead, back = [_INFINITE] * size, [_INFINITE] * size
        ahead[entry] = 0
        forth, reverse = [(0, 0, entry)], []
        best = _INFINITE
        for state in exits:
            back[4 * n + state] = 0
            heappush(reverse, (0, 0, state))
            if n == 0 and state == entry:
                best = 0
        settled, met = [], set()
        while forth and reverse and forth[0][0] + reverse[0][0] <= best:
            if forth[0][0] <= reverse[0][0]:
                cost, at, state = heappop(forth)
                if cost > ahead[4 * at + state]:
                    continue
                settled.append((cost, at, state))
                for _, step, to, then in self.onward(at, state):
                    node, total = 4 * to + then, cost + step
                    if total < ahead[node]:
                        ahead[node] = total
                        heappush(forth, (total, to, then))
                    best = min(best, total + back[node])
            else:
                cost, left, state = heappop(reverse)
                at = n - left
                if cost > back[4 * at + state]:
                    continue
                met.add(4 * at + state)
                for step, to, then in self.backward(at, state):
                    node, total = 4 * to + then, cost + step
                    if total < back[node]:
                        back[node] = total
                        heappush(reverse, (total, n - to, then))
                    best = min(best, total + ahead[node])
        if best == _INFINITE:
            return None
        return best, self._least(entry, exits, best, ahead, back, settled, met)

    def _least(self, entry, exits, best, ahead, back, settled, met) -> str:
        """The least audit of all cheapest ways: forward halves that reach a crossing, then backward halves."""
        ends = {4 * self.n + s for s in exits}
        known = {4 * at + state for _, at, state in settled}
        alive: dict[int, list[tuple[str, int, int]]] = {}
        for cost, at, state in reversed(settled):
            ways = []
            for initial, step, to, then in self.onward(at, state):
                node, total = 4 * to + then, cost + step
                crossing = node in met and total + back[node] == best
                if crossing or (node in known and ahead[node] == total and node in alive):
                    ways.append((initial, to, then))
            if ways or (4 * at + state in ends and cost == best):
                alive[4 * at + state] = ways
        audit, at, state = [], 0, entry
        while 4 * at + state not in met:
            ways = alive[4 * at + state]
            if not ways:
                return "".join(audit)
            initial, at, state = ways[0]
            audit.append(initial)
        while back[4 * at + state] or at < self.n:
            here = back[4 * at + state]
            for initial, step, to, then in self.onward(at, state):
                if 4 * to + then in met and step + back[4 * to + then] == here:
                    audit.append(initial)
                    at, state = to, then
                    break
        return "".join(audit)


_KEY = ("conv_id", "turn", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows damaged by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes away its
    [.!?], 3 repeats it, 4 sets its role to user. Nulls are one space, in roles, texts and that key."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in _KEY]
    rows = ids_of(conversations, *_KEY).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        spaced[2].alias("role"),
        spaced[3].alias("text"),
        (F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1])) % 20).alias("harm"),
    )
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", ""))
    copies = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("harm <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def numbered(turns: DataFrame) -> DataFrame:
    """All rows with their place, as a written table: by conversation and turn (null first), rows of one
    turn by role and text.

    The order is made by range partitions, so a conversation of any length is spread over tasks.
    """
    rows = ids_of(turns, *_KEY).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    ranged = rows.withColumn("_head", F.left("text", F.lit(24))).repartitionByRange("conv_id", "turn", "role", "_head")
    placed = ranged.sortWithinPartitions(*_KEY).withColumn("place", F.monotonically_increasing_id())
    return written(placed.select("place", *_KEY), "repair-rows")


def _codes(rows: DataFrame) -> DataFrame:
    """The letters of each conversation's rows by block, with whether it is the first and the last one.

    A row is no duplicate if its place is the first of its conversation, role and text. These first
    places are found with map-side sums and joined by place, which no key makes uneven.
    """
    first = (
        rows.groupBy("conv_id", F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256).alias("_digest"))
        .agg(F.min("place").alias("place"))
        .select("place", F.lit(True).alias("_first"))
    )
    body = F.rtrim("text", F.lit(_SPACE))
    plain = rows.select(
        "place",
        "conv_id",
        F.left("role", F.lit(1)).alias("_initial"),
        (body == "").alias("_blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("_open"),
    )
    fault = F.when(F.col("_blank"), 1).when(F.col("_first").isNull(), 2).when(F.col("_open"), 3).otherwise(0)
    base = F.when(F.col("_initial") == "s", 4).when(F.col("_initial") == "u", 8).when(F.col("_initial") == "a", 12).otherwise(0)
    letters = plain.join(first, "place", "left").select(
        "conv_id", F.shiftright("place", BLOCK_BITS).alias("block"), "place", F.char((F.lit(65) + base + fault).cast("long")).alias("letter")
    )
    blocks = letters.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "letter"))).alias("l"))
    blocks = blocks.select("conv_id", "block", F.array_join(F.col("l.letter"), "").alias("codes"))
    return written(blocks, "repair-blocks")


def _searched(blocks: DataFrame) -> DataFrame:
    """Cost and audit of each block for every state before and after it that its conversation allows."""
    spans = blocks.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    spans = spans.withColumnRenamed("conv_id", "_conv")
    known = blocks.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    framed = known.select(
        "conv_id", "block", "codes",
        (F.col("block") == F.coalesce("low", "block")).alias("opens"), (F.col("block") == F.coalesce("high", "block")).alias("closes"),
    )
    names = ["conv_id", "block", "codes", "entry", "leave", "cost", "audit"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, block, codes, opens, closes in zip(*(c.to_pylist() for c in batch.columns)):
                lattice = Lattice(codes, closes)
                for entry in (0,) if opens else range(4):
                    for exits in [(0, 3)] if closes else [(s,) for s in range(4)]:
                        found = lattice.cheapest(entry, exits)
                        if found is not None:
                            out.append((conv_id, block, codes, entry, -1 if closes else exits[0], *found))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return map_arrow(
        framed, run, "conv_id long, block long, codes string, entry long, leave long, cost long, audit string"
    )


class Chain:
    """The blocks of one conversation: the cheapest states between them, then the least audits."""

    def __init__(self) -> None:
        self.blocks: dict[int, tuple[str, dict[int, list[tuple[int, int, str]]]]] = {}

    def add(self, block: int, codes: str, entry: int, leave: int, cost: int, audit: str) -> None:
        self.blocks.setdefault(block, (codes, {}))[1].setdefault(entry, []).append((leave, cost, audit))

    def pieces(self) -> Iterator[tuple[int, str, int, str]]:
        """(block, codes, cost, audit) in order."""
        order = sorted(self.blocks)
        rest: dict[int, int] = {-1: 0}
        after: list[dict[int, int]] = []
        for block in reversed(order):
            after.append(rest)
            ways = self.blocks[block][1]
            rest = {s: min((c + rest[t] for t, c, _ in w if t in rest), default=_INFINITE) for s, w in ways.items()}
            rest = {s: c for s, c in rest.items() if c < _INFINITE}
        state = 0
        for block in order:
            follow = after.pop()
            codes, ways = self.blocks[block]
            least = min(c + follow[t] for t, c, _ in ways[state] if t in follow)
            audit, leave, cost = min((a, t, c) for t, c, a in ways[state] if t in follow and c + follow[t] == least)
            yield block, codes, cost, audit
            state = leave


def _chained(searched: DataFrame) -> DataFrame:
    """One row per block with its part of the audit; a conversation holds a few numbers per block."""
    names = ["conv_id", "block", "codes", "cost", "audit"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        current, chain, rows = None, None, []
        for batch in batches:
            for conv_id, *way in zip(*(c.to_pylist() for c in batch.columns)):
                if chain is None or conv_id != current:
                    if chain is not None:
                        rows += [(current, *piece) for piece in chain.pieces()]
                    current, chain = conv_id, Chain()
                chain.add(*way)
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
        if chain is not None:
            rows += [(current, *piece) for piece in chain.pieces()]
        if rows:
            yield out(rows)

    ordered = searched.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return map_arrow(ordered, run, "conv_id long, block long, codes string, cost long, audit string")


class Reader:
    """Applies the audit to the rows of one conversation as they pass, keeping the report."""

    def __init__(self) -> None:
        self.counts = [0, 0, 0, 0]
        self.illegal = self.cost = self.distinct = self.state = 0
        self.low = self.high = self.initial = None
        self.audits: list[str] = []
        self.codes, self.audit, self.at, self.row_at = "", "", 0, 0
        self.digest, self.any = hashlib.sha256(), False

    def block(self, codes: str, cost: int, audit: str) -> list[tuple[str, str]]:
        made = self.finish()
        self.codes, self.audit, self.at, self.row_at = codes, audit, 0, 0
        self.cost += cost
        self.audits.append(audit)
        return made

    def _made(self, role: str, text: str, state: int) -> tuple[str, str]:
        self.state = state
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True
        return role, text

    def finish(self) -> list[tuple[str, str]]:
        """Turns inserted here, before the next row or at the end."""
        made = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            state = _added(self.state)
            made.append(self._made(_ROLE_OF[state], "", state))
            self.at += 1
        return made

    def row(self, turn: int | None, role: str, text: str) -> list[tuple[str, str]]:
        initial, fault = _row(self.codes[self.row_at])
        self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        made = self.finish()
        edit = self.audit[self.at]
        if edit == "K":
            made.append(self._made(role, text, _KEEPS[initial][self.state]))
        elif edit == "R":
            state = _added(self.state)
            made.append(self._made(_ROLE_OF[state], text, state))
        self.at, self.row_at = self.at + 1, self.row_at + 1
        return made

    def report(self, conv_id: int | None) -> tuple:
        self.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        _, blank, duplicate, truncated = self.counts
        return conv_id, gaps, blank, duplicate, truncated, self.illegal, self.cost, "".join(self.audits), self.digest.hexdigest()


def _ordered(rows: DataFrame, pieces: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per conversation, its audit by block and its rows, sorted to be read one after the other."""
    none = F.lit(None)
    marks = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    streams = [
        marks.select("conv_id", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"),
                     none.cast("long").alias("number"), none.cast("string").alias("first"), none.cast("string").alias("second")),
        pieces.select("conv_id", "block", F.lit(1), F.lit(0).cast("long"), "cost", "codes", "audit"),
        rows.select("conv_id", F.shiftright("place", BLOCK_BITS), F.lit(2), "place", "turn", "role", "text"),
    ]
    union = streams[0].union(streams[1]).union(streams[2])
    sorted_rows = union.repartition("conv_id").sortWithinPartitions("conv_id", "block", "kind", "place")
    return sorted_rows.select("conv_id", "kind", "number", "first", "second")


def edits(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered rows and the cheapest audit of each conversation by block of rows."""
    rows = numbered(turns)
    return rows, _chained(_searched(_codes(rows)))


def _read(stream: DataFrame, schema: str, kinds: list, each_turn: bool) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def turns_of(made: list[tuple[str, str]]) -> None:
            nonlocal number
            for role, text in made:
                rows.append((current, number, role, text))
                number += 1

        current, reader, number, rows = None, None, 0, []
        for batch in batches:
            for conv_id, kind, value, first, second in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv_id != current:
                    if reader is not None:
                        turns_of(reader.finish()) if each_turn else rows.append(reader.report(current))
                    current, reader, number = conv_id, Reader(), 0
                made = reader.block(first, value, second) if kind == 1 else reader.row(value, first, second) if kind == 2 else []
                if each_turn:
                    turns_of(made)
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
        if reader is not None:
            turns_of(reader.finish()) if each_turn else rows.append(reader.report(current))
        if rows:
            yield out(rows)

    return map_arrow(stream, run, schema)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns of all conversations: conv_id, number (from 0), role, text.

    Order, faults and nulls are those of ``report``; a conversation whose rows are all deleted has none.
    """
    rows, pieces = edits(turns)
    schema = "conv_id long, number long, role string, text string"
    return _read(_ordered(rows, pieces, rows), schema, [pa.int64(), pa.int64(), pa.string(), pa.string()], True)


def report(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its cheapest repair, and a digest.

    ``conversations`` has every conv_id to report, also those without rows in ``turns``: they have
    zeros, an empty audit and the digest of an empty text. A null role or text is one space, a null
    conversation id is a conversation of its own, null turns come first and count for no gap, rows of
    one turn are ordered by role and text, a repeated row is a duplicate, and further columns are
    ignored. The digest is a chain over the repaired text, which passes its task as a stream; held
    are only the audit of a conversation, which is part of its row, and a few numbers per block.
    """
    rows, pieces = edits(turns)
    schema = (
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string"
    )
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return _read(_ordered(rows, pieces, turns if conversations is None else conversations), schema, kinds, False)


def _sql_add(way: str, cost: str, initial: str) -> str:
    return f"(printf('%09d', CAST(left({way}, 9) AS INT) + {cost}) || substr({way}, 10) || '{initial}')"


def _oracle() -> str:
    """The same by a recursive sweep over rows, with cost and audit of each state as one string."""
    def closed(a: str) -> str:
        b2 = f"list_min([{a}a2, {_sql_add(a + 'a0', '2', 'I')}, {_sql_add(a + 'a1', '2', 'I')}, {_sql_add(a + 'a3', '2', 'I')}])"
        return f"{a}a0 AS b0, {a}a1 AS b1, {b2} AS b2, list_min([{a}a3, {_sql_add(b2, '2', 'I')}]) AS b3"

    def when(condition: str, value: str) -> str:
        return f"CASE WHEN fault NOT IN (1, 2) AND {condition} THEN {value} END"

    more = "CAST(fault = 3 AS INT)"
    keep_u = ", ".join(when("p = 'u'", _sql_add(b, more, "K")) for b in ("b0", "b1", "b3"))
    role_u = ", ".join(when("true", _sql_add(b, f"2 + {more}", "R")) for b in ("b0", "b1", "b3"))
    return f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CAST(xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) AS BIGINT) % 20 AS k
    FROM conversations
), harmed AS (
    SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM keyed, range(2) r(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS p,
        regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM harmed
), f AS (
    SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
        WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(p) OVER (PARTITION BY conv_id ORDER BY i) || p NOT IN ('su', 'ua', 'au') AS broken FROM placed
), swept AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS a0, CAST(NULL AS VARCHAR) AS a1, CAST(NULL AS VARCHAR) AS a2, CAST(NULL AS VARCHAR) AS a3 FROM f
    UNION ALL
    SELECT conv_id, i, {_sql_add('b0', '3', 'D')}, list_min([{_sql_add('b1', '3', 'D')}, {when("p = 's'", _sql_add('b0', more, 'K'))}]),
        list_min([{_sql_add('b2', '3', 'D')}, {keep_u}, {role_u}]),
        list_min([{_sql_add('b3', '3', 'D')}, {when("p = 'a'", _sql_add('b2', more, 'K'))}, {when("true", _sql_add('b2', f'2 + {more}', 'R'))}])
    FROM (SELECT f.*, {closed('s.')} FROM swept s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1) step
), ends AS (
    SELECT conv_id, list_min([b0, b3]) AS way FROM (SELECT conv_id, {closed('')} FROM swept QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1) c
), marks AS (
    SELECT conv_id, k, substr(way, 9 + k, 1) AS edit, count(*) FILTER (substr(way, 9 + k, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i
    FROM (SELECT conv_id, way, unnest(range(1, length(way) - 8)) AS k FROM ends) u
), made AS (
    SELECT m.conv_id, m.k, m.edit, f.role, coalesce(CASE WHEN m.edit <> 'I' THEN f.text END, '') AS text,
        row_number() OVER (PARTITION BY m.conv_id ORDER BY m.k)
            - max(CAST(m.edit = 'K' AND f.p = 's' AS INT)) OVER (PARTITION BY m.conv_id) AS e
    FROM marks m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i AND m.edit <> 'I' WHERE m.edit <> 'D'
), texts AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN e % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS digest
    FROM made GROUP BY 1
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (broken) AS illegal FROM f GROUP BY 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(way, 9) AS BIGINT), 0) AS cost,
    coalesce(substr(way, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE = _oracle()

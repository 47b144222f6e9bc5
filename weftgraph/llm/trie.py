"""Prefix trie of conversations: range-sorted turn arrays, common prefixes of neighbours, a stack sweep.

1. A turn becomes WIDTH bytes: the first 16 of md5 over role and text (role's length first), and the text's UTF-8 length.  The turns of a
   conversation, one after another, are its turn array; arrays compare as bytes, so a prefix comes before what extends it.
2. Conversations are rebuilt (see rebuilt): base and own turns meet by the base's id, which at most nine
   conversations share.
3. All rebuilt conversations are range-sorted by (turn array, conv_id), so copies that a third of all conversations
   share are dealt over as many ranges as their number asks for.
4. Each range is swept with a stack of intervals: rows that share a prefix of hi turns.  The common prefix of
   neighbours says which intervals close; a closed interval gives the nodes of depths (lo, hi], whose members are the same.
5. Intervals on the path of a range's first or last row may go on in other ranges.  Each range hands over these two
   paths, and one task stitches them in the order of ranges with the same stack; its input is two paths a range, not rows.
6. A node below a branching point needs that node's smallest member, known only when the whole branch is closed: it is
   looked up by (a member, depth), by broadcast for at most HOT nodes with most children, by a join for the others.
7. ends_sha256 is streamed: rows come in order of conv_id.  Runs of equal conversations that touch a range's edge or
   are longer than `chunk` are handed over as chunks of ids and hashed in order, one node a group, in bounded memory.

Edge cases: null roles and texts are empty ones; a null turn comes first; turns with equal numbers (repeated rows
included, which stay) are ordered by role, then by their bytes here; rows with a null conv_id belong to no conversation and are left out;
c % 5 keeps the sign of c, as in SQL; turnless conversations end at the root; very long texts enter by hash and
length; a conversation's turns, WIDTH bytes each, must fit in one row (over 10**7 turns); other columns are not read; an empty table
gives no nodes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, freed, met, partitions, saved

WIDTH, CHUNK = 20, 4096
NODE, TOP, NAME, PATH, IDS = 0, 1, 2, 3, 4  # kinds of records
DRAIN = 20_000  # records that a task holds before it gives them on
SWEPT = (
    "kind int, part int, seq long, ref long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends binary, tops long, last boolean, turns binary, ids binary"
)
_COLUMNS = [c.split()[0] for c in SWEPT.split(", ")]
_EMPTY = hashlib.sha256(b"").digest()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, b (the conversation whose first turns it takes), turns."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    own = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    size = F.unhex(F.lpad(F.hex(F.octet_length("text")), 8, "0"))
    name = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("b"), "turn", "role", F.concat(F.unhex(F.md5(name)), size).alias("tok"))
    # By the base's id: a conversation and its base land in one task, so that rebuilding needs no further shuffle.
    rows = rows.repartition(partitions(rows.sparkSession), "b")
    listed = F.expr("listagg(tok) WITHIN GROUP (ORDER BY turn ASC NULLS FIRST, role, tok)")
    return rows.groupBy("b", "conv_id").agg(listed.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of the base (h = crc32 of the id modulo 9), then the own turns after h."""
    base = F.max(F.when(F.col("conv_id") == F.col("b"), F.col("turns")))
    both = turn_arrays(conversations).groupBy("b").agg(base.alias("base"), F.collect_list(F.struct("conv_id", "turns")).alias("own"))
    each = both.select(F.coalesce("base", F.lit(b"")).alias("base"), F.explode("own").alias("own")).select("base", "own.*")
    cut = (F.crc32(F.col("conv_id").cast("string")) % 9 * WIDTH).cast("int")
    rest = F.substring("turns", cut + 1, F.octet_length("turns"))
    return each.select("conv_id", F.concat(F.substring("base", F.lit(1), cut), rest).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both."""
    most = min(len(a), len(b)) // WIDTH
    low, step = 0, 1  # the first `low` are equal; double, then halve
    while low + step <= most and a[low * WIDTH : (low + step) * WIDTH] == b[low * WIDTH : (low + step) * WIDTH]:
        low, step = low + step, step * 2
    while step:
        if low + step <= most and a[low * WIDTH : (low + step) * WIDTH] == b[low * WIDTH : (low + step) * WIDTH]:
            low += step
        step //= 2
    return low


class Interval:
    """Conversations that share hi turns: what is known of the node at depth hi but for open intervals below."""

    __slots__ = ("hi", "ref", "first", "least", "n", "children", "leaves", "saved", "ends", "ids", "seq", "names")

    def __init__(self, hi: int, ref: int, first: bool = False):
        self.hi, self.ref, self.first = hi, ref, first  # ref: one of its conversations; first: holds the range's first row
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.ids, self.seq = None, [], 0  # hash of the ids that end here; ids not yet hashed; chunks handed over
        self.names = {ref: 0}  # conversations by which nodes below know it, and how many do

    def take(self, least: int, n: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n += n

    def ends_hash(self) -> bytes | None:
        """Hash of the ids that end here; None if they were handed over as chunks."""
        return None if self.seq else self.ends or hashlib.sha256(_joined(self.ids)).digest()


def _joined(ids: list[int]) -> bytes:
    return b",".join(b"%d" % c for c in ids)


class Records:
    """Rows of SWEPT to be given on, as columns."""

    def __init__(self):
        self.cols, self.n = {c: [] for c in _COLUMNS}, 0

    def add(self, n: int = 1, **values) -> None:
        """n rows; a value is one for all, or a list of n."""
        for c, own in self.cols.items():
            v = values.get(c)
            own += v if isinstance(v, list) else [v] * n
        self.n += n

    def drained(self) -> list[list]:
        out = list(self.cols.values())
        self.__init__()
        return out


class Sweep:
    """The stack over rows (or ranges' paths) in order; closed intervals go to out."""

    def __init__(self, part: int | None = None):
        self.part, self.out, self.stack, self.turns = part, Records(), [], b""

    def close(self, lcp: int, path: list | None = None) -> None:
        """Close all intervals deeper than lcp; path gathers those that hold the range's first row, to be stitched."""
        stack = self.stack
        while stack[-1].hi > lcp:
            x = stack.pop()
            if stack[-1].hi < lcp:
                stack.append(Interval(lcp, x.ref, x.first))
            if path is not None and x.first:
                path.append(x)
            else:
                self.give(x, stack[-1])

    def give(self, x: Interval, up: Interval) -> None:
        """Nodes of depths (up.hi, x.hi], and x's sums to the interval above."""
        lo, k = up.hi, x.hi - up.hi
        leaves = x.leaves + (x.children == 0)
        size = np.frombuffer(self.turns[lo * WIDTH : x.hi * WIDTH], np.uint8).reshape(k, WIDTH)[:, 16:].copy().view(">u4").ravel()
        total = (np.cumsum(size[::-1].astype(np.int64) * (x.n - 1))[::-1] + x.saved).tolist()
        if x.seq:
            self.hand_over(x)
        self.out.add(
            k, kind=[TOP] + [NODE] * (k - 1), ref=[up.ref] + [None] * (k - 1), depth=list(range(lo + 1, x.hi + 1)), conv_id=x.least,
            parent_conv_id=[None] + [x.least] * (k - 1), n_convs=x.n, n_children=[1] * (k - 1) + [x.children], n_leaves=leaves,
            saved_tokens=total, ends=[_EMPTY] * (k - 1) + [x.ends_hash()],
        )
        self.named(x)
        up.take(x.least, x.n)
        up.children += 1
        up.names[up.ref] += 1
        up.leaves += leaves
        up.saved += total[0]

    def named(self, x: Interval) -> None:
        """Where intervals below, and chunks of ids, find x's smallest member."""
        for name, tops in x.names.items():
            if tops or x.seq:
                self.out.add(kind=NAME, ref=name, depth=x.hi, conv_id=x.least, tops=tops)

    def hand_over(self, x: Interval) -> None:
        """A chunk of the ids that end at x."""
        if x.ids:
            self.out.add(kind=IDS, part=self.part, seq=x.seq, ref=x.ref, depth=x.hi, ids=_joined(x.ids))
            x.ids, x.seq = [], x.seq + 1


class RangeSweep:
    """One range's sweep: closed nodes, chunks of ids, and the paths of the first and last row."""

    def __init__(self, chunk: int):
        from pyspark import TaskContext

        self.chunk = chunk
        self.sweep, self.head, self.path = Sweep(TaskContext.get().partitionId()), None, []

    def __call__(self, convs, arrays):
        s = self.sweep
        for c, turns in zip(convs, arrays):
            if self.head is None:
                self.head = (c, turns)
                s.stack.append(Interval(0, c, True))
            else:
                s.close(common_turns(s.turns, turns), self.path)
            own, length = s.stack[-1], len(turns) // WIDTH
            if own.hi < length:
                own = Interval(length, c, c == self.head[0])
                s.stack.append(own)
            own.take(c, 1)
            own.ids.append(c)
            if len(own.ids) == self.chunk:
                s.hand_over(own)
            s.turns = turns
            if s.out.n > DRAIN:
                yield s.out.drained()
        yield s.out.drained()

    def flush(self):
        s = self.sweep
        if self.head is not None:
            firsts = self.path + [x for x in reversed(s.stack) if x.first]  # from the deepest on
            lasts = [x for x in reversed(s.stack) if not x.first]
            for x in firsts + lasts:
                if x.seq or x is firsts[0] or x is s.stack[-1]:  # equal rows may go on in the next range
                    s.hand_over(x)
                s.out.add(
                    kind=PATH, part=s.part, last=not x.first, depth=x.hi, ref=x.ref, conv_id=x.least, n_convs=x.n, n_children=x.children,
                    n_leaves=x.leaves, saved_tokens=x.saved, ends=x.ends_hash() if x.ids else None, seq=x.seq, tops=x.names[x.ref],
                )
            kept = max(x.hi for x in s.stack if x.first)
            s.out.add(kind=PATH, part=s.part, depth=kept, turns=self.head[1], ids=s.turns)
        return s.out.drained()


class Stitch:
    """All ranges' paths, in order of ranges; a range's summary (its first and last turn arrays) comes first."""

    def __init__(self):
        self.sweep, self.held, self.now = Sweep(), [], None

    def __call__(self, *cols):
        for r in (dict(zip(_COLUMNS, x)) for x in zip(*cols)):
            if r["turns"] is None:
                self.held.append(r)
                continue
            self.range_done()
            self.held, self.now = [], r
            if self.sweep.out.n > DRAIN:
                yield self.sweep.out.drained()
        yield self.sweep.out.drained()

    def range_done(self) -> None:
        if self.now is None:
            return
        s, head = self.sweep, self.now["turns"]
        if s.stack:
            s.close(common_turns(s.turns, head))
        s.turns, at = head, 0
        for r in self.held:  # by depth
            if r["last"]:
                continue
            while at < len(s.stack) and s.stack[at].hi < r["depth"]:
                at += 1
            if at == len(s.stack):
                s.stack.append(Interval(r["depth"], r["ref"]))
            elif s.stack[at].hi > r["depth"]:  # parts what was one interval in the ranges before
                s.stack.insert(at, Interval(r["depth"], s.stack[at].ref))
            _stitched(s.stack[at], r)
        s.close(self.now["depth"])  # what the range itself has closed
        s.turns = self.now["ids"]
        for r in self.held:
            if r["last"]:
                s.stack.append(Interval(r["depth"], r["ref"]))
                _stitched(s.stack[-1], r)

    def flush(self):
        self.range_done()
        s = self.sweep
        if s.stack:
            s.close(0)
            x = s.stack[0]
            s.out.add(kind=NODE, depth=0, conv_id=x.least, n_convs=x.n, n_children=x.children, n_leaves=x.leaves + (x.children == 0), saved_tokens=x.saved, ends=x.ends_hash())
            s.named(x)
        return s.out.drained()


def _stitched(x: Interval, r: dict) -> None:
    """A range's share of x."""
    if r["n_convs"]:
        x.take(r["conv_id"], r["n_convs"])
    x.children += r["n_children"]
    x.leaves += r["n_leaves"]
    x.saved += r["saved_tokens"]
    x.seq += r["seq"]
    x.ends = r["ends"] or x.ends
    x.names[r["ref"]] = x.names.get(r["ref"], 0) + r["tops"]


class EndsHash:
    """SHA-256 of each node's chunks of ids, streamed: rows are sorted by node, range and place."""

    def __init__(self):
        self.node, self.sha = None, None

    def __call__(self, convs, depths, ids):
        out = []
        for c, d, x in zip(convs, depths, ids):
            if (c, d) == self.node:
                self.sha.update(b"," + x)
            else:
                out += self.done()
                self.node, self.sha = (c, d), hashlib.sha256(x)
        return list(map(list, zip(*out))) or [[], [], []]

    def done(self):
        return [(*self.node, self.sha.digest())] if self.node else []

    def flush(self):
        return list(map(list, zip(*self.done()))) or [[], [], []]


def trie_nodes(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows = saved(rebuilt(conversations))  # read twice: ranges are chosen by a sample
    ranged = rows.repartitionByRange(partitions(spark), "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    swept = saved(arrow_map(ranged.select("conv_id", "turns"), partial(RangeSweep, chunk), SWEPT))
    freed(rows)
    paths = swept.filter(f"kind = {PATH}").repartition(1).sortWithinPartitions("part", F.col("turns").isNull(), "depth")
    both = swept.union(saved(arrow_map(paths, Stitch, SWEPT)))
    # (a member, depth) -> the node's smallest member.
    names = saved(both.filter(f"kind = {NAME}").select("ref", "depth", F.col("conv_id").alias("found"), "tops"))
    tops = both.filter(f"kind = {TOP}").withColumns({"at": F.col("depth"), "depth": F.col("depth") - 1})
    tops = met(tops, names, ["ref", "depth"], "tops").withColumns({"parent_conv_id": F.col("found"), "depth": F.col("at")})
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    nodes = both.filter(f"kind = {NODE}").select(*cols).union(tops.select(*cols))
    chunks = both.filter(f"kind = {IDS}").select("ref", "depth", "part", "seq", "ids").join(names.drop("tops"), ["ref", "depth"])
    told = chunks.repartition(partitions(spark), "found", "depth").sortWithinPartitions("found", "depth", "part", "seq")
    ends = arrow_map(told.select("found", "depth", "ids"), EndsHash, "conv_id long, depth long, sha binary")
    late = nodes.filter("ends IS NULL").join(ends, ["conv_id", "depth"]).withColumn("ends", F.col("sha")).select(*cols)
    return nodes.filter("ends IS NOT NULL").union(late).withColumn("ends_sha256", F.lower(F.hex("ends"))).drop("ends")

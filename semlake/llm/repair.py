"""Cheapest repair of damaged conversations, with the least audit among equals.

Conversations are hashed by id, sorted by turn and streamed through Arrow batches.  Each row is kept (K, cost 0),
given another role (R, 1), or deleted (D, 2; required for blank and duplicate rows); an empty turn is inserted (I, 5)
anywhere; an undeleted truncated row adds 5.  The role initials must come to ``(s?(ua)+)?``, so four states suffice:
nothing yet, after ``s``, after ``u``, after ``a``.

*Persistent audits.*  The best audit of a state is a node: a letter linked to the node of the letters before it, so
states share their prefixes.  A node has ancestors at distances 1, 2, 4, ... and a rolling hash.  Audits of equal cost
are compared by a search for their longest common prefix over ancestors' hashes; the equality that the hashes promise
is then verified letter by letter, and verified nodes are united so that no letter is verified twice.  Neither of two
such audits begins the other: the rest would be inserts only, which cost.

*Bounded windows.*  A state from which nothing can be gained over another is dropped (the bounds are at ``_prune``).
From time to time the letters that the states have in common are settled: their turns go out, and the nodes and texts
behind them are let go.  What a task holds of a conversation are its unsettled rows, one digest and one letter a row.
Audits may differ from the start for ever (``DKRKR...`` beside ``KRKRK...`` where one role speaks alone): then nothing
settles before the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from semlake.llm.common import bounded_batches, shuffle_width

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
WINDOW = 64
SPACE = " \t\n\x0b\x0c\r"
MODULUS, BASE = (1 << 61) - 1, 1_000_003_579
START, S, U, A = range(4)
#: States from which a role initial can follow, and the state that it leads to.
STEPS = {"s": ((START,), S), "u": ((START, S, A), U), "a": ((U,), A)}
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Node:
    """The last letter of an audit; ``up[k]`` is the node 2^k letters before."""

    __slots__ = ("letter", "depth", "hash", "up", "same")

    def __init__(self, parent: Node | None, letter: str) -> None:
        self.letter, self.same = letter, None
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * BASE + ord(letter)) % MODULUS
        up, at, k = [parent], parent, 0
        while len(at.up) > k:
            at = at.up[k]
            up.append(at)
            k += 1
        self.up = up

    def at(self, depth: int) -> Node:
        node, far = self, self.depth - depth
        k = 0
        while far:
            if far & 1:
                node = node.up[k]
            far >>= 1
            k += 1
        return node


def _root(x: Node) -> Node:
    while x.same is not None:
        if x.same.same is not None:
            x.same = x.same.same
        x = x.same
    return x


def _differing(x: Node, y: Node) -> tuple[Node, Node]:
    """The first letters in which two audits of equal length and unequal hashes differ, if hashes don't collide."""
    k = len(x.up) - 1
    while k >= 0:
        if k < len(x.up) and x.up[k] is not y.up[k] and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
        k -= 1
    return x, y


def _verified(x: Node, y: Node) -> tuple[Node, Node] | None:
    """None if the letters up to two nodes of one depth are the same, else the first two that differ."""
    pairs, found = [], None
    while (a := _root(x)) is not (b := _root(y)):
        if x.letter != y.letter:
            found, pairs = (x, y), []
        else:
            pairs.append((a, b))
        x, y = x.up[0], y.up[0]
    for a, b in pairs if found is None else ():
        if (a := _root(a)) is not (b := _root(b)):
            a.same = b
    return found


def smaller(x: Node, y: Node) -> bool:
    """Whether audit x is less than y in ASCII order."""
    if x is y:
        return False
    depth = min(x.depth, y.depth)
    a, b = x.at(depth), y.at(depth)
    if a.hash == b.hash:
        unlike = _verified(a, b)
        if unlike is None:
            if x.depth == y.depth:
                return False
            return x.depth < y.depth
    else:
        unlike = _differing(a, b)
        if unlike[0].depth > 1:
            unlike = _verified(unlike[0].up[0], unlike[1].up[0]) or unlike
    return unlike[0].letter < unlike[1].letter


def _offer(best: list, state: int, cost: int, parent: Node, letter: str) -> None:
    now = best[state]
    if now is None or cost < now[0]:
        best[state] = (cost, Node(parent, letter))
    elif cost == now[0]:
        node = Node(parent, letter)
        if smaller(node, now[1]):
            best[state] = (cost, node)


def _inserted(best: list) -> None:
    """Inserts of a turn before the next row; more than ``ua`` in a row gain nothing."""
    for initial in "ua":
        froms, to = STEPS[initial]
        for state in froms:
            if best[state] is not None:
                _offer(best, to, best[state][0] + INSERT, best[state][1], "I")


def _prune(best: list) -> None:
    """Drop states that another beats whatever follows.

    From A everything is open that is open from S; from START only a following ``s`` more, which A deletes for 2; from U
    only a following ``a`` more, which A deletes for 2.
    """
    a = best[A]
    if a is not None:
        for state, more in ((START, DELETE), (S, 0), (U, DELETE)):
            if best[state] is not None and a[0] + more < best[state][0]:
                best[state] = None


def advance(best: list, initial: str, gone: bool, cut: bool) -> list:
    """The states after one more row; gone: it must be deleted, cut: it is truncated."""
    out: list = [None] * 4
    for state, now in enumerate(best):
        if now is not None:
            _offer(out, state, now[0] + DELETE, now[1], "D")
    if not gone:
        for given in "sua":
            froms, to = STEPS[given]
            for letter, cost in (("K", KEEP),) if given == initial else (("R", REROLE),) if given != "s" else ():
                for state in froms:
                    if best[state] is not None:
                        _offer(out, to, best[state][0] + cost + CUT * cut, best[state][1], letter)
    _inserted(out)
    _prune(out)
    return out


def _common(nodes: list[Node]) -> Node:
    """The deepest node that all audits share."""
    x = nodes[0]
    for y in nodes[1:]:
        depth = min(x.depth, y.depth)
        x, y = x.at(depth), y.at(depth)
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and x.up[k] is not y.up[k]:
                x, y = x.up[k], y.up[k]
        x = x if x is y else x.up[0]
    return x


def _letters(node: Node, above: Node) -> str:
    out = []
    while node is not above:
        out.append(node.letter)
        node = node.up[0]
    return "".join(reversed(out))


class Conversation:
    """One conversation's rows in order -> its repaired turns, as they settle, and its counts."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id = conv_id
        self.best: list = [(0, Node(None, "")), None, None, None]
        _inserted(self.best)
        self.base = self.best[START][1]
        self.waiting: list[tuple[str, str]] = []
        self.seen: set[bytes] = set()
        self.audit: list[str] = []
        self.state = START
        self.last = self.low = self.high = None
        self.turns, self.rows, self.next = 0, 0, WINDOW
        self.count = dict.fromkeys(COUNTS, 0)

    def add(self, turn: int | None, role: str, text: str) -> list[tuple[str, str]]:
        """A further row -> turns that settle by it."""
        self.rows += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        bare = text.strip(SPACE)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=20).digest()
        fault = "blank" if not bare else "duplicate" if key in self.seen else "truncated" if bare[-1] not in ".!?" else None
        self.seen.add(key)
        if fault:
            self.count[fault] += 1
        if self.last is not None:
            self.count["illegal"] += self.last + role[:1] not in LEGAL
        self.last = role[:1]
        self.waiting.append((role, text))
        self.best = advance(self.best, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        if self.rows < self.next:
            return []
        out = self._settle()
        self.next = self.rows + max(WINDOW, len(self.waiting))  # what stays unsettled is not gone through for every row
        return out

    def _settle(self) -> list[tuple[str, str]]:
        shared = _common([now[1] for now in self.best if now is not None])
        if shared is self.base:
            return []
        out = self._apply(_letters(shared, self.base))
        # the nodes below are made anew over an empty audit; what they share stays shared
        self.base = Node(None, "")
        new: dict[int, Node] = {id(shared): self.base}
        for state, now in enumerate(self.best):
            if now is not None:
                path, node = [], now[1]
                while id(node) not in new:
                    path.append(node)
                    node = node.up[0]
                at = new[id(node)]
                for old in reversed(path):
                    at = new[id(old)] = Node(at, old.letter)
                self.best[state] = (now[0], at)
        return out

    def _apply(self, letters: str) -> list[tuple[str, str]]:
        self.audit.append(letters)
        out, used = [], 0
        for e in letters:
            role, text = ("", "") if e == "I" else self.waiting[used]
            used += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if self.state == U else "user"
            self.state = STEPS[role[:1]][1]
            out.append((role, text))
        del self.waiting[:used]
        return out

    def end(self) -> list[tuple[str, str]]:
        """The last turns; then ``count`` and ``audit`` are whole."""
        ends = [now for now in (self.best[START], self.best[A]) if now is not None]
        top = min(cost for cost, _ in ends)
        ends = [node for cost, node in ends if cost == top]
        node = ends[-1] if len(ends) == 2 and smaller(ends[1], ends[0]) else ends[0]
        self.count["cost"] = top
        self.count["gaps"] = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self._apply(_letters(node, self.base))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, list[tuple[str, str]], bool]]:
    """Sorted rows ``conv_id, turn, role, text`` (role null: only the id) -> settled turns, and whether these are the last."""
    now = None
    for b in batches:
        for conv_id, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now, now.end(), True
                now = Conversation(conv_id)
            if role is not None and (turns := now.add(turn, role, text)):
                yield now, turns, False
    if now is not None:
        yield now, now.end(), True


def _sorted(conversations: DataFrame) -> DataFrame:
    """Whole conversations in order: by turn (nulls first), then role and text; null roles and texts are one space."""
    bounded_batches(conversations.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.col("dropped") if "dropped" in conversations.columns else F.lit(False)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(~gone, blank("role")).alias("role"), F.when(~gone, blank("text")).alias("text"))
    return rows.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> the turns of the repaired conversations: ``conv_id, no, role, text``.

    Rows of one turn stand in the order of role and text.  A null conv_id is a conversation of its own, null roles and
    texts are one space.  Rows with a true ``dropped`` (optional) count for their id only.  Other columns are not read.
    """
    rows = _sorted(conversations)
    kind = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, last = 0, None
        for conv, turns, _ in _streamed(batches):
            no = no if conv is last else 0
            last = conv
            for k in range(0, len(turns), 1000):
                part = turns[k : k + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([conv.conv_id] * len(part), kind), pa.array(range(no, no + len(part)), pa.int64()), pa.array([r for r, _ in part], pa.string()), pa.array([t for _, t in part], pa.string())], names=["conv_id", "no", "role", "text"])
                no += len(part)

    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, no long, role string, text string")


def audits(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` -> a row for each conversation: ``conv_id``, counts of its faults, cost and audit of
    its cheapest repair, and the hash of the repaired turns (``role:text``, joined by newlines).

    Rows as in :func:`repaired_turns`.  A conversation all of whose rows are dropped has zeros, an empty audit and the
    hash of an empty text.
    """
    rows = _sorted(conversations)
    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, begun, made = hashlib.sha256(), False, []

        def packed() -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*made), kinds)], names=names)

        for conv, turns, over in _streamed(batches):
            for role, text in turns:
                digest.update(("\n" * begun + f"{role}:{text}").encode())
                begun = True
            if over:
                made.append((conv.conv_id, *(conv.count[c] for c in COUNTS), "".join(conv.audit), digest.hexdigest()))
                digest, begun = hashlib.sha256(), False
                if len(made) == 1000:
                    yield packed()
                    made = []
        if made:
            yield packed()

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {counts}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of ``conv_id:turn`` (nulls are one space) modulo 20, and ``dropped``: 0 drops the
    row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role user."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("dropped"), F.explode(copies)).drop("col")

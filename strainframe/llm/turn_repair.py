"""Repair of conversation structure by a shortest path with whole-number weights.

The roles of a sound conversation read ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turn, or nothing at all. Rows may be kept, given
another role or deleted, and empty turns may be inserted. A path through the
graph of (rows read, what the last turn was, turns inserted) is a way to
repair; an edge weighs one whole number, whose high digits are its cost and
whose low digits hold its letter at a fixed position, zero where no letter is.
The plain minimum of the sums is then the cheapest way, and among those the one
whose letters come first in ASCII.

Numbers stay short: after ``BLOCK`` rows the letters written so far give way to
their rank among the few ends of paths that are left, and a conversation of any
length takes time in proportion to its rows. Rows arrive in order and are not
gathered; each end of a path carries the hash of its own repaired text.

Which rows repeat earlier ones is found beforehand from digests, so that no
task remembers the turns of a long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of the edits, and what a truncated row adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Digits of the letters: zero ends an audit, the others follow ASCII.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {digit: letter for letter, digit in DIGITS.items()}
#: Rows whose letters are held in one number.
BLOCK = 256
#: Inserted turns that the graph allows. An inserted turn never pays at these costs: deleting its partner (2) and at
#: worst a system turn left alone (2) is cheaper than inserting (5).
INSERTS = 1
WHITE = " \t\n\v\f\r"

#: What the last turn was: nothing, system, user, assistant. Sound conversations end at nothing or assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
SOUND = (START, ASSISTANT)
AFTER = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
ROLES = {"u": "user", "a": "assistant"}

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Walk:
    """Cheapest ways to repair the rows read so far, one for each (last turn, turns inserted).

    Letters of one number of inserted turns have equal length, and only those are compared on the way. Ranks of past
    blocks order them where inserting never pays; with costs at which it can, ``block`` has to exceed the rows.
    """

    def __init__(self, inserts: int = INSERTS, costs: tuple[int, int, int, int, int] = (KEEP, REROLE, DELETE, INSERT, TRUNCATED), block: int = BLOCK):
        self.inserts, self.costs, self.block = inserts, costs, block
        self.width = 3 * (block + inserts)  # bits of the letters; a rank of 16 bits and the cost lie above them
        self.read = 0  # rows in this block
        self.ends: dict[tuple[int, int], tuple[int, object, tuple]] = {(START, 0): (0, None, ())}

    def _weight(self, cost: int, letter: str, layer: int) -> int:
        """Cost in the high digits, the letter at its position: rows read and turns inserted before it."""
        return (cost << (self.width + 16)) + (DIGITS[letter] << (self.width - 3 * (self.read + layer + 1)))

    def _insert(self) -> None:
        """Edges that add an empty turn between rows."""
        for layer in range(self.inserts):
            for initial, role in ROLES.items():
                for last, then in AFTER[initial].items():
                    if (last, layer) not in self.ends:
                        continue
                    weight, hashed, chain = self.ends[last, layer]
                    weight += self._weight(self.costs[3], "I", layer)
                    if (then, layer + 1) not in self.ends or weight < self.ends[then, layer + 1][0]:
                        self.ends[then, layer + 1] = (weight, _more(hashed, f"{role}:"), chain)

    def row(self, role: str, text: str, fault: str | None) -> None:
        keep, rerole, delete, _, truncated = self.costs
        self._insert()
        best: dict[tuple[int, int], tuple[int, tuple[int, int], str | None]] = {}

        def edge(source, last, weight, said):
            target = (last, source[1])
            weight += self.ends[source][0]
            if target not in best or weight < best[target][0]:
                best[target] = (weight, source, said)

        extra = truncated if fault == "truncated" else 0
        for source in self.ends:
            last, layer = source
            edge(source, last, self._weight(delete, "D", layer), None)
            if fault in ("blank", "duplicate"):
                continue
            then = AFTER.get(role[:1], {}).get(last)
            if then is not None:
                edge(source, then, self._weight(keep + extra, "K", layer), role)
            for initial, other in ROLES.items():
                if last in AFTER[initial]:
                    edge(source, AFTER[initial][last], self._weight(rerole + extra, "R", layer), other)
        self.ends = {
            target: (weight, self.ends[source][1] if said is None else _more(self.ends[source][1], f"{said}:{text}"), self.ends[source][2])
            for target, (weight, source, said) in best.items()
        }
        self.read += 1
        if self.read == self.block:
            self._settle()

    def _letters(self, weight: int, layer: int) -> str:
        digits = weight & ((1 << self.width) - 1)
        found = (digits >> (self.width - 3 * (place + 1)) & 7 for place in range(self.read + layer))
        return "".join(LETTERS[digit] for digit in found if digit)

    def _settle(self) -> None:
        """Letters of the block go to the chains; their order stays as a rank."""
        low = (1 << (self.width + 16)) - 1
        ranks = {value: rank for rank, value in enumerate(sorted({weight & low for weight, _, _ in self.ends.values()}))}
        self.ends = {
            (last, layer): ((weight & ~low) + (ranks[weight & low] << self.width), hashed, (chain, self._letters(weight, layer)))
            for (last, layer), (weight, hashed, chain) in self.ends.items()
        }
        self.read = 0

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired text)."""
        self._insert()
        found = []
        for (last, layer), (weight, hashed, chain) in self.ends.items():
            if last not in SOUND:
                continue
            pieces = [self._letters(weight, layer)]
            while chain:
                chain, piece = chain
                pieces.append(piece)
            audit = "".join(reversed(pieces))
            found.append((weight >> (self.width + 16), audit, hashed))
        longest = max(len(audit) for _, audit, _ in found)
        # One number again: the cost, then the letters with zeros up to a common length.
        cost, audit, hashed = min(found, key=lambda end: int(f"{end[0]:o}" + "".join(str(DIGITS[x]) for x in end[1]).ljust(longest, "0") or "0", 8))
        return cost, audit, (hashed or sha256()).hexdigest()


def _more(hashed, piece: str):
    """A hash of the text that goes on with a further line."""
    if hashed is None:
        return sha256(piece.encode())
    hashed = hashed.copy()
    hashed.update(b"\n" + piece.encode())
    return hashed


class Conversation:
    """Counts of one conversation while its rows pass."""

    def __init__(self, walk: Walk):
        self.walk, self.counts = walk, dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.before = self.repeats = None
        self.initial = None

    def mark(self, turn, role: str, name: str) -> None:
        """Rows of this turn, role and digest repeat an earlier one."""
        self.repeats = (turn, role, name)

    def fault(self, turn, role: str, text: str, name: str) -> str | None:
        own, again = (turn, role, name), self.before
        self.before = own
        trimmed = text.rstrip(WHITE)
        if not trimmed:
            return "blank"
        if own in (again, self.repeats):
            return "duplicate"
        return None if trimmed[-1] in ".!?" else "truncated"

    def row(self, turn, role: str, text: str, name: str) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        fault = self.fault(turn, role, text, name)
        if fault:
            self.counts[fault] += 1
        self.walk.row(role, text, fault)

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.counts.values(), self.illegal, *self.walk.result())


HEAD, MARK, ROW = range(3)


def _report_batches(batches: Iterator[pa.RecordBatch], inserts: int) -> Iterator[pa.RecordBatch]:
    """Rows (conversation, kind, turn, role, text, digest) in order; one report for each conversation."""
    held = None
    types = [*[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conversation", *(part.split()[0] for part in REPORT.split(", "))]
    found: list[tuple] = []

    def answer(kind):
        return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found, strict=True), [kind, *types])), names=names)

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.types[0]
        for name, what, turn, role, text, digest in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held is None or held[0] != name:
                if held:
                    found.append((held[0], *held[1].report()))
                held = (name, Conversation(Walk(inserts)))
            if what == MARK:
                held[1].mark(turn, role, digest)
            elif what == ROW:
                held[1].row(turn, role, text, digest)
        if found:
            yield answer(kind)
            found.clear()
    if held:
        found.append((held[0], *held[1].report()))
        yield answer(kind)


def _ordered(rows: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    conversation, turn, role, text = (F.col(f"`{name}`") for name in columns)
    said = F.coalesce(text.cast("string"), F.lit(" "))
    return rows.select(
        conversation.alias("conversation"), F.lit(ROW).alias("kind"), turn.cast("long").alias("turn"),
        F.coalesce(role.cast("string"), F.lit(" ")).alias("role"), said.alias("text"), F.md5(said).alias("digest"),
    )


def _place() -> Column:
    """Order of turns, null first."""
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Marks for the rows whose role and text were seen at an earlier turn.

    Only digests travel. Texts found at one turn alone need no mark: equal rows of one turn lie side by side.
    """
    slim = rows.select("conversation", "role", "digest", _place().alias("place"))
    firsts = slim.groupBy("conversation", "role", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first <> last")
    firsts = firsts.select(F.col("conversation").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conversation").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = slim.distinct().join(firsts, same).filter(F.col("place") > F.col("first"))
    return again.select("conversation", F.lit(MARK).alias("kind"), F.col("place.turn").alias("turn"), "role", F.lit("").alias("text"), "digest")


def _dealt(rows: DataFrame) -> DataFrame:
    """One conversation after another, its head first, then its turns; a mark comes right before the rows it speaks of."""
    order = [F.col("conversation").asc_nulls_first(), (F.col("kind") != HEAD), F.col("turn").asc_nulls_first(), "role", "digest", "kind"]
    return rows.repartition("conversation").sortWithinPartitions(*order)


def repair(rows: DataFrame, ids: DataFrame | None = None, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), inserts: int = INSERTS) -> DataFrame:
    """One report for each conversation: gaps, faults, illegal neighbours, cost, audit and digest of the repaired text.

    ``columns`` name the conversation, turn, role and text. ``ids`` (one column) names conversations that are
    to be reported even without rows: zeros, an empty audit, the digest of nothing. Rows are taken by turn, null
    first; rows of one turn by role and then by the MD5 of the text, so that equal rows are neighbours. A null role
    or text counts as one space, a null conversation is a conversation like others. A role that begins with none of
    s, u and a cannot be kept. Other columns are not read. The first fault of a row counts: blank, duplicate
    (role and text seen earlier), truncated. Digests run through a conversation's text in order, so one task reads
    it, row by row; nothing of it is gathered but its audit.
    """
    kind = rows.schema[columns[0]].dataType.simpleString()
    ordered = _ordered(rows, columns)
    dealt = ordered.unionByName(_repeated(ordered))
    if ids is not None:
        heads = ids.select(F.col(f"`{ids.columns[0]}`").alias("conversation")).distinct()
        none = {"kind": F.lit(HEAD), "turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "digest": F.lit("")}
        dealt = dealt.unionByName(heads.withColumns(none))
    found = _dealt(dealt).mapInArrow(partial(_report_batches, inserts=inserts), f"conversation {kind}, {REPORT}")
    return found.withColumnRenamed("conversation", columns[0])


def _repaired_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after a head whose text is the audit; each letter takes its row, and an inserted turn none."""
    names = ["conversation", "place", "role", "text", "edit", "turn"]
    held: list = [None, "", 0, 0, START]  # conversation, audit, letters read, turns written, last turn
    for batch in batches:
        found: list[tuple] = []

        def write(edit, role, text, turn):
            initial = role[:1] if edit == "K" else "a" if held[4] == USER else "u"
            found.append((held[0], held[3], role if edit == "K" else ROLES[initial], text, edit, turn))
            held[3], held[4] = held[3] + 1, AFTER[initial][held[4]]

        def inserted():
            while held[1][held[2] : held[2] + 1] == "I":
                held[2] += 1
                write("I", "", "", None)

        for name, what, turn, role, text, _ in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if what == HEAD:
                held[:] = [name, text, 0, 0, START]
                inserted()
                continue
            edit = held[1][held[2]]
            held[2] += 1
            if edit != "D":
                write(edit, role, text, turn)
            inserted()
        types = [batch.schema.types[0], pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
        if found:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found, strict=True), types)), names=names)


def repaired_turns(rows: DataFrame, reports: DataFrame, columns: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """The repaired conversations row by row: (conversation, place, role, text, edit, turn), from the audits of ``repair``.

    ``place`` counts from 0, ``edit`` is K, R or I; inserted turns have an empty text and a null turn.
    """
    kind = rows.schema[columns[0]].dataType.simpleString()
    audits = reports.select(
        F.col(f"`{columns[0]}`").alias("conversation"), F.lit(HEAD).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit("").alias("digest"),
    )
    dealt = _dealt(_ordered(rows, columns).unionByName(audits))
    found = dealt.mapInArrow(_repaired_batches, f"conversation {kind}, place long, role string, text string, edit string, turn long")
    return found.withColumnRenamed("conversation", columns[0])

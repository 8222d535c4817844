"""Repair of conversation structure: the cheapest edits after which the roles follow a grammar.

A row's signature is one letter for its role and its first fault; a conversation's signature is its
rows' letters in order. What the rest of a conversation costs depends on the letters left and on the
state of the grammar only, so conversations share it: distinct signatures are sorted from their ends
over all partitions, and neighbours in that order share a path of a suffix automaton. Each node of
the path, a suffix, and each grammar state gets its cheapest cost and first edit once. Rows pass
through two sorted streams, one that spells signatures and one that applies the edits, so a task
holds one conversation's letters, never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import written

#: Costs of edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar (s?(ua)+)? : by state, what each initial leads to; the start and the state after a may end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (True, False, False, True)
#: By state, the role that a reroled or inserted row must have.
_ROLE = ("user", "user", "assistant", "user")
_FORCED = tuple(_NEXT[x][r[0]] for x, r in enumerate(_ROLE))

#: Fixed values of the contract: what counts as white space, and what ends a sentence.
_WORD, _CUT = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
_OK, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_INITIALS = "sua?"


def letter(initial: int, fault: int) -> str:
    return chr(65 + 4 * initial + fault)


def parts(char: str) -> tuple[str, int]:
    """(role initial, ? for any other; fault) of a signature's letter."""
    initial, fault = divmod(ord(char) - 65, 4)
    return _INITIALS[initial], fault


Node = list[tuple[int, str, int]]  # by grammar state: cost to go, first edit, state after it


def _node(char: str | None, rest: Node | None) -> Node:
    """The node that reads ``char`` and goes on to ``rest``; no char: the end. Edits differ in their first letter, so ties need no more than it."""
    far = 1 << 60
    out: Node = []
    for state in range(4):
        if char is None:
            out.append((0, "", state) if _ENDS[state] else (far, "", state))
            continue
        initial, fault = parts(char)
        options = [(rest[state][0] + DELETE, "D", state)]
        if fault not in (_BLANK, _DUPLICATE):
            more = TRUNCATED if fault == _TRUNCATED else 0
            if initial in _NEXT[state]:
                options.append((rest[_NEXT[state][initial]][0] + more, "K", _NEXT[state][initial]))
            options.append((rest[_FORCED[state]][0] + more + REROLE, "R", _FORCED[state]))
        out.append(min(options))
    for _ in range(3):  # insertions lead from state to state of one node
        out = [min(out[x], (out[_FORCED[x]][0] + INSERT, "I", _FORCED[x])) for x in range(4)]
    return out


class SuffixAutomaton:
    """Nodes of the signature at hand, from its end; the next signature keeps those of the suffix that they share."""

    def __init__(self):
        self.word, self.nodes, self.made = "", [_node(None, None)], 0

    def solve(self, signature: str) -> tuple[int, str]:
        """(cost, audit) of a signature."""
        word, same = signature[::-1], 0
        for a, b in zip(word, self.word, strict=False):
            if a != b:
                break
            same += 1
        del self.nodes[same + 1 :]
        for char in word[same:]:
            self.nodes.append(_node(char, self.nodes[-1]))
            self.made += 1
        self.word = word
        at, state, audit = len(word), 0, []
        while True:
            _, edit, state = self.nodes[at][state]
            if not edit:
                return self.nodes[len(word)][0][0], "".join(audit)
            audit.append(edit)
            at -= edit != "I"


def solved(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature; an empty one costs nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            out = [automaton.solve(s) for s in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("signature"), pa.array([c for c, _ in out], pa.int64()), pa.array([a for _, a in out], pa.string())], names=["signature", "cost", "audit"])

    ends = F.reverse("signature")
    return signatures.select("signature").distinct().repartitionByRange(ends).sortWithinPartitions(ends).mapInArrow(run, "signature string, cost long, audit string")


def _fault(text: Column, first: Column) -> Column:
    """First fault of a row: blank, duplicate (not the first of its role and text), truncated."""
    return F.when(~text.rlike(_WORD), _BLANK).when(~first, _DUPLICATE).when(~text.rlike(_CUT), _TRUNCATED).otherwise(_OK)


def faulty_rows(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``digest``, ``copies`` and two letters, ``one`` of the first copy and ``more`` of the rest.

    Equal rows are collapsed first, and the first turn of a role and text comes from an aggregate, so
    a row repeated without end, or a text said in every turn, is a row a partition before it is shuffled.
    """
    key = ["conv_id", "role", "digest"]
    some = turns.withColumn("digest", F.sha2("text", 256)).groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = some.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    placed = some.alias("s").join(firsts.alias("f"), F.col("s.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("s.role") == F.col("f.role")) & (F.col("s.digest") == F.col("f.digest")), "left")
    first = F.col("f.first").isNull() | (F.col("f.first.known").eqNullSafe(F.col("s.turn").isNotNull()) & F.col("f.first.turn").eqNullSafe(F.col("s.turn")))
    initial = F.substring("s.role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    spelt = lambda fault: F.char(65 + 4 * number + fault)
    return placed.select("s.*", spelt(_fault(F.col("s.text"), first)).alias("one"), spelt(_fault(F.col("s.text"), F.lit(False))).alias("more"))


def _by_conversation(df: DataFrame, *then: str | Column) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *then)


#: Ascending, so nulls come first.
_ORDER = ("turn", "role", "digest")
_SPELT = "conv_id long, signature string, gaps long"


def signatures(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps) of every id of ``convs``, also of one without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, text, low, high, turns, out = None, False, [], None, None, 0, []

        def closed() -> None:
            gaps = 0 if low is None else high - low + 1 - turns
            out.append((conv, "".join(text), gaps))

        for batch in batches:
            for c, turn, one, more, copies in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "one", "more", "copies")), strict=True):
                if not open_ or c != conv:
                    if open_:
                        closed()
                    conv, open_, text, low, high, turns = c, True, [], None, None, 0
                if one is None:
                    continue
                text.append(one + more * (copies - 1))
                if turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
            if out:
                yield _columns(out, _SPELT)
                out.clear()
        if open_:
            closed()
            yield _columns(out, _SPELT)

    narrow = rows.select("conv_id", "turn", "role", "digest", "one", "more", "copies")
    marks = convs.select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "string"), ("one", "string"), ("more", "string"), ("copies", "long"))))
    return _by_conversation(narrow.unionByName(marks), *_ORDER).mapInArrow(run, _SPELT)


_KINDS = {"long": pa.int64(), "string": pa.string()}


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(zip(*rows, strict=True), named, strict=True)], names=[n for n, _ in named])


class Repair:
    """Applies one conversation's edits to its rows as they come; ``rows()`` yields what they become."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _role(self, role: str | None) -> str:
        role = _ROLE[self.state] if role is None else role
        self.state = _NEXT[self.state][role[0]]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._role(None), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._role(role if edit == "K" else None), text


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows (conv_id, n, role, text) of the repaired conversations; ``plans`` are (conv_id, audit)."""

    def run(stream: Iterator[tuple]) -> Iterator[tuple]:
        for c, n, role, text in _applied(stream):
            if n:
                yield c, n, role, text

    return _streamed(rows, plans, run, "conv_id long, n long, role string, text string")


def _applied(stream: Iterator[tuple]) -> Iterator[tuple]:
    """From rows (conv_id, audit or None, role, text, copies) to (conv_id, n, role, text), n from 1; each conversation opens with n = 0 and its audit."""
    conv, now, n = None, None, 0
    for c, audit, role, text, copies in stream:
        if audit is not None:
            if now:
                for r, t in now.inserted():
                    n += 1
                    yield conv, n, r, t
            conv, now, n = c, Repair(audit), 0
            yield c, 0, None, None
            continue
        for _ in range(copies):
            for r, t in now.row(role, text):
                n += 1
                yield conv, n, r, t
    if now:
        for r, t in now.inserted():
            n += 1
            yield conv, n, r, t


def _streamed(rows: DataFrame, plans: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each partition's conversations: the audit first, then the rows in order."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text", "copies")), strict=True)

        out, size = [], 0
        for row in run(each()):
            out.append(row)
            size += len(row[-1] or "")
            if len(out) >= 5000 or size > 1 << 22:
                yield _columns(out, schema)
                out, size = [], 0
        if out:
            yield _columns(out, schema)

    null = lambda t: F.lit(None).cast(t)
    first = plans.select("conv_id", F.lit(0).alias("kind"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("digest"), "audit", null("string").alias("text"), null("long").alias("copies"))
    then = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", null("string").alias("audit"), "text", "copies")
    return _by_conversation(first.unionByName(then), "kind", *_ORDER).mapInArrow(batches_of, schema)


def _hashes(stream: Iterator[tuple]) -> Iterator[tuple]:
    conv, sha, open_ = None, None, False
    for c, n, role, text in _applied(stream):
        if not n:
            if open_:
                yield conv, sha.hexdigest()
            conv, sha, open_ = c, hashlib.sha256(), True
            continue
        sha.update(f"{'' if n == 1 else chr(10)}{role}:{text}".encode())
    if open_:
        yield conv, sha.hexdigest()


def repair(turns: DataFrame, convs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, rows): per conversation its faults and cheapest edits, and the rows (conv_id, turn, role, text, ...) that they apply to.

    ``convs`` names ids to report besides those of ``turns``. A null role or text counts as one space;
    rows of a null conversation are one conversation. Rows go by turn, nulls first; of one turn by role,
    then by the text's SHA-256; equal rows lie side by side. Other columns aren't read. An empty table
    gives empty tables; an id without rows has zeros and an empty audit. ``repaired_rows(rows, report)``
    gives the repaired texts.

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    ids = turns.select("conv_id") if convs is None else turns.select("conv_id").unionByName(convs.select(F.col("conv_id").cast("long").alias("conv_id")))
    rows = written(faulty_rows(turns), "turns")
    spelt = written(signatures(rows, ids.distinct()), "conversations")
    plans = spelt.join(solved(spelt), "signature")
    count = lambda fault: F.length(F.regexp_replace("signature", f"[^{''.join(letter(i, fault) for i in range(4))}]", "")).cast("long")
    initials = F.translate("signature", "".join(letter(i, f) for i in range(4) for f in range(4)), "".join(x * 4 for x in _INITIALS))
    # each pair that fits takes its first letter away, and what is left besides the last letter doesn't fit
    unfit = F.regexp_replace(initials, "s(?=u)|u(?=a)|a(?=u)", "")
    illegal = F.greatest(F.length(unfit) - 1, F.lit(0)).cast("long")
    facts = plans.select("conv_id", "gaps", count(_BLANK).alias("blank"), count(_DUPLICATE).alias("duplicate"), count(_TRUNCATED).alias("truncated"), illegal.alias("illegal"), "cost", "audit")
    facts = written(facts, "plans")
    hashes = _streamed(rows, facts, _hashes, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "c")
    return facts.join(hashes, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"), rows


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    new = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(turns), turns.select("conv_id").distinct())[0]

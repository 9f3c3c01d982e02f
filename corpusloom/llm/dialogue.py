"""Conversation repair: the cheapest edits that make the roles of a conversation alternate, found by branch and bound.

Rows are dealt by ranges of (conversation, turn) and read in order, so a task meets each conversation as one run. A run is
repaired at once if it lies inside a task. A conversation that two tasks share, or that is longer than a
segment (`SEGMENT_ROWS`, `SEGMENT_BYTES`), is left as segments: rows seen earlier are found by a shuffle of digests, and
what is then brought together for the search is one byte a row, as the audit itself is one letter a row and one
value of the result. Texts stay in their segments, which rewrite them by their part of the audit; the checksum reads
the rewritten segments in order, one at a time.

The search goes depth first over (row, state of the role pattern) with an explicit stack. The bound of a node is the cheapest way to
finish from it, so the first incumbent has the bound of the root as its cost. Children are pushed so that audits are visited in
ASCII order: among audits of one cost the first met is the least, and a prefix that reaches a node at no less than the
cost recorded in the node's dominance table is worse than the recorded one. A prefix whose cost and bound exceed the incumbent
is dropped. The search ends with the proof: all that is left on the stack is dominated or bounded away.

Defined cases: a null conv_id is a conversation, null turns come first. Null role and text are one space, and null parts of the checksum's
key as well. Rows of one turn are ordered by role, then by text, so equal rows are neighbours. Empty texts are blank.
An empty role has no initial and fits nowhere. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, staged

SEGMENT_ROWS = 2048
SEGMENT_BYTES = 4 << 20
SPACE = " \t\n\x0b\x0c\r"
MARKS = ".!?"

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1

#: classes of a row: initial s, u, a or another, plus four times its fault
S, U, A, OTHER = range(4)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {(S, U), (U, A), (A, U)}

#: states of `(s?(ua)+)?`: start, after s, after u, after a
STATES = range(4)
ACCEPTING = (0, 3)
#: state after the initial that a state wants, and that initial
STEP = (2, 2, 3, 2)
WANTED = (U, U, A, U)
ROLES = {U: "user", A: "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the checksum of a row's key decides; null role and text for dropped rows."""

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    read = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 0, None).when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 0, None).when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return read.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def row_class(role: str, text: str, seen: bool) -> int:
    """Initial and first fault of a row."""
    body = text.rstrip(SPACE)
    fault = BLANK if not body else DUPLICATE if seen else TRUNCATED if body[-1] not in MARKS else SOUND
    return {"s": S, "u": U, "a": A}.get(role[:1], OTHER) + 4 * fault


def kept_state(state: int, initial: int) -> int | None:
    """State after a kept row, if it fits."""
    if initial == WANTED[state]:
        return STEP[state]
    return 1 if state == 0 and initial == S else None


def suffix_bounds(classes: bytes) -> list[list[int]]:
    """Per row and state the cheapest cost to finish from there."""

    def with_inserts(own: list[int]) -> list[int]:
        for _ in range(2):  # further inserts only come back to a state
            own = [min(own[q], COST[INSERT] + own[STEP[q]]) for q in STATES]
        return own

    never = COST[DELETE] * len(classes) + 4 * COST[INSERT]
    bounds = [with_inserts([0 if q in ACCEPTING else never for q in STATES])]
    for code in reversed(classes):
        after, initial, fault = bounds[-1], code & 3, code >> 2
        own = [COST[DELETE] + after[q] for q in STATES]
        if fault in (SOUND, TRUNCATED):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            for q in STATES:
                own[q] = min(own[q], COST[REROLE] + extra + after[STEP[q]])
                kept = kept_state(q, initial)
                if kept is not None:
                    own[q] = min(own[q], COST[KEEP] + extra + after[kept])
        bounds.append(with_inserts(own))
    bounds.reverse()
    return bounds


def search(classes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, the ASCII-least audit among them."""
    n, bounds = len(classes), suffix_bounds(classes)
    incumbent, audit = bounds[0][0], None
    best: dict[int, int] = {}
    path = bytearray()
    stack = [(0, 0, 0, 0, b"")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        if cost + bounds[i][state] > incumbent or (audit is not None and cost + bounds[i][state] == incumbent):
            continue
        node = 4 * i + state
        if best.get(node, cost + 1) <= cost:
            continue
        best[node] = cost
        del path[depth:]
        path += letter
        depth = len(path)
        if i == n and state in ACCEPTING:
            incumbent, audit = cost, bytes(path)
            continue
        children = []  # in reverse ASCII order
        if i < n:
            code = classes[i]
            initial, fault = code & 3, code >> 2
            if fault in (SOUND, TRUNCATED):
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                children.append((i + 1, STEP[state], cost + COST[REROLE] + extra, depth, b"R"))
                kept = kept_state(state, initial)
                if kept is not None:
                    children.append((i + 1, kept, cost + COST[KEEP] + extra, depth, b"K"))
        children.append((i, STEP[state], cost + COST[INSERT], depth, b"I"))
        if i < n:
            children.append((i + 1, state, cost + COST[DELETE], depth, b"D"))
        stack += children
    return incumbent, audit.decode()


def replay(audit: str, state: int, initials: list[int], rows: list[tuple[str, str]]) -> tuple[list[str], int]:
    """`role:text` of the repaired rows, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == INSERT:
            out.append(f"{ROLES[WANTED[state]]}:")
            state = STEP[state]
            continue
        role, text = rows[at]
        if letter == KEEP:
            out.append(f"{role}:{text}")
            state = kept_state(state, initials[at])
        elif letter == REROLE:
            out.append(f"{ROLES[WANTED[state]]}:{text}")
            state = STEP[state]
        at += 1
    return out, state


def _classes(rows: list[tuple[str, str]]) -> bytes:
    seen: set[tuple[str, str]] = set()
    out = bytearray()
    for row in rows:
        out.append(row_class(*row, row in seen))
        seen.add(row)
    return bytes(out)


def _counts(classes: bytes) -> list[int]:
    """blank, duplicate, truncated and illegal."""
    faults = [code >> 2 for code in classes]
    initials = [code & 3 for code in classes]
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
    return [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal]


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def repair(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and repaired text of one conversation."""
    classes = _classes(rows)
    cost, audit = search(classes)
    lines, _ = replay(audit, 0, [c & 3 for c in classes], rows)
    return _gaps(turns), *_counts(classes), cost, audit, "\n".join(lines)


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _records(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _read_runs(segment_rows: int, segment_bytes: int, id_type: pa.DataType):
    """Results of whole conversations, and the segments of the others, from rows in order."""
    strings = pa.list_(pa.string())
    names = ["conv_id", "seg", *NUMBERS, "audit", "sha", "turns", "roles", "texts"]
    types = [id_type, pa.int64(), *[pa.int64()] * len(NUMBERS), pa.string(), pa.string(), pa.list_(pa.int64()), strings, strings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        out, out_bytes = [], 0
        current, whole, open_ = None, False, False  # the first conversation may have begun in the task before
        turns: list = []
        rows: list = []
        size = 0

        def close(whole: bool) -> None:
            nonlocal made, turns, rows, size, out_bytes
            if whole:
                *numbers, audit, text = repair(turns, rows)
                out.append((current, None, *numbers, audit, hashlib.sha256(text.encode()).hexdigest(), None, None, None))
            else:
                out.append((current, base + made, *[None] * len(NUMBERS), None, None, turns, [r for r, _ in rows], [t for _, t in rows]))
                out_bytes += size
                made += 1
            turns, rows, size = [], [], 0

        for batch in batches:
            for key, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or key != current:
                    if open_:
                        close(whole)
                        whole = True
                    current, open_ = key, True
                if role is None:
                    continue
                if len(rows) >= segment_rows or size >= segment_bytes:
                    close(False)
                    whole = False
                turns.append(turn)
                rows.append((role, text))
                size += len(role) + len(text)
                if out_bytes >= segment_bytes:
                    yield _records(out, names, types)
                    out, out_bytes = [], 0
            if len(out) >= 500:
                yield _records(out, names, types)
                out, out_bytes = [], 0
        if open_:
            close(False)  # it may go on in the task after
        if out:
            yield _records(out, names, types)

    return run


def _digest(key, role: str, text: str) -> bytes:
    code = hashlib.blake2b(digest_size=16)
    for part in ("" if key is None else f"={key}", role, text):
        data = part.encode()
        code.update(len(data).to_bytes(8, "little"))
        code.update(data)
    return code.digest()


def _encoded(id_type: pa.DataType):
    """Per segment the classes of its rows, its turns in short, and the digests of its different rows with their first places."""
    names = ["conv_id", "seg", "classes", "low", "high", "n_turns", "digests", "places"]
    types = [id_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, seg, turns, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(zip(roles, texts, strict=True))
                classes = _classes(rows)
                known = [t for t in turns if t is not None]
                first = [k for k, code in enumerate(classes) if code >> 2 not in (BLANK, DUPLICATE)]
                out.append((key, seg, classes, min(known, default=None), max(known, default=None), len(set(known)), [_digest(key, *rows[k]) for k in first], first))
            yield _records(out, names, types)

    return run


def _solve(id_type: pa.DataType):
    """The audit of one conversation, in parts that belong to its segments, and its numbers."""
    names = ["conv_id", "seg", "state", "part", *NUMBERS]
    types = [id_type, pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * len(NUMBERS)]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        parts = []
        for classes, again in zip(table.column("classes").to_pylist(), table.column("again").to_pylist(), strict=True):
            own = bytearray(classes)
            for k in again or ():
                own[k] = own[k] & 3 | 4 * DUPLICATE
            parts.append(bytes(own))
        classes = b"".join(parts)
        cost, audit = search(classes)
        low, high = (table.column(c).to_pylist() for c in ("low", "high"))
        # turns are in order: what a segment shares with those before it is its least turn at most
        n_turns, last = sum(table.column("n_turns").to_pylist()), None
        for a, b in zip(low, high, strict=True):
            if a is not None:
                n_turns -= a == last
                last = b
        known = [t for t in low + high if t is not None]
        gaps = max(known) - min(known) + 1 - n_turns if known else 0
        numbers = (gaps, *_counts(classes), cost)
        rows, at, state, key = [], 0, 0, table.column("conv_id")[0].as_py()
        begin = 0
        for seg, own in zip(table.column("seg").to_pylist(), parts, strict=True):
            entry, end, taken = state, begin, 0
            while end < len(audit) and (taken < len(own) or at + taken == len(classes)):
                letter = audit[end]
                if letter == INSERT:
                    state = STEP[state]
                elif letter == KEEP:
                    state = kept_state(state, own[taken] & 3)
                elif letter == REROLE:
                    state = STEP[state]
                taken += letter != INSERT
                end += 1
            rows.append((key, seg, entry, audit[begin:end], *numbers))
            begin, at = end, at + len(own)
        return pa.Table.from_batches([_records(rows, names, types)])

    return run


def _rewritten(id_type: pa.DataType):
    """Per segment its repaired text (null without rows), its part of the audit and the numbers of its conversation."""
    names = ["conv_id", "seg", "part", *NUMBERS, "repaired"]
    types = [id_type, pa.int64(), pa.string(), *[pa.int64()] * len(NUMBERS), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, seg, roles, texts, state, part, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(zip(roles, texts, strict=True))
                lines, _ = replay(part, state, [row_class(r, "", False) & 3 for r in roles], rows)
                out.append((key, seg, part, *numbers, "\n".join(lines) if lines else None))
            yield _records(out, names, types)

    return run


def _joined(id_type: pa.DataType):
    """One row per conversation from its rewritten segments in order; a checksum passes over them."""
    names = ["conv_id", *NUMBERS, "audit", "repaired_sha256"]
    types = [id_type, *[pa.int64()] * len(NUMBERS), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, current, numbers, parts, code, begun = False, None, (), [], None, False
        for batch in batches:
            out = []
            for key, _, part, *own, repaired in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_ or key != current:
                    if open_:
                        out.append((current, *numbers, "".join(parts), code.hexdigest()))
                    open_, current, numbers, parts, code, begun = True, key, own, [], hashlib.sha256(), False
                parts.append(part)
                if repaired is not None:
                    code.update((("\n" if begun else "") + repaired).encode())
                    begun = True
            if out:
                yield _records(out, names, types)
        if open_:
            yield _records([(current, *numbers, "".join(parts), code.hexdigest())], names, types)

    return run


def repair_conversations(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of (conv_id, turn, role, text)."""
    batches_of(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    id_type = pa.schema(rows.select("conv_id").limit(0).toArrow().schema).field(0).type
    numbers = ", ".join(f"{n} long" for n in NUMBERS)
    # a prefix of the text is enough for the ranges, and keeps the sampled bounds small
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kind}, seg long, {numbers}, audit string, sha string, turns array<long>, roles array<string>, texts array<string>"
    read = staged(dealt.select("conv_id", "turn", "role", "text").mapInArrow(_read_runs(segment_rows, segment_bytes, id_type), schema), "dialogues")
    whole = read.where("seg IS NULL").select("conv_id", *NUMBERS, "audit", F.col("sha").alias("repaired_sha256"))

    segments = read.where("seg IS NOT NULL").select("conv_id", "seg", "turns", "roles", "texts")
    schema = f"conv_id {kind}, seg long, classes binary, low long, high long, n_turns long, digests array<binary>, places array<int>"
    encoded = staged(segments.mapInArrow(_encoded(id_type), schema), "classes")
    digests = encoded.select("seg", F.explode(F.arrays_zip("digests", "places")).alias("d")).select("seg", F.col("d.digests").alias("digest"), F.col("d.places").alias("place"))
    several = digests.groupBy("digest").agg(F.min("seg").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("digest", "first")
    again = digests.join(several, "digest").where("seg > first").groupBy("seg").agg(F.collect_list("place").alias("again"))
    marked = encoded.drop("digests", "places").join(again, "seg", "left")
    paths = marked.groupBy("conv_id").applyInArrow(_solve(id_type), f"conv_id {kind}, seg long, state int, part string, {numbers}")
    texts = segments.select("conv_id", "seg", "roles", "texts").join(paths.drop("conv_id"), "seg").select("conv_id", "seg", "roles", "texts", "state", "part", *NUMBERS)
    pieces = texts.mapInArrow(_rewritten(id_type), f"conv_id {kind}, seg long, part string, {numbers}, repaired string")
    joined = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_joined(id_type), f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string")
    return whole.unionByName(joined)

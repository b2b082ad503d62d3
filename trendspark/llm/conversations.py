"""Conversation repair: the cheapest edits that make turns alternate, by a Viterbi search that emits as survivors coalesce.

A repaired conversation has role initials `(s?(ua)+)?`. Four states tell what was emitted last:
nothing, the system turn, a user's, an assistant's. Rows of a conversation pass in order; for every state
the cheapest edits that lead to it survive, as a path of a backpointer tree. Nodes count their references;
one that no survivor's path uses goes, and as soon as all survivors descend from one child of the
root, that child's edits are emitted and it becomes the root. So a task holds the unresolved suffixes
only, however long a conversation is.

Ties are broken by the complete strings of edits. Strings that have used the same rows can't be
prefixes of one another (each ends with the edit of the last row), so the order of the survivors is
carried as ranks: two candidates with different parents compare as these, others by their last edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trendspark.llm.common import SPACE_CHARS, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that may be inserted, or a row be made, after a state; and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("", "system", "user", "assistant")
LEGAL = frozenset(("su", "ua", "au"))
#: (state, other state, cost): what can still be done from the other state can be done from this one for so much more at most.
#: From an assistant's turn the same edits lead on as from nothing, but for a system row, which is deleted instead of kept; a user's turn needs an insertion more.
NO_WORSE = ((ASSISTANT, START, DELETE), (ASSISTANT, SYSTEM, 0), (USER, START, DELETE + INSERT), (USER, SYSTEM, INSERT))
#: Rows handed to Arrow at once.
ROWS = 5000


@cache
def moves(initial: str, fault: str) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state after a row: (state before, cost, edits) of the cheapest ways there, ASCII-least on ties.

    Before the row up to two turns are inserted (a third would come back to a state); blank and
    duplicate rows are deleted.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        at, cost = before, 0
        for inserted in range(3):
            ways = [(at, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                if initial == "s" and at == START:
                    ways.append((SYSTEM, KEEP + more, "K"))
                elif initial == ROLE[NEXT[at]][0]:
                    ways.append((NEXT[at], KEEP + more, "K"))
                ways.append((NEXT[at], REROLE + more, "R"))
            for after, c, edit in ways:
                way = (cost + c, "I" * inserted + edit)
                best[before, after] = min(way, best.get((before, after), way))
            at, cost = NEXT[at], cost + INSERT
    return tuple(tuple((b, *w) for (b, a), w in sorted(best.items()) if a == after) for after in range(4))


class _Node:
    """Edits of one row (insertions before it included) on the path of a survivor; refs counts children and the survivor."""

    __slots__ = ("parent", "kids", "refs", "state", "edits", "row")

    def __init__(self, parent: _Node | None, state: int, edits: str, row):
        self.parent, self.state, self.edits, self.row, self.refs, self.kids = parent, state, edits, row, 1, []
        if parent is not None:
            parent.refs += 1
            parent.kids.append(self)


class Search:
    """The survivors of one conversation; `emit` is called with (state before, edits, row) as edits become certain."""

    def __init__(self, emit: Callable[[int, str, object], None]):
        self.emit = emit
        self.root = _Node(None, START, "", None)
        # state -> (cost, rank in the order of complete edits, node)
        self.survivors: dict[int, tuple[int, int, _Node]] = {START: (0, 0, self.root)}

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            node = parent

    def _resolve(self) -> None:
        """Emit what all survivors share."""
        root = self.root
        while root.refs == 1 and root.kids:
            (child,) = root.kids
            child.parent = None
            self.emit(child.state, child.edits, child.row)
            root = child
        self.root = root

    def step(self, initial: str, fault: str, row) -> None:
        old, found = self.survivors, []
        for after, ways in enumerate(moves(initial if initial in ("s", "u", "a") else "", fault)):
            best = None
            for before, cost, edits in ways:
                if before in old:
                    c, rank, _ = old[before]
                    way = (c + cost, rank, edits, before)
                    if best is None or way < best:
                        best = way
            if best:
                found.append((best, after))
        costs = {after: best[0] for best, after in found}
        # what can't win any more goes: else the path that deletes all rows would share no edit with the others for ever
        lost = {b for a, b, more in NO_WORSE if a in costs and b in costs and costs[a] + more < costs[b]}
        found = sorted((x for x in found if x[1] not in lost), key=lambda x: x[0][1:3])  # by complete edits
        self.survivors = {after: (cost, rank, _Node(old[before][2], before, edits, row)) for rank, ((cost, _, edits, before), after) in enumerate(found)}
        for _, _, node in old.values():
            self._release(node)
        self._resolve()

    def end(self) -> int:
        """Emit the rest, insertions at the end included, and return the cost."""
        ends = []
        for state, (cost, rank, node) in self.survivors.items():
            inserted = 0
            while state not in (START, ASSISTANT):
                state, inserted = NEXT[state], inserted + 1
            ends.append((cost + INSERT * inserted, rank, inserted, node))
        cost, _, inserted, chosen = min(ends, key=lambda x: x[:2])
        for *_, node in ends:
            if node is not chosen:
                self._release(node)
        self._resolve()
        state = next(s for s, x in self.survivors.items() if x[2] is chosen)
        if inserted:
            self.emit(state, "I" * inserted, None)
        return cost

    def size(self) -> int:
        """Nodes that are held."""
        seen, stack = 0, [self.root]
        while stack:
            node = stack.pop()
            seen += 1
            stack.extend(node.kids)
        return seen


def applied(state: int, edits: str, row: tuple) -> Iterator[tuple[str, str | None, str | None, tuple | None]]:
    """(edit, role, text, row) of each edit; a deleted row has no role and text. row: (turn, role, text, ...)."""
    for e in edits:
        if e == "D":
            yield e, None, None, row
        elif e == "K":
            yield e, row[1], row[2], row
            state = SYSTEM if row[1][:1] == "s" else NEXT[state]
        else:
            state = NEXT[state]
            yield (e, ROLE[state], "", None) if e == "I" else (e, ROLE[state], row[2], row)


def marked(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """(conv, turn, role, text, absent, fault), each conversation in one partition and in order.

    Order is by turn (nulls first), role and text. One shuffle by conversation: earlier equal
    rows are found in the same partitions.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), (F.coalesce(F.col(absent_col), F.lit(False)) if absent_col else F.lit(False)).alias("absent"),
    ).repartition("conv")
    same = Window.partitionBy("conv", "absent", F.xxhash64("role", "text"), F.xxhash64(F.lit("again"), "text", "role")).orderBy(F.asc_nulls_first("turn"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn(
        "fault", F.when(bare == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    )
    return rows.select("conv", "turn", "role", "text", "absent", "fault").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable, row: Callable, end: Callable) -> Iterator:
    """Call begin(conv), row(turn, role, text, fault) of present rows and end(), and yield what end and row have to hand on."""
    now, any_yet = None, False
    for b in batches:
        for conv, turn, role, text, absent, fault in zip(*(c.to_pylist() for c in b.columns)):
            if not any_yet or conv != now:
                if any_yet:
                    yield from end()
                now, any_yet = conv, True
                begin(conv)
            if not absent:
                yield from row(turn, role, text, fault)
    if any_yet:
        yield from end()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _key_type(conversations: DataFrame, conv_col: str) -> StructField:
    return StructField(conv_col, conversations.schema[conv_col].dataType)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """The edits of every conversation in order: conv_col, step, edit (K, R, D or I), turn, old_role, role, text, fault.

    Repaired conversations are the rows whose edit isn't D, by step; inserted rows have no turn,
    deleted ones no role and text. Null roles and texts are one space, rows with a null conversation
    are one conversation of that key; rows where absent_col is true are skipped. Other columns are ignored, an empty
    table has no edits. A conversation is read by one task, in order, as its repair and digest
    are sequential; memory is bounded by its unresolved edits.
    """
    out = StructType([_key_type(conversations, conv_col), *[StructField(n, LongType() if n in ("step", "turn") else StringType()) for n in ("step", "edit", "turn", "old_role", "role", "text", "fault")]])
    arrow = to_arrow_schema(out)

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}

        def emit(state, labels, row):
            for e, role, text, r in applied(state, labels, row):
                at["out"].append((at["conv"], at["step"], e, r[0] if r else None, r[1] if r else None, role, text, r[3] if r else ""))
                at["step"] += 1

        def begin(conv):
            at.update(conv=conv, step=0, out=[], search=Search(emit))

        def flush():
            done, at["out"] = at["out"], []
            return done

        def row(turn, role, text, fault):
            at["search"].step(role[:1], fault, (turn, role, text, fault))
            return flush()

        def end():
            at["search"].end()
            return flush()

        return _batches(_conversations(batches, begin, row, end), arrow)

    return marked(conversations, conv_col, turn_col, role_col, text_col, absent_col).mapInArrow(edits, out)


def audit(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (its edits in order) and repaired_sha256.

    gaps are the turns missing between the least and the greatest; the three faults count rows by the first
    that holds (a duplicate equals an earlier row in role and text); illegal counts neighbours whose role initials
    aren't su, ua or au. The digest is of the repaired `role:text` joined by newlines. Conversations
    of which all rows are absent have zeros, an empty audit and the digest of the empty string. Nulls as in `repair`.
    """
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = StructType([_key_type(conversations, conv_col), *[StructField(n, LongType()) for n in names], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    arrow = to_arrow_schema(out)

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict = {}

        def emit(state, labels, row):
            at["audit"].append(labels)
            for e, role, text, _ in applied(state, labels, row):
                if e != "D":
                    at["digest"].update(f"{at['glue']}{role}:{text}".encode("utf-8", "surrogatepass"))
                    at["glue"] = "\n"

        def begin(conv):
            at.update(conv=conv, audit=[], digest=hashlib.sha256(), glue="", search=Search(emit), least=None, last=None, turns=0, role=None, illegal=0, blank=0, duplicate=0, truncated=0)

        def row(turn, role, text, fault):
            if turn is not None and turn != at["last"]:
                at["least"], at["last"], at["turns"] = turn if at["least"] is None else at["least"], turn, at["turns"] + 1
            if at["role"] is not None:
                at["illegal"] += at["role"] + role[:1] not in LEGAL
            at["role"] = role[:1]
            if fault:
                at[fault] += 1
            at["search"].step(role[:1], fault, (turn, role, text))
            return ()

        def end():
            cost = at["search"].end()
            gaps = at["last"] - at["least"] + 1 - at["turns"] if at["turns"] else 0
            yield at["conv"], gaps, at["blank"], at["duplicate"], at["truncated"], at["illegal"], cost, "".join(at["audit"]), at["digest"].hexdigest()

        return _batches(_conversations(batches, begin, row, end), arrow)

    return marked(conversations, conv_col, turn_col, role_col, text_col, absent_col).mapInArrow(audits, out)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(`conv_id:turn`) % 20 (nulls: one space): 0 marks it absent, 1 empties its text, 2 removes . ! ?, 3 repeats it, 4 makes its role user."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind)
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("absent"), F.col("kind"),
    )
    return rows.select("conv_id", "turn", "role", "text", "absent", F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damaged(table(spark, sf_dir, "conversations")), absent_col="absent")


#: crc32 bit by bit; then a recursion over the rows of a conversation that keeps the best edits of each state as whole strings.
ORACLE = r"""
with recursive
named as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
crc as (
  select name, 0 as step, 4294967295::bigint as c from (select distinct name from named)
  union all
  select name, step + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end from (
    select name, step, case when step % 8 = 0 then xor(c, ascii(substr(name, step // 8 + 1, 1))::bigint) else c end as x
    from crc where step < 8 * length(name))),
kinds as (
  select name, xor(c, 4294967295::bigint) % 20 as kind from crc where step = 8 * length(name)),
damage as (
  select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
    case kind when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
    unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as copy
  from named join kinds using (name)),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as rn,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from damage),
r as (
  select *, left(role, 1) as ini, lag(left(role, 1)) over (partition by conv_id order by rn) as prior,
    case when bare = '' then 'blank' when nth > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from ordered),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where prior is not null and prior || ini not in ('su', 'ua', 'au')) as illegal, max(rn) as n
  from r group by conv_id),
ins(q, p, w, i, o) as (values
  ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('0', 'u', 3, 'I', 'user:' || chr(10)), ('s', 'u', 3, 'I', 'user:' || chr(10)), ('a', 'u', 3, 'I', 'user:' || chr(10)), ('u', 'a', 3, 'I', 'assistant:' || chr(10)),
  ('0', 'a', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 'a', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))),
steps as (
  select conv_id, 0::bigint as rn, '0' as q, 0::bigint as c, '' as a, '' as t from counts
  union all
  select conv_id, rn, q, c, a, t from (
    select *, row_number() over (partition by conv_id, q order by c, a) as best from (
      select s.conv_id, r.rn, e.q, s.c + ins.w + e.w as c, s.a || ins.i || e.e as a, s.t || ins.o || e.o as t
      from steps s join r on r.conv_id is not distinct from s.conv_id and r.rn = s.rn + 1
      join ins on ins.q = s.q
      cross join lateral (
        select ins.p as q, 4 as w, 'D' as e, '' as o
        union all
        select r.ini, case when r.fault = 'truncated' then 3 else 0 end, 'K', r.role || ':' || r.text || chr(10)
        where r.fault in ('', 'truncated') and ins.p || r.ini in ('0s', '0u', 'su', 'ua', 'au')
        union all
        select case ins.p when 'u' then 'a' else 'u' end, 3 + case when r.fault = 'truncated' then 3 else 0 end, 'R',
          case ins.p when 'u' then 'assistant' else 'user' end || ':' || r.text || chr(10)
        where r.fault in ('', 'truncated')) e)) where best = 1),
done as (
  select s.conv_id, s.c + ins.w as c, s.a || ins.i as a, s.t || ins.o as t,
    row_number() over (partition by s.conv_id order by s.c + ins.w, s.a || ins.i) as best
  from steps s join counts k on k.conv_id is not distinct from s.conv_id and k.n = s.rn join ins on ins.q = s.q
  where ins.p in ('0', 'a'))
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(d.c, 0)::bigint as cost, coalesce(d.a, '') as audit,
  sha256(coalesce(left(d.t, length(d.t) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts k on k.conv_id is not distinct from o.conv_id
left join done d on d.conv_id is not distinct from o.conv_id and d.best = 1
"""

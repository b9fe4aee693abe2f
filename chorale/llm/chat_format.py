"""Chat formatting: the cheapest repair of roles over an automaton of legal turns, then rendering.

A legal conversation is an optional system turn and then user and assistant by turns, an assistant's last. A turn may be kept,
merged into the message before it, relabelled, or have an empty message of the other role inserted before it; each change has a
cost, and dynamic programming over the automaton's states finds the cheapest sequence. On ties the state of the lower number wins.

A turn acts on the states as a matrix of costs, and such matrices combine by minimum and sum in any grouping. So conversations
are cut into chunks of CHUNK turn numbers, each chunk's matrix is made on its own, the few matrices of a conversation give each
chunk the states it is entered and left in, and chunks are then traced back independently: a conversation with most of all rows
is spread over as many tasks as it has chunks. The result has a row for each turn with its piece of the rendering; pieces in
order of turn make up the conversation, so no row grows with a conversation's length.

Defined results: turns are in order of turn (null last), role and text; null text is empty; role is matched in any case and by
usual synonyms, an unknown or null one costs a relabelling; a row without conv_id is a conversation of its own; a row that is
repeated is a turn each time. In texts "<|im_" is rendered as "<| im_", so no text can forge a turn. conv_id and turn may be of any
integer type, conv_id a string as well. Extra columns are ignored, whatever their names. Turns of a conversation that agree in
their number, or have none, are one chunk, so their number bounds a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


MERGE, INSERT, RELABEL = 1, 2, 3
CHUNK = 4096
ROLES = ("start", "system", "user", "assistant")  # states are the role of the last message
SYNONYMS = {"system": 1, "developer": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "bot": 3, "gpt": 3, "model": 3, "ai": 3}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60
#: What begins a mark, and what stands for it in texts, so that none of them forges a turn.
ESCAPED = ("<|im_", "<| im_")
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def step(state: int, to: int) -> tuple[int, list[int], bool] | None:
    """Cost, inserted roles and whether it merges, for a message of role `to` after state, whatever its label was."""
    if to == START or to == SYSTEM and state > SYSTEM:
        return None
    if to == state:
        return MERGE, [], True
    if to == ASSISTANT and state < USER:
        return INSERT, [USER], False
    return 0, [], False


def turn_matrix(role: int) -> list[list[int]]:
    """Costs from each state to each, for a turn of this role (0: unknown)."""
    return [[(s[0] + (RELABEL if b != role else 0)) if (s := step(a, b)) else FAR for b in STATES] for a in STATES]


MATRICES = [turn_matrix(r) for r in STATES]
#: Costs and inserted roles that end a conversation.
ENDING: dict[int, tuple[int, list[int]]] = {START: (0, []), SYSTEM: (2 * INSERT, [USER, ASSISTANT]), USER: (INSERT, [ASSISTANT]), ASSISTANT: (0, [])}


def product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(min(a[i][k] + b[k][j] for k in STATES), FAR) for j in STATES] for i in STATES]


def trace(roles: list[int], entry: int, leave: int | None) -> list[int]:
    """The state after each turn on a cheapest way from entry to leave (None: to the end of the conversation)."""
    cost = [0 if s == entry else FAR for s in STATES]
    back = []
    for r in roles:
        m = MATRICES[r]
        came = [min(STATES, key=lambda a: (cost[a] + m[a][b], a)) for b in STATES]
        cost = [min(cost[a] + m[a][b], FAR) for b, a in enumerate(came)]
        back.append(came)
    at = min(STATES, key=lambda s: (cost[s] + ENDING[s][0], s)) if leave is None else leave
    out = []
    for came in reversed(back):
        out.append(at)
        at = came[at]
    return out[::-1]


def rendered(roles: list[int], states: list[int], texts: list[str], entry: int, ends: bool) -> Iterator[tuple[str, str, str, int, str]]:
    """For each turn its new role, action, inserted roles (before, after), cost and piece of the rendering."""
    state = entry
    for k, (role, to, text) in enumerate(zip(roles, states, texts)):
        cost, inserted, merges = step(state, to)
        action = "+".join(a for a, done in (("relabel", to != role), ("merge", merges), ("insert", inserted)) if done) or "keep"
        piece = JOIN if merges else (CLOSE if state != START else "") + "".join(OPEN.format(ROLES[i]) + CLOSE for i in inserted) + OPEN.format(ROLES[to])
        piece += text
        cost += RELABEL if to != role else 0
        if ends and k == len(roles) - 1:
            more, last = ENDING[to]
            cost += more
            piece += CLOSE + "".join(OPEN.format(ROLES[i]) + CLOSE for i in last)
            action += "+end" if last else ""
            inserted = inserted + last
        yield ROLES[to], action, ",".join(ROLES[i] for i in inserted), cost, piece
        state = to


def role_number(role: str | None) -> int:
    return SYNONYMS.get((role or "").strip().lower(), 0)


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first width columns; a row whose first column is null is a run of its own."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[:width] != held[0][:width] or row[0] is None):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def format_chat(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each row of df: conv_id, turn, role, new_role, action, inserted, cost, rendered."""
    conv, turn = df.schema["conv_id"].dataType.simpleString(), df.schema["turn"].dataType.simpleString()
    lost = F.col("conv_id").isNull()
    # null turns are last
    number = F.coalesce(F.floor(F.col("turn") / chunk).cast("long"), F.lit((1 << 62)))
    rows = df.select("conv_id", number.alias("chunk"), "turn", "role", "text")

    def pack(pairs: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*pairs), kinds)] if pairs else [pa.array([], k) for k in kinds], names=names)

    id_kind = {k: to_arrow_type(df.schema[c].dataType) for k, c in ((conv, "conv_id"), (turn, "turn"))}
    flat = pa.list_(pa.int64())

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for rows in groups(batches, 2):
            m = MATRICES[role_number(rows[0][3])]
            for r in rows[1:]:
                m = product(m, MATRICES[role_number(r[3])])
            found.append((rows[0][0], rows[0][1], sum(m, [])))
            if len(found) >= 4096:
                yield pack(found, ["conv_id", "chunk", "m"], [id_kind[conv], pa.int64(), flat])
                found = []
        yield pack(found, ["conv_id", "chunk", "m"], [id_kind[conv], pa.int64(), flat])

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The states in which each chunk of a conversation is entered and left."""
        found = []
        for rows in groups(batches, 1):
            costs = [[0, FAR, FAR, FAR]]
            ms = [[r[2][4 * i : 4 * i + 4] for i in STATES] for r in rows]
            for m in ms:
                costs.append([min(min(costs[-1][a] + m[a][b] for a in STATES), FAR) for b in STATES])
            leave = min(STATES, key=lambda s: (costs[-1][s] + ENDING[s][0], s))
            for k in range(len(rows) - 1, -1, -1):
                entry = min(STATES, key=lambda a: (costs[k][a] + ms[k][a][leave], a))
                found.append((rows[k][0], rows[k][1], entry, leave, k == len(rows) - 1))
                leave = entry
            if len(found) >= 4096:
                yield pack(found, ["conv_id", "chunk", "entry", "leave", "ends"], [id_kind[conv], pa.int64(), pa.int32(), pa.int32(), pa.bool_()])
                found = []
        yield pack(found, ["conv_id", "chunk", "entry", "leave", "ends"], [id_kind[conv], pa.int64(), pa.int32(), pa.int32(), pa.bool_()])

    names = ["conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"]
    kinds = [id_kind[conv], id_kind[turn], pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for rows in groups(batches, 2):
            # without conv_id each row is a conversation, from the start to an end
            for part in [[r] for r in rows] if rows[0][0] is None else [rows]:
                entry, leave, ends = (START, None, True) if part[0][0] is None else part[0][5:8]
                roles, texts = [role_number(r[3]) for r in part], [(r[4] or "").replace(*ESCAPED) for r in part]
                states = trace(roles, entry, leave)
                for r, told in zip(part, rendered(roles, states, texts, entry, ends)):
                    found.append((r[0], r[2], r[3], *told))
                    size += len(told[-1])
                    if size > 4 << 20 or len(found) >= 4096:
                        yield pack(found, names, kinds)
                        found, size = [], 0
        yield pack(found, names, kinds)

    told_schema = f"conv_id {conv}, turn {turn}, role string, new_role string, action string, inserted string, cost long, rendered string"
    dealt = rows.where(~lost).repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", F.col("turn").asc_nulls_last(), "role", "text")
    made = dealt.select("conv_id", "chunk", "turn", "role").mapInArrow(matrices, f"conv_id {conv}, chunk long, m array<long>")
    told = made.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(ways, f"conv_id {conv}, chunk long, entry int, leave int, ends boolean")
    known = told.select(F.col("conv_id").alias("t_conv"), F.col("chunk").alias("t_chunk"), "entry", "leave", "ends")
    every = rows.join(known, (F.col("conv_id") == F.col("t_conv")) & (F.col("chunk") == F.col("t_chunk")), "left")
    every = every.select("conv_id", "chunk", "turn", "role", "text", "entry", "leave", "ends")
    alone, every = every.where("conv_id is null").mapInArrow(repaired, told_schema), every.where("conv_id is not null")
    every = every.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", F.col("turn").asc_nulls_last(), "role", "text")
    return every.mapInArrow(repaired, told_schema).unionByName(alone)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = {
    # costs[1..4] are those of ending in each state; a conversation's turns are worked off side by side with all others'
    "op4_chat_format": """
        with recursive t as (
            select conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') as text, row_number() over (partition by conv_id order by turn nulls last, role nulls first, text nulls first) as i, count(*) over (partition by conv_id) as n,
                   case trim(lower(coalesce(role, ''))) when 'system' then 1 when 'developer' then 1 when 'user' then 2 when 'human' then 2 when 'prompter' then 2
                        when 'assistant' then 3 when 'bot' then 3 when 'gpt' then 3 when 'model' then 3 when 'ai' then 3 else 0 end as r
            from conversations),
        fwd(conv_id, i, c, came) as (
            select distinct conv_id, 0::bigint, [0, 1000000000, 1000000000, 1000000000]::bigint[], [0, 0, 0, 0]::bigint[] from t
            union all
            select conv_id, i, [1000000000, list_min(s) + 3 * (r <> 1)::int, list_min(u) + 3 * (r <> 2)::int, list_min(a) + 3 * (r <> 3)::int]::bigint[],
                   [0, list_position(s, list_min(s)) - 1, list_position(u, list_min(u)) - 1, list_position(a, list_min(a)) - 1]::bigint[]
            from (select t.conv_id, t.i, t.r, [c[1], c[2] + 1] as s, [c[1], c[2], c[3] + 1, c[4]] as u, [c[1] + 2, c[2] + 2, c[3], c[4] + 1] as a
                  from fwd join t on t.conv_id = fwd.conv_id and t.i = fwd.i + 1)),
        bwd(conv_id, i, state) as (
            select f.conv_id, f.i, list_position([c[1], c[2] + 4, c[3] + 2, c[4]], list_min([c[1], c[2] + 4, c[3] + 2, c[4]])) - 1
            from fwd f join (select conv_id, max(i) as n from fwd group by conv_id) m on f.conv_id = m.conv_id and f.i = m.n
            union all
            select b.conv_id, b.i - 1, f.came[b.state + 1] from bwd b join fwd f on f.conv_id = b.conv_id and f.i = b.i where b.i > 0),
        x as (select t.*, b.state as s, p.state as was, ['start', 'system', 'user', 'assistant'] as names, b.state = 3 and p.state < 2 as ins, t.i = n and b.state in (1, 2) as ends
              from t join bwd b on b.conv_id = t.conv_id and b.i = t.i join bwd p on p.conv_id = t.conv_id and p.i = t.i - 1)
        select conv_id, turn, role, names[s + 1] as new_role,
               coalesce(nullif(concat_ws('+', case when s <> r then 'relabel' end, case when s = was then 'merge' end, case when ins then 'insert' end), ''), 'keep') || case when ends then '+end' else '' end as action,
               concat_ws(',', case when ins then 'user' end, case when ends and s = 1 then 'user' end, case when ends then 'assistant' end) as inserted,
               (3 * (s <> r)::int + (s = was)::int + 2 * ins::int + case when ends then case s when 1 then 4 else 2 end else 0 end)::bigint as cost,
               case when s = was then chr(10) || chr(10) else case when was > 0 then '<|im_end|>' || chr(10) else '' end || case when ins then '<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) else '' end
                    || '<|im_start|>' || names[s + 1] || chr(10) end || text
               || case when i = n then '<|im_end|>' || chr(10) else '' end || case when ends and s = 1 then '<|im_start|>user' || chr(10) || '<|im_end|>' || chr(10) else '' end
               || case when ends then '<|im_start|>assistant' || chr(10) || '<|im_end|>' || chr(10) else '' end as rendered
        from x"""
}
QUERIES = {"op4_chat_format": op4_chat_format}

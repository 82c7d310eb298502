"""Chat formatting in budgeted windows (operator 1), DataFrame and SQL functions only.

Turns of a conversation, in order, are rendered one after another; prefix sums of their tokens choose
the windows: each takes new turns while the system turn, the repeated history and they stay within
``budget`` tokens, always whole turns. Every later window repeats the system turn (a leading turn of
role system) and as many of the turns before it as fit ``history`` tokens. The loss mask holds each
assistant text in the one window where it is new; what is repeated is context only.

    window = <s> turn...        turn = [INST]role[/INST]text</s>

Inside roles and texts each control string is written as the escape character and a letter, and the
escape character as itself and 0; read backwards that gives the text again, whatever it holds.

Null roles and texts are empty. Turns sort by turn, role, text, nulls first; repeated rows are turns of
their own. A turn over the budget is a window of its own, without history, longer than the budget. A
null conv_id is a conversation like any other. An empty table gives an empty result; other columns are
ignored. A conversation is one row of the result, hence of one task, as its formatted text is; a task needs
about ten times the bytes of its longest one, of whatever number and length of turns. Sums and windows are
built block by block of turns, as an array that grows one by one is copied each time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUDGET, HISTORY = 512, 128
ESCAPE = "␛"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Escapes in the order of writing; reading undoes them from the last.
PAIRS = ((ESCAPE, ESCAPE + "0"), *((c, ESCAPE + chr(97 + i)) for i, c in enumerate(CONTROLS)))
#: Tokens of a text: words or numbers, and every other visible character. Marks of a turn count OVERHEAD.
TOKEN, OVERHEAD = r"[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]", 4
#: Turns in a block.
BLOCK = 64


def escape(text: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), PAIRS, text)


def unescape(text: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[1]), F.lit(p[0])), reversed(PAIRS), text)


def _unescape_sql(x: str) -> str:
    return reduce(lambda s, p: f"replace({s}, '{p[1]}', '{p[0]}')", reversed(PAIRS), x)


def _settle(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, computed once a row: a generator of one row keeps the optimiser from writing an
    expression out again inside each of its uses."""
    return df.selectExpr(f"inline(array(struct({', '.join(columns)})))")


def _total(array: str, value: str, kind: str) -> str:
    return f"aggregate({array}, CAST(0 AS {kind}), (s, x) -> s + CAST({value} AS {kind}))"


def _block_sums(array: str, value: str, kind: str) -> str:
    """What ``value`` (of x) sums to before each block of a full array."""
    each = _total(f"slice({array}, b * {BLOCK} + 1, {BLOCK})", value, kind)
    return f"aggregate(sequence(0, CAST((size({array}) - 1) div {BLOCK} AS int)), array(CAST(0 AS {kind})), (a, b) -> array_append(a, element_at(a, -1) + {each}))"


def _sums(array: str, value: str, kind: str, blocks: str) -> str:
    """0 and the running sums of ``value`` over a full array, given those before its blocks."""
    own = _total(f"slice({array}, b * {BLOCK} + 1, k)", value, kind)
    within = f"transform(sequence(1, least({BLOCK}, size({array}) - b * {BLOCK})), k -> {blocks}[b] + {own})"
    return f"flatten(array(array(CAST(0 AS {kind})), flatten(transform(sequence(0, CAST((size({array}) - 1) div {BLOCK} AS int)), b -> {within}))))"


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, n_turns and windows: array of (formatted, repeated, loss).

    ``repeated`` counts the turns at a window's start that earlier windows have brought; ``loss`` is an
    array of (at, chars), 0-based places in ``formatted`` of the escaped texts to learn."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    rows = rows.select("conv_id", F.col("t.turn"), F.col("t.role"), escape(F.col("t.role")).alias("er"), escape(F.col("t.text")).alias("et"), (F.regexp_count(F.col("t.text"), F.lit(TOKEN.replace("\\\\", "\\"))) + OVERHEAD).cast("long").alias("tokens"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "et", "er", "tokens"))).alias("t"))
    chats = _settle(
        chats, "conv_id", "t", "size(t) AS n", "CASE WHEN t[0].role = 'system' THEN 1 ELSE 0 END AS sys",
        "transform(t, x -> concat('[INST]', x.er, '[/INST]', x.et, '</s>')) AS shown",
        _block_sums("t", "x.tokens", "bigint") + " AS token_blocks",
    )
    chats = _settle(
        chats, "conv_id", "t", "n", "sys", "shown", _sums("t", "x.tokens", "bigint", "token_blocks") + " AS pre",
        "transform(t, x -> length(x.er) + 13) AS head", _block_sums("shown", "length(x)", "int") + " AS shown_blocks",
    )
    chats = _settle(chats, "conv_id", "t", "n", "sys", "shown", "pre", "head", _sums("shown", "length(x)", "int", "shown_blocks") + " AS chars")
    # where the history of a window begins whose first new turn is i: the least k from which all fits, by halving
    room = f"greatest(0, least({history}, {budget} - pre[sys] - t[i].tokens))"
    middle = "(h.low + h.high) div 2"
    since = f"""CASE WHEN i <= sys THEN i ELSE aggregate(sequence(0, CAST(ceil(log2(i + 2)) AS int)), named_struct('low', sys, 'high', i),
        (h, _) -> CASE WHEN h.low >= h.high THEN h WHEN pre[i] - pre[CAST({middle} AS int)] <= {room} THEN named_struct('low', h.low, 'high', CAST({middle} AS int)) ELSE named_struct('low', CAST({middle} AS int) + 1, 'high', h.high) END, h -> h.high) END"""
    span, none = "struct<s: int, e: int, since: int>", "CAST(array() AS array<struct<s: int, e: int, since: int>>)"
    over = f"i > a.s AND pre[sys] + pre[i + 1] - pre[a.since] > {budget}"
    step = f"CASE WHEN {over} THEN named_struct('s', i, 'since', {since}, 'own', array_append(a.own, named_struct('s', a.s, 'e', i, 'since', a.since))) ELSE a END"
    inner = f"aggregate(sequence(greatest(sys, b * {BLOCK}), least(n, (b + 1) * {BLOCK}) - 1), named_struct('s', o.s, 'since', o.since, 'own', {none}), (a, i) -> {step})"
    outer = f"""aggregate(sequence(CAST(sys div {BLOCK} AS int), CAST((n - 1) div {BLOCK} AS int)), named_struct('s', sys, 'since', sys, 'out', CAST(array() AS array<array<{span}>>)),
        (o, b) -> element_at(transform(array({inner}), r -> named_struct('s', r.s, 'since', r.since, 'out', array_append(o.out, r.own))), 1),
        o -> array_append(flatten(o.out), named_struct('s', o.s, 'e', n, 'since', o.since)))"""
    chats = _settle(chats, "conv_id", "t", "n", "sys", "shown", "head", "chars", f"CASE WHEN n = sys THEN array(named_struct('s', sys, 'e', n, 'since', sys)) ELSE {outer} END AS spans")
    return chats.selectExpr(
        "conv_id", "CAST(n AS bigint) AS n_turns",
        """transform(spans, w -> named_struct(
            'formatted', concat('<s>', CASE WHEN sys = 1 THEN shown[0] ELSE '' END, array_join(slice(shown, w.since + 1, w.e - w.since), '')),
            'repeated', CASE WHEN w.s = sys THEN 0 ELSE sys + w.s - w.since END,
            'loss', CASE WHEN w.e > w.s THEN transform(filter(sequence(w.s, w.e - 1), j -> t[j].role = 'assistant'),
                j -> named_struct('at', 3 + chars[sys] + chars[j] - chars[w.since] + head[j], 'chars', length(t[j].et))) ELSE CAST(array() AS array<struct<at: int, chars: int>>) END)) AS windows""",
    )


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss (array of texts), from the formatted windows alone."""
    role, rest = "substring_index(substring(x, 7), '[/INST]', 1)", "substring(x, instr(x, '[/INST]') + 7)"
    new = "slice(split(substring(w.formatted, 4), '</s>'), w.repeated + 1, greatest(0, size(split(w.formatted, '</s>')) - 1 - w.repeated))"
    return chats.selectExpr(
        "conv_id", "n_turns",
        f"flatten(transform(windows, w -> transform({new}, x -> named_struct('role', {_unescape_sql(role)}, 'text', {_unescape_sql(rest)})))) AS turns",
        f"flatten(transform(windows, w -> transform(w.loss, l -> {_unescape_sql('substring(w.formatted, l.at + 1, l.chars)')}))) AS loss",
        "aggregate(windows, 0L, (a, w) -> a + length(w.formatted)) AS formatted_chars",
        "CAST(size(windows) AS bigint) AS n_windows",
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    back = read_back(format_chats(turns))
    return back.selectExpr(
        "conv_id", "CAST(size(turns) AS bigint) AS n_turns",
        r"sha2(array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), ''), 256) AS turns_sha256",
        "aggregate(loss, 0L, (a, x) -> a + length(x)) AS loss_chars",
        "sha2(array_join(loss, ''), 256) AS loss_sha256",
        "formatted_chars", "n_windows",
    )

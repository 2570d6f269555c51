"""Chat formatting with Spark expressions only, and the way back.

A conversation becomes blocks ``### role: text<then/>text</turn>\\n``: adjacent turns of one role
share a block. Inside texts and roles the characters that control strings are made of are escaped
(``\\`` as ``\\b``, ``#`` as ``\\h``, ``<`` as ``\\l``, in roles also ``:`` as ``\\c``), so no text
can imitate a mark and every text comes back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, NEXT, END = "### ", ": ", "<then/>", "</turn>\n"
_ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    # A backslash of an escaped text always begins a code; its own code is undone last.
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: id_col, formatted, loss_runs.

    Turns are ordered by (turn, role, text), so repeated turn numbers have a fixed order; null
    numbers come first, null roles and texts count as empty, a null id is a conversation of its
    own. ``loss_runs`` covers the formatted string with (learn, n_chars) runs: ``learn`` is true
    on the texts of ``trained_role`` alone, not on marks between them. An empty table gives no
    rows. Other columns are not read.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    told = turns.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")))).alias("turns"))
    # Each turn with the roles before and after it; blocks begin and end where these differ.
    near = F.expr("""zip_with(turns, zip_with(
        concat(array(cast(null as string)), slice(turns.role, 1, size(turns) - 1)),
        concat(slice(turns.role, 2, size(turns)), array(cast(null as string))),
        (p, q) -> struct(p as prev, q as next)), (t, n) -> struct(t.role as role, t.text as text, n.prev as prev, n.next as next))""")

    def pieces(t: Column) -> Column:
        opens, closes = ~t.role.eqNullSafe(t.prev), ~t.role.eqNullSafe(t.next)
        return F.struct(F.when(opens, F.concat(F.lit(HEAD), _role(t.role), F.lit(AFTER_ROLE))).otherwise(F.lit(NEXT)).alias("before"),
                        escape(t.text).alias("body"), F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("after"),
                        (t.role == trained_role).alias("learn"))

    parts = told.select(id_col, F.transform(near, pieces).alias("parts"))
    return parts.select(
        id_col,
        F.array_join(F.transform("parts", lambda p: F.concat(p.before, p.body, p.after)), "").alias("formatted"),
        F.filter(F.flatten(F.transform("parts", lambda p: F.array(
            F.struct(F.lit(False).alias("learn"), F.length(p.before).alias("n_chars")),
            F.struct(p.learn.alias("learn"), F.length(p.body).alias("n_chars")),
            F.struct(F.lit(False).alias("learn"), F.length(p.after).alias("n_chars"))))),
            lambda r: r.n_chars > 0).alias("loss_runs"))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.split(formatted, F.lit(END))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, AFTER_ROLE, 1)
        role = F.replace(F.substring(head, len(HEAD) + 1, 1 << 30), F.lit("\\c"), F.lit(":"))
        body = F.substring(block, F.length(head) + F.lit(len(AFTER_ROLE) + 1), F.lit(2**31 - 1))
        return F.transform(F.split(body, F.lit(NEXT)), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt_text(formatted: Column, loss_runs: Column) -> Column:
    """The text under the loss mask, as the turns had it."""
    under = F.aggregate(loss_runs, F.struct(F.lit(1).alias("at"), F.lit("").alias("text")), lambda a, r: F.struct(
        (a.at + r.n_chars).alias("at"), F.when(r.learn, F.concat(a.text, F.substring(formatted, a.at, r.n_chars))).otherwise(a.text).alias("text")), lambda a: a.text)
    return unescape(under)


def chat_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted strings and their loss masks hold when they are read back."""
    both = formatted.select(id_col, "formatted", parse_chat(F.col("formatted")).alias("t"), learnt_text(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    return both.select(
        id_col, F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))

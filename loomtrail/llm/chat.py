"""Chat formatting in Spark expressions only.

A conversation is a set of rows (conv_id, turn, role, text). Rows are collected as structs, sorted, adjacent
turns of one role are merged by array functions, and the parts are concatenated:

    <turn>ROLE\\n PART (<part/> PART)* </turn>\\n

Every `&` and `<` of a text becomes `&amp;` and `&lt;`, so a raw `<` occurs only in the template and unescaping
is exact. In a role a line feed becomes `&nl;` too.

Defined cases: a null text or role is the empty string; a null turn sorts first; ties of `turn` are ordered by role,
then text, and repeated rows are all kept; a null conv_id is one conversation; an empty table gives an empty
result; other columns are ignored. One conversation is one row, so it must fit in a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, PART, CLOSE = "<turn>", "<part/>", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def merge_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, merged array<struct<role, texts array<string>>>: sorted turns, adjacent ones of one role together."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = (
        conversations.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")))).alias("turns"))
        # arrays of their own: a field of an array of structs, taken within a lambda, would be built anew for each element
        .select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))
    )
    opens = F.transform("roles", lambda r, i: F.when((i > 0) & (r == F.get("roles", i - 1)), F.lit(-1)).otherwise(i))
    runs = turns.select("conv_id", "roles", "texts", F.array_remove(opens, F.lit(-1)).alias("first"))
    end = lambda k: F.coalesce(F.get("first", k + 1), F.size("roles"))
    return runs.select(
        "conv_id",
        F.transform("first", lambda i, k: F.struct(F.get("roles", i).alias("role"), F.slice("texts", i + 1, end(k) - i).alias("texts"))).alias("merged"),
    )


def format_chat(conversations: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """conv_id, formatted string, segments array<struct<text, loss>>.

    The segments in order make up `formatted`; those with loss=true are under the loss mask: each text of
    `loss_role`, escaped, without any template string.
    """
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    plain = F.lit(False)

    def block(m: Column) -> Column:
        lead = F.concat(F.lit(OPEN + ""), _escape_role(m["role"]), F.lit("\n"))
        inner = F.transform(
            m["texts"],
            lambda t, i: F.array(segment(F.when(i == 0, lead).otherwise(F.lit(PART)), plain), segment(escape(t), m["role"] == loss_role)),
        )
        return F.concat(F.flatten(inner), F.array(segment(F.lit(CLOSE), plain)))

    return (
        merge_turns(conversations)
        .select("conv_id", F.flatten(F.transform("merged", block)).alias("segments"))
        .select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")
    )


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that `format_chat` was given, read back from its string."""
    body = lambda b: F.substring_index(b, OPEN, -1)
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b.startswith(OPEN))
    role = lambda b: F.substring_index(body(b), "\n", 1)
    rest = lambda b: F.substring(body(b), F.length(role(b)) + 2, F.length(b))
    heads = F.transform(blocks, lambda b: F.struct(_unescape_role(role(b)).alias("role"), F.split(rest(b), PART, -1).alias("texts")))
    return F.flatten(F.transform(heads, lambda h: F.transform(h["texts"], lambda t: F.struct(h["role"].alias("role"), unescape(t).alias("text")))))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back from `format_chat`'s output."""
    read = formatted.select("conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"), unescape(F.array_join(F.filter("segments", lambda s: s["loss"])["text"], "")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

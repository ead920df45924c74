"""Chat histories as arrays of (role, content), and the prompt made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import stripped_or_empty
from siftwork.operators.timeline import rows_before

# Turns that are kept, sent and put into a prompt, and the prompt's texts.
KEPT_TURNS, SENT_TURNS, PROMPT_TURNS = 16, 8, 8
SYSTEM = "你是電腦組裝顧問，所有回覆一律使用繁體中文。"
HISTORY = "以下是先前對話紀錄（舊→新，最多8則）："
MESSAGE = "現在的使用者訊息："
CLOSING = "請在理解脈絡後以繁體中文回答。"
USER_LABEL, OTHER_LABEL, AFTER_LABEL = "使用者", "AI", "："


def last_turns(history: Column, most: int) -> Column:
    """The last so many items, all of a shorter array; a null history is empty."""
    h = F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))
    return F.slice(h, F.greatest(F.size(h) - (most - 1), F.lit(1)), F.lit(most))


def is_role(role: Column) -> Column:
    return F.coalesce(role.isin("user", "ai"), F.lit(False))


def prompt(message: Column, history: Column) -> Column:
    """The whole prompt: instruction, the last turns with their labels, the new message, closing instruction."""

    def line(turn: Column) -> Column:
        label = F.when(turn["role"] == "user", USER_LABEL).otherwise(OTHER_LABEL)
        return F.concat(label, F.lit(AFTER_LABEL), F.coalesce(turn["content"], F.lit("")))

    turns = F.array_join(F.transform(last_turns(history, PROMPT_TURNS), line), "\n")
    return F.concat(F.lit(f"{SYSTEM}\n\n{HISTORY}\n"), turns, F.lit(f"\n\n{MESSAGE}"), F.coalesce(message, F.lit("")), F.lit(f"\n{CLOSING}"))


def reply(text: Column) -> Column:
    """A model's answer, null to empty, without white space around it."""
    return stripped_or_empty(text)


def addresses(recipients: Column) -> Column:
    """The addresses of recipients (array of email, name); null for none."""
    return F.when(F.size(F.coalesce(recipients, F.array().cast("array<struct<email:string,name:string>>"))) > 0, F.transform(recipients, lambda r: r["email"]))


def prompts(turns: DataFrame, slot_turns: int = 1024) -> DataFrame:
    """conv_id, turn, prompt for each user turn of turns (conv_id, turn, role, content): the prompt of its call, made of the turns before it.

    Turns alike in number are in order of role and content. A very long conversation is spread over slots of turn numbers.
    """
    rows = turns.select("conv_id", "turn", "role", "content", F.struct("role", "content").alias("said"))
    past = rows_before(rows, ["conv_id"], "turn", "said", PROMPT_TURNS, "past", F.floor(F.col("turn") / slot_turns))
    history = F.transform("past", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    return past.where("role = 'user'").select("conv_id", "turn", prompt(F.col("content"), history).alias("prompt"))

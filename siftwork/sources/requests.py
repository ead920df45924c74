"""Typed request records from JSON bodies, with their rules declared in one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import length_between, stripped


@dataclass(frozen=True)
class Field:
    """strip: white space at the ends goes before the length counts. No lengths: any text."""

    required: bool = True
    strip: bool = False
    least: int | None = None
    most: int | None = None


_NAME, _PASSWORD = Field(strip=True, least=3, most=50), Field(least=8, most=128)

# The fields of each request and their bounds.
RECORDS: dict[str, dict[str, Field]] = {
    "register": {"email": _NAME, "username": _NAME, "password": _PASSWORD},
    "login": {"email": _NAME, "password": _PASSWORD},
    "resend_verification": {"email": Field(required=False)},
    "forgot_password": {"email": Field()},
    "reset_password": {"token": Field(strip=True, least=5, most=512), "password": _PASSWORD},
}


def parsed(bodies: DataFrame, record: str, column: str = "body") -> DataFrame:
    """Adds the record's fields and faulty, the names of those missing or out of bounds, in order.

    A body that is no JSON object, or null, lacks every field. Fields are stripped where the record says so.
    """
    fields = RECORDS[record]
    read = F.from_json(F.col(column), ", ".join(f"{name} string" for name in fields))
    values = {name: stripped(read[name]) if f.strip else read[name] for name, f in fields.items()}
    wrong = []
    for name, f in fields.items():
        bad = values[name].isNull() if f.least is None else ~length_between(values[name], f.least, f.most)
        wrong.append(F.when(bad if f.required else F.lit(False), F.lit(name)))
    return bodies.withColumns({**values, "faulty": F.array_compact(F.array(*wrong))})

"""Explicit schemas of the content files."""

from __future__ import annotations

from pyspark.sql import types as T

#: Field names and defaults of the content files, as they are spelled there. Fixed values.
DEFAULT_SOURCE, DEFAULT_CHECKED, DEFAULT_KIT = "curated", "2026-11-06", 40
PHRASE = {"id": None, "lang": None, "theme": None, "english": None, "romanization": None, "youSay": None, "soundTip": None, "note": None, "source": DEFAULT_SOURCE, "checked": DEFAULT_CHECKED}
LANGUAGE = {"code": None, "name": None, "status": None, "kitTotal": DEFAULT_KIT}
SOUND = {"lang": None, "newSounds": None, "rhythm": None, "registerFirst": None, "trap": None}
NUMBER = {"value": None, "word": None, "youSay": None, "note": "", "source": DEFAULT_SOURCE, "checked": DEFAULT_CHECKED}
INTEGERS = ("theme", "kitTotal")

LOG = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("theme", T.IntegerType()), T.StructField("item_id", T.StringType()), T.StructField("payload", T.StringType())]
)


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)

"""Text functions on columns: tokens, content words, turn texts, parsed numbers, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content.
STOP_WORDS = """the a an and or of to in for on with is are was were be been being this
that it as at by from into your you i we they he she their our my me us them
please can could would should will shall do does did have has had not no if
then than so but about after before all any""".split()
# Words that a lexical sensor reacts to, and its tokens.
KEYWORDS = ["ejecuta", "borra", "transfiere", "firma", "pago", "desplaza", "dinero", "ip"]
TOKEN = "[a-záéíóúñ]+"


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Runs between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def content_words(text: Column) -> Column:
    """Distinct lower-case words of over two letters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def lexical_score(text: Column) -> Column:
    """0.8 where a keyword is a token; else words / 80, between 0.3 and 0.34."""
    hit = F.arrays_overlap(tokenize(text), F.array(*map(F.lit, KEYWORDS)))
    return F.when(hit, F.lit(0.8)).otherwise(F.greatest(F.lit(0.3), F.least(word_count(F.lower(text)) / F.lit(80.0), F.lit(0.34))))


def sha_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 24)


def first_present(*columns: Column, default: str | None = None) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(default))


def tagged_turn(turn: Column) -> Column:
    """An agent's thought and action with tags, a line each; its content if it has neither."""
    thought = F.when(F.length(turn["thought"]) > 0, F.concat(F.lit("[THOUGHT] "), turn["thought"]))
    action = F.when(F.length(turn["action"]) > 0, F.concat(F.lit("[ACTION] "), turn["action"]))
    both = F.concat_ws("\n", thought, action)
    return F.when((turn["role"] == "agent") & (both != ""), both).otherwise(F.coalesce(turn["content"], F.lit("")))


def plain_turn(turn: Column) -> Column:
    """An agent's thought and action without tags, between them a space; else the content."""
    empty = F.lit("")
    return F.when(turn["role"] == "agent", F.concat(F.coalesce(turn["thought"], empty), F.lit(" "), F.coalesce(turn["action"], empty))).otherwise(F.coalesce(turn["content"], empty))


def mapped_role(role: Column) -> Column:
    return F.when(role == "user", "user").when(role == "agent", "assistant").when(role == "environment", "tool").otherwise(role)


def joined_user_turns(turns: Column) -> Column:
    """Contents of all turns but the assistant's, between them a space."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] != "assistant"), lambda t: t["content"]), " ")


def parse_risk(reply: Column) -> Column:
    """The first number of a model's reply, 0 to 1; 0.5 without one."""
    number = F.regexp_extract(reply, r"(\d?\.\d+|\d)", 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number.try_cast("double"), F.lit(0.5))))


def guard_verdict(reply: Column) -> Column:
    """1 for a guard model's reply that starts with `unsafe`, else 0."""
    return F.when(F.startswith(F.lower(F.trim(reply)), F.lit("unsafe")), 1.0).otherwise(0.0)


def parsed_output(raw: Column, name: str, kind: str = "double") -> Column:
    """The number after name= in a result's text; -1 for a missing turn (int), 0 for other values."""
    found = F.regexp_extract(raw, rf"{name}=(-?\d+(?:\.\d+)?)", 1).try_cast(kind)
    return F.coalesce(found, F.lit(-1 if kind == "int" else 0.0).cast(kind))

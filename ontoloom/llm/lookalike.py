"""Visually identical texts in one form.

1. *Plain forms.* Characters that differ in width, weight, ligatures, blanks and
   invisible characters alone are replaced by their plain ones; marks are put in
   canonical order.
2. *Script sets.* Each letter has the set of scripts in which a letter of its look
   exists: its own, and those of its confusables. The confusables are the public
   ones of Unicode, as Spark's ICU library holds them, of letters that look like
   one ASCII letter.
3. *Intersection.* The sets of a token's letters are intersected. Letters of more
   than one script make a mixed-script token; a token of one script that could as
   well be spelt in another is a whole-script confusable.
4. *Consistent spelling.* A token is spelt in one script of the intersection: the
   text's main script if that is among them (the one with most letters in tokens
   that have no other), else Latin, else the first by name. Where nothing is common,
   every letter that has a Latin look-alike is written with it.
5. Marks are composed again.

The choice depends on the looks alone, so texts that look the same get equal
forms. Letter case, accents, wording, line breaks and runs of several blanks are
kept, and two ASCII characters never become one (a CR before an LF is no
character of its own). Fraktur, script and double-struck letters, fractions and
Latin letters below U+0250 do not look like plain letters. Rows without a doc_id
are no documents. Null texts have no form, empty texts the empty form; texts
without a visible character are in no pair."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

# Look-alikes to which the public table gives another letter, or none.
OWN_PAIRS = {"І": "I", "ӏ": "l", "Ι": "I", "ɑ": "a", "ɡ": "g"}
# Invisible characters as ranges, and hyphens that look like the plain one.
INVISIBLE = "00ad 034f 061c 115f-1160 17b4-17b5 180b-180e 200b-200f 202a-202e 2060-2064 2066-206f fe00-fe0f feff fff9-fffb e0001-e007f e0100-e01ef 0000-0008 000e-001f 007f-0084 0086-009f"
HYPHENS = "‐‑"
# Alphabets whose letters do not look like plain ones.
ORNATE = ("FRAKTUR", "SCRIPT", "DOUBLE-STRUCK", "BLACK-LETTER")


def _plain() -> dict[int, str | None]:
    """Characters to replace before decomposition, found by rule: wide, narrow, bold
    and non-breaking forms, Latin ligatures, Roman numerals, blanks, invisibles."""
    table: dict[int, str | None] = {}
    for code in range(0x20000):
        c = chr(code)
        tag = unicodedata.decomposition(c).split(" ")[0]
        if tag in ("<wide>", "<narrow>", "<noBreak>") or tag == "<compat>" and (0xFB00 <= code <= 0xFB06 or 0x2160 <= code <= 0x217F or 0x1C4 <= code <= 0x1CC):
            table[code] = unicodedata.normalize("NFKC", c)
        if tag == "<font>" and code >= 0x1D400 and not any(word in unicodedata.name(c) for word in ORNATE):
            table[code] = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Zs" and c != " ":
            table[code] = " "
    for part in INVISIBLE.split():
        low, _, high = part.partition("-")
        table |= dict.fromkeys(range(int(low, 16), int(high or low, 16) + 1))
    return table | dict.fromkeys(map(ord, HYPHENS), "-")


PLAIN = _plain()
PLAIN_CHARS = frozenset(map(chr, PLAIN))
ANY_PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(PLAIN)) + "]+")
#: Letters from here on may be look-alikes.
FOREIGN = re.compile("[ɐ-ʯͰ-῿Ⰰ-\U0003ffff]")
TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
ASCII_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


@lru_cache(maxsize=100_000)
def script(c: str) -> str:
    """A letter's script: the first word of its name."""
    return unicodedata.name(c, "UNKNOWN").split(" ")[0]


def confusables(spark: SparkSession) -> dict[str, str]:
    """The ASCII letter that each letter of another script looks like: letters of
    which Unicode's public table makes one ASCII letter, one of a script for each.
    The table is read in one call; it has a fixed size."""
    letters = [chr(c) for c in range(0x250, 0x1F000) if not 0xD800 <= c < 0xE000 and c not in PLAIN and unicodedata.category(chr(c)).startswith("L")]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    looks = checker.getSkeleton(0, "\n".join(letters)).split("\n")
    found, taken = dict(OWN_PAIRS), {(script(c), look) for c, look in OWN_PAIRS.items()}
    for c, look in zip(letters, looks):
        if look == "l" and unicodedata.category(c) == "Lu":
            look = "I"
        if len(look) == 1 and look.isascii() and look.isalpha() and (script(c), look) not in taken and not any(word in unicodedata.name(c) for word in ORNATE):
            found.setdefault(c, look)
            taken.add((script(c), look))
    return found


class Spelling:
    """The consistent spelling of texts, by a table of confusables."""

    def __init__(self, alike: dict[str, str]) -> None:
        self.alike = alike
        self.back: dict[str, dict[str, str]] = {}
        for c, look in alike.items():
            self.back.setdefault(script(c), {}).setdefault(look, c)
        self.back.pop("LATIN", None)
        self.sets: dict[str, frozenset] = {}
        self.spelt: dict[tuple, str] = {}

    def scripts(self, c: str) -> frozenset:
        """The scripts in which a letter of this look exists; marks go with all."""
        if c not in self.sets:
            look = self.alike.get(c, c)
            if not look.isascii():
                self.sets[c] = frozenset((script(c),))
            else:
                self.sets[c] = frozenset(("LATIN", *(s for s, held in self.back.items() if look in held)))
        return self.sets[c]

    @lru_cache(maxsize=200_000)  # noqa: B019
    def shared(self, token: str) -> frozenset:
        """The intersection of the letters' script sets."""
        sets = [self.scripts(c) for c in token if c.isalpha()]
        return frozenset.intersection(*sets) if sets else frozenset(("LATIN",))

    def main(self, text: str) -> str:
        votes: Counter = Counter()
        for token, n in Counter(TOKEN.findall(text)).items():
            held = self.shared(token)
            if len(held) == 1:
                votes[next(iter(held))] += n * len(token)
        return min(votes, key=lambda s: (-votes[s], s != "LATIN", s), default="LATIN")

    def spell(self, token: str, main: str) -> str:
        """A token in one script."""
        if (token, main) in self.spelt:
            return self.spelt[token, main]
        held = self.shared(token)
        chosen = main if main in held or not held else "LATIN" if "LATIN" in held else min(held)
        looks = [self.alike.get(c, c) for c in token]
        if held and chosen != "LATIN":
            back = self.back.get(chosen, {})
            looks = [back.get(x, x) for x in looks]
        if len(self.spelt) > 200_000:
            self.spelt.clear()
        self.spelt[token, main] = "".join(looks)
        return self.spelt[token, main]

    def form(self, text: str | None) -> str | None:
        """The one form of a text."""
        if text is None:
            return None
        plain = decomposed(text)
        if plain.isascii():
            return plain
        if FOREIGN.search(plain):
            main = self.main(plain)
            plain = TOKEN.sub(lambda m: self.spell(m[0], main), plain)
        return unicodedata.normalize("NFC", plain)

    def report(self, text: str) -> tuple[str, int, int]:
        """(main script, mixed-script tokens, whole-script confusables): tokens with
        letters of several scripts, and tokens of one that is not the main script and
        could be spelt in that."""
        plain = decomposed(text)
        if not FOREIGN.search(plain):
            return "LATIN", 0, 0
        main, mixed, whole = self.main(plain), 0, 0
        for token in TOKEN.findall(plain):
            own = {script(c) for c in token if c.isalpha()}
            mixed += len(own) > 1
            whole += len(own) == 1 and main not in own and main in self.shared(token)
        return main, mixed, whole


def decomposed(text: str) -> str:
    """A text in plain characters, marks apart."""
    if text.isascii():
        return ASCII_CONTROL.sub("", text).replace("\r\n", "\n")
    if not PLAIN_CHARS.isdisjoint(text):
        text = ANY_PLAIN.sub(lambda m: m[0].translate(PLAIN), text)
    return unicodedata.normalize("NFD", text).replace("\r\n", "\n")


# ---------------------------------------------------------------- tables

def _texts(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")


def forms(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with every text in its one form."""
    alike = confusables(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Spelling(alike)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": pd.Series([own.form(t) for t in batch["text"]], dtype=object)})

    return _texts(documents).mapInPandas(run, "doc_id BIGINT, text STRING")


def script_report(documents: DataFrame) -> DataFrame:
    """(doc_id, main_script, mixed_tokens, whole_tokens) of the texts that are not null."""
    alike = confusables(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Spelling(alike)
        for batch in batches:
            rows = [(d, *own.report(t)) for d, t in zip(batch["doc_id"], batch["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", "main_script", "mixed_tokens", "whole_tokens"])

    return _texts(documents).where("text is not null").mapInPandas(run, "doc_id BIGINT, main_script STRING, mixed_tokens INT, whole_tokens INT")


def look_keys(documents: DataFrame) -> DataFrame:
    """(doc_id, form, exact): hashes of the form and the text of each document that
    has a visible character, each document once."""
    alike = confusables(documents.sparkSession)
    digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Spelling(alike)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                form = own.form(text)
                if form and not form.isspace():
                    rows.append((doc_id, digest(form), digest(text)))
            yield pd.DataFrame(rows, columns=["doc_id", "form", "exact"])

    valid = _texts(documents).where(F.length("text") > 0)
    return valid.mapInPandas(run, "doc_id BIGINT, form BINARY, exact BINARY").dropDuplicates(["doc_id"])


def same_look(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): documents whose texts differ but look the same.

    Only hashes are shuffled. Forms are first reduced to their distinct texts;
    only forms of two texts or more go on, so groups of exact copies never meet
    themselves. A group of copies that has a variant is a skewed key of a
    sort-merge join, which adaptive execution splits."""
    keys = written(look_keys(documents))
    shared = keys.groupBy("form", "exact").agg(F.count("*").alias("copies"))
    several = shared.groupBy("form").agg(F.count("*").alias("texts")).where(F.col("texts") > 1).select("form")
    variants = written(keys.join(several, "form"))
    texts = variants.select("form", "exact").distinct()
    meet = texts.toDF("form", "x").join(texts.toDF("form", "y"), "form").where(F.col("x") != F.col("y")).select("x", "y")
    one, two = variants.select(F.col("exact").alias("x"), F.col("doc_id").alias("doc_id_a")), variants.select(F.col("exact").alias("y"), F.col("doc_id").alias("doc_id_b"))
    return meet.join(one, "x").join(two, "y").where(F.col("doc_id_a") < F.col("doc_id_b")).select("doc_id_a", "doc_id_b")


def look_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, group_id, texts): one row a document that has a visible character, the
    smallest doc_id of its look, and the number of different texts of that look."""
    keys = written(look_keys(documents))
    texts = keys.groupBy("form", "exact").agg(F.min("doc_id").alias("first"))
    groups = texts.groupBy("form").agg(F.min("first").alias("group_id"), F.count("*").alias("texts"))
    return keys.join(groups, "form").select("doc_id", "group_id", "texts")

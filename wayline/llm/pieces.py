"""What the tokenising operators share: loading a vocabulary file and cutting texts into the pieces that are encoded one by one."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from typing import Generic, TypeVar

import regex
from pyspark.sql import SparkSession

#: Texts of these characters only (ASCII and the Latin letters up to U+024F, without rare controls and U+0130) are cut by `regex`,
#: where both libraries agree on letters, digits, blanks and lower case; all other texts are cut by the tokenizers library.
PLAIN = regex.compile(r"[\t-\r\x20-\x7E\xA0-įı-ɏ]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_SHOWN = dict(enumerate(byte_symbols()))


def in_symbols(piece: str) -> str:
    """A piece of text as the symbols of its UTF-8 bytes."""
    return piece.encode().decode("latin-1").translate(_SHOWN)


Key, Value = TypeVar("Key"), TypeVar("Value")


def plain_pattern(pattern: str) -> re.Pattern:
    """A vocabulary file's pattern for PLAIN texts, with the letters and numbers among their characters spelt out."""
    some = lambda kind: "".join(regex.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
    for kind in "LN":
        pattern = pattern.replace(rf"[\p{{{kind}}}]", rf"\p{{{kind}}}").replace(rf"\p{{{kind}}}", f"{{{kind}}}")
    out, inside = [], False
    for part in re.split(r"(\\.|[\[\]]|\{[LN]\})", pattern):
        inside = part == "[" or inside and part != "]"
        out.append((some(part[1]) if inside else f"[{some(part[1])}]") if part in ("{L}", "{N}") else part)
    return re.compile("".join(out))


class Remembered(Generic[Key, Value]):
    """What was made for keys, for those of them that keep coming: two generations of up to `most` keys, the older of which is dropped."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def of(self, keys: set[Key], make: Callable[[set[Key]], dict[Key, Value]]) -> dict[Key, Value]:
        """A mapping that holds at least the given keys; it is good until the next call."""
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        missing = keys.difference(self.young)
        if self.old:
            back = {k: self.old[k] for k in missing if k in self.old}
            self.young.update(back)
            missing.difference_update(back)
        self.young.update(make(missing))
        return self.young


def path(name: str) -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(file: str) -> str:
    """A vocabulary file's JSON: a few MB whatever the corpus, so it may be broadcast."""
    with open(file, encoding="utf-8") as f:
        return f.read()


def sent(spark: SparkSession, file: str):
    return spark.sparkContext.broadcast(text_of(file))


def library(json_text: str):
    """The tokenizers library on one thread, as Spark already runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json_text)
